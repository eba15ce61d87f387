"""Scalar expressions over flow and packet columns; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import WINDOW_SECONDS


def utc(text: Column) -> Column:
    """A time without a zone as an instant of UTC, whatever the session's zone; null if it can't be read."""
    return F.concat(text, F.lit("Z")).try_cast("timestamp")


def iso_millis(text: Column | str) -> Column:
    """Epoch milliseconds of ``yyyy-MM-ddTHH:mm:ss.SSS`` in UTC (what follows is ignored), null for anything else."""
    s = F.col(text) if isinstance(text, str) else text
    shaped = (F.length(s) >= 23) & (F.substring(s, 5, 1) == "-") & (F.substring(s, 11, 1) == "T")
    return F.when(shaped, F.unix_millis(utc(F.substring(s, 1, 23))))


def millis_iso(ms: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSS`` in UTC, by arithmetic that no session setting touches."""
    part = lambda unit, count, width: F.lpad(F.pmod(F.floor(ms / unit), F.lit(count)).cast("string"), width, "0")
    day = F.date_from_unix_date(F.floor(ms / 86_400_000).cast("int")).cast("string")
    return F.concat(day, F.lit("T"), part(3_600_000, 24, 2), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit("."), part(1, 1000, 3))


def window_start(ms: Column) -> Column:
    """Start of the five-minute window in epoch seconds."""
    return (F.floor(ms / (1000 * WINDOW_SECONDS)) * WINDOW_SECONDS).cast("long")


def is_syn_only(flags: Column) -> Column:
    return F.contains(flags, F.lit("S")) & ~F.rlike(flags, F.lit("[AFR]"))


def has_flag(flags: Column, letter: str) -> Column:
    return F.contains(flags, F.lit(letter))


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, zero if ``whole`` is zero or null."""
    return F.when(whole != 0, part / whole).otherwise(0.0)


def at_least_one(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit(0)) == 0, 1).otherwise(x)


def round2(x: Column) -> Column:
    """Half away from zero at two decimals, for values that aren't negative."""
    return F.floor(x * 100 + 0.5) / 100
