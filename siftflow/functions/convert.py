"""Conversion of connection-log fields (ports, times, states, protocols) to flow fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .flow import millis_iso, utc

# Protocol names and their numbers.
PROTOCOLS = {
    "tcp": 6, "udp": 17, "icmp": 1, "igmp": 2, "ipv6-icmp": 58, "arp": 0, "rtp": 0, "rtcp": 0, "pim": 103,
    "ipx/spx": 0, "udt": 0, "unas": 0,
}
# Connection state prefixes, tried in this order, and the flags they stand for.
STATE_FLAGS = [
    ("S_FA", ".A.S...F"), ("S_A", "..AS...."), ("FA_FA", ".A.....F"), ("PA_PA", "..A.P..."), ("S_", "....S..."),
    ("SR_A", "..AS.R.."), ("A_A", "..A....."), ("S_R", "....S.R."), ("R_", ".....R.."), ("SR_", "....S.R."),
]
_NO_FLAGS, _ACK = "........", "..A....."


def protocol_number(name: Column) -> Column:
    known = F.create_map(*(x for k, v in PROTOCOLS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(F.coalesce(name, F.lit(""))))), F.lit(0))


def port_number(text: Column) -> Column:
    """A decimal or ``0x`` hexadecimal port, else 0."""
    s = F.trim(F.coalesce(text, F.lit("")))
    decimal = F.when(F.rlike(s, F.lit(r"^[+-]?\d+$")), s.try_cast("int"))
    hexadecimal = F.when(F.rlike(s, F.lit("^0x[0-9a-fA-F]{1,8}$")), F.conv(F.substring(s, 3, 8), 16, 10).try_cast("int"))
    return F.coalesce(decimal, hexadecimal, F.lit(0))


def integer(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("long"), F.lit(0).cast("long"))


def iso_time(text: Column) -> Column:
    """Four input layouts as ISO with milliseconds; anything else with its spaces turned to ``T``."""
    s = F.trim(F.coalesce(text, F.lit("")))
    fraction = r"(\.\d{1,6})?$"
    slashes = F.rlike(s, F.lit(r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}" + fraction))
    dashes = F.rlike(s, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}(T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}| \d{1,2}:\d{1,2}:\d{1,2})$"))
    parsed = F.when(slashes | dashes, utc(F.replace(s, F.lit("/"), F.lit("-"))))
    return F.coalesce(millis_iso(F.unix_millis(parsed)), F.replace(s, F.lit(" "), F.lit("T")))


def end_time(start: Column, seconds: Column) -> Column:
    """An ISO start plus a duration; the start itself if the duration isn't positive or the start can't be read."""
    begin = F.when(F.rlike(start, F.lit(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{1,6}$")), utc(start))
    micros = F.unix_micros(begin) + F.round(seconds * 1e6).cast("long")
    later = millis_iso(F.floor(micros / 1000))
    return F.when(seconds > 0, F.coalesce(later, start)).otherwise(start)


def state_flags(state: Column, proto: Column) -> Column:
    """The flags a TCP connection state stands for, by the first prefix that fits."""
    s = F.upper(F.trim(F.coalesce(state, F.lit(""))))
    out = F.when(proto != 6, _NO_FLAGS)
    for prefix, flags in STATE_FLAGS:
        out = out.when(F.startswith(s, F.lit(prefix)), flags)
    return out.when(F.contains(s, F.lit("A")), _ACK).otherwise(_NO_FLAGS)


def label_class(label: Column) -> Column:
    """``botnet``, ``normal``, ``background`` or ``other``, in that priority."""
    s = F.lower(F.coalesce(label, F.lit("")))
    return F.when(F.contains(s, F.lit("bot")), "botnet").when(F.contains(s, F.lit("normal")), "normal").when(F.contains(s, F.lit("background")), "background").otherwise("other")


def is_botnet_label(label: Column) -> Column:
    return F.contains(F.lower(F.coalesce(label, F.lit(""))), F.lit("bot")).cast("int")


def attack_label(label: Column) -> Column:
    """0 for benign, 1 for any other, null for null."""
    return F.when(label.isNotNull(), (F.upper(F.trim(label)) != "BENIGN").cast("int"))


def finite_float(x: Column) -> Column:
    """Single precision, infinities turned to NaN."""
    return F.when(F.abs(x) == float("inf"), float("nan")).otherwise(x).cast("float")
