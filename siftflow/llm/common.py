"""Shared plumbing of the training-data operators: lineage cuts, running sums in arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import remove, scratch_path, shared_folder

__all__ = ["bind", "bound_batches", "drop_spilled", "partitions", "running", "scratch_path", "shared_folder", "spill", "table", "workspace"]

_OPEN: list[list[DataFrame]] = []


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    What was written goes by ``drop_spilled``, at the end of a ``workspace``, or when the application ends.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._siftflow_path = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def drop_spilled(*written: DataFrame) -> None:
    """Delete what ``spill`` wrote for these, once nothing reads it any more."""
    for df in written:
        path = getattr(df, "_siftflow_path", None)
        if path:
            remove(df.sparkSession, path)
            df._siftflow_path = None


@contextmanager
def workspace() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what is spilled inside, but for what is passed to the function it gives."""
    mine: list[DataFrame] = []
    kept: list[DataFrame] = []
    _OPEN.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _OPEN.remove(mine)
        drop_spilled(*(df for df in mine if not any(df is k for k in kept)))
        if _OPEN:
            _OPEN[-1].extend(kept)


#: Steps of a running aggregate that share one array while it grows.
RUN = 256


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], element: str) -> Column:
    """The states ``step(state, item)`` after each item, from ``zero``; ``element`` is the state's SQL type.

    States are gathered in runs of ``RUN``, so that a long array isn't copied at every step.
    """
    none = F.array().cast(f"array<{element}>")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int")), lambda n: F.slice(items, n * RUN + 1, RUN))

    def one(acc: Column, x: Column) -> Column:
        return bind(step(acc["s"], x), lambda s: F.struct(s.alias("s"), F.concat(acc["out"], F.array(s)).alias("out")))

    def run(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["s"].alias("s"), none.alias("out")), one)
        return bind(done, lambda d: F.struct(d["s"].alias("s"), F.concat(acc["all"], F.array(d["out"])).alias("all")))

    start = F.struct(zero.cast(element).alias("s"), F.array().cast(f"array<array<{element}>>").alias("all"))
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(runs, start, run)["all"])).otherwise(none)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which the cluster sizes to its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of an Arrow batch: texts are long, and every worker holds a batch several times over.
BATCH_ROWS = 1000


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, its session set to hand rows to Python in batches of ``BATCH_ROWS`` at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df
