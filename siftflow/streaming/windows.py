"""Window features on streams, late rows included, and a running best score per address.

``Fragments`` gives all features of flows and of packets, the same code that tables take. ``event_counts`` and
``flow_counts`` are native streaming aggregations of counts, which drop rows later than the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from ..functions.flow import is_syn_only, iso_millis, window_start
from ..operators.flow_features import flow_features, normalize, valid_time
from ..operators.model import best_window
from ..operators.packet_features import packet_features
from ..schemas import WINDOW_SECONDS
from ..scratch import file_system, remove

WATERMARK = f"{WINDOW_SECONDS} seconds"


def event_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Events per key and tumbling window; works on streams and on tables alike."""
    kind = events.schema[time].dataType
    events = events.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need the zoned type
    counted = events.withWatermark(time, watermark).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").cast(kind).alias("window_start"), key, "n", "total")


def flow_counts(flows: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Counting features per calling address and window, closed by the watermark; rows later than that are dropped.

    Sets of peers and ports are kept as sets, because streams can't count distinct values; a window bounds them.
    """
    rows = valid_time(normalize(flows)).where("src4_addr <> ''").withColumn("time", F.timestamp_millis("first_ms")).withWatermark("time", watermark)
    n = F.col("flow_count")
    sums = rows.groupBy(F.window("time", f"{WINDOW_SECONDS} seconds"), F.col("src4_addr").alias("ip")).agg(
        F.count("*").alias("flow_count"),
        F.size(F.collect_set("dst4_addr")).cast("long").alias("unique_dst_ips"),
        F.size(F.collect_set("dst_port")).cast("long").alias("unique_dst_ports"),
        F.sum("in_bytes").alias("total_bytes"),
        F.sum("in_packets").alias("total_packets"),
        F.count_if(is_syn_only(F.col("tcp_flags"))).alias("syn"),
    )
    return sums.select("ip", F.unix_seconds("window.start").alias("win"), "flow_count", "unique_dst_ips", "unique_dst_ports", "total_bytes", "total_packets", (F.col("syn") / n * 100).alias("pct_syn_only"))


class Fragments:
    """Features of windows as they close, appended batch by batch under ``path/features``.

    A batch's rows join the open ones. Windows that ended ``watermark`` seconds before the latest time seen so
    far are closed: ``features`` is computed of their rows, which are then forgotten. A row that comes later
    than that opens a fragment of its own, which closes with its batch. ``flush`` closes what is left. The open
    rows, a watermark and a window of them, are rewritten by each batch under its number and the version before
    last goes; a batch that runs again finds what it found before.
    """

    def __init__(self, path: str, millis: Column, features: Callable[[DataFrame], DataFrame], watermark: int = WINDOW_SECONDS):
        self.path, self.millis, self.features, self.watermark = path, millis, features, watermark

    @classmethod
    def of_flows(cls, path: str, watermark: int = WINDOW_SECONDS) -> Fragments:
        return cls(path, iso_millis("first"), flow_features, watermark)

    @classmethod
    def of_packets(cls, path: str, watermark: int = WINDOW_SECONDS) -> Fragments:
        return cls(path, F.floor(F.col("timestamp") * 1000), packet_features, watermark)

    def _before(self, spark: SparkSession, number: int) -> tuple[DataFrame | None, int | None]:
        """Open rows and the latest time, as the batch before left them."""
        if number == 0:
            return None, None
        return spark.read.parquet(f"{self.path}/open/v{number - 1}"), spark.read.parquet(f"{self.path}/latest/v{number - 1}").first()[0]

    def merge(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_ms", self.millis).where("_ms is not null").persist()
        try:
            held, latest = self._before(spark, number)
            latest = max((x for x in (latest, rows.agg(F.max("_ms")).first()[0]) if x is not None), default=None)
            limit = -(1 << 62) if latest is None else latest // 1000 - self.watermark
            rows_open = rows if held is None else held.unionByName(rows)
            over = window_start(F.col("_ms")) + WINDOW_SECONDS <= F.lit(limit)
            self.features(rows_open.where(over).drop("_ms")).write.mode("overwrite").parquet(f"{self.path}/features/batch={number}")
            rows_open.where(~over).write.mode("overwrite").parquet(f"{self.path}/open/v{number}")
            spark.createDataFrame([(latest,)], "latest long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/latest/v{number}")
        finally:
            rows.unpersist()
        for kind in ("open", "latest"):
            remove(spark, f"{self.path}/{kind}/v{number - 2}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """Run on a stream; ``trigger`` as Structured Streaming takes it, all that is there now by default."""
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(self.merge)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def flush(self, spark: SparkSession) -> None:
        """Close all windows that are still open; safe to repeat."""
        where, files = file_system(spark, f"{self.path}/open")
        numbers = [int(x.getPath().getName()[1:]) for x in files.listStatus(where)] if files.exists(where) else []
        if numbers:
            rows = spark.read.parquet(f"{self.path}/open/v{max(numbers)}")
            self.features(rows.drop("_ms")).write.mode("overwrite").parquet(f"{self.path}/features/batch=-1")

    def read(self, spark: SparkSession) -> DataFrame:
        """All features so far, with ``batch``, the number of the batch that closed the window (-1: the flush)."""
        return spark.read.parquet(f"{self.path}/features")


def run_available(stream: DataFrame, name: str, checkpoint: str | None = None, mode: str = "append") -> DataFrame:
    """Take in what is there now, then stop; the result is a table in memory, for tests and small inputs."""
    writer: DataStreamWriter = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query: StreamingQuery = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def keep_best(scored: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Every address's best window so far, under ``path/v<batch>``; the version before last is removed.

    ``scored`` streams ``(ip, win, probability, ...)``. Late fragments of a window are scored on their own, as
    the best over fragments counts. A batch reads the version before it, so a batch that runs again is harmless.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        all_rows = batch
        if number > 0:
            all_rows = spark.read.parquet(f"{path}/v{number - 1}").unionByName(batch)
        best_window(all_rows).write.mode("overwrite").parquet(f"{path}/v{number}")
        remove(spark, f"{path}/v{number - 2}")

    return scored.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(merge)


class Progress(StreamingQueryListener):
    """Passes rows taken in so far to a callback."""

    def __init__(self, told: Callable[[int], None]):
        self.told, self.rows = told, 0

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.rows += event.progress.numInputRows
        self.told(self.rows)

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass
