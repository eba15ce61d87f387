"""Flow sources: NDJSON, JSON arrays, connection-log CSV, raw text exports, training CSV.

Schemas are always given. ``mode`` says what a bad record does: ``skip`` drops it, ``keep`` leaves it with
its text in ``_corrupt``, ``fail`` raises when rows are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import convert
from ..schemas import FLOW, LABELLED_FLOW, RULE_FLOW

CORRUPT = "_corrupt"
MODES = ("skip", "keep", "fail")


def _parse(records: DataFrame, text: Column, schema: T.StructType, mode: str) -> DataFrame:
    """Objects in ``text`` as columns, nulls and unknown keys handled by the schema."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = records.select(F.from_json(text, wide, {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}).alias("r"), *(c for c in records.columns if c != "value")).select("r.*", *(c for c in records.columns if c != "value"))
    if mode == "keep":
        return parsed
    if mode == "fail":
        checked = F.when(F.col(CORRUPT).isNotNull(), F.raise_error(F.concat(F.lit("bad flow record: "), F.substring(CORRUPT, 1, 200)))).otherwise(F.lit(True))
        return parsed.where(checked.cast("boolean")).drop(CORRUPT)
    return parsed.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_records(kept: DataFrame) -> DataFrame:
    """``(bad, first_bad)``: how many of the records read in mode ``keep`` are bad, and the first of them as text.

    First by file and place, as far as Spark numbers rows in reading order; null without any.
    """
    rows = kept.select(F.monotonically_increasing_id().alias("n"), F.col(CORRUPT).alias("text")).where("text is not null")
    return rows.agg(F.count("*").alias("bad"), F.min_by("text", "n").alias("first_bad"))


def parse_lines(lines: DataFrame, schema: T.StructType, mode: str) -> DataFrame:
    """An object per ``value``; other columns pass through."""
    line = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace("value", r"[\t\r]", " ")), ",$", ""), " +$", "")
    return _parse(lines.withColumn("value", line).where("value <> ''"), F.col("value"), schema, mode)


def read_ndjson(spark: SparkSession, path: str | list[str], schema: T.StructType = FLOW, mode: str = "skip") -> DataFrame:
    """An object per line; white space, one comma after it, and blank lines don't count."""
    return parse_lines(spark.read.text(path), schema, mode)


def _broken_off(closed: DataFrame, opened: DataFrame) -> DataFrame:
    """``file`` of those that break off inside an object; ``closed`` and ``opened`` are their pieces up to each ``}`` and ``{``.

    Such a file has a ``{`` in its last piece and no ``}`` at its end. The pieces and one byte for each come to one
    byte more than the file where it doesn't end with their separator, so the two sums tell which end it has. Only
    files with a ``{`` in the last piece are read for the second sum.
    """
    ends = closed.groupBy("file").agg(F.max_by(F.contains("value", F.lit("{")), "at").alias("open"), F.sum("bytes").alias("bytes")).where("open")
    sums = opened.withColumnRenamed("bytes", "other").join(F.broadcast(ends.select("file", "bytes")), "file").groupBy("file", "bytes").agg(F.sum("other").alias("other"))
    return sums.where("bytes >= other").select("file")


def array_objects(reader: DataFrameReader, path: str | list[str], order: bool = False) -> DataFrame:
    """``(file, value)``, with ``order`` ``position`` besides: the text of each object, from a ``{`` to the next ``}``.

    Files are split at any ``}``, so a task holds an object at a time, however large its file.
    """

    def pieces(end: str) -> DataFrame:
        # the first place of a split, then the order in it
        at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
        return reader.text(path, lineSep=end).select("value", F.col("_metadata.file_path").alias("file"), at.alias("at"), (F.octet_length("value") + 1).alias("bytes"))

    closed = pieces("}")
    broken = F.broadcast(_broken_off(closed, pieces("{")))
    # what a file breaks off in is its last piece
    last = closed.join(broken, "file", "left_semi").withColumn("last", F.lead("at").over(Window.partitionBy("file").orderBy("at")).isNull())
    found = closed.join(broken, "file", "left_anti").unionByName(last.where("not last").drop("last")).where(F.contains("value", F.lit("{")))
    if order:
        found = found.withColumn("position", F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1)
    value = F.concat(F.regexp_extract("value", r"(?s)\{.*", 0), F.lit("}")).alias("value")
    return found.select("file", *(["position"] if order else []), value)


def parse_arrays(objects: DataFrame, schema: T.StructType, mode: str) -> DataFrame:
    """An object per ``value``; other columns pass through."""
    return _parse(objects, F.col("value"), schema, mode)


def read_json_array(spark: SparkSession, path: str | list[str], schema: T.StructType = FLOW, mode: str = "skip", order: bool = False) -> DataFrame:
    """Objects of JSON arrays, from each ``{`` to the next ``}``; an object that the file breaks off is ignored.

    ``order`` adds ``position``, the object's place in its file; then the objects of a file are sorted in one task.
    """
    return parse_arrays(array_objects(spark.read, path, order).drop("file"), schema, mode)


def read_rule_flows(spark: SparkSession, path: str | list[str], mode: str = "skip") -> DataFrame:
    """A JSON array of flows as the rules take them; files that don't start with ``[`` are refused."""
    for one in [path] if isinstance(path, str) else path:
        if not _first_line(spark, one).startswith("["):
            raise ValueError("not a JSON array")
    return read_json_array(spark, path, RULE_FLOW, mode, order=True)


def read_connection_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of a connection log in CSV, all strings."""
    return spark.read.option("header", True).option("encoding", "UTF-8").csv(path)


def convert_connection_log(rows: DataFrame) -> DataFrame:
    """Connection-log rows as labelled flows; columns that the log lacks count as empty."""
    c = {k: F.coalesce(F.col(k), F.lit("")) if k in rows.columns else F.lit("") for k in ("StartTime", "Dur", "Proto", "SrcAddr", "Sport", "DstAddr", "Dport", "State", "TotPkts", "TotBytes", "Label")}
    proto = convert.protocol_number(c["Proto"])
    start = convert.iso_time(c["StartTime"])
    end = convert.end_time(start, F.coalesce(F.trim(c["Dur"]).try_cast("double"), F.lit(0.0)))
    out = {
        "first": start, "last": end, "in_packets": convert.integer(c["TotPkts"]), "in_bytes": convert.integer(c["TotBytes"]), "proto": proto,
        "tcp_flags": convert.state_flags(c["State"], proto), "src_port": convert.port_number(c["Sport"]), "dst_port": convert.port_number(c["Dport"]),
        "src4_addr": F.trim(c["SrcAddr"]), "dst4_addr": F.trim(c["DstAddr"]), "type": F.lit("FLOW"), "received": start, "ip_next_hop": F.lit(None).cast("string"),
        "in_src_mac": F.lit("00:00:00:00:00:00"), "out_dst_mac": F.lit("00:00:00:00:00:00"), "export_sysid": F.lit(1), "label": F.trim(c["Label"]),
    }
    return rows.select(*(out[f.name].cast(f.dataType).alias(f.name) for f in LABELLED_FLOW.fields))


def label_counts(flows: DataFrame) -> DataFrame:
    """``(botnet, normal, background, other)`` flows."""
    kind = convert.label_class(F.col("label"))
    return flows.agg(*(F.count_if(kind == k).alias(k) for k in ("botnet", "normal", "background", "other")))


def read_raw_export(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text exports of ``Flow Record:`` blocks with ``key = value`` lines, as flows.

    Keys match in any case, with spaces or underscores. Times stand in brackets; protocols begin with their
    number; flags end their line.
    """
    blocks = spark.read.option("lineSep", "Flow Record:").text(path).where(F.rlike("value", F.lit(r"\S\s+=\s+\S")))

    def value(*keys: str) -> Column:
        names = "|".join(k.replace("_", "[ _]") for k in keys)
        found = F.regexp_extract("value", rf"(?im)^[ \t]*(?:{names})[ \t]+=[ \t]+(.+?)[ \t\r]*$", 1)
        return F.when(found != "", found)

    def time(*keys: str) -> Column:
        return F.replace(F.regexp_extract(value(*keys), r"\[(.+?)\]", 1), F.lit(" "), F.lit("T"))

    out = {
        "first": time("first"), "last": time("last"), "in_packets": value("in_packets"), "in_bytes": value("in_bytes"), "proto": F.regexp_extract(value("proto"), r"^\S+", 0),
        "tcp_flags": F.regexp_extract(value("tcp_flags"), r"\S+$", 0), "src_port": value("src_port"), "dst_port": value("dst_port"),
        "src4_addr": value("src_addr", "src4_addr"), "dst4_addr": value("dst_addr", "dst4_addr"), "type": F.lit("FLOW"), "received": time("received_at", "received"),
        "ip_next_hop": value("ip_next_hop"), "in_src_mac": value("in_src_mac"), "out_dst_mac": value("out_dst_mac"), "export_sysid": value("export_sysid"),
    }
    return blocks.select(*(out[f.name].try_cast(f.dataType).alias(f.name) for f in RULE_FLOW.fields))


Reader = Callable[..., DataFrame]
#: Readers of flows by format, called with session, path and mode; more can be registered.
READERS: dict[str, Reader] = {}


def register_reader(kind: str, reader: Reader) -> None:
    """Make ``reader(spark, path, mode)`` known to ``read_flows``; a format that is known already is replaced."""
    READERS[kind] = reader


register_reader("json", lambda spark, path, mode: read_json_array(spark, path, mode=mode))
register_reader("ndjson", lambda spark, path, mode: read_ndjson(spark, path, mode=mode))
register_reader("raw", lambda spark, path, mode: read_raw_export(spark, path).select(*FLOW.fieldNames()))
register_reader("csv", lambda spark, path, mode: convert_connection_log(read_connection_log(spark, path)).select(*FLOW.fieldNames()))


def _first_line(spark: SparkSession, path: str) -> str:
    """The first line with anything in it, of whichever file comes first; no more than one split is read for it."""
    row = spark.read.text(path).where(F.trim(F.regexp_replace("value", r"[\t\r]", " ")) != "").limit(1).collect()
    return row[0][0].strip() if row else ""


def read_flows(spark: SparkSession, path: str, kind: str = "auto", mode: str = "skip") -> DataFrame:
    """Flows of one input; ``auto`` takes a JSON array if the text starts with one, else a raw export."""
    if kind == "auto":
        kind = "json" if _first_line(spark, path)[:1] in ("[", "{") else "raw"
    if kind not in READERS:
        raise ValueError(f"unknown flow format {kind!r}")
    return READERS[kind](spark, path, mode=mode)


def read_training_csv(spark: SparkSession, paths: list[str], columns: list[str], label: str = "Label", limit_files: int | None = None) -> DataFrame:
    """Feature columns and label of CSV files; unreadable files are passed over, infinities become NaN."""
    raw = spark.read.option("header", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).csv(paths[:limit_files])
    return raw.select(*(convert.finite_float(F.col(f"`{c}`").try_cast("double")).alias(c) for c in columns), convert.attack_label(F.col(label)).alias("label")).where("label is not null")


def distinct_labels(df: DataFrame, label: str = "Label") -> DataFrame:
    return df.select(F.trim(label).alias("label")).distinct().orderBy("label")
