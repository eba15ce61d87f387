"""Inputs by file name: single files and directories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from ..functions.formatting import file_size
from ..schemas import FLOW
from ..scratch import scratch_path
from .flows import array_objects, parse_arrays, parse_lines, read_json_array, read_ndjson
from .pcap import decode_files, read_pcap

#: Kinds in the order in which a directory is worked through, and the file names they go by.
KINDS = {"json": (".json",), "ndjson": (".ndjson",), "pcap": (".pcap",)}


def kind_of(path: str) -> str:
    """The kind of a file, by its extension in any case."""
    for kind, ends in KINDS.items():
        if path.lower().endswith(ends):
            return kind
    raise ValueError(f"unsupported file format: {path}")


def classify(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, size, kind)`` of all files below a folder; other names are ``unsupported``."""
    name = F.lower("path")
    kind = F.lit("unsupported")
    for k, ends in KINDS.items():
        kind = F.when(F.endswith(name, F.lit(ends[0])), k).otherwise(kind)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("size"), kind.alias("kind"))


def file_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``(kind, files, bytes, shown)`` per kind."""
    sums = classify(spark, folder).groupBy("kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return sums.withColumn("shown", file_size(F.col("bytes")))


def read_file(spark: SparkSession, path: str, mode: str = "skip") -> tuple[str, DataFrame]:
    """``("flow" or "packet", rows)`` of one file."""
    kind = kind_of(path)
    if kind == "pcap":
        return "packet", read_pcap(spark, path)
    return "flow", (read_ndjson if kind == "ndjson" else read_json_array)(spark, path, mode=mode)


def _glob(kind: str) -> str:
    """File names of a kind, in any case."""
    return "*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in KINDS[kind][0])


def read_folder(spark: SparkSession, folder: str, mode: str = "skip") -> tuple[dict[str, DataFrame], DataFrame]:
    """Flows and packets below a folder, each with ``file``, and ``(file, error)`` of captures that can't be read.

    One reader a kind takes all its files, whose names don't reach the driver but for JSON files that end in an object
    or inside one. Captures are decoded once, into the shared folder, so that one that can't be read costs itself only.
    Kinds without a file are left out.
    """
    kinds = {r.kind for r in classify(spark, folder).select("kind").distinct().collect()}
    found: dict[str, DataFrame] = {}
    failed = spark.createDataFrame([], "file string, error string")

    def files(kind: str) -> DataFrameReader:
        return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", _glob(kind))

    name = F.col("_metadata.file_path").alias("file")
    flows = []
    if "json" in kinds:
        flows.append(parse_arrays(array_objects(files("json"), folder), FLOW, mode))
    if "ndjson" in kinds:
        flows.append(parse_lines(files("ndjson").text(folder).select("value", name), FLOW, mode))
    if flows:
        found["flow"] = reduce(DataFrame.unionByName, flows)
    if "pcap" in kinds:
        path = scratch_path(spark, "packets")
        decode_files(files("pcap").format("binaryFile").load(folder).select("content", F.col("path").alias("file"))).write.parquet(path)
        decoded = spark.read.parquet(path)
        found["packet"] = decoded.where("error is null").drop("error")
        failed = decoded.where("error is not null").select("file", "error")
    return found, failed
