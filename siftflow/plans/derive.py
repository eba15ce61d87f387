"""Flows and packets derived from ``lineitem``, so that results can be compared with SQL on the same tables.

``FLOWS_SQL`` and ``PACKETS_SQL`` are the same projections for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Unique, so it can stand for the order of arrival.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
BASE_MS = 1704067200000  # 2024-01-01 UTC
_FIRST_MS = f"{BASE_MS} + (l_orderkey * 7919 + l_linenumber * 104729) % 7200000"
_LAST_MS = f"{_FIRST_MS} + l_linenumber * 250 - 250"
_PORT = "CASE l_partkey % 7 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 6667 WHEN 3 THEN 53 WHEN 4 THEN 23 WHEN 5 THEN 8080 ELSE 50505 END"
_PROTO = "CASE WHEN l_returnflag = 'A' THEN 17 WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 1 ELSE 6 END"
_FLAGS = "CASE WHEN l_returnflag = 'A' THEN '' WHEN l_linestatus = 'O' AND l_linenumber <= 3 THEN '....S...' WHEN l_linenumber = 5 THEN '..A..R..' ELSE '..AP.SF.' END"
#: Few enough flows carry a botnet label that both classes of windows exist.
_LABEL = "CASE WHEN l_suppkey % 40 < 4 AND l_linenumber = 1 THEN 'flow=From-Botnet' WHEN l_returnflag = 'A' THEN 'flow=Background' ELSE 'flow=Normal' END"


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records plus the ordering columns and ``label``."""
    return flows_of(lineitem(spark, sf_dir))


def lineitem_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream; a stream reads folders, and the name picks the table out of this one."""
    return spark.readStream.schema(lineitem(spark, sf_dir).schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)


def flows_of(lineitem: DataFrame) -> DataFrame:
    # a time without a zone, so that any session writes the same; a short expression, as it is inlined several times
    iso = "date_format(timestampadd(MILLISECOND, {}, timestamp_ntz'1970-01-01 00:00:00'), \"yyyy-MM-dd'T'HH:mm:ss.SSS\")"
    return lineitem.selectExpr(
        *ORDER,
        f"{iso.format(_FIRST_MS)} AS first",
        f"{iso.format(_LAST_MS)} AS last",
        "CAST(l_quantity AS BIGINT) AS in_packets",
        "CAST(l_quantity AS BIGINT) * (40 + l_partkey % 1000) AS in_bytes",
        f"{_PROTO} AS proto",
        f"{_FLAGS} AS tcp_flags",
        "CAST(1024 + l_suppkey AS INT) AS src_port",
        f"{_PORT} AS dst_port",
        "concat('10.0.0.', CAST(l_suppkey % 40 AS STRING)) AS src4_addr",
        "concat('10.0.0.', CAST(l_partkey % 64 AS STRING)) AS dst4_addr",
        f"{_LABEL} AS label",
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet records of the same rows."""
    return packets_of(lineitem(spark, sf_dir))


def packets_of(lineitem: DataFrame) -> DataFrame:
    return flows_of(lineitem).selectExpr(
        f"({_FIRST_MS}) / 1000.0D AS timestamp",
        "src4_addr AS src_ip",
        "dst4_addr AS dst_ip",
        "src_port",
        "dst_port",
        "CAST(40 + l_partkey % 1000 AS INT) AS length",
        "proto",
        "CAST(32 + l_partkey % 97 AS SMALLINT) AS ttl",
        "tcp_flags",
    )


FLOWS_SQL = f"""flows AS (
  SELECT {', '.join(ORDER)}, {_FIRST_MS} AS first_ms, {_LAST_MS} AS last_ms,
    ({_FIRST_MS}) // 300000 * 300 AS win,
    CAST(l_quantity AS BIGINT) AS in_packets, CAST(l_quantity AS BIGINT) * (40 + l_partkey % 1000) AS in_bytes,
    {_PROTO} AS proto, {_FLAGS} AS tcp_flags, CAST(1024 + l_suppkey AS INT) AS src_port, {_PORT} AS dst_port,
    '10.0.0.' || CAST(l_suppkey % 40 AS VARCHAR) AS src4_addr, '10.0.0.' || CAST(l_partkey % 64 AS VARCHAR) AS dst4_addr,
    {_LABEL} AS label
  FROM lineitem)"""

PACKETS_SQL = f"""{FLOWS_SQL},
packets AS (SELECT first_ms / 1000.0::DOUBLE AS ts, src4_addr AS src_ip, dst4_addr AS dst_ip, src_port, dst_port,
  40 + l_partkey % 1000 AS length, proto, 32 + l_partkey % 97 AS ttl, tcp_flags FROM flows),
roles AS (SELECT src_ip AS ip, dst_port AS port, * EXCLUDE (src_ip, dst_ip, src_port, dst_port), CAST(floor(ts / 300) * 300 AS BIGINT) AS win FROM packets
  UNION ALL SELECT dst_ip, src_port, * EXCLUDE (src_ip, dst_ip, src_port, dst_port), CAST(floor(ts / 300) * 300 AS BIGINT) FROM packets)"""
