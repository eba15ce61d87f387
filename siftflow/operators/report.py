"""Ranked reports. Only what a report shows reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BENIGN_SHOWN, OVERALL_SHOWN = 5, 10


def ranked(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("probability"), "ip")


def top_benign(results: DataFrame, n: int = BENIGN_SHOWN) -> DataFrame:
    return ranked(results.where(~F.col("is_botnet"))).limit(n)


def top_overall(results: DataFrame, n: int = OVERALL_SHOWN) -> DataFrame:
    return ranked(results).limit(n)


def totals(results: DataFrame, records: DataFrame) -> DataFrame:
    """``(records, botnet_ips, ips)``; records count whether or not their time could be read."""
    zero = F.lit(0).cast("long")
    found = results.agg(zero.alias("records"), F.count_if("is_botnet").alias("botnet_ips"), F.count("*").alias("ips"))
    read = records.agg(F.count("*").alias("records"), zero.alias("botnet_ips"), zero.alias("ips"))
    return found.unionByName(read).agg(*(F.sum(c).alias(c) for c in found.columns))


def result_lines(results: DataFrame) -> DataFrame:
    """``line`` of each result, as the report prints it."""
    head = F.when(F.col("is_botnet"), "[BOTNET DETECTED]").otherwise("[BENIGN TRAFFIC ]")
    why = F.when(F.col("is_botnet") & (F.col("explanation") != ""), F.concat(F.lit(" ("), "explanation", F.lit(")"))).otherwise("")
    return results.withColumn("line", F.concat(head, F.format_string(" IP: %-15s | ML Probability: %6.2f%%", "ip", "probability"), why))


def summary(results: DataFrame, records: int, seconds: float) -> str:
    """All botnet addresses, the likeliest benign ones, and totals. Read ``results`` from a written table."""
    flagged = [r.line for r in result_lines(ranked(results.where("is_botnet"))).toLocalIterator()]
    benign = [r.line for r in result_lines(top_benign(results)).collect()]
    ips = results.count()
    return "\n".join([
        "",
        *flagged,
        "",
        "[Top Benign Background Noise (For Contrast)]",
        *benign,
        "",
        f"Done. Processed {records} records.",
        f"Identified {len(flagged)} specific Botnet IPs out of {ips} total communicating IPs.",
        f"Execution time: {seconds:.4f} seconds",
        "",
    ])


def rule_lines(scores: DataFrame) -> DataFrame:
    """Rule results, highest risk first, with ``line``."""
    return scores.withColumn("line", F.concat_ws(" ", F.concat("ip", F.lit(":")), F.format_string("%.2f%%", "risk"), F.concat(F.lit("("), F.array_join("reasons", ", "), F.lit(")")))).orderBy(F.desc("risk"), "ip")


def tee(text: str, path: str | None = None) -> None:
    """Print a report, and write it to a file too if one is named."""
    print(text, end="")
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_features(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Feature tables as CSV with a header, or Parquet."""
    df.write.mode("overwrite").option("header", True).format(kind).save(path)


def write_flows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
