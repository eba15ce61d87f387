"""Command line: score an input and print the report, or apply the rules."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import flow_features as ff
from .operators import model as md
from .operators import packet_features as pf
from .operators import report, rules
from .schemas import FLOW_FEATURES, PACKET_FEATURES
from .sources.flows import read_rule_flows
from .sources.router import file_type_counts, read_file, read_folder


def session(name: str = "siftflow") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftflow", description=__doc__)
    p.add_argument("--input", required=True, help="a .json, .ndjson or .pcap file, or a folder of them")
    p.add_argument("--output", help="also write the report here")
    p.add_argument("--flow-model", help="trees for flow features (JSON)")
    p.add_argument("--packet-model", help="trees for packet features (JSON)")
    p.add_argument("--rules", help="rule configuration (JSON); applies the rules in place of a model")
    p.add_argument("--fragment-by-file", action="store_true", help="keep windows of different files apart")
    p.add_argument("--list", action="store_true", help="only count files by kind")
    p.add_argument("--yes", action="store_true", help="work through a folder without asking")
    return p


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def analyse(inputs: dict[str, DataFrame], flow_model: md.Ensemble | None, packet_model: md.Ensemble | None, by_file: bool = False) -> DataFrame:
    """Results of flows and packets together; an address in both comes up twice."""
    found = []
    if "flow" in inputs:
        if flow_model is None:
            raise ValueError("flows need --flow-model")
        part = F.col("file") if by_file and "file" in inputs["flow"].columns else None
        found.append(md.results(ff.flow_features(inputs["flow"], fragment=part), flow_model, FLOW_FEATURES))
    if "packet" in inputs:
        if packet_model is None:
            raise ValueError("packets need --packet-model")
        found.append(md.results(pf.packet_features(inputs["packet"]), packet_model, PACKET_FEATURES))
    if not found:
        raise ValueError("no supported file in the input")
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def run(spark: SparkSession, args: argparse.Namespace) -> str:
    """The report of one call."""
    if args.rules:
        config = rules.RuleConfig.load(args.rules)
        flows = read_rule_flows(spark, args.input)
        scores = rules.risk_scores(rules.triggered(flows, config, ["position"]), config.weights.by_reason())
        return "".join(r.line + "\n" for r in report.rule_lines(scores).toLocalIterator())
    folder = is_folder(spark, args.input)
    if args.list or (folder and not args.yes):
        counts = file_type_counts(spark, args.input).orderBy("kind").collect()
        shown = "".join(f"{r.kind}: {r.files} files, {r.shown}\n" for r in counts)
        if args.list:
            return shown
        print(shown, end="")
        if input("Proceed? [y/N] ").strip().lower() not in ("y", "yes"):
            return "cancelled\n"
    began = time.time()
    flow_model = md.Ensemble.load(args.flow_model, len(FLOW_FEATURES)) if args.flow_model else None
    packet_model = md.Ensemble.load(args.packet_model, len(PACKET_FEATURES)) if args.packet_model else None
    if folder:
        inputs, failed = read_folder(spark, args.input)
    else:
        kind, rows = read_file(spark, args.input, mode="fail")
        inputs, failed = {kind: rows}, spark.createDataFrame([], "file string, error string")
    results = analyse(inputs, flow_model, packet_model, args.fragment_by_file).cache()
    records = sum(rows.count() for rows in inputs.values())
    text = report.summary(results, records, time.time() - began)
    results.unpersist()
    return text + "".join(f"skipped {r.file}: {r.error}\n" for r in failed.orderBy("file").toLocalIterator())


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        report.tee(run(session(), args), args.output)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
