"""Command line: ``python -m kerbside {synthetic,track,analyze,query,report} ...``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kerbside import config, pipeline, sinks


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kerbside")
    p.add_argument("--config", help="YAML file of settings")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("synthetic", help="analyse the scripted scene")
    s.add_argument("output")
    s.add_argument("--fps", type=float, default=30.0)
    s.add_argument("--duration", type=float, default=10.0)
    for name, text in (("track", "boxes (Parquet) to tracks"), ("analyze", "points (Parquet) to all tables")):
        c = sub.add_parser(name, help=text)
        c.add_argument("input")
        c.add_argument("output")
    r = sub.add_parser("report", help="report of a finished run")
    r.add_argument("run")
    q = sub.add_parser("query", help="a named query over a folder of tables")
    q.add_argument("name")
    q.add_argument("folder")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    c = config.load(a.config) if a.config else config.Config()
    spark = SparkSession.builder.appName("kerbside").getOrCreate()
    if a.command == "synthetic":
        from kerbside.sources import scenario

        print(*pipeline.run(spark, scenario.points(spark, c.metres_per_pixel, fps=a.fps, duration_s=a.duration), a.output, c), sep="\n")
    elif a.command == "analyze":
        print(*pipeline.run(spark, spark.read.parquet(a.input), a.output, c), sep="\n")
    elif a.command == "track":
        from kerbside.operators.tracking import track

        sinks.save(track(spark.read.parquet(a.input), c.tracker), a.output)
    elif a.command == "report":
        t = {n: sinks.load(spark, f"{a.run}/{n}.json", "json") for n in ("analytics/traffic_summary", "events/events")}
        page = sinks.report(t["analytics/traffic_summary"], sinks.load(spark, f"{a.run}/analytics/conflicts.json", "json"), t["events/events"])
        sinks.save_text(spark, page, f"{a.run}/reports/traffic_report.html")
    else:
        from kerbside.plans.catalogue import QUERIES

        QUERIES[a.name](spark, a.folder).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
