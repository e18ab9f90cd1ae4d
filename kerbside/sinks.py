"""Tables written to a folder, and a report of their figures."""

from __future__ import annotations

import html
import json
from string import Template

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.storage import remove


def flat(df: DataFrame) -> DataFrame:
    """Arrays of simple values as comma-joined text, other nested columns as JSON, for CSV."""
    def one(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind.startswith("array<") and "struct" not in kind:
            return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(name)
        return (F.to_json(c) if kind.split("<")[0] in ("array", "struct", "map") else c).alias(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])


def save(df: DataFrame, path: str, kind: str = "parquet", single: bool = False) -> None:
    df = df.coalesce(1) if single else df
    if kind == "csv":
        flat(df).write.mode("overwrite").csv(path, header=True)
    elif kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {kind!r}")


def load(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    reader = {"parquet": spark.read.parquet, "csv": lambda p: spark.read.csv(p, header=True, inferSchema=True), "json": spark.read.json}
    return reader[kind](path)


def save_artifacts(tables: dict[str, tuple[DataFrame, tuple[str, ...]]], folder: str, always: tuple[str, ...] = ()) -> list[str]:
    """Write each table in its formats below a folder; empty ones are left out unless they are always written."""
    written = []
    for name, (df, kinds) in tables.items():
        if name not in always and df.isEmpty():
            continue
        for kind in kinds:
            save(df, f"{folder}/{name}.{kind}", kind)
            written.append(f"{name}.{kind}")
    return written


def register_run(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Views over the tables of a run: Parquet, else CSV; names that aren't there are skipped."""
    from pyspark.errors import AnalysisException

    found = []
    for name in names:
        for kind in ("parquet", "csv", "json"):
            try:
                load(spark, f"{folder}/{name}.{kind}", kind).createOrReplaceTempView(name.replace("/", "_"))
            except AnalysisException:
                continue
            found.append(name)
            break
    return found


_PAGE = Template("""<!doctype html><html><head><meta charset="utf-8"><title>$title</title>
<style>body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:.3em .6em}</style></head>
<body><h1>$title</h1><h2>Figures</h2>$figures<h2>Classes</h2>$classes<h2>Conflicts</h2>$conflicts<h2>Events</h2>$events</body></html>""")


def _table(rows: list[dict]) -> str:
    if not rows:
        return "<p>None.</p>"
    cell = lambda v: html.escape(f"{v:.3f}" if isinstance(v, float) else str(v))
    head = "".join(f"<th>{html.escape(k)}</th>" for k in rows[0])
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table>"


def report(summary: DataFrame, conflicts: DataFrame, events: DataFrame, title: str = "Road-user report", top_conflicts: int = 12, top_events: int = 10) -> str:
    """An HTML page: figures, shares of classes, the first conflicts and events. Only the summary's row and the tops are collected."""
    s = json.loads(summary.select(F.to_json(F.struct("*"))).first()[0])
    total = s["metadata"]["total_vehicles_observed"]
    shares = [{"class": k, "tracks": n, "share %": 100.0 * n / max(1, total)} for k, n in sorted(s["metadata"].get("class_breakdown", {}).items())]
    figures = [{"figure": k, "value": v} for part in ("metadata", "flow_and_congestion", "surrogate_safety", "behavioral_events", "data_quality_and_integrity") for k, v in s[part].items() if not isinstance(v, dict)]
    figures.append({"figure": "anomalies", "value": sum(n for k, n in s["behavioral_events"].get("events_by_type", {}).items() if "ANOMALY" in k)})
    first = lambda df, order, n: [r.asDict() for r in flat(df).orderBy(*order).limit(n).collect()]
    return _PAGE.substitute(
        title=html.escape(title), figures=_table(figures), classes=_table(shares),
        conflicts=_table(first(conflicts, ["frame_id", "track_a", "track_b"], top_conflicts)), events=_table(first(events, ["start_s", "event_type", "track_id"], top_events)),
    )


def save_text(spark: SparkSession, text: str, path: str) -> None:
    """Write a text to a path of any store through Hadoop's file system."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


__all__ = ["flat", "load", "register_run", "remove", "report", "save", "save_artifacts", "save_text"]
