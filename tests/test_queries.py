"""Every query with an SQL form against DuckDB, and the whole run."""

import duckdb
import pytest

from kerbside.plans import catalogue

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def base(sf):
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"create view {n} as select * from read_parquet('{sf}/{n}.parquet')")
    return con


def plain(rows):
    simple = (int, str, bool, type(None))
    return sorted((tuple(round(v, 3) if isinstance(v, float) else v if isinstance(v, simple) else str(v) for v in r) for r in map(tuple, rows)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, sf, base, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    want = plain(base.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalogue.SQL[name]})").fetchall())
    assert got == want


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_whole_run(spark, tmp_path):
    from kerbside import pipeline, sinks
    from kerbside.sources import scenario

    written = pipeline.run(spark, scenario.points(spark, fps=10.0, duration_s=15.0), str(tmp_path))
    assert {"trajectories/trajectories.parquet", "events/events.json", "analytics/traffic_summary.json", "reports/traffic_report.html"} <= set(written)
    assert "Road-user report" in (tmp_path / "reports/traffic_report.html").read_text()
    assert sinks.register_run(spark, str(tmp_path), ["tracks/tracks", "nope"]) == ["tracks/tracks"]
    assert spark.table("tracks_tracks").count() == 8


def test_botsort_takes_all_boxes(spark, sf, tmp_path, monkeypatch):
    from kerbside.operators import tracking

    spark.read.parquet(f"{sf}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 7").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(tracking, "track", lambda found, **_: found)
    rows = catalogue.QUERIES["track_botsort"](spark, str(tmp_path)).collect()
    assert len(rows) == len({x.det_id for x in rows}) == spark.read.parquet(f"{sf}/part.parquet").count() > 7
    assert all(x.look is not None for x in rows)
