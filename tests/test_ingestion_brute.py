"""p1, p3, p4 and p5 over whole test tables against plain Python."""

from __future__ import annotations

import brute
from pyspark.sql import functions as F

from tidemark.operators import quality_profile
from tidemark.plans import ingestion


def _rows(spark, path, *cols):
    t = spark.read.parquet(path)
    return [tuple(r) for r in t.select(*cols).collect()]


def test_parse_failures(spark, sf):
    want = brute.parse_failures(_rows(spark, f"{sf}/raw_lines.parquet", "file_id", "line_no", "raw_line"))
    got = {(r[0], r[1]): r[2] for r in ingestion.p1_found(spark, sf).collect()}
    assert got == want and want
    n = spark.read.parquet(f"{sf}/raw_lines.parquet").filter("line_no > 1").count()
    assert ingestion.p1_loaded(spark, sf).count() == n - len(want)


def test_snapshot_changes(spark, sf):
    want = brute.snapshot_changes(_rows(spark, f"{sf}/ncaapredictions.parquet", "sport_key", "season", "snapshot_label", "snapshot_ts", "row_id", "road", "home", "line"))
    got = [tuple(r) for r in ingestion.p3_found(spark, sf).select("sport_key", "season", "snapshot_label", "road", "home", "change_kind").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_drift(spark, sf):
    want, _ = brute.drift(_rows(spark, f"{sf}/board_archive.parquet", "file_id", "sport_key", "season", "delivered_ts", "content"))
    got = [tuple(r) for r in ingestion.p4_found(spark, sf).select("file_id", "change_kind", "old_field", "new_field").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    files = _rows(spark, f"{sf}/board_archive.parquet", "n_records")
    assert ingestion.p4_table(spark, sf).count() == sum(r[0] for r in files)


def test_issues(spark, sf):
    limits = {}
    for t, c, lo, hi, p in _rows(spark, f"{sf}/column_limits.parquet", "table_name", "column_name", "min_ok", "max_ok", "text_pattern"):
        limits.setdefault(t, {})[c] = (lo, hi, p)
    want = set()
    for t, (label, ts) in ingestion.PROFILED.items():
        cols = list(limits[t])
        rows = [(r[0], r[1], r[2], r[3], dict(zip(cols, r[4:]))) for r in _rows(spark, f"{sf}/{t}.parquet", "sport_key", "season", label, ts, *cols)]
        want |= {(t, *x) for x in brute.issues(rows, cols, limits[t])}
    got = [tuple(r) for r in ingestion.p5_found(spark, sf).select("table_name", "sport_key", "season", "load_label", "column_name", "issue").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_hot_loads_get_the_same_figures(spark, sf):
    rows = spark.read.parquet(f"{sf}/ncaapredictions.parquet")
    cols = ["line", "lineopen", "linedial", "phcover", "neutral"]
    one = quality_profile.number_profile(rows, ingestion.STREAM, "snapshot_label", "snapshot_ts", cols)
    hot = quality_profile.number_profile(rows, ingestion.STREAM, "snapshot_label", "snapshot_ts", cols, hot_rows=20)
    rounded = lambda df: sorted(map(str, df.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes)).collect()))
    assert rounded(one) == rounded(hot)
