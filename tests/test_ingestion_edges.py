"""Nulls, empty and long values, ties, repetitions, empty tables and clashing columns for p1, p3, p4 and p5."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import parse_failures, quality_profile, schema_drift, snapshots

RAW = "file_id bigint, line_no int, raw_line string, reason string, names string"
T0 = dt.datetime(2025, 1, 1)


def _reasons(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], RAW)
    return {(r[0], r[1]): r[2] for r in parse_failures.parse_failures(df).collect()}


def test_lines_of_every_kind(spark):
    head = "road,home,line,neutral,phcover"
    long = "a" * 200_000
    many = '"' + '""' * 20_000 + '",b,1,0,0'
    cases = {
        "a,b,1,0,.5": None, "a,b,1,0,.5\r": None, "a,b,1,0,.5\r\r": "bad_value", '"a","b","1","0","0"': None, '"a,x",b,1,0,0': None, '"a""x",b,1,0,0': None, '"",b,1,0,0': "bad_value",
        'a"x,b,1,0,0': "quoting", '"a"x,b,1,0,0': "quoting", '"a,b,1,0,0': "quoting", ' "a",b,1,0,0': "quoting", "a,b,1,0": "column_count", "a,b,1,0,0,": "column_count", "": "column_count", None: "column_count",
        "a,b,100,0,0": None, "a,b,100.01,0,0": "bad_value", "a,b,PK,+0,pk": None, "a,b,−3.5,1,1.": None, "a,b,1e5,0,0": "bad_value", "a,b,1e400,0,0": "bad_value", "a,b,0x1F,0,0": "bad_value", "a,b,1d,0,0": "bad_value",
        "a,b,NA,N/A,None": None, "a,b,na,0,0": "bad_value", "\ta ,b, 1\t,0,0": None, ".,b,1,0,0": "bad_value", "a,b,٣,0,0": "bad_value", "a,b,1,0.5,0": "bad_value", "a,b,1,0,1.01": "bad_value", f"{long},b,1,0,0": None, many: None,
    }
    rows = [(1, 1, head)] + [(1, i + 2, line) for i, line in enumerate(cases)]
    got = _reasons(spark, rows)
    assert {line: got.get((1, i + 2)) for i, line in enumerate(cases)} == cases


def test_bets_and_headers(spark):
    head = "Date,Bet,American Odds,Decimal Odds,Win/Loss,Profit if risk 1u"
    cases = {"x,A -3,-110,1.9,W,.9": None, ",A,even,,,": None, "x,A,99,1.9,W,1": "bad_value", "x,A,+10000,1,P,0": None, "x,A,1e2,1,L,0": "bad_value", "x,A,-110.0,1,L,0": "bad_value", "x,,100,1,L,0": "bad_value", "x,A,100,1,w,0": "bad_value"}
    rows = [(2, 1, head)] + [(2, i + 2, line) for i, line in enumerate(cases)] + [(3, 2, "a,b"), (3, 3, 'a"b'), (4, 1, None), (4, 2, "a"), (5, 1, 'ro"ad'), (5, 2, "a"), (None, 2, "a,b")]
    got = _reasons(spark, rows)
    assert {line: got.get((2, i + 2)) for i, line in enumerate(cases)} == cases
    assert got[3, 2] == got[4, 2] == got[5, 2] == got[None, 2] == "column_count" and got[3, 3] == "quoting"


def test_repeated_and_far_offsets(spark):
    rows = [(1, 1, "road,home"), (1, 1, "road,home"), (1, 2, "a,b"), (1, 2, "a,b"), (1, 3, "a"), (1, 3, "a"), (1, 4, "a,b"), (1, 4, 'a"'), (1, 90_000, "a"), (1, 90_001, "a,b")]
    assert _reasons(spark, rows) == {(1, 3): "column_count", (1, 4): "quoting", (1, 90_000): "column_count"}
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], RAW)
    assert parse_failures.load_typed(df).count() == 3
    empty = spark.createDataFrame([], RAW)
    assert parse_failures.parse_failures(empty).count() == 0 and parse_failures.load_typed(empty).count() == 0


SNAP = "sport_key string, season int, snapshot_label string, snapshot_ts timestamp, row_id bigint, road string, home string, line double, seq int, seal string"


def _changes(spark, rows):
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SNAP)
    from tidemark.functions.text import normal_double, normal_name

    out = snapshots.snapshot_changes(df, ["sport_key", "season"], "snapshot_label", "snapshot_ts", [normal_name(F.col("road")), normal_name(F.col("home"))], ["road", "home"], [normal_double(F.col("line"))], "row_id")
    return sorted(tuple(r)[2:] for r in out.collect())


def test_snapshot_edges(spark):
    t = [T0 + dt.timedelta(days=i) for i in range(5)]
    nan = float("nan")
    rows = [
        ("g", 1, "a", t[0], 1, " A\t b ", "C", 1.0), ("g", 1, "a", t[0], 2, "a b", "c", nan), ("g", 1, "a", t[0], 3, "x", "y", -0.0), ("g", 1, "a", t[0], 4, None, "y", 1.0),
        ("g", 1, "b", t[1], 5, "A B", "c", None), ("g", 1, "b", t[1], 6, "x", "y", 0.0), ("g", 1, "b", t[1], 6, "x", "y", 0.0),
        ("g", 1, "c", t[2], 7, None, None, 1.0),
        ("g", 1, "d", t[3], 8, "x", "y", 5.0), ("g", 1, "e", t[4], 9, "x", "y", 6.0), ("g", 1, None, t[4], 9, "q", "y", 6.0), (None, None, "n", t[0], 1, "x", "y", 1.0), (None, None, "o", t[1], 2, "x", "y", 2.0),
    ]
    assert _changes(spark, rows) == [("c", "a b", "c", "removed"), ("c", "x", "y", "removed"), ("d", "x", "y", "added"), ("e", "x", "y", "changed"), ("o", "x", "y", "changed")]
    assert _changes(spark, []) == []


FILES = "file_id bigint, sport_key string, season int, delivered_ts timestamp, content string, names string, seq int"


def test_drift_edges(spark):
    def files(*contents):
        return spark.createDataFrame([(i + 1, "g", 1, T0 + dt.timedelta(days=i), c, "n", 0) for i, c in enumerate(contents)], FILES)

    nums = ["line", "linea"]
    args = (["sport_key", "season"], "delivered_ts", nums)
    f = files(
        "road,home,line,linea\na,b,1,2\nc,d,3,4\n", "Road, HOME ,line,new\r\na,b,1,2\r\nc,d,3,9\r\n", "road,home,line,new\na,b,x,NA\nc,d,3,NA\n", "road,home,line,new,dup,dup\na,b,1,q,1,2\n", "road,home,line\n", None, "road,home,line\na,b,NA,extra\n"
    )
    got = {tuple(r) for r in schema_drift.drift_report(f, *args).collect()}
    assert got == {(2, "renamed", "linea", "new"), (3, "retyped", "line", "line"), (4, "retyped", "line", "line"), (4, "retyped", "new", "new"), (4, "added", "", "dup"), (5, "removed", "new", ""), (5, "removed", "dup", "")}
    table = {(r.file_id, r.line_no): r for r in schema_drift.one_table(f, *args).collect()}
    assert len(table) == 8 and table[2, 2].linea == 2.0 and table[3, 2].line is None and "x" in table[3, 2]._rescued and table[4, 2]._rescued == '{"new":"q"}'
    assert "extra" in table[7, 2]._rescued
    none = spark.createDataFrame([], FILES)
    assert schema_drift.drift_report(none, *args).count() == 0 and schema_drift.one_table(none, *args).count() == 0


def test_profile_edges(spark):
    nan = float("nan")
    schema = "sport_key string, season int, load string, ts timestamp, x double, t string, n bigint, median double"
    rows = [("g", 1, "a", T0, v, s, 1, 0.0) for v, s in ((1.0, "Ab1"), (nan, " "), (None, None), (-0.0, "é"), (0.0, "x" * 100_000))] + [("g", 1, "b", T0 + dt.timedelta(days=1), None, None, None, None), ("g", 1, None, T0, 1.0, "a", 1, 0.0)]
    df = spark.createDataFrame(rows, schema)
    p = {r.load: r for r in quality_profile.number_profile(df, ["sport_key", "season"], "load", "ts", ["x"]).collect()}
    assert set(p) == {"a", "b"} and (p["a"].n_rows, p["a"].n_missing, p["a"].n_distinct, p["a"].median, p["b"].n_missing, p["b"].median) == (5, 2, 2, 0.0, 1, None)
    t = {r.load: r for r in quality_profile.text_profile(df, ["sport_key", "season"], "load", "ts", {"t": "[A-Za-z]+"}).collect()}
    assert (t["a"].n_missing, t["a"].n_distinct, t["a"].n_bad, t["a"].n_masks, t["b"].n_missing, t["b"].n_distinct) == (2, 3, 2, 2, 1, 0)
    m = {r.load: r.divergence for r in quality_profile.mask_report(df, ["sport_key", "season"], "load", "ts", {"t": None}).collect()}
    assert m == {"a": None}
    assert quality_profile.number_profile(df.limit(0), ["sport_key", "season"], "load", "ts", ["x"]).count() == 0


def test_mask_divergence(spark):
    schema = "s string, load string, ts timestamp, t string"
    rows = [("g", "a", T0, "Ab"), ("g", "a", T0, "12"), ("g", "b", T0 + dt.timedelta(days=1), "Cd"), ("g", "b", T0 + dt.timedelta(days=1), "Ef"), ("g", "c", T0 + dt.timedelta(days=2), "7")]
    d = {r.load: r.divergence for r in quality_profile.mask_report(spark.createDataFrame(rows, schema), ["s"], "load", "ts", {"t": None}).collect()}
    assert d["a"] is None and abs(d["c"] - 1.0) < 1e-9 and abs(d["b"] - 0.311278) < 1e-5


def test_masks_of_every_column(spark, sf):
    from tidemark.plans import ingestion

    got = ingestion.p5_masks(spark, sf).select("table_name", "column_name", "dominant_mask").distinct().collect()
    seen = {(r.table_name, r.column_name) for r in got}
    assert {("ncaapredictions", c) for c in ("road", "home", "line", "lineopen")} | {("model_ranking_2026", c) for c in ("model_name", "fast_review_flag", "model_mse", "canonical_model_id", "selection_tier")} <= seen
    assert {r.dominant_mask for r in got if r.column_name == "line"} <= {"9.9", "-9.9"}


def test_a_field_beside_its_new_name_is_kept(spark):
    rows = [(1.0, '{"old":"2","older":"3"}'), (None, '{"old":"2","older":"3"}'), (None, '{"older":"3"}'), (1.0, '{"old":"x"}'), (None, '{"old":"2"}')]
    got = [tuple(r) for r in schema_drift.promote(spark.createDataFrame(rows, "line double, _rescued string").coalesce(1), {"old": "line", "older": "line"}).collect()]
    assert got == [(1.0, '{"old":"2","older":"3"}'), (2.0, '{"older":"3"}'), (3.0, None), (1.0, '{"old":"x"}'), (2.0, None)]


def test_a_rename_holds_for_its_stream_only(spark):
    def rows(stream, *contents):
        return [(stream * 10 + i, f"g{stream}", 1, T0 + dt.timedelta(days=i), c, "n", 0) for i, c in enumerate(contents)]

    f = spark.createDataFrame(rows(1, "road,home,linea\na,b,2\n", "road,home,new\na,b,2\n") + rows(2, "road,home,linea,new\na,b,2,7\n") + rows(3, "road,home\na,b\n") + [(90, None, None, T0, "road,home,new\nc,d,5\n", "n", 0)], FILES)
    got = {r.file_id: (r.linea, r.new) for r in schema_drift.one_table(f, ["sport_key", "season"], "delivered_ts", ["linea"]).collect()}
    assert got == {10: (2.0, None), 11: (2.0, None), 20: (2.0, 7.0), 30: (None, None), 90: (None, 5.0)}


def test_number_masks_are_those_of_the_text_form(spark):
    values = [0.0, 1.0, -1.5, 0.001, 0.00099, -0.0001, 9999999.0, 1e7, -1e7, 1e300, 5e-324, float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    x = F.col("x") + F.lit(0.0)
    for r in df.select("x", quality_profile.number_mask(x, False).alias("a"), quality_profile.value_mask(x.cast("string")).alias("b")).collect():
        assert r.a == r.b, r
    n = spark.createDataFrame([(v,) for v in (0, 7, -7, 10**12)], "x bigint")
    for r in n.select(quality_profile.number_mask(F.col("x").cast("double"), True).alias("a"), quality_profile.value_mask(F.col("x").cast("string")).alias("b")).collect():
        assert r.a == r.b


def test_marks_do_not_split_masks(spark):
    assert [r[0] for r in spark.createDataFrame([("हिन्दी में 12",), ("Ábc",)], "x string").select(quality_profile.value_mask(F.col("x"))).collect()] == ["a a 9", "Aa"]


def test_number_masks_count_every_cell(spark):
    nan = float("nan")
    values = [1.0, -1.0, nan, None, 1e9, -1e-9, float("inf"), 0.0, -0.0, 2.5]
    df = spark.createDataFrame([("g", "a" if i % 2 else None, v, i) for v in values for i in (1, 3)] + [("g", "b", None, None)], "s string, load string, x double, k int")
    got = {(r.load, r.column_name, r["mask"]): (r.n, r.lo, r.hi) for r in quality_profile.number_masks(df, ["s"], "load", ["x", "k"]).collect()}
    assert got == {
        ("a", "x", "9.9"): (8, 0.0, 2.5), ("a", "x", "-9.9"): (2, -1.0, -1.0), ("a", "x", ""): (4, None, None), ("a", "x", "9.9A9"): (2, 1e9, 1e9), ("a", "x", "-9.9A-9"): (2, -1e-9, -1e-9), ("a", "x", "Aa"): (2, float("inf"), float("inf")),
        ("a", "k", "9"): (20, 1.0, 3.0), ("b", "x", ""): (1, None, None), ("b", "k", ""): (1, None, None),
    }
