"""Hand-made rows for the panel operators: pushes, zero edges, nulls, repetitions, ties, empty tables."""

from __future__ import annotations

import datetime as dt
import math
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boards, fitted, lines, pairs, search, walkforward
from tidemark.operators import consensus as C
from tidemark.sources import feeds
from tidemark.streaming import snapshots

PANEL = "sport_key string, season int, wk int, game_key string, canonical_model_id string, model_name string, prediction_home_margin double, market_home_margin double, actual_home_margin double, pair_orientation double, selected_source string, road string, home string, loaded_ts timestamp, pred string"
T0 = dt.datetime(2025, 1, 1)


def _panel(spark, rows):
    """rows: game, model, prediction, market, actual, orientation, days."""
    return spark.createDataFrame([("g", 2025, 1, g, m, m, p, k, a, o, "pt_mirror", "r", "h", T0 + dt.timedelta(days=d), "x") for g, m, p, k, a, o, d in rows], PANEL)


def _half_means(seed):
    """100 lists of 16 numbers whose means lie halfway between two numbers of 6 decimals, and the means rounded."""
    rnd, out = random.Random(seed), []
    while len(out) < 100:
        m = [rnd.randint(-30000, 30000) for _ in range(16)]
        if sum(m) % 2:
            out.append(([x / 1000 for x in m], float((Decimal(sum(m)) / 16000).quantize(Decimal("0.000001"), ROUND_HALF_UP))))
    return out


def test_board_means_halfway(spark, tmp_path):
    from tidemark.plans import panel

    sets = _half_means(3)
    rows = [("g", 2025, 1, f"s{i}", f"r{k}", "h", k, 1.0, x) for i, (xs, _) in enumerate(sets) for k, x in enumerate(xs)]
    spark.createDataFrame(rows, "sport_key string, season int, wk int, snapshot_label string, road string, home string, row_id int, line double, linea double").write.parquet(f"{tmp_path}/ncaapredictions.parquet")
    got = {r.snapshot_label: r["mean"] for r in panel.board_long(spark, str(tmp_path)).collect()}
    assert got == {f"s{i}": mean for i, (_, mean) in enumerate(sets)}


def test_weighted_means_halfway(spark):
    sets = _half_means(4)
    rows = [("g", 2025, 1, f"w{i}", f"m{k}", x, 0.0, 0.0) for i, (xs, _) in enumerate(sets) for k, x in enumerate(xs)]
    cell = spark.createDataFrame(rows, "sport_key string, season int, wk int, game_key string, model string, pred double, market double, actual double")
    got = {r.game_key: r.weighted for r in walkforward.inverse_mse(cell).collect()}
    assert got == {f"w{i}": mean for i, (_, mean) in enumerate(sets)}


def test_latest_orientation_and_grades(spark):
    nan = float("nan")
    rows = [
        ("push", "a", 5.0, 3.0, 3.0, None, 0), ("push", "b", 6.0, 3.0, 3.0, 1.0, 0),
        ("zero", "a", 2.0, 3.0, 9.0, 1.0, 0), ("zero", "b", 4.0, 3.0, 9.0, 1.0, 0),
        ("flat", "a", 5.0, 3.0, 9.0, 1.0, 0), ("flat", "b", 5.0, 3.0, 9.0, 1.0, 0),
        ("one", "a", 5.0, 3.0, 9.0, -1.0, 0), ("old", "a", 1.0, 3.0, None, 1.0, 0), ("old", "a", 7.0, 3.0, None, 1.0, 2), ("old", "a", 7.0, 3.0, None, 1.0, 2), ("old", "b", nan, 3.0, None, 1.0, 0),
        ("none", "a", None, 3.0, 4.0, 1.0, 0), (None, "a", 1.0, 1.0, 1.0, 1.0, 0), ("none", None, 1.0, 1.0, 1.0, 1.0, 0), ("nomarket", "a", 1.0, None, 1.0, 1.0, 0), ("nomarket", "b", 2.0, None, 1.0, 1.0, 0),
    ]
    g = {r.game_key: r for r in C.graded(C.consensus(C.cells(_panel(spark, rows)))).collect()}
    assert set(g) == {"push", "zero", "flat", "one", "old", "nomarket"}
    assert (g["push"].grade, g["zero"].grade, g["flat"].grade, g["old"].grade, g["nomarket"].grade) == ("push", "no_bet", "win", None, None)
    assert math.isinf(g["flat"].signal) and g["one"].signal is None and g["one"].mean == -5.0 and g["old"].mean == 7.0 and g["old"].n == 1 and g["zero"].signal == 0
    grid = {r.threshold: r for r in C.threshold_grid(C.graded(C.consensus(C.cells(_panel(spark, rows)))), "signal", [0.0, 1.0, 99.0], keep_empty=True).collect()}
    assert (grid[0.0].wins, grid[0.0].pushes, grid[99.0].wins) == (1, 1, 1)
    empty = C.cells(_panel(spark, []))
    assert C.graded(C.consensus(empty)).count() == 0 and C.robust_consensus(empty).count() == 0 and C.threshold_grid(C.graded(C.consensus(empty)), "signal", [0.0], keep_empty=True).count() == 0


def test_constant_edges_have_no_correlation(spark):
    rows = [(f"g{i}", m, 3.0 + (1 if m == "c" else i * k), 3.0, 4.0, 1.0, 0) for i in range(40) for m, k in (("a", 1.0), ("b", -2.0), ("c", 0.0))]
    cell = C.cells(_panel(spark, rows))
    r = {(x.model_a, x.model_b): x.r for x in pairs.pairwise_correlation(cell).collect()}
    assert r == {("a", "b"): -1.0, ("a", "c"): None, ("b", "c"): None}
    assert pairs.pairwise_correlation(cell.filter("game_key < 'g2'")).count() == 0
    e = {x.effective_n for x in pairs.effective_n(cell, pairs.pairwise_correlation(cell)).collect()}
    assert e == {round(9 / 5, 6)}
    assert {tuple(x) for x in pairs.average_linkage(spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.1)], "model_a string, model_b string, r double"), 0.85).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_components_of_a_long_path(spark):
    n = 40
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(n + 2)], "node string")
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(n - 1)] + [("n040", "n041")], "a string, b string")
    got = {r.node: r.component for r in pairs.components(nodes, edges).collect()}
    assert set(got.values()) == {"n000", "n040"} and got["n039"] == "n000"


def test_priors_never_see_their_own_period(spark):
    rows = [("g", 2025, w, f"g{w}{i}", "m", "m", 10.0 + w, 0.0, 10.0, 1.0, "pt", "r", "h", T0, "x") for w in (1, 2, 3) for i in (0, 1)]
    p = {r.wk: (r.prior_n, r.prior_bias) for r in walkforward.prior_model_stats(C.cells(spark.createDataFrame(rows, PANEL))).collect()}
    assert p == {1: (0, None), 2: (2, 1.0), 3: (4, 1.5)}


def test_sign_test(spark):
    df = spark.createDataFrame([(0, 0), (5, 5), (8, 2), (400, 300)], "w int, l int")
    got = [r[0] for r in df.select(walkforward.sign_test("w", "l")).collect()]
    want = [min(1.0, 2 * sum(math.comb(w + n, i) for i in range(min(w, n) + 1)) / 2 ** (w + n)) for w, n in ((0, 0), (5, 5), (8, 2), (400, 300))]
    assert got == pytest.approx(want)


def test_subset_search_against_plain_python(spark):
    from itertools import combinations

    rng = np.random.default_rng(3)
    rows = [(f"g{g}", m, float(rng.integers(-40, 40)) / 2, 1.5, float(rng.integers(-20, 20)), 1.0, 0) for g in range(30) for m in "abcde" if rng.random() < 0.8]
    cell = C.cells(_panel(spark, rows))
    got = {tuple(r.models): (r.bets, r.wins, r.losses, r.pushes) for r in search.score_subsets(cell, list("abcde"), 2, 3, 0.5, 2).collect()}
    games = {}
    for r in cell.collect():
        games.setdefault((r.game_key, r.market, r.actual), {})[r.model] = r.pred
    for r in (2, 3):
        for c in combinations("abcde", r):
            n = [0, 0, 0, 0]
            for (_, market, actual), p in games.items():
                v = [p[m] for m in c if m in p]
                if len(v) < 2:
                    continue
                e, sd, cover = float(np.mean(v)) - market, float(np.std(v, ddof=1)), actual - market
                if abs(e) < 1e-9 or (sd > 1e-6 and round(abs(e) / sd, 6) < 0.5):
                    continue
                n[0] += 1
                n[3 if cover == 0 else 1 if e * cover > 0 else 2] += 1
            assert got[c] == tuple(n)
    with pytest.raises(ValueError, match="too many"):
        search.score_subsets(cell, list("abcde"), 2, 3, most_subsets=5)


def test_larger_subsets_with_few_models_a_game(spark):
    from itertools import combinations

    rng = np.random.default_rng(7)
    models = [f"m{i}" for i in range(9)]
    rows = [(f"g{g}", m, float(rng.integers(-40, 40)) / 2, 1.5, float(rng.integers(-20, 20)), 1.0, 0) for g in range(60) for i, m in enumerate(models) if rng.random() < 0.9 - 0.08 * i]
    cell = C.cells(_panel(spark, rows))
    games = {}
    for r in cell.collect():
        games.setdefault((r.game_key, r.market, r.actual), {})[r.model] = r.pred
    for least, most, enough in ((3, 6, 3), (4, 7, 4), (2, 5, 3), (3, 4, 2)):
        got = {tuple(r.models): (r.bets, r.wins, r.losses, r.pushes) for r in search.score_subsets(cell, models, least, most, 0.5, enough).collect()}
        assert len(got) == search.subset_count(9, least, most)
        for r in range(least, most + 1):
            for c in combinations(models, r):
                n = [0, 0, 0, 0]
                for (_, market, actual), p in games.items():
                    v = [p[m] for m in c if m in p]
                    if len(v) < enough:
                        continue
                    e, sd, cover = float(np.mean(v)) - market, float(np.std(v, ddof=1)), actual - market
                    if abs(e) < 1e-9 or (sd > 1e-6 and round(abs(e) / sd, 6) < 0.5):
                        continue
                    n[0] += 1
                    n[3 if cover == 0 else 1 if e * cover > 0 else 2] += 1
                assert got[c] == tuple(n)


def test_the_pool_is_as_large_as_the_bound(spark, sf, monkeypatch):
    from tidemark.plans import panel

    n = search.largest_pool(3, 6)
    assert n == 45 and search.subset_count(n, 3, 6) <= 10_000_000 < search.subset_count(n + 1, 3, 6)
    seen = []
    monkeypatch.setattr(panel.search, "score_subsets", lambda c, models, *a: seen.append((len(models), *a)))
    panel._searched_widely(spark, sf)
    assert seen == [(45, 3, 6, 0.75, 3)]


def test_communities_and_meta(spark):
    board = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"]), (3, ["a", "b", "c"]), (4, ["d", "e"])], "rank int, models array<string>")
    com = search.communities(board)
    assert {r["rank"]: r.community for r in com.collect()} == {1: 1, 2: 2, 3: 1, 4: 3}
    rows = [("x", m, v, 0.0, 1.0, 1.0, 0) for m, v in (("a", 1.0), ("b", 3.0), ("d", 5.0), ("e", 5.0))]
    (r,) = search.meta(C.cells(_panel(spark, rows)), com).collect()
    # a and b twice (means 2, spread 2), d and e once (mean 5, spread 0)
    assert (r.communities, r.meta_mean, r.meta_sd) == (2, 3.5, round(math.sqrt((1.0 + 0.0) / 2 + 4.5), 6))


def test_lines_and_regimes(spark):
    schema = "game_key string, sport_key string, season int, wk int, open_margin double, midweek_margin double, close_margin double, actual_home_margin double, pair_orientation double, line double"
    rows = [("a", "g", 1, 1, -12.0, 5.0, 5.0, 1.0, 1.0, 0.0), ("b", "g", 1, 1, None, None, None, None, None, None), ("c", "g", 1, 1, 60.0, 20.0, 20.0, 3.0, -1.0, 0.0), ("c", "g", 1, 1, 60.0, 20.0, 20.0, 3.0, -1.0, 0.0)]
    df = spark.createDataFrame(rows, schema)
    qc = {r.game_key: (r.review, r.suspect) for r in lines.open_line_qc(df).collect()}
    assert qc["a"] == ("large move", "favorite flip") and qc["b"] == ("missing open; missing midweek; missing close", "") and qc["c"][1] == "gross gap; magnitude mismatch; far from stable"
    assert {r.game_key: r.open for r in lines.clean(df).collect()} == {"a": None, "b": None, "c": None}
    assert lines.long_lines(lines.clean(df)).count() == 4
    assert [r[0] for r in spark.createDataFrame([(3.0,), (-3.1,), (28.0,), (None,)], "x double").select(lines.regime(F.col("x"))).collect()] == ["0-3", "3-7", "21-28", "28+"]


def test_slugs_and_matches(spark):
    df = spark.createDataFrame([("N. Texas A&M St.",), (None,), ("",)], "t string")
    assert [tuple(r) for r in df.select(boards.team_slug(F.col("t")), boards.schedule_slug(F.col("t"))).collect()] == [("n texas a and m st", "north texas a and m state"), (None, None), ("", "")]


def test_fitted_forecasts(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(150):
        truth = float(rng.normal(0, 10))
        rows += [(f"g{g}", m, truth + float(rng.normal(0, s)), 0.0, truth, 1.0, 0) for m, s in (("good", 1.0), ("bad", 20.0))]
    cell = C.cells(_panel(spark, rows))
    truth = {r.game_key: r.actual for r in cell.collect()}
    for out, col in ((fitted.ridge_consensus(cell, ["bad", "good"]), "ridge"), (fitted.bayes_consensus(cell, ["bad", "good"], 100.0), "edge")):
        assert np.mean([abs(r[col] - truth[r.game_key]) for r in out.collect()]) < 1.5
    d = fitted.density(cell.filter("game_key = 'g0'")).toPandas()
    assert abs(np.trapezoid(d.density, d["at"]) - 1) < 0.02


def test_feeds(spark, tmp_path):
    (tmp_path / "board_2024.csv").write_text("Home,line,new\n A ,−3.5,x\nB,NA,\n")
    r = feeds.typed(feeds.read_csv_texts(spark, str(tmp_path / "board_2024.csv")), ["line"]).withColumn("season", feeds.season_from_name()).orderBy("Home").collect()
    assert [(x.Home, x.line, x.new, x.season) for x in r] == [("A", -3.5, "x", 2024), ("B", None, None, 2024)]
    p = '{"events":[{"id":"1","date":"2025-09-06T18:00Z","competitions":[{"status":{"type":{"name":"FINAL"}},"broadcasts":[{"names":["N1","N2"]}],"competitors":[{"homeAway":"home","team":{"displayName":"H Owls","location":"H"}},{"homeAway":"away","team":{"displayName":"A Owls"}}]}]},{"id":"2"}]}'
    (e,) = feeds.scoreboard_games(spark.createDataFrame([(p,), ("broken",), (None,)], "payload string")).collect()
    assert (e.event_id, e.away, e.home, e.home_names, e.broadcast, e.status) == ("1", "A Owls", "H Owls", ["H Owls", "H"], "N1, N2", "FINAL")
    m = feeds.length_prefixed(spark.createDataFrame([("3;abc2;xy9;cut",), (None,), ("",)], "content string")).collect()
    assert [(x.pos, x.message) for x in m] == [(0, "abc"), (1, "xy")]
    w = feeds.fixed_width_rows(spark.createDataFrame([("head\n  A   10\r\nB 2\n",)], "page string"), r"\s*(\w+)\s+(\d+)\s*", ["name", "n"]).collect()
    assert [tuple(x) for x in w] == [("A", "10"), ("B", "2")]
    rows = feeds.fingerprint(spark.createDataFrame([("a", None), ("a", ""), ("a", None)], "x string, y string"), ["x", "y"])
    assert feeds.append_new(rows, str(tmp_path / "t"), ["sha"]) == 2 and feeds.append_new(rows, str(tmp_path / "t"), ["sha"]) == 0
    (tmp_path / "broken").mkdir()
    assert feeds.append_new(rows, str(tmp_path / "broken"), ["sha"]) == 2
    (tmp_path / "torn").mkdir()
    (tmp_path / "torn" / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):  # an unreadable target is no empty one
        feeds.append_new(rows, str(tmp_path / "torn"), ["sha"])


def test_snapshot_stream(spark, sf, tmp_path):
    t = spark.read.parquet(f"{sf}/ncaapredictions.parquet").select("row_id", "snapshot_ts", "snapshot_label", "line")
    t.union(t.limit(20)).repartition(2).write.parquet(str(tmp_path / "in"))
    s = snapshots.read_snapshots(spark, str(tmp_path / "in"), t.schema)
    out = snapshots.run_to_table(snapshots.distinct_rows(s, ["row_id"], "snapshot_ts", "400 days"), "seen_rows", str(tmp_path / "cp"))
    assert out.count() == t.select("row_id").distinct().count()


def test_models_without_a_known_pair_stand_alone(spark):
    corr = spark.createDataFrame([("a", "b", 0.9), ("c", "d", None)], "model_a string, model_b string, r double")
    nodes = spark.createDataFrame([(m,) for m in "abcd"], "model string")
    assert {tuple(x) for x in pairs.average_linkage(corr, 0.3, nodes=nodes).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}


def test_board_matrix_of_all_models(spark, sf):
    from tidemark.plans import panel

    b = spark.read.parquet(f"{sf}/ncaapredictions.parquet")
    cols, out = boards.model_columns(b), panel.wide_board_matrix(spark, sf)
    assert len(cols) > 50 and set(out.columns) == {"sport_key", "season", "road", "home", *cols}
    long = boards.wide_to_long(boards.latest_snapshot(boards.board_records(b)), cols)
    assert sum(v is not None for r in out.select(*cols).collect() for v in r) == long.select("sport_key", "season", "road", "home", "board_column").distinct().count()


def test_stable_k_takes_the_worst_of_three_or_falls_back(spark):
    def rows(g, *bets):
        return [(g, i / 4, w, n, 0, x) for i, (w, n, x) in enumerate(bets)]

    p = spark.createDataFrame(
        rows("mean", (30, 10, 0.60), (20, 10, 0.50), (20, 10, 0.10), (12, 6, 0.90), (12, 5, 0.90))  # by means 0.75 would win
        + rows("wide", (20, 10, 0.50), (20, 9, 0.501), (20, 8, 0.505), (20, 7, 0.51), (9, 9, 0.52))
        + rows("thin", (12, 3, 0.5), (3, 1, 0.6), (0, 0, None), (12, 3, 0.4)) + rows("none", (0, 0, None)) + rows("few", (2, 1, 0.2), (1, 2, 0.1), (1, 2, 0.1), (1, 2, 0.1)),
        "g string, threshold double, wins bigint, losses bigint, pushes int, wilson double",
    )
    got = {r.g: (r.k, r.plateau, r.centred) for r in search.stable_k(p, ["g"], 10).collect()}
    assert got == {"mean": (0.25, 0.1, True), "wide": (0.25, 0.5, True), "thin": (0.75, 0.4, False), "few": (0.75, 0.1, False)}


def test_later_seasons_change_no_earlier_fit(spark):
    rnd = np.random.RandomState(3)
    rows = []
    for season in (2023, 2024, 2025):
        for g in range(60):
            actual = float(rnd.normal(0, 10))
            rows += [(f"g{season}_{g}", "s", season, 1, m, actual + float(rnd.normal(0, sd)), 0.0, actual) for m, sd in (("good", 2.0), ("bad", 20.0))]
    schema = "game_key string, sport_key string, season int, wk int, model string, pred double, market double, actual double"
    a = spark.createDataFrame(rows, schema)
    b = spark.createDataFrame([(*r[:5], r[5] * (5 if r[2] == 2025 else 1), r[6], -r[7] if r[2] == 2025 else r[7]) for r in rows], schema)
    for f, col in ((fitted.ridge_consensus, "ridge"), (fitted.bayes_consensus, "edge")):
        of = lambda df: {r.game_key: r[col] for r in f(df, ["bad", "good"], prior=True).collect()}  # noqa: B023, E731
        x, y = of(a), of(b)
        early = [k for k in x if "2025" not in k]
        assert len(x) == 180 and all(x[k] == y[k] for k in early) and any(x[k] != y[k] for k in x)
    ridge = {r.game_key: r.ridge for r in fitted.ridge_consensus(a, ["bad", "good"], least=50, prior=True).collect()}
    assert all(ridge[k] == 0.0 for k in ridge if "2023" in k) and any(abs(ridge[k]) > 1 for k in ridge if "2024" in k)
