"""p2: names, dates, exact search of close vectors, and bets placed on known games."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest

matching = pytest.importorskip("tidemark.llm.matching")
from pyspark.sql import functions as F  # noqa: E402

LINES = "game_key string, sport_key string, season int, wk int, pt_road string, pt_home string, pair_orientation double, open_home_margin_raw double, midweek_home_margin_raw double, close_home_margin_raw double, actual_home_margin double"
PLAN = "sport_key string, season int, away string, home string, game_join_key string, kickoff_utc timestamp, espn_away string, espn_home string, loaded_ts timestamp"
BETS = "bet_id bigint, sport_key string, season int, bet_date string, bet string, win_loss string, profit_1u double, bet_team string, bet_spread double, is_moneyline boolean, team string, score double"


def test_names():
    assert matching.normal_name("W. Oströuth St.") == "west ostrouth state" and matching.normal_name("") == ""
    a = matching.aliases("E. Zelly St.", "East Zelly State", "East Zelly State Kestrels")
    assert a["east zelly state"] == "full" and a["kestrels"] == "nickname" and a["zelly state"] == "part" and a["ezsu"] == "letters"
    assert matching.aliases("Kessden", None, None)["kes"] == "letters"


def test_dates(spark):
    cases = {"9/1/25": (2025, 9, 1), "09/15/2021": (2021, 9, 15), "2025-09-19": (2025, 9, 19), "21-Oct": (2025, 10, 21), "Jan 3": (2026, 1, 3), "Sept 2": (2025, 9, 2), "": None, "soon": None, "2/30/25": None, None: None}
    df = spark.createDataFrame([(k, 2025) for k in cases], "t string, s int")
    got = [r[0] for r in df.select(matching.typed_date(F.col("t"), F.col("s"))).collect()]
    assert got == [dt.date(*v) if v else None for v in cases.values()]


def test_search_finds_all_close_vectors(spark):
    rnd = random.Random(5)
    names = sorted({"".join(rnd.choices("abcdeo", k=rnd.randint(5, 9))) for _ in range(60)})
    said = sorted({n[:i] + n[i + 1 :] for n in names for i in (2, 4)} | set(names))
    m = spark.createDataFrame([("g", 1, s) for s in said], "sport_key string, season int, mention string")
    t = spark.createDataFrame([("g", 1, n, n, None) for n in names], "sport_key string, season int, team string, schedule_name string, espn_name string")
    got = {(r.mention, r.team) for r in matching.close_names(m, t).filter("kind = 'full'").collect()}
    ones = lambda v: sum(map(int.bit_count, v))
    for s, n in itertools.product(said, names):
        a, b = matching.bit_vector(s), matching.bit_vector(n)
        apart, dice = ones([x ^ y for x, y in zip(a, b)]), 2 * ones([x & y for x, y in zip(a, b)]) / (ones(a) + ones(b))
        if apart <= matching.RADIUS and dice >= matching.LEAST_DICE:
            assert (s, n) in got


def test_search_keeps_swaps_in_short_names(spark):
    want = {("Ulmahm", "Ulmham"), ("Tovrton", "Torvton"), ("Osrty", "Ostry")}
    m = spark.createDataFrame([("g", 1, s) for s, _ in want], "sport_key string, season int, mention string")
    t = spark.createDataFrame([("g", 1, n, n, None) for _, n in want], "sport_key string, season int, team string, schedule_name string, espn_name string")
    assert want <= {(r.mention, r.team) for r in matching.close_names(m, t).filter("kind = 'full'").collect()}


def _season(spark):
    teams = [f"{a}{b}" for a in ("Hest", "Vel", "Ruddw", "Garv", "Nimm", "Tarv") for b in ("ouston", "marrick", "ick", "ingo")]
    rnd = random.Random(1)
    lines, plan = [], []
    for wk in range(1, 9):
        order = teams[:]
        rnd.shuffle(order)
        for i in range(0, len(order), 2):
            r, h = order[i], order[i + 1]
            line, key = rnd.randint(-40, 40) / 2, f"w{wk}_{r}_{h}"
            lines.append((key, "g", 2025, wk, r, h, 1.0, line + 0.5, line, line, line + rnd.choice([-7.0, 8.0])))
            plan.append(("g", 2025, r, h, key, dt.datetime(2025, 9, 6, 18) + dt.timedelta(days=7 * (wk - 1)), f"{r} Owls", f"{h} Owls", dt.datetime(2025, 8, 1)))
    return spark.createDataFrame(lines, LINES), spark.createDataFrame(plan, PLAN), lines


def test_bets_find_their_games(spark):
    lines, plan, rows = _season(spark)
    bets, want = [], {}
    for i, (key, _, _, wk, road, home, _, _, _, line, actual) in enumerate(rows[:80]):
        won = line + (-line) is not None and actual - line
        day = dt.date(2025, 9, 4) + dt.timedelta(days=7 * (wk - 1))
        name = home if i % 3 else home[:2] + home[3:]
        bets.append((i, "g", 2025, day.isoformat() if i % 7 else f"{day.month}/{day.day}/25", f"{name} {-line:+}", "W" if won > 0 else "L", None, None, None, None, "x", 0.0))
        want[i] = key
    bets.append((900, "g", 2025, "2025-01-01", "Nobody Known -3", "W", None, None, None, None, "x", 0.0))
    bets.append((901, None, None, None, None, None, None, None, None, None, None, None))
    bets.append(bets[0])
    df = spark.createDataFrame(bets, BETS)
    got = {r.bet_id: r for r in matching.match(df, df.limit(0), lines, plan).collect()}
    right = sum(got[k].game_key == v and got[k].confidence > 0.5 for k, v in want.items() if k in got)
    assert right >= 76 and 900 not in got and 901 not in got and all(0 <= r.confidence <= 1 for r in got.values())
    assert matching.match(df.limit(0), df.limit(0), lines, plan).count() == 0
    assert matching.match(df, df.limit(0), lines.limit(0), plan.limit(0)).count() == 0


def test_no_table_is_gathered_in_the_driver(spark):
    lines, plan, rows = _season(spark)
    df = spark.createDataFrame([(i, "g", 2025, "9/1/25", f"{r[5]} -3 (opp. {r[4]})", "W", None, None, None, None, "x", 0.0) for i, r in enumerate(rows[:5])], BETS)
    sides = matching.games(lines, plan)
    mentions = df.select("sport_key", "season", F.regexp_extract("bet", r"^(\w+)", 1).alias("mention"))
    for made in (matching.close_names(mentions, sides), matching.candidates(matching.parsed_bets(df, df.limit(0)), sides), matching.match(df, df.limit(0), lines, plan)):
        assert made.count() and made.collect()
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_codes_stand_for_levels():
    assert all(set(matching.START[f]) <= set(matching.LEVELS[f]) for f in matching.FIELDS)
    assert matching.levels_of(0) == ("full", "none", "none", "none", "none")
    assert matching.levels_of(((((4 * 4 + 1) * 11 + 3) * 10 + 9) * 3 + 2) * 2 + 1) == ("nickname~", "same", "0", "far", "other")
