"""Market lines of a game at three times: long form, checks, repricing of fixed sides, overlap, migration, movement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import normal_double
from tidemark.operators.consensus import DIGITS, EPS, edge, grade, record, rates

# The three references, and the limits of the check of opening lines.
REFERENCES = ["open", "midweek", "close"]
MOVE, STABLE, BIG_OPEN, SMALL_CLOSE = 10.0, 2.5, 50.0, 25.0


def games(lines: DataFrame) -> DataFrame:
    """game_key, sport_key, season, wk, open, midweek, close, actual: one row per game, in the pair's orientation."""
    own = lines.filter(F.col("game_key").isNotNull())
    sign = F.coalesce("pair_orientation", F.lit(1.0))
    of = lambda c: normal_double(F.col(c))
    picked = own.select("game_key", "sport_key", "season", "wk", *(of(f"{r}_margin").alias(r) for r in REFERENCES), (of("actual_home_margin") * sign).alias("actual"))
    return picked.groupBy("game_key").agg(F.max(F.struct("sport_key", "season", "wk", *REFERENCES, "actual")).alias("r")).select("game_key", "r.*")


def open_line_qc(lines: DataFrame) -> DataFrame:
    """game_key, review, suspect: why a game's opening line needs a look, and why it is not to be trusted; '' for none."""
    g = games(lines)
    o, m, c = F.col("open"), F.col("midweek"), F.col("close")
    gap = F.abs(c - o)
    flags = lambda *xs: F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in xs))), "; ")
    review = flags(("missing open", o.isNull()), ("missing midweek", m.isNull()), ("missing close", c.isNull()), ("large move", gap >= MOVE), ("large open", F.abs(o) >= BIG_OPEN))
    suspect = flags(
        ("favorite flip", (gap >= MOVE) & (F.signum(o) != F.signum(c)) & (F.abs(o) >= STABLE) & (F.abs(c) >= STABLE)),
        ("gross gap", gap >= 3 * MOVE),
        ("magnitude mismatch", (F.abs(o) >= BIG_OPEN) & (F.abs(c) <= SMALL_CLOSE) & (gap >= SMALL_CLOSE)),
        ("far from stable", (F.abs(m - c) <= STABLE) & (F.abs(o - (m + c) / 2) >= 2 * MOVE)),
    )
    return g.select("game_key", review.alias("review"), suspect.alias("suspect"))


def clean(lines: DataFrame) -> DataFrame:
    """Games whose suspect opening lines are null."""
    flags = open_line_qc(lines).select("game_key", (F.col("suspect") != "").alias("bad"))
    return games(lines).join(flags, "game_key").withColumn("open", F.when(~F.col("bad"), F.col("open"))).drop("bad")


def long_lines(wide: DataFrame) -> DataFrame:
    """game_key, sport_key, season, wk, actual, reference, line: a row per game and reference that has a line."""
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("reference"), F.col(r).alias("line")) for r in REFERENCES)))
    return wide.select("game_key", "sport_key", "season", "wk", "actual", each.alias("x")).select("game_key", "sport_key", "season", "wk", "actual", "x.*").filter(F.col("line").isNotNull())


def selections(consensus: DataFrame, wide: DataFrame, k: float = 0.75) -> DataFrame:
    """game_key, reference, line, edge, signal, side (1, -1 or 0), actual: what the consensus picks at every line."""
    from tidemark.operators.consensus import signal

    j = consensus.select("game_key", "mean", "sd").join(long_lines(wide), "game_key")
    e = edge(F.col("mean"), F.col("line"))
    s = j.withColumn("edge", e).withColumn("signal", signal(F.col("edge"), F.col("sd")))
    picked = (F.col("signal") + EPS >= k) & (F.abs(F.col("edge")) >= EPS)
    return s.withColumn("side", F.when(F.coalesce(picked, F.lit(False)), F.signum("edge").cast("int")).otherwise(0))


def reference_performance(sel: DataFrame) -> DataFrame:
    """reference, wins, losses, pushes, ats, wilson: picks graded at their own line."""
    g = sel.filter((F.col("side") != 0) & F.col("actual").isNotNull()).withColumn("grade", grade(F.col("edge"), F.round(F.col("actual") - F.col("line"), DIGITS)))
    return rates(g.groupBy("reference").agg(*record()))


def repricing(sel: DataFrame, wide: DataFrame) -> DataFrame:
    """chosen_at, graded_at, wins, losses, pushes, mean_move: sides frozen at one line and graded at each."""
    picked = sel.filter((F.col("side") != 0) & F.col("actual").isNotNull()).select("game_key", F.col("reference").alias("chosen_at"), F.col("line").alias("chosen_line"), "side", "actual")
    at = picked.join(long_lines(wide).select("game_key", F.col("reference").alias("graded_at"), "line"), "game_key")
    out = F.round(F.col("side") * (F.col("actual") - F.col("line")), DIGITS)
    g = at.withColumn("grade", F.when(F.abs(out) < EPS, "push").when(out > 0, "win").otherwise("loss"))
    return g.groupBy("chosen_at", "graded_at").agg(*record(), F.round(F.avg(F.col("side") * (F.col("line") - F.col("chosen_line"))), 6).alias("mean_move"))


def overlap(sel: DataFrame) -> DataFrame:
    """reference_a, reference_b, both, only_a, only_b, flipped, jaccard: how the picks of two references coincide."""
    per = sel.groupBy("game_key").agg(*(F.coalesce(F.max(F.when(F.col("reference") == r, F.col("side"))), F.lit(0)).alias(r) for r in REFERENCES))
    pairs = [(a, b) for i, a in enumerate(REFERENCES) for b in REFERENCES[i + 1 :]]
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("reference_a"), F.lit(b).alias("reference_b"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs)))
    x = per.select(each.alias("x")).select("x.*")
    a, b = F.col("a") != 0, F.col("b") != 0
    n = x.groupBy("reference_a", "reference_b").agg(
        F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"), F.count_if(a & b & (F.col("a") != F.col("b"))).alias("flipped")
    )
    return n.withColumn("jaccard", F.round(F.try_divide(F.col("both"), F.col("both") + F.col("only_a") + F.col("only_b")), 6))


def migration(sel: DataFrame) -> DataFrame:
    """pattern, games, mean_clv, positive: games by the references that picked them, and the line's move for the first pick.

    A pattern has o, m and c for the references with a pick, - for those without. The move counts from the first to the
    closing line, towards the picked side.
    """
    pick = lambda c: {r: F.max(F.when(F.col("reference") == r, F.col(c))) for r in REFERENCES}
    sides, lines_ = pick("side"), pick("line")
    per = sel.groupBy("game_key").agg(*(F.coalesce(sides[r], F.lit(0)).alias(f"s_{r}") for r in REFERENCES), *(lines_[r].alias(f"l_{r}") for r in REFERENCES))
    pattern = F.concat(*(F.when(F.col(f"s_{r}") != 0, r[0]).otherwise("-") for r in REFERENCES))
    side = F.coalesce(*(F.when(F.col(f"s_{r}") != 0, F.col(f"s_{r}")) for r in REFERENCES))
    at = F.coalesce(*(F.when(F.col(f"s_{r}") != 0, F.col(f"l_{r}")) for r in REFERENCES))
    clv = side * (F.col("l_close") - at)
    out = per.select(pattern.alias("pattern"), clv.alias("clv")).filter(F.col("pattern") != "---")
    return out.groupBy("pattern").agg(F.count("*").alias("games"), F.round(F.avg("clv"), 6).alias("mean_clv"), F.count_if(F.col("clv") > 0).alias("positive"))


def regime(line: Column) -> Column:
    """Closed on the right: how large a line is."""
    a = F.abs(line)
    return F.when(a <= 3, "0-3").when(a <= 7, "3-7").when(a <= 10, "7-10").when(a <= 14, "10-14").when(a <= 21, "14-21").when(a <= 28, "21-28").otherwise("28+")
