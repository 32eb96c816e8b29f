"""Canonical panel, per-game consensus, signals and grades.

A panel has one row per game, model and load. Everything here is one shuffle by game (or by game and model) with partial
aggregation; no step pivots to a wide matrix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import normal_double

# Below EPS an edge or a cover is none; decimals kept of a mean before it is compared.
EPS = 1e-12
DIGITS = 9
MARGINS = ["prediction_home_margin", "market_home_margin", "actual_home_margin", "pair_orientation"]
GAME = ["game_key", "sport_key", "season", "wk"]


def latest_panel(panel: DataFrame) -> DataFrame:
    """One row per game and model: the last loaded; of equal times the one with the greatest values.

    Rows without game or model are left out; NaN is null.
    """
    rest = [*MARGINS, "selected_source", "sport_key", "season", "wk", "model_name", "road", "home"]
    clean = panel.filter(F.col("game_key").isNotNull() & F.col("canonical_model_id").isNotNull()).select(
        "game_key", "canonical_model_id", "loaded_ts", *(normal_double(F.col(c)).alias(c) if c in MARGINS else F.col(c) for c in rest)
    )
    return clean.groupBy("game_key", "canonical_model_id").agg(F.max(F.struct("loaded_ts", *rest)).alias("r")).select("game_key", "canonical_model_id", "r.*")


def oriented(latest: DataFrame) -> DataFrame:
    """With pred, market and actual: the home margins times the pair's orientation, which is 1 where it is missing."""
    sign = F.coalesce("pair_orientation", F.lit(1.0))
    return latest.select("*", *((F.col(f"{a}_home_margin") * sign).alias(b) for a, b in (("prediction", "pred"), ("market", "market"), ("actual", "actual"))))


def game_reference(rows: DataFrame, first_source: str = "pt") -> DataFrame:
    """One row per game: its most frequent season and week, and median market and actual, of the first source if it has any."""
    first = F.col("selected_source").startswith(first_source)
    of = lambda c: F.coalesce(F.median(F.when(first, F.col(c))), F.median(c)).alias(c)
    return rows.groupBy("game_key").agg(F.min("sport_key").alias("sport_key"), F.mode("season", True).alias("season"), F.mode("wk", True).alias("wk"), of("market"), of("actual"))


def cells(panel: DataFrame) -> DataFrame:
    """game_key, sport_key, season, wk, model, pred, market, actual: the canonical cells with a prediction."""
    rows = oriented(latest_panel(panel))
    ref = game_reference(rows)
    own = rows.filter(F.col("pred").isNotNull()).select("game_key", F.col("canonical_model_id").alias("model"), "pred")
    return own.join(ref, "game_key").select(*GAME, "model", "pred", "market", "actual")


def consensus(cell: DataFrame, least: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Per game: n, mean, median, sd of the predictions with market and actual; games with fewer than ``least`` are left out."""
    return (
        cell.groupBy(*GAME, "market", "actual", *by)
        .agg(F.count("*").alias("n"), F.round(F.avg("pred"), DIGITS).alias("mean"), F.round(F.median("pred"), DIGITS).alias("median"), F.round(F.stddev_samp("pred"), DIGITS).alias("sd"))
        .filter(F.col("n") >= least)
    )


def robust_consensus(cell: DataFrame, fraction: float = 0.1, median_weight: float = 0.5) -> DataFrame:
    """Per game: n, winsorised mean (clipped to the quantiles from three models on), hybrid with the median, and raw MAD."""
    q = cell.groupBy("game_key").agg(F.percentile("pred", [fraction, 0.5, 1 - fraction]).alias("q"), F.count("*").alias("n"))
    j = cell.join(q, "game_key").withColumn("clipped", F.when(F.col("n") >= 3, F.least(F.greatest("pred", F.col("q")[0]), F.col("q")[2])).otherwise(F.col("pred")))
    agg = j.groupBy("game_key").agg(F.first("n").alias("n"), F.avg("clipped").alias("w"), F.first(F.col("q")[1]).alias("m"), F.median(F.abs(F.col("pred") - F.col("q")[1])).alias("mad"))
    return agg.select("game_key", "n", F.round("w", 6).alias("winsorized"), F.round(median_weight * F.col("m") + (1 - median_weight) * F.col("w"), 6).alias("hybrid"), F.round("mad", 6).alias("mad"))


def settled(c: Column, digits: int = 6) -> Column:
    """A mean rounded half up, alike in whatever order it was summed: what the order leaves open lies beyond 12 decimals."""
    return F.round(F.round(c, 12), digits)


def edge(forecast: Column, market: Column) -> Column:
    return F.round(forecast - market, DIGITS)


def signal(edge_: Column, sd: Column) -> Column:
    """Edge in standard deviations; without spread it is infinite for any edge and 0 for none."""
    return F.when(sd.isNull() | edge_.isNull(), None).when(sd > EPS, F.abs(edge_) / sd).when(F.abs(edge_) > EPS, F.lit(float("inf"))).otherwise(0.0)


def grade(edge_: Column, cover: Column) -> Column:
    """no_bet, push, win or loss; null without an edge or a cover."""
    return (
        F.when(edge_.isNull() | cover.isNull(), None)
        .when(F.abs(edge_) < EPS, "no_bet")
        .when(F.abs(cover) < EPS, "push")
        .when(edge_ * cover > 0, "win")
        .otherwise("loss")
    )


def graded(games: DataFrame, forecast: str = "mean") -> DataFrame:
    """Consensus games with edge, cover, signal and grade."""
    g = games.withColumn("edge", edge(F.col(forecast), F.col("market"))).withColumn("cover", F.round(F.col("actual") - F.col("market"), DIGITS))
    return g.withColumn("signal", signal(F.col("edge"), F.col("sd"))).withColumn("grade", grade(F.col("edge"), F.col("cover")))


def agreement(cell: DataFrame) -> DataFrame:
    """Per game: the share of models on the consensus' side of the market, null without an edge."""
    mean = cell.groupBy("game_key").agg(F.round(F.avg("pred"), DIGITS).alias("mean"))
    j = cell.filter(F.col("market").isNotNull()).join(mean, "game_key")
    side = F.signum(F.col("mean") - F.col("market"))
    same = (F.signum(F.round(F.col("pred") - F.col("market"), DIGITS)) == F.signum(F.round(F.col("mean") - F.col("market"), DIGITS))).cast("double")
    return j.groupBy("game_key").agg(F.round(F.avg(F.when(F.abs(F.col("mean") - F.col("market")) > EPS, same)), 6).alias("agreement"), F.max(side.cast("int")).alias("side"))


def wilson_lower(wins: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """Lower end of the Wilson interval of a win rate; null without trials."""
    p = wins / F.nullif(n, F.lit(0))
    return (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def record(where: Column | None = None) -> list[Column]:
    """Aggregates of graded rows: bets, wins, losses, pushes; ``where`` limits the rows that count as bets."""
    keep = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    n = lambda g: F.count_if(keep & (F.col("grade") == g))
    return [n("win").alias("wins"), n("loss").alias("losses"), n("push").alias("pushes")]


def rates(df: DataFrame) -> DataFrame:
    """With ats (wins over wins and losses) and its Wilson lower end, rounded."""
    n = F.col("wins") + F.col("losses")
    return df.withColumn("ats", F.round(F.try_divide(F.col("wins"), n), 6)).withColumn("wilson", F.round(F.when(n > 0, wilson_lower(F.col("wins"), n.cast("double"))), 6))


def threshold_grid(rows: DataFrame, column: str, grid: Sequence[float], by: Sequence[str] = (), keep_empty: bool = False) -> DataFrame:
    """The record at every threshold of ``column``: one pass that keeps all thresholds' counts, no row is multiplied.

    Rows are first counted by how many thresholds they reach; the counts are then summed from above. ``keep_empty``
    gives thresholds without bets as zeros for every group that has rows.
    """
    steps = sorted(grid)
    reached = sum((F.when(F.col(column) + EPS >= t, 1).otherwise(0) for t in steps), F.lit(0))
    counted = rows.filter(F.col("grade").isNotNull() & (F.col("grade") != "no_bet")).groupBy(*by, reached.alias("_r")).agg(*record())
    spread = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.lit(i + 1).alias("_i")) for i, t in enumerate(steps))))
    at = counted.select(*by, "_r", "wins", "losses", "pushes", spread.alias("_s")).select(*by, "_r", "wins", "losses", "pushes", "_s.*")
    total = at.groupBy(*by, "threshold").agg(*(F.sum(F.when(F.col("_r") >= F.col("_i"), F.col(c)).otherwise(0)).alias(c) for c in ("wins", "losses", "pushes")))
    return rates(total if keep_empty else total.filter(F.col("wins") + F.col("losses") + F.col("pushes") > 0))


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """With cum (running sum), peak (its highest so far, 0 at least) and drawdown (cum - peak)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    c = df.withColumn("cum", F.sum(value).over(w))
    return c.withColumn("peak", F.greatest(F.lit(0).cast("bigint"), F.max("cum").over(w))).withColumn("drawdown", F.col("cum") - F.col("peak"))
