"""Periods, folds and what was known before each period.

Priors come from sums per model and period, cumulated over strictly earlier periods: a small table, windowed by model.
No period is looped over on the driver.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.consensus import DIGITS, edge, settled

PERIOD = ["sport_key", "season", "wk"]


def period_coverage(cell: DataFrame, least: int = 1) -> DataFrame:
    """sport_key, season, wk, period, games, models, scorable: the periods of each sport in order, from 1."""
    g = cell.groupBy(*PERIOD).agg(
        F.count_distinct("game_key").alias("games"),
        F.count_distinct("model").alias("models"),
        F.count_distinct(F.when(F.col("market").isNotNull() & F.col("actual").isNotNull(), F.col("game_key"))).alias("scorable"),
    )
    w = Window.partitionBy("sport_key").orderBy("season", "wk")
    return g.filter(F.col("scorable") >= least).withColumn("period", F.row_number().over(w))


def folds(periods: DataFrame, blocks: int, size: int, discovery: int) -> DataFrame:
    """sport_key, fold, role, season, wk: the last ``blocks`` blocks of ``size`` periods, each after all periods before it.

    A sport with fewer than ``discovery`` periods before its first block has fewer blocks.
    """
    w = Window.partitionBy("sport_key")
    p = periods.withColumn("total", F.max("period").over(w))
    n = F.greatest(F.lit(0), F.least(F.lit(blocks), F.floor((F.col("total") - discovery) / F.lit(size)).cast("int")))
    p = p.withColumn("n", n).filter(F.col("n") > 0)
    p = p.withColumn("fold", F.explode(F.sequence(F.lit(1), F.col("n"))))
    start = F.col("total") - (F.col("n") - F.col("fold") + 1) * size
    role = F.when(F.col("period") <= start, "discovery").when(F.col("period") <= start + size, "validation")
    return p.withColumn("role", role).filter(F.col("role").isNotNull()).select("sport_key", "fold", "role", "season", "wk", "period")


def prior_model_stats(cell: DataFrame) -> DataFrame:
    """sport_key, season, wk, model, prior_n, prior_bias, prior_mse, prior_mae: each model's errors before each period."""
    err = F.round(F.col("pred") - F.col("actual"), DIGITS)
    sums = cell.groupBy(*PERIOD, "model").agg(
        F.count("actual").alias("n"), F.coalesce(F.sum(err), F.lit(0.0)).alias("e"), F.coalesce(F.sum(err * err), F.lit(0.0)).alias("ee"), F.coalesce(F.sum(F.abs(err)), F.lit(0.0)).alias("ae")
    )
    w = Window.partitionBy("sport_key", "model").orderBy("season", "wk").rowsBetween(Window.unboundedPreceding, -1)
    s = sums.select(*PERIOD, "model", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"p{c}") for c in ("n", "e", "ee", "ae")))
    of = lambda c: F.round(F.try_divide(F.col(c), F.col("pn")), 6)
    return s.select(*PERIOD, "model", F.col("pn").cast("bigint").alias("prior_n"), of("pe").alias("prior_bias"), of("pee").alias("prior_mse"), of("pae").alias("prior_mae"))


def bias_corrected(cell: DataFrame, shrink: float = 200.0) -> DataFrame:
    """Per game: the mean of predictions less each model's prior bias, shrunk by n / (n + shrink)."""
    prior = prior_model_stats(cell)
    adj = F.col("pred") - F.coalesce(F.col("prior_bias") * F.col("prior_n") / (F.col("prior_n") + shrink), F.lit(0.0))
    return cell.join(prior, [*PERIOD, "model"]).groupBy("game_key").agg(F.count("*").alias("n"), F.round(F.avg(adj), 6).alias("bias_corrected"))


def inverse_mse(cell: DataFrame, least: int = 20, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Per game: predictions weighted by 1 / prior MSE relative to the game's mean weight, within low to high.

    A model with fewer than ``least`` earlier errors has the weight 1.
    """
    prior = prior_model_stats(cell)
    j = cell.join(prior, [*PERIOD, "model"]).withColumn("inv", F.when((F.col("prior_n") >= least) & (F.col("prior_mse") > 0), 1.0 / F.col("prior_mse")))
    mean = j.groupBy("game_key").agg(F.avg("inv").alias("m"))
    rel = F.when(F.col("inv").isNull(), 1.0).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.col("inv") / F.col("m"))))
    w = j.join(mean, "game_key").withColumn("w", rel)
    return w.groupBy("game_key").agg(F.count("*").alias("n"), settled(F.sum(F.col("w") * F.col("pred")) / F.sum("w")).alias("weighted"))


def market_lambda(games: DataFrame, least: int = 30, most: float = 1.5) -> DataFrame:
    """sport_key, season, wk, prior_games, lam: the no-intercept slope of cover on edge over earlier periods, 0 to ``most``.

    1 where fewer than ``least`` games came before or none had an edge. ``games`` has edge and cover.
    """
    ok = F.col("edge").isNotNull() & F.col("cover").isNotNull()
    sums = games.groupBy(*PERIOD).agg(F.count_if(ok).alias("n"), F.coalesce(F.sum(F.when(ok, F.col("edge") * F.col("cover"))), F.lit(0.0)).alias("xy"), F.coalesce(F.sum(F.when(ok, F.col("edge") * F.col("edge"))), F.lit(0.0)).alias("xx"))
    w = Window.partitionBy("sport_key").orderBy("season", "wk").rowsBetween(Window.unboundedPreceding, -1)
    s = sums.select(*PERIOD, *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"p{c}") for c in ("n", "xy", "xx")))
    fit = F.greatest(F.lit(0.0), F.least(F.lit(most), F.col("pxy") / F.col("pxx")))
    return s.select(*PERIOD, F.col("pn").cast("bigint").alias("prior_games"), F.round(F.when((F.col("pn") >= least) & (F.col("pxx") > 1e-12), fit).otherwise(1.0), 6).alias("lam"))


def market_anchored(games: DataFrame) -> DataFrame:
    """Per sport and season: n, alpha, beta, gamma of actual = alpha + beta market + gamma (mean - market), from sums.

    The three normal equations are solved in closed form; null where they have no single solution.
    """
    ok = games.filter(F.col("edge").isNotNull() & F.col("cover").isNotNull())
    m, e, y = F.col("market"), F.col("edge"), F.col("actual")
    s = ok.groupBy("sport_key", "season").agg(
        F.count("*").alias("n"), *(F.avg(c).alias(k) for k, c in {"m": m, "e": e, "y": y, "mm": m * m, "ee": e * e, "me": m * e, "my": m * y, "ey": e * y}.items())
    )
    c = F.col
    smm, see, sme = c("mm") - c("m") * c("m"), c("ee") - c("e") * c("e"), c("me") - c("m") * c("e")
    smy, sey = c("my") - c("m") * c("y"), c("ey") - c("e") * c("y")
    det = smm * see - sme * sme
    ok_ = (c("n") >= 11) & (det > 1e-9)
    beta, gamma = (smy * see - sey * sme) / det, (sey * smm - smy * sme) / det
    out = s.withColumn("b", F.when(ok_, beta)).withColumn("g", F.when(ok_, gamma))
    return out.select("sport_key", "season", "n", F.round(c("y") - c("b") * c("m") - c("g") * c("e"), 5).alias("alpha"), F.round("b", 5).alias("beta"), F.round("g", 5).alias("gamma"))


def incremental_rank(cell: DataFrame, least: int = 25) -> DataFrame:
    """model, n, r, score, rank: correlation of a model's edge with the cover, shrunk by sqrt(n / (n + 50))."""
    from tidemark.operators.pairs import pearson

    x, y = edge(F.col("pred"), F.col("market")), F.round(F.col("actual") - F.col("market"), DIGITS)
    ok = cell.filter(F.col("market").isNotNull() & F.col("actual").isNotNull()).select("model", x.alias("x"), y.alias("y"))
    s = ok.groupBy("model").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    r = F.round(pearson(F.col("n"), *(F.col(k) for k in ("sx", "sy", "sxx", "syy", "sxy"))), 6)
    scored = s.filter(F.col("n") >= least).select("model", "n", r.alias("r")).withColumn("score", F.round(F.col("r") * F.sqrt(F.col("n") / (F.col("n") + 50.0)), 5))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc_nulls_last(), "model")))


def _binomial_p(w: int, n: int) -> float:
    k, t = min(w, n), w + n
    logs = (math.lgamma(t + 1) - math.lgamma(i + 1) - math.lgamma(t - i + 1) - t * math.log(2) for i in range(k + 1))
    return min(1.0, 2 * math.fsum(map(math.exp, logs)))


@F.pandas_udf(T.DoubleType())
def sign_test(wins: pd.Series, losses: pd.Series) -> pd.Series:
    """Two-sided exact sign test of wins against losses, by the sum of binomial terms."""
    return pd.Series([_binomial_p(int(w), int(n)) for w, n in zip(wins, losses, strict=True)])
