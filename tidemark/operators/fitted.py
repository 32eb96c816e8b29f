"""Consensus forecasts with fitted weights: ridge, Bayes, and a density over a grid.

Sums over the panel are taken in Spark; only matrices over models, of the registry's size, are solved in NumPy.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.consensus import DIGITS, GAME, edge


def _pairs(cell: DataFrame, models: Sequence[str], value: Column) -> DataFrame:
    """season, a, b: the ordered pairs of models within each game, as structs of model and v."""
    held = cell.filter(F.col("model").isin(list(models))).groupBy("game_key", "season").agg(F.collect_list(F.struct("model", value.alias("v"))).alias("m"))
    return held.select("season", "m", F.explode("m").alias("a")).select("season", "a", F.explode("m").alias("b"))


class Moments(NamedTuple):
    """Sums over games: products of the models' edges, products with the cover, and the number of games."""

    gram: np.ndarray
    right: np.ndarray
    n: int


def edge_moments(cell: DataFrame, models: Sequence[str]) -> dict[int, Moments]:
    """Each season's sums; a missing edge is 0. The collected tables have seasons times models squared rows at most."""
    x = cell.filter(F.col("market").isNotNull() & F.col("actual").isNotNull() & F.col("model").isin(list(models)))
    x = x.withColumn("x", edge(F.col("pred"), F.col("market"))).withColumn("y", F.round(F.col("actual") - F.col("market"), DIGITS))
    n = {r.season: r.n for r in x.groupBy("season").agg(F.count_distinct("game_key").alias("n")).collect()}
    gram = _pairs(x, models, F.col("x")).groupBy("season", F.col("a.model").alias("i"), F.col("b.model").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("g")).collect()
    right = x.groupBy("season", "model").agg(F.sum(F.col("x") * F.col("y")).alias("r")).collect()
    at, k = {m: i for i, m in enumerate(models)}, len(models)
    out = {s: Moments(np.zeros((k, k)), np.zeros(k), n[s]) for s in n}
    for row in gram:
        out[row.season].gram[at[row.i], at[row.j]] = row.g
    for row in right:
        out[row.season].right[at[row.model]] = row.r
    return out


def ridge_consensus(cell: DataFrame, models: Sequence[str], alpha: float = 10.0, least: int = 100, prior: bool = False) -> DataFrame:
    """Per game: the market plus the ridge-weighted edges; the market alone with fewer than ``least`` games to fit.

    With ``prior`` a season's weights are fitted on the seasons before it alone, else one fit is made on all games.
    """
    by = edge_moments(cell, models)
    rows, known = [], sorted(by)
    for s in known:
        fit = [by[x] for x in known if x < s or not prior]
        n = sum(m.n for m in fit)
        w = np.linalg.solve(sum(m.gram for m in fit) + alpha * np.eye(len(models)), sum(m.right for m in fit)) if n >= max(least, 1) else np.zeros(len(models))
        rows += [(s, m, float(v)) for m, v in zip(models, w, strict=True)]
    table = cell.sparkSession.createDataFrame(rows, "season int, model string, weight double")
    x = cell.filter(F.col("market").isNotNull() & F.col("model").isin(list(models))).join(F.broadcast(table), ["season", "model"], "left")
    return x.groupBy(*GAME, "market").agg(F.round(F.col("market") + F.coalesce(F.sum(F.col("weight") * (F.col("pred") - F.col("market"))), F.lit(0.0)), 6).alias("ridge"))


def error_covariance(cell: DataFrame, models: Sequence[str], shrink: float = 0.35, least: int = 30, prior: bool = False) -> dict[int, np.ndarray]:
    """For each season the covariance of the models' errors, off-diagonal shrunk, eigenvalues kept above a floor.

    Pairs with fewer than ``least`` shared games count as unrelated, and a model with fewer has the mean variance of the
    others. With ``prior`` a season's matrix comes from the seasons before it alone, else from all.
    """
    x = cell.filter(F.col("actual").isNotNull()).withColumn("e", F.round(F.col("pred") - F.col("actual"), DIGITS))
    a, b = F.col("a.v"), F.col("b.v")
    sums = _pairs(x, models, F.col("e")).groupBy("season", F.col("a.model").alias("i"), F.col("b.model").alias("j")).agg(F.count("*").alias("n"), F.sum(a * b).alias("ab"), F.sum(a).alias("sa"), F.sum(b).alias("sb")).collect()
    at, k = {m: i for i, m in enumerate(models)}, len(models)
    seasons = sorted({r.season for r in cell.select("season").distinct().collect() if r.season is not None})
    of = {s: np.zeros((4, k, k)) for s in seasons}
    for r in sums:
        of[r.season][:, at[r.i], at[r.j]] = r.n, r.ab, r.sa, r.sb
    out = {}
    for s in seasons:
        n, ab, sa, sb = sum((of[x] for x in seasons if x < s or not prior), np.zeros((4, k, k)))
        with np.errstate(divide="ignore", invalid="ignore"):
            cov = np.where((n >= least) & (n > 1), (ab - sa * sb / n) / (n - 1), 0.0)
        spread = np.diag(cov).copy()
        cov = cov * (1 - shrink)
        cov[np.diag_indices(k)] = np.where(spread > 0, spread, spread[spread > 0].mean() if (spread > 0).any() else 1.0)
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        out[s] = vectors @ np.diag(np.maximum(values, 1e-6 * max(values.max(initial=1.0), 1.0))) @ vectors.T
    return out


def bayes_consensus(cell: DataFrame, models: Sequence[str], prior_sd: float = 7.0, prior: bool = False) -> DataFrame:
    """Per game: posterior edge and its spread from the available models' edges under their error covariance.

    Games with the same available models share one matrix; they are worked on together, by Arrow batches. ``prior`` is as
    in error_covariance.
    """
    cov = error_covariance(cell, models, prior=prior)
    at = {m: i for i, m in enumerate(models)}
    x = cell.filter(F.col("market").isNotNull() & F.col("season").isNotNull() & F.col("model").isin(list(models)))
    held = x.groupBy("game_key", "season", "market").agg(F.array_sort(F.collect_list(F.struct("model", "pred"))).alias("m"))

    def solve(batches):
        import pandas as pd

        for pdf in batches:
            known: dict[tuple, tuple[np.ndarray, float]] = {}  # of one batch, so that it stays small
            out = []
            for key, season, market, cells_ in zip(pdf["game_key"], pdf["season"], pdf["market"], pdf["m"], strict=True):
                ids = tuple(at[c["model"]] for c in cells_)
                if (season, ids) not in known:
                    inv = np.linalg.inv(cov[season][np.ix_(ids, ids)])
                    known[season, ids] = inv.sum(axis=0), 1 / (1 / prior_sd**2 + inv.sum())
                weights, var = known[season, ids]
                d = np.array([c["pred"] for c in cells_]) - market
                out.append((key, round(float(var * (weights @ d)), 6), round(float(np.sqrt(var)), 6)))
            yield pd.DataFrame(out, columns=["game_key", "edge", "sd"])

    return held.mapInPandas(solve, "game_key string, edge double, sd double")


def density(cell: DataFrame, steps: int = 61, width: float = 4.0) -> DataFrame:
    """Per game: at, density of a Gaussian kernel estimate over mean +- width * sd, with Scott's bandwidth; from two models."""
    s = cell.groupBy("game_key").agg(F.count("*").alias("n"), F.avg("pred").alias("m"), F.stddev_samp("pred").alias("sd"), F.collect_list("pred").alias("p")).filter((F.col("n") > 1) & (F.col("sd") > 1e-9))
    s = s.withColumn("h", F.col("sd") * F.pow("n", F.lit(-0.2)))
    grid = s.select("game_key", "n", "m", "sd", "h", "p", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"))
    at = F.col("m") + F.col("sd") * width * (2.0 * F.col("i") / (steps - 1) - 1)
    grid = grid.withColumn("at", at)
    d = F.aggregate(F.transform("p", lambda x: F.exp(-F.pow((F.col("at") - x) / F.col("h"), 2) / 2)), F.lit(0.0), lambda a, b: a + b)
    return grid.select("game_key", F.round("at", 6).alias("at"), F.round(d / (F.col("n") * F.col("h") * float(np.sqrt(2 * np.pi))), 9).alias("density"))
