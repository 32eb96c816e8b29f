"""Relations between models: pairwise edge correlation, clusters, effective number, leave-one-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.consensus import DIGITS, EPS, edge
from tidemark.sources import checkpoint


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from sums; null where one side does not vary."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 1e-9) & (vy > 1e-9), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (n * sxy - sx * sy) / F.sqrt(vx * vy))))


def _game_pairs(cell: DataFrame, value: Column) -> DataFrame:
    """game_key, a, b (structs of model and v, a's model first): the pairs of models within each game.

    A game's models meet within the game's own row, whose length is the number of models (the registry's size), so the
    work is games times models squared at most and no model is a hot key of a self-join.
    """
    held = cell.groupBy("game_key").agg(F.sort_array(F.collect_list(F.struct("model", value.alias("v")))).alias("m"))
    first = held.select("game_key", "m", F.posexplode("m").alias("i", "a"))
    return first.select("game_key", "a", F.explode(F.slice("m", F.col("i") + 2, F.greatest(F.size("m") - F.col("i") - 1, F.lit(0)))).alias("b"))


def pairwise_correlation(cell: DataFrame, value: str = "edge", least: int = 30) -> DataFrame:
    """model_a < model_b, shared, r: over the games that both forecast; null where one side does not vary."""
    x = cell.filter(F.col("market").isNotNull()).withColumn("edge", edge(F.col("pred"), F.col("market")))
    both = _game_pairs(x, F.col(value))
    a, b = F.col("a.v"), F.col("b.v")
    s = both.groupBy(F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b")).agg(
        F.count("*").alias("shared"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy")
    )
    r = pearson(F.col("shared"), *(F.col(c) for c in ("sx", "sy", "sxx", "syy", "sxy")))
    return s.filter(F.col("shared") >= least).select("model_a", "model_b", "shared", F.round(r, 6).alias("r"))


def effective_n(cell: DataFrame, corr: DataFrame) -> DataFrame:
    """Per game: n and n^2 over the sum of |r| of its models' pairs (1 with itself, 0 where unknown), within 1 to n."""
    r = corr.select("model_a", "model_b", F.abs(F.coalesce("r", F.lit(0.0))).alias("r"))
    met = _game_pairs(cell, F.lit(0)).select("game_key", F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"))
    off = met.join(r, ["model_a", "model_b"]).groupBy("game_key").agg(F.sum("r").alias("s"))
    n = cell.groupBy("game_key").agg(F.count("*").alias("n"))
    eff = F.col("n") * F.col("n") / (F.col("n") + 2 * F.coalesce("s", F.lit(0.0)))
    return n.join(off, "game_key", "left").select("game_key", "n", F.round(F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), eff)), 6).alias("effective_n"))


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component: connected components, named by their least node.

    Labels travel along the edges and along the labels already found, so the rounds needed grow with the logarithm of
    the longest path; each round is a join by node with its lineage cut. ``edges`` has a and b.
    """
    both = checkpoint(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = nodes.select("node", F.col("node").alias("component"))
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("c"))
        low = label.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("c", "component")).alias("n"))
        jump = low.select(F.col("node").alias("n"), F.col("n").alias("nn"))
        step = checkpoint(low.join(jump, "n", "left").select("node", "component", F.least("n", F.coalesce("nn", "n")).alias("new")))
        label = step.select("node", F.col("new").alias("component"))
        if not step.filter(F.col("new") != F.col("component")).limit(1).count():
            return label
    raise RuntimeError("components did not settle")


def leave_one_out(cell: DataFrame, least: int = 2) -> DataFrame:
    """Per model: games, the consensus' MAE with and without it over its games, and how far the mean moves."""
    sums = cell.groupBy("game_key").agg(F.sum("pred").alias("s"), F.count("*").alias("n"))
    j = cell.filter(F.col("actual").isNotNull()).join(sums.filter(F.col("n") > least), "game_key")
    with_, without = F.round(F.col("s") / F.col("n"), DIGITS), F.round((F.col("s") - F.col("pred")) / (F.col("n") - 1), DIGITS)
    return j.groupBy("model").agg(
        F.count("*").alias("games"),
        F.round(F.avg(F.abs(with_ - F.col("actual"))), 6).alias("mae_with"),
        F.round(F.avg(F.abs(without - F.col("actual"))), 6).alias("mae_without"),
        F.round(F.avg(F.abs(with_ - without)), 6).alias("mean_shift"),
    )


def average_linkage(corr: DataFrame, threshold: float = 0.85, most_models: int = 2000, nodes: DataFrame | None = None) -> DataFrame:
    """model, cluster: average linkage on 1 - r, cut at 1 - threshold; unknown pairs have r 0.

    ``nodes`` (model) are clustered too where no pair of theirs is known. The matrix over models is small and is clustered on the driver; beyond ``most_models`` the call fails.
    """
    import numpy as np

    rows = corr.filter(F.col("r").isNotNull()).collect()
    names = sorted({r.model_a for r in rows} | {r.model_b for r in rows} | ({r.model for r in nodes.collect()} if nodes is not None else set()))
    if len(names) > most_models:
        raise ValueError(f"more than {most_models} models")
    at = {n: i for i, n in enumerate(names)}
    d = np.ones((len(names), len(names)))
    for r in rows:
        d[at[r.model_a], at[r.model_b]] = d[at[r.model_b], at[r.model_a]] = 1 - r.r
    np.fill_diagonal(d, np.inf)
    size, members = np.ones(len(names)), {i: [i] for i in range(len(names))}
    while len(members) > 1:
        i, j = divmod(int(np.argmin(d)), len(names))
        if not d[i, j] <= 1 - threshold + EPS:
            break
        i, j = min(i, j), max(i, j)
        d[i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        size[i] += size[j]
        members[i] += members.pop(j)
    out = [(names[k], names[min(m)]) for m in members.values() for k in m]
    return corr.sparkSession.createDataFrame(out, "model string, cluster string")


def greedy_diverse(ranked: DataFrame, corr: DataFrame, most: int = 12, ceiling: float = 0.9) -> DataFrame:
    """place, model, worst: models by rank, each taken if its |r| to all taken before stays below the ceiling.

    Sequential by nature over the registry's models (some dozens); both inputs are brought to the driver.
    """
    order = [r.model for r in ranked.orderBy("rank").collect()]
    r = {frozenset((x.model_a, x.model_b)): abs(x.r or 0.0) for x in corr.collect()}
    taken: list[tuple[int, str, float]] = []
    for m in order:
        worst = max((r.get(frozenset((m, t)), 0.0) for _, t, _ in taken), default=0.0)
        if worst < ceiling and len(taken) < most:
            taken.append((len(taken) + 1, m, float(worst)))
    return ranked.sparkSession.createDataFrame(taken, "place int, model string, worst double")
