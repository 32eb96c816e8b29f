"""Exhaustive search over model subsets, their overlap communities, and the ensemble of ensembles.

A game has few of the models, so a subset's bet there depends on few of its members. A kernel scores what a game has and
splits it, by inclusion and exclusion, into shares of which a subset's record is the sum over its own parts. Every model
is a task with the subsets in which it comes first; games are sent to their models, subsets never are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.consensus import DIGITS, EPS, GAME, rates

#: Cells that the kernel holds at once, and subsets in a batch of its result.
CELLS, BATCH = 500_000, 50_000


def subset_count(models: int, least: int, most: int) -> int:
    return sum(comb(models, r) for r in range(least, most + 1))


def largest_pool(least: int, most: int, most_subsets: int = 10_000_000) -> int:
    """How many models an exhaustive search of these sizes takes."""
    return max(n for n in range(63) if subset_count(n, least, most) <= most_subsets)


@cache
def _listed(n: int, r: int) -> np.ndarray:
    """All r of n in colexicographic order, one per row: a row's place, ``_place``, does not depend on n."""
    if r == 0:
        return np.zeros((1, 0), dtype=np.int8)
    below = _listed(n - 1, r - 1) if n >= r else np.zeros((0, r - 1), dtype=np.int8)
    rows = [np.hstack([below[: comb(t, r - 1)], np.full((comb(t, r - 1), 1), t, dtype=np.int8)]) for t in range(r - 1, n)]
    return np.vstack(rows) if rows else np.zeros((0, r), dtype=np.int8)


_BINOM = np.array([[min(comb(n, j), 2**62) for n in range(63)] for j in range(64)], dtype=np.int64)


def _place(rows: np.ndarray) -> np.ndarray:
    """The places of ascending rows (last axis) among all of their length."""
    out = np.zeros(rows.shape[:-1], dtype=np.int64)
    for j in range(rows.shape[-1]):
        out += _BINOM[j + 1][rows[..., j]]
    return out


def _outcomes(n: int, s: np.ndarray, ss: np.ndarray, market: np.ndarray, cover: np.ndarray, k: float) -> np.ndarray:
    """Bets, wins and pushes, as 0 and 1 on a first axis, of n forecasts with sum ``s`` and sum of squares ``ss``."""
    mean = np.round(s / n, DIGITS)
    sd = np.round(np.sqrt(np.maximum(0.0, (ss - s * s / n) / (n - 1))), 6)
    edge = np.round(mean - market[:, None], DIGITS)
    with np.errstate(divide="ignore", invalid="ignore"):
        signal = np.where(sd > 1e-6, np.round(np.abs(edge) / sd, 6), np.inf)
    bet = (np.abs(edge) >= EPS) & (signal >= k)
    push = bet & (np.abs(cover) < EPS)[:, None]
    return np.stack([bet, bet & ~push & (edge * cover[:, None] > 0), push]).astype(np.int32)


def _add_games(shares: dict[int, np.ndarray], own: np.ndarray, at: np.ndarray, pred: np.ndarray, market: np.ndarray, cover: np.ndarray, least: int, most: int, k: float) -> None:
    """Adds games with equally many later models ``at`` (relative) to the shares, by size of what joins the first model."""
    m, diff = at.shape[1], {}
    for v in range(least - 1, min(most - 1, m) + 1):
        t = _listed(m, v)
        x = pred[:, t]
        s, ss = x.sum(-1), (x * x).sum(-1)
        diff[v] = _outcomes(v + 1, s + own[:, None], ss + (own * own)[:, None], market, cover, k)
        if v >= least:
            diff[v] -= _outcomes(v, s, ss, market, cover, k)
        share = diff[v].copy()
        for w in range(least - 1, v):
            for part in combinations(range(v), w):
                share += (-1) ** (v - w) * diff[w][:, :, _place(t[:, part])]
        place = _place(at[:, t])
        for i in range(3):
            np.add.at(shares[v][i], place.ravel(), share[i].ravel())


def _shares(cell: DataFrame, order: Sequence[str], least: int, most: int, k: float, totals, smallest: int) -> DataFrame:
    """size, place, mask, bets, wins, losses, pushes of every subset of ``smallest`` to ``most``, one row each.

    With ``totals`` (a broadcast of the smaller subsets' totals by size) the rows are totals, without it shares.
    """
    at_, n = {m: i for i, m in enumerate(order)}, len(order)
    spark = cell.sparkSession
    number = F.create_map(*(F.lit(x) for m, i in at_.items() for x in (m, i)))
    ok = cell.filter(F.col("model").isin(list(order)) & F.col("market").isNotNull() & F.col("actual").isNotNull())
    games = ok.groupBy("game_key", "market", "actual").agg(F.array_sort(F.collect_list(F.struct(number[F.col("model")].alias("i"), F.col("pred")))).alias("p"))
    each = games.select("market", "actual", F.posexplode("p").alias("pos", "own"), "p").select(F.col("own.i").alias("first"), "market", "actual", F.col("own.pred").alias("own"), F.slice("p", F.col("pos") + 2, F.size("p")).alias("p"))
    each = each.filter(F.size("p") >= least - 1).select("first", "market", "actual", "own", F.col("p.i").alias("at"), F.col("p.pred").alias("pred"))
    none = spark.range(n).select(F.col("id").cast("int").alias("first"), *(F.lit(0.0).alias(c) for c in ("market", "actual", "own")), F.array().cast("array<int>").alias("at"), F.array().cast("array<double>").alias("pred"))
    sent = each.unionByName(none).repartition(max(1, 2 * n), "first")

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, dict[int, np.ndarray]] = {}
        for pdf in batches:
            for (i, m), g in pdf.groupby([pdf["first"], pdf["at"].map(len)]):
                if i not in held:
                    held[i] = {v: np.zeros((3, comb(n - 1 - i, v)), dtype=np.int64) for v in range(least - 1, most)}
                shares = held[i]
                if m < least - 1:
                    continue
                step = max(1, CELLS // max(1, comb(m, min(most - 1, m // 2))))
                own, at, pred = g["own"].to_numpy(float), np.stack(g["at"].to_numpy()) - i - 1, np.stack(g["pred"].to_numpy()).astype(float)
                market = g["market"].to_numpy(float)
                cover = np.round(g["actual"].to_numpy(float) - market, DIGITS)
                for lo in range(0, len(g), step):
                    s = slice(lo, lo + step)
                    _add_games(shares, own[s], at[s].reshape(-1, m), pred[s].reshape(-1, m), market[s], cover[s], least, most, k)
        for i, shares in held.items():
            for v in range(max(0, smallest - 1), most):
                every = _listed(n - 1 - i, v)
                for lo in range(0, len(every), BATCH):
                    t = every[lo : lo + BATCH].astype(np.int64)
                    whole = shares[v][:, lo : lo + BATCH].copy() if v in shares else np.zeros((3, len(t)), dtype=np.int64)
                    if totals is not None:
                        for w in range(least - 1, v):
                            for part in combinations(range(v), w):
                                whole += shares[w][:, _place(t[:, part])]
                        if v >= least:
                            whole += totals.value[v][:, _place(t + i + 1)]
                    mask = (1 << i) + (np.int64(1) << (t + i + 1)).sum(axis=1)
                    place = _place(np.hstack([np.full((len(t), 1), i), t + i + 1]))
                    yield pd.DataFrame({"size": v + 1, "place": place, "mask": mask, "bets": whole[0], "wins": whole[1], "losses": whole[0] - whole[1] - whole[2], "pushes": whole[2]})

    return sent.mapInPandas(kernel, "size int, place bigint, mask bigint, bets bigint, wins bigint, losses bigint, pushes bigint")


def score_subsets(cell: DataFrame, models: Sequence[str], least: int = 3, most: int = 4, k: float = 0.75, min_available: int = 3, most_subsets: int = 10_000_000) -> DataFrame:
    """models (array), size, bets, wins, losses, pushes, ats, wilson: every subset's record at signal >= k.

    ``models`` are at most 62, best with the frequent ones first; more subsets than ``most_subsets`` fail rather than
    being left out. A subset's mean and spread in a game are of its models that forecast it; fewer than
    ``min_available`` (or than two) give no bet. The totals of the subsets below the largest size are brought to the
    driver and broadcast; their number is bounded by ``most_subsets`` and does not grow with the games.
    """
    order = list(dict.fromkeys(models))[::-1]  # rare models first: the games of a frequent one then have few later models
    if len(order) > 62 or subset_count(len(order), least, most) > most_subsets:
        raise ValueError("too many subsets for an exhaustive search")
    enough, n = max(2, min_available), len(order)
    total: dict[int, np.ndarray] = {}
    if most > enough:
        low = _shares(cell, order, enough, most - 1, k, None, enough).select("size", "place", "bets", "wins", "pushes").toPandas()
        part = {}
        for r in range(enough, most):
            rows = low[low["size"] == r]
            part[r] = np.zeros((3, comb(n, r)), dtype=np.int64)
            part[r][:, rows["place"].to_numpy()] = rows[["bets", "wins", "pushes"]].to_numpy().T
        for r in range(enough, most):
            total[r], t = part[r].copy(), _listed(n, r)
            for w in range(enough, r):
                for c in combinations(range(r), w):
                    total[r] += part[w][:, _place(t[:, c])]
    scored = _shares(cell, order, enough, most, k, cell.sparkSession.sparkContext.broadcast({r: x.astype(np.int32) for r, x in total.items()}), least)
    names = F.array_sort(F.filter(F.transform(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(1 << i).cast("bigint").alias("b")) for i, m in enumerate(order))), lambda x: F.when(F.col("mask").bitwiseAND(x["b"]) != 0, x["m"])), lambda x: x.isNotNull()))
    return rates(scored.select(names.alias("models"), "size", "bets", "wins", "losses", "pushes"))


def leaderboard(scored: DataFrame, least_bets: int, top: int) -> DataFrame:
    """rank and the subset: the best by Wilson's lower end, then bets, then names; a report of ``top`` rows."""
    ok = scored.filter(F.col("bets") >= least_bets).withColumn("names", F.array_join("models", "|"))
    best = ok.orderBy(F.col("wilson").desc_nulls_last(), F.col("bets").desc(), "names").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("wilson").desc_nulls_last(), F.col("bets").desc(), "names"))).drop("names")


def pair_frequency(board: DataFrame) -> DataFrame:
    """model_a < model_b, subsets: how many of a leaderboard's subsets hold both."""
    first = board.select("models", F.posexplode(F.array_sort("models")).alias("i", "model_a"))
    both = first.select("model_a", F.explode(F.slice(F.array_sort("models"), F.col("i") + 2, F.size("models"))).alias("model_b"))
    return both.groupBy("model_a", "model_b").agg(F.count("*").alias("subsets"))


def jaccard_pairs(board: DataFrame) -> DataFrame:
    """rank_a < rank_b, jaccard: the overlap of a leaderboard's subsets. A leaderboard is a report of bounded length."""
    a, b = board.select(F.col("rank").alias("rank_a"), F.col("models").alias("ma")), board.select(F.col("rank").alias("rank_b"), F.col("models").alias("mb"))
    j = a.join(F.broadcast(b), F.col("rank_a") < F.col("rank_b"))
    return j.select("rank_a", "rank_b", F.round(F.size(F.array_intersect("ma", "mb")) / F.size(F.array_union("ma", "mb")), 6).alias("jaccard"))


def communities(board: DataFrame, threshold: float = 0.5) -> DataFrame:
    """rank, models, community: by rank, each subset joins the community whose first subset it overlaps most, or its own.

    Sequential by nature over a leaderboard of bounded length; done on the driver.
    """
    heads: list[tuple[int, set[str]]] = []
    out = []
    for r in board.orderBy("rank").collect():
        own = set(r.models)
        best = max(((len(own & h) / len(own | h), -i) for i, (_, h) in enumerate(heads)), default=(0.0, 0))
        if heads and best[0] >= threshold:
            out.append((r["rank"], list(r.models), heads[-best[1]][0]))
        else:
            heads.append((len(heads) + 1, own))
            out.append((r["rank"], list(r.models), len(heads)))
    return board.sparkSession.createDataFrame(out, "rank int, models array<string>, community int")


def meta(cell: DataFrame, grouped: DataFrame, min_available: int = 2) -> DataFrame:
    """Per game: communities, meta_mean, meta_sd: means over subsets, then over communities, with both spreads kept apart.

    ``grouped`` (a bounded leaderboard) is broadcast; each cell meets the subsets that hold its model.
    """
    member = grouped.select("rank", "community", F.explode("models").alias("model"))
    each = cell.join(F.broadcast(member), "model").groupBy(*GAME, "market", "actual", "community", "rank").agg(F.count("*").alias("n"), F.avg("pred").alias("m"), F.var_samp("pred").alias("v"))
    sub = each.filter(F.col("n") >= max(2, min_available))
    com = sub.groupBy(*GAME, "market", "actual", "community").agg(F.avg("m").alias("cm"), (F.avg(F.col("v") / F.col("n")) + F.coalesce(F.var_samp("m"), F.lit(0.0))).alias("cv"))
    out = com.groupBy(*GAME, "market", "actual").agg(F.count("*").alias("communities"), F.avg("cm").alias("mean"), F.sqrt(F.avg("cv") + F.coalesce(F.var_samp("cm"), F.lit(0.0))).alias("sd"))
    return out.select(*GAME, "market", "actual", "communities", F.round("mean", 6).alias("meta_mean"), F.round("sd", 6).alias("meta_sd"))


def stable_k(profile: DataFrame, by: Sequence[str], least: int, band: float = 0.01, anchor: float = 0.75) -> DataFrame:
    """by, k, bets, plateau, centred: the threshold whose neighbours hold up too.

    A threshold with ``least`` bets on it and on both sides is as good as the worst Wilson end of the three. Of those
    within ``band`` of the best, the one with most bets is taken, then the lowest. Where no threshold has such sides, the
    one with most bets is taken, of enough bets if there is one: then the nearest to ``anchor``, the best end, the lowest.
    Groups without any bet give no row.
    """
    keys = list(by) or [F.lit(1)]
    w, all_ = Window.partitionBy(*keys).orderBy("threshold"), Window.partitionBy(*keys)
    p = profile.withColumn("bets", F.col("wins") + F.col("losses") + F.col("pushes")).withColumn("enough", (F.col("bets") >= least) & F.col("wilson").isNotNull())
    sides = F.coalesce(F.lag("enough").over(w) & F.lead("enough").over(w), F.lit(False))
    worst = F.least(F.lag("wilson").over(w), F.col("wilson"), F.lead("wilson").over(w))
    p = p.withColumn("plateau", F.when(F.col("enough") & sides, worst))
    p = p.withColumn("best", F.max("plateau").over(all_)).withColumn("near", F.coalesce(F.col("plateau") >= F.col("best") - band, F.lit(False)))
    p = p.filter((F.col("near") & F.col("best").isNotNull()) | (F.col("best").isNull() & (F.col("bets") > 0)))
    centred = F.col("best").isNotNull()
    rest = [F.when(~centred, x) for x in (F.abs(F.col("threshold") - anchor), -F.coalesce("wilson", F.lit(-1.0)))]
    pick = Window.partitionBy(*keys).orderBy(F.when(~centred, F.col("bets") >= least).desc(), F.col("bets").desc(), *rest, "threshold")
    first = p.withColumn("_r", F.row_number().over(pick)).filter("_r = 1")
    return first.select(*by, F.col("threshold").alias("k"), "bets", F.coalesce("plateau", "wilson").alias("plateau"), centred.alias("centred"))
