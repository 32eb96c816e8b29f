"""The current board: wide to long, latest snapshot, source precedence, name keys, matching and orientation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import normal_double

# The board's market columns.
MARKET = ["lineopen", "line", "linemidweek"]


def team_slug(c: Column) -> Column:
    """Lower case, & as and, other signs as blanks, one blank between words."""
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def schedule_slug(c: Column) -> Column:
    """team_slug with a last ``st`` written as state and a first direction letter written out."""
    s = F.regexp_replace(team_slug(c), " st$", " state")
    for letter, word in (("n", "north"), ("s", "south"), ("e", "east"), ("w", "west")):
        s = F.regexp_replace(s, f"^{letter} ", f"{word} ")
    return s


def pair_key(a: Column, b: Column) -> Column:
    """A key of two names that does not depend on their order."""
    return F.array_join(F.array_sort(F.array(schedule_slug(a), schedule_slug(b))), "__")


def board_records(board: DataFrame) -> DataFrame:
    """One row per stream, snapshot, road and home: the one with the highest row_id (of equal ones the greatest values)."""
    keys = ["sport_key", "season", "snapshot_label", "road", "home"]
    rest = [c for c in board.columns if c not in (*keys, "row_id")]
    own = board.filter(F.col("road").isNotNull() & F.col("home").isNotNull())
    return own.groupBy(*keys).agg(F.max(F.struct("row_id", *rest)).alias("_r")).select(*keys, *(f"_r.{c}" for c in board.columns if c not in keys))


def model_columns(board: DataFrame) -> list[str]:
    return [c for c in board.columns if c.startswith("line") and c not in MARKET]


def wide_to_long(board: DataFrame, columns: Sequence[str]) -> DataFrame:
    """sport_key, season, wk, snapshot_label, road, home, board_column, pred: a row per number of a model's column."""
    keys = ["sport_key", "season", "wk", "snapshot_label", "road", "home"]
    each = F.explode(F.filter(F.array(*(F.struct(F.lit(c).alias("board_column"), normal_double(F.col(c)).alias("pred")) for c in columns)), lambda x: x["pred"].isNotNull()))
    return board.select(*keys, each.alias("x")).select(*keys, "x.*")


def latest_snapshot(board: DataFrame) -> DataFrame:
    """The rows of each stream's last snapshot (by time, then label)."""
    last = board.groupBy("sport_key", "season").agg(F.max(F.struct("snapshot_ts", "snapshot_label"))["snapshot_label"].alias("snapshot_label"))
    return board.join(last, ["sport_key", "season", "snapshot_label"])


def line_moves(board: DataFrame) -> DataFrame:
    """sport_key, season, road, home, first_line, last_line, snapshots, moves: each game's line over all its snapshots."""
    line = normal_double(F.col("line"))
    r = board.filter(line.isNotNull()).select("sport_key", "season", "road", "home", "snapshot_ts", "snapshot_label", line.alias("line"))
    w = Window.partitionBy("sport_key", "season", "road", "home").orderBy("snapshot_ts", "snapshot_label")
    m = r.withColumn("moved", F.coalesce((F.lag("line").over(w) != F.col("line")).cast("int"), F.lit(0)))
    at = F.struct("snapshot_ts", "snapshot_label")
    return m.groupBy("sport_key", "season", "road", "home").agg(F.min_by("line", at).alias("first_line"), F.max_by("line", at).alias("last_line"), F.count("*").alias("snapshots"), F.sum("moved").alias("moves"))


def by_precedence(rows: DataFrame, keys: Sequence[str], order: Sequence[str], source: str = "selected_source") -> DataFrame:
    """Of the rows with equal keys those of the first source that has any (named ones first, others after)."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(source)), F.lit(0))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    w = Window.partitionBy(*keys)
    return rows.withColumn("_rank", rank).withColumn("_first", F.min("_rank").over(w)).filter(F.col("_rank") == F.col("_first")).drop("_rank", "_first")


def schedule_matches(lines: DataFrame, schedule: DataFrame) -> DataFrame:
    """game_key, matches, reversed: how many scheduled games a line's two names meet in its stream, in which order.

    A game counts once however often it is scheduled; the names are compared without regard to their order.
    """
    s = schedule.filter(F.col("away").isNotNull() & F.col("home").isNotNull()).select(
        "sport_key", "season", pair_key(F.col("away"), F.col("home")).alias("pair"), schedule_slug(F.col("away")).alias("away_slug"), F.col("game_join_key").alias("target")
    ).distinct()
    g = lines.filter(F.col("game_key").isNotNull()).select("game_key", "sport_key", "season", pair_key(F.col("pt_road"), F.col("pt_home")).alias("pair"), schedule_slug(F.col("pt_road")).alias("road_slug")).distinct()
    j = g.join(s, ["sport_key", "season", "pair"], "left")
    return j.groupBy("game_key").agg(F.count_distinct("target").alias("matches"), F.count_distinct(F.when(F.col("away_slug") != F.col("road_slug"), F.col("target"))).alias("reversed"))


def orientation_votes(rows: DataFrame, line: str, other: str) -> DataFrame:
    """For each stream: games, same, opposite, sign: whether two sources' margins agree in sign or are turned around."""
    p = F.col(line) * F.col(other)
    v = rows.groupBy("sport_key", "season").agg(F.count("*").alias("games"), F.count_if(p > 0).alias("same"), F.count_if(p < 0).alias("opposite"))
    return v.withColumn("sign", F.when(F.col("same") > F.col("opposite"), 1).when(F.col("same") < F.col("opposite"), -1).otherwise(0))
