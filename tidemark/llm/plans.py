"""Queries of the operators on texts and entities over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import encoding, matching, packing, sentences
from tidemark.sources import table


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bet's most likely game with the confidence, whether high or low."""
    names = ("market_signal_live_matches", "market_signal_live_unmatched", "line_history", "schedule")
    return matching.match(*(table(spark, sf_dir, n) for n in names))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_matches(spark, sf_dir).filter(F.col("confidence") > matching.THRESHOLD).select("bet_id", "game_key")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, from their ids."""
    return encoding.decode(p6_ids(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of every text; the board's fields, named by the registry, are written in lower case everywhere."""
    fields = table(spark, sf_dir, "models").select("board_column").filter("board_column is not null").distinct().collect()  # a fixed table
    return sentences.sentences(table(spark, sf_dir, "documents"), [r[0] for r in fields])


QUERIES = {"p2_found": p2_found, "p2_matches": p2_matches, "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_found": p7_found, "p8_found": p8_found}
ORACLE_SQL: dict[str, str] = {}
