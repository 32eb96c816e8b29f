"""Queries of the ingestion operators (p1, p3, p4, p5) over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import normal_double, normal_name
from tidemark.operators import parse_failures, quality_profile, schema_drift, snapshots
from tidemark.sources import table

STREAM = ["sport_key", "season"]
#: Tables that p5 profiles: label and time of a load.
PROFILED = {"ncaapredictions": ("snapshot_label", "snapshot_ts"), "model_ranking_2026": ("load_label", "load_ts")}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_failures.parse_failures(table(spark, sf_dir, "raw_lines"))


def p1_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_failures.load_typed(table(spark, sf_dir, "raw_lines"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = [normal_name(F.col("road")), normal_name(F.col("home"))]
    rows = table(spark, sf_dir, "ncaapredictions")
    return snapshots.snapshot_changes(rows, STREAM, "snapshot_label", "snapshot_ts", key, ["road", "home"], [normal_double(F.col("line"))], "row_id")


def board_numbers(spark: SparkSession, sf_dir: str) -> list[str]:
    """The target's number columns: the board's own and the registry's; the registry is a small fixed table."""
    names = table(spark, sf_dir, "models").select("board_column").filter("board_column is not null").distinct()
    return [*schema_drift.BASE_NUMBERS, *sorted({r[0].lower() for r in names.collect()} - set(schema_drift.BASE_NUMBERS))]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.drift_report(table(spark, sf_dir, "board_archive"), STREAM, "delivered_ts", board_numbers(spark, sf_dir))


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.one_table(table(spark, sf_dir, "board_archive"), STREAM, "delivered_ts", board_numbers(spark, sf_dir))


def _profile(spark: SparkSession, sf_dir: str, name: str, numbers: list[str], patterns: dict[str, str | None]) -> DataFrame:
    label, ts = PROFILED[name]
    rows = table(spark, sf_dir, name).withColumnRenamed(label, "load_label")
    parts = []
    if numbers:
        parts.append(quality_profile.number_profile(rows, STREAM, "load_label", ts, numbers))
    if patterns:
        parts.append(quality_profile.text_profile(rows, STREAM, "load_label", ts, patterns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _columns(spark: SparkSession, sf_dir: str, name: str, only: set[str] | None = None) -> tuple[list[str], list[str]]:
    label, ts = PROFILED[name]
    fields = [f for f in table(spark, sf_dir, name).schema.fields if f.name not in {*STREAM, label, ts} and (only is None or f.name in only)]
    numbers = [f.name for f in fields if quality_profile.is_number_type(f.dataType)]
    return numbers, [f.name for f in fields if f.name not in numbers]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "column_limits")
    fixed = limits.select("table_name", "column_name", "text_pattern").collect()  # a fixed table of 69 rows
    out = None
    for name in PROFILED:
        checked = {r.column_name: r.text_pattern for r in fixed if r.table_name == name}
        numbers, texts = _columns(spark, sf_dir, name, set(checked))
        if not numbers and not texts:
            continue
        label, ts = PROFILED[name]
        rows, keys = table(spark, sf_dir, name).withColumnRenamed(label, "load_label"), [*STREAM, "load_label", "column_name"]
        # missing shares, ranges and pattern violations come from the masks; distinct counts and quantiles need the values
        masks = quality_profile.mask_profile(quality_profile.mask_counts(rows, STREAM, "load_label", {c: checked[c] for c in texts}, numbers), STREAM, "load_label").alias("m")
        figures = ("n_distinct", "q1", "median", "q3")
        if numbers:
            values = quality_profile.number_profile(rows, STREAM, "load_label", ts, numbers).select(*keys, *figures).alias("v")
            both = masks.join(values, [F.col(f"m.{k}").eqNullSafe(F.col(f"v.{k}")) for k in keys], "left")
            profile = both.select(*(F.col(f"m.{c}") for c in masks.columns if c != "n_values"), F.coalesce("m.n_values", "v.n_distinct").alias("n_distinct"), *(F.col(f"v.{c}") for c in figures[1:]))
        else:
            profile = masks.withColumnRenamed("n_values", "n_distinct").withColumns({c: F.lit(None).cast("double") for c in figures[1:]})
        profile = quality_profile.with_load_time(profile, rows, STREAM, "load_label", ts)
        own = limits.filter(F.col("table_name") == name).select("column_name", "min_ok", "max_ok").dropDuplicates(["column_name"])
        found = quality_profile.issues(profile, own, STREAM, "load_label").select(F.lit(name).alias("table_name"), *STREAM, "load_label", "column_name", "issue")
        out = found if out is None else out.unionByName(found)
    return out


def p5_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole profile: every column of both tables in every load."""
    out = None
    for name in PROFILED:
        numbers, texts = _columns(spark, sf_dir, name)
        profile = _profile(spark, sf_dir, name, numbers, dict.fromkeys(texts)).select(
            F.lit(name).alias("table_name"), *STREAM, "load_label", "column_name", "n_rows", "n_missing", "n_distinct", "min_value", "q1", "median", "q3", "max_value", "n_masks"
        )
        out = profile if out is None else out.unionByName(profile)
    return out


def p5_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominant masks, rare values and mask divergence of every column of both tables, numbers by their text form."""
    out = None
    for name, (label, ts) in PROFILED.items():
        numbers, texts = _columns(spark, sf_dir, name)
        rows = table(spark, sf_dir, name).withColumnRenamed(label, "load_label")
        told = quality_profile.mask_report(rows, STREAM, "load_label", ts, dict.fromkeys(texts), numbers)
        told = told.select(F.lit(name).alias("table_name"), *STREAM, "load_label", "column_name", "n_masks", "dominant_mask", "rare_values", F.round("divergence", 9).alias("divergence"))
        out = told if out is None else out.unionByName(told)
    return out


QUERIES = {"p1_found": p1_found, "p1_loaded": p1_loaded, "p3_found": p3_found, "p4_found": p4_found, "p4_table": p4_table, "p5_found": p5_found, "p5_profile": p5_profile, "p5_masks": p5_masks}
