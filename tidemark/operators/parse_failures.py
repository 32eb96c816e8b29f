"""Rows that fail to parse: a strict load, and what it leaves behind with the reason.

Records keep their offset (file_id, line_no). The strict load takes only records that conform in every respect; the
failures are all offsets minus the loaded ones (an anti-join), and only that remainder is diagnosed.

A file may hold most of all rows, so a file's header is never joined to its records by file alone: the header is
repeated for every block of ``BLOCK`` line numbers, and records join on (file_id, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.csvline import is_well_quoted, split_fields, without_cr
from tidemark.functions.text import is_missing, is_number, to_number, trim_blanks

#: Line numbers that share one copy of their file's header.
BLOCK = 20_000

# The kinds of checked fields, by header name (lower case).
REQUIRED = ["road", "home", "bet"]
SHARES = ["phcover", "phwin"]
NUMBERS = ["decimal odds", "profit if risk 1u", "profit"]
RESULTS = ["W", "L", "P"]
MAX_LINE = 100.0
MIN_ODDS, MAX_ODDS = 100.0, 10000.0


def _kind(name: Column) -> Column:
    return (
        F.when(name.isin(REQUIRED), "required")
        .when(name.startswith("line"), "line")
        .when(name.isin(SHARES), "share")
        .when(name == "neutral", "flag")
        .when(name == "american odds", "odds")
        .when(name.isin(NUMBERS), "number")
        .when(name == "win/loss", "result")
        .otherwise("any")
    )


def _is_bad(kind: Column, value: Column) -> Column:
    """Whether a trimmed value is bad for its kind; never null for a value."""
    number = to_number(value)
    missing = is_missing(value)
    odds_ok = value.rlike(r"\A[eE][vV][eE][nN]\z") | (
        value.rlike(r"\A[+\-−]?[0-9]+\z") & F.abs(number).between(MIN_ODDS, MAX_ODDS)
    )
    return (
        F.when(kind == "any", False)
        .when(kind == "required", missing)
        .when(missing, False)
        .when(kind == "line", ~F.coalesce(F.abs(number) <= MAX_LINE, F.lit(False)))
        .when(kind == "share", ~F.coalesce(number.between(0.0, 1.0), F.lit(False)))
        .when(kind == "flag", ~F.coalesce((number == 0.0) | (number == 1.0), F.lit(False)))
        .when(kind == "odds", ~F.coalesce(odds_ok, F.lit(False)))
        .when(kind == "number", ~is_number(value))
        .when(kind == "result", ~value.isin(RESULTS))
        .otherwise(False)
    )


def headers(raw: DataFrame) -> DataFrame:
    """file_id, block, names, kinds: each file's header, once per block of its lines.

    Of repeated headers the greatest line counts. A file whose header is missing, null or wrongly quoted has none.
    """
    per_file = raw.groupBy("file_id").agg(
        F.max(F.when(F.col("line_no") == 1, without_cr(F.col("raw_line")))).alias("header"), F.max("line_no").alias("last_no")
    )
    names = F.transform(split_fields(F.col("header")), lambda x: F.lower(trim_blanks(x)))
    return (
        per_file.filter(is_well_quoted(F.col("header")))
        .select("file_id", names.alias("names"), F.sequence(F.lit(0), (F.col("last_no") / BLOCK).cast("int")).alias("blocks"))
        .select("file_id", F.explode("blocks").alias("block"), "names", F.transform("names", _kind).alias("kinds"))
    )


def _with_header(records: DataFrame, heads: DataFrame, how: str) -> DataFrame:
    at = records.withColumn("block", (F.col("line_no") / BLOCK).cast("int"))
    return at.join(heads, ["file_id", "block"], how).drop("block")


def _records(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("line_no") > 1).select(
        "file_id", "line_no", "raw_line", F.md5(F.col("raw_line").cast("binary")).alias("line_md5"), without_cr(F.col("raw_line")).alias("line")
    )


def _values(line: Column) -> Column:
    return F.transform(split_fields(line), trim_blanks)


def _any_bad(kinds: Column, values: Column) -> Column:
    return F.exists(F.zip_with(kinds, values, _is_bad), lambda bad: bad)


def strict_load(raw: DataFrame) -> DataFrame:
    """file_id, line_no, line_md5, names, values: the records that conform to their file's header in every respect."""
    quoted = _records(raw).filter(is_well_quoted(F.col("line")))
    counted = _with_header(quoted, headers(raw), "inner").withColumn("values", _values(F.col("line")))
    good = counted.filter(F.size("values") == F.size("names")).filter(~_any_bad(F.col("kinds"), F.col("values")))
    return good.select("file_id", "line_no", "line_md5", "names", "values")


def parse_failures(raw: DataFrame) -> DataFrame:
    """file_id, line_no, fail_reason: one row per record that the strict load leaves out.

    ``raw`` needs file_id, line_no and raw_line; other columns are ignored. Defined results: a null line fails as
    ``column_count``, an empty one is a record of one empty field; all well quoted records of a file without a readable
    header fail as ``column_count``; a repeated offset is one record, and with several texts it fails if one of them
    does, with the first reason that applies to one. Rows without a line number are no records.
    """
    loaded = strict_load(raw).select("file_id", "line_no", "line_md5")
    rest = _records(raw).join(loaded, ["file_id", "line_no", "line_md5"], "left_anti")
    told = _with_header(rest, headers(raw), "left")
    rank = (
        F.when(~F.coalesce(is_well_quoted(F.col("line")), F.lit(True)), 1)
        .when(F.col("line").isNull() | F.col("names").isNull() | (F.size(split_fields(F.col("line"))) != F.size("names")), 2)
        .otherwise(3)
    )
    first = told.groupBy("file_id", "line_no").agg(F.min(rank).alias("rank"))
    reasons = F.array(F.lit("quoting"), F.lit("column_count"), F.lit("bad_value"))
    return first.select("file_id", "line_no", F.element_at(reasons, F.col("rank")).alias("fail_reason"))


def load_typed(raw: DataFrame) -> DataFrame:
    """The conforming records, typed: file_id, line_no, the board's fields, its models' numbers and the bets' fields.

    ``model_lines`` maps each posting model's column to its number (missing tokens are left out). Repeated offsets with
    the same text give one row. EVEN odds are 100.
    """
    rows = strict_load(raw).dropDuplicates(["file_id", "line_no", "line_md5"])
    value = F.map_from_arrays(F.array_distinct("names"), F.slice("values", F.lit(1), F.size(F.array_distinct("names"))))
    same = F.size(F.array_distinct("names")) == F.size("names")
    first = F.map_from_entries(
        F.transform(F.array_distinct("names"), lambda n: F.struct(n, F.element_at("values", F.array_position("names", n).cast("int"))))
    )
    rows = rows.withColumn("v", F.when(same, value).otherwise(first))

    def text(name: str) -> Column:
        x = F.try_element_at("v", F.lit(name))
        return F.when(~is_missing(x), x)

    def number(name: str) -> Column:
        return to_number(F.try_element_at("v", F.lit(name)))

    market = ["line", "lineopen", "linemidweek"]
    models = F.map_filter(
        F.transform_values(F.map_filter("v", lambda k, _: k.startswith("line") & ~k.isin(market)), lambda _, x: to_number(x)),
        lambda _, x: x.isNotNull(),
    )
    odds = F.try_element_at("v", F.lit("american odds"))
    return rows.select(
        "file_id",
        "line_no",
        text("road").alias("road"),
        text("home").alias("home"),
        *(number(n).alias(n) for n in [*market, "neutral", *SHARES]),
        F.when(F.size(models) > 0, models).alias("model_lines"),
        text("date").alias("bet_date"),
        text("bet").alias("bet"),
        F.when(F.upper(odds) == "EVEN", F.lit(100.0)).otherwise(to_number(odds)).cast("int").alias("american_odds"),
        number("decimal odds").alias("decimal_odds"),
        text("win/loss").alias("win_loss"),
        number("profit if risk 1u").alias("profit_1u"),
    )
