"""Column-level profile of every load, its value masks, and what differs from the preceding load.

Number columns: one shuffle of the rows by load, then the sorted values of each column give all figures at once. A load
of more than ``HOT_ROWS`` rows is never held by one task: its cells are counted by value, split at approximate quantiles
and ranked within these ranges, which gives the same exact figures.

Values of every column are generalised to masks of character classes. A load's masks carry how many values they stand
for, the missing ones too, their extremes and their pattern violations: missing shares, ranges and violations are read
from the masks, and only distinct counts and quantiles need the values. Masks that are rare over a stream are reported,
and how far a load's masks diverge from the last's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import normal_double

#: Rows of a load that one task may hold.
HOT_ROWS = 100_000
#: Ranges into which a hot column's values are split.
RANGES = 32
#: Hot loads whose split points are broadcast (points of 8 bytes: some MB at most); beyond, they are joined by shuffle.
MOST_HOT = 500
#: A mask below this share of a column's values in its stream is rare.
RARE_SHARE = 0.01

_QUANTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
_FIGURES = ["n_rows", "n_missing", "n_distinct", "min_value", *_QUANTILES, "max_value"]


def value_mask(c: Column) -> Column:
    """Character classes in runs: ``A`` upper-case letters, ``a`` other letters and marks, ``9`` digits, others as they are."""
    m = F.regexp_replace(c, r"\p{Lu}+", "A")
    m = F.regexp_replace(m, r"[\p{L}\p{M}&&[^A]]+", "a")
    return F.regexp_replace(m, r"\p{N}+", "9")


# The masks that a number's text form can have, besides its sign.
NUMBER_MASKS = ["9", "9.9", "9.9A9", "9.9A-9", "Aa"]


def _has_form(x: Column, mask: str, whole: bool) -> Column:
    a = F.abs(x)
    large, small = a >= 1e7, (a > 0) & (a < 1e-3)
    if whole:
        return x.isNotNull() if mask == "9" else F.lit(False)
    return {"9": F.lit(False), "9.9": ~large & ~small, "9.9A9": large & (a < float("inf")), "9.9A-9": small, "Aa": a == float("inf")}[mask]


def number_mask(x: Column, whole: bool) -> Column:
    """``value_mask`` of a number's text form, told from its size; ``x`` is a double without NaN and -0."""
    form = F.lit(None).cast("string")
    for m in NUMBER_MASKS:
        form = F.when(_has_form(x, m, whole), m).otherwise(form)
    return F.when(x < 0, F.concat(F.lit("-"), form)).otherwise(form)


def is_number_type(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def _loads(rows: DataFrame, stream: Sequence[str], label: str, ts: str) -> DataFrame:
    return rows.filter(F.col(label).isNotNull()).groupBy(*stream, label).agg(F.count("*").alias("n_rows"), F.min(ts).alias("load_at"))


def _interpolated(sorted_values: Column, n: Column, q: float) -> Column:
    at = (n - 1) * F.lit(q)
    lo = F.floor(at).cast("int")
    a, b = F.get(sorted_values, lo), F.get(sorted_values, F.ceil(at).cast("int"))
    return a + (b - a) * (at - lo)


def _by_load(rows: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str]) -> DataFrame:
    held = rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.min(ts).alias("load_at"), *(F.collect_list(normal_double(F.col(c).cast("double"))).alias(f"v{i}") for i, c in enumerate(columns))
    )
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias("v")) for i, c in enumerate(columns)))
    long = held.select(*keys, "load_at", "n_rows", F.explode(each).alias("_e")).select(*keys, "load_at", "n_rows", "_e.column_name", F.sort_array("_e.v").alias("_v"))
    n = F.size("_v")
    return long.select(
        *keys,
        "load_at",
        "column_name",
        "n_rows",
        (F.col("n_rows") - n).alias("n_missing"),
        F.size(F.array_distinct("_v")).cast("bigint").alias("n_distinct"),
        F.get("_v", F.lit(0)).alias("min_value"),
        *(_interpolated(F.col("_v"), n, q).alias(k) for k, q in _QUANTILES.items()),
        F.get("_v", n - 1).alias("max_value"),
    )


def _by_range(rows: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], broadcast: bool) -> DataFrame:
    group = [*keys, "column_name"]
    cells = rows.select(*keys, F.col(ts).alias("_ts"), F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), normal_double(F.col(c).cast("double")).alias("x")) for c in columns))).alias("_c")).select(*keys, "_ts", "_c.*")
    head = cells.groupBy(*group).agg(F.count("*").alias("n_rows"), F.count("x").alias("n"), F.min("_ts").alias("load_at"), F.percentile_approx("x", [i / RANGES for i in range(1, RANGES)]).alias("points"))
    counted = cells.filter(F.col("x").isNotNull()).groupBy(*group, "x").agg(F.count("*").alias("m"))
    there, r, h = head.select(*group, "points"), counted.alias("r"), "h"
    there = F.broadcast(there).alias(h) if broadcast else there.alias(h)
    on = F.lit(True)
    for k in group:
        on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"h.{k}"))
    placed = r.join(there, on).select("r.*", F.size(F.filter("h.points", lambda p: p < F.col("r.x"))).alias("part"))
    parts = placed.groupBy(*group, "part").agg(F.sum("m").alias("part_n"), F.count("*").alias("part_distinct"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    before = F.coalesce(F.sum("part_n").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before)
    p = parts.alias("p")
    on = F.col("c.part") == F.col("p.part")
    for k in group:
        on = on & F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}"))
    ranked = placed.alias("c").join(F.broadcast(p) if broadcast else p, on).select("c.*", "p.before")
    upto = F.col("before") + F.sum("m").over(Window.partitionBy(*group, "part").orderBy("x"))
    ranked = ranked.withColumn("upto", upto).withColumn("first", F.col("upto") - F.col("m"))  # ranks first ... upto-1
    h2, k2 = head.select(*group, "n").alias("h"), ranked.alias("k")
    on = F.lit(True)
    for k in group:
        on = on & F.col(f"k.{k}").eqNullSafe(F.col(f"h.{k}"))
    ranked = k2.join(F.broadcast(h2) if broadcast else h2, on).select("k.*", "h.n")

    def at(q: float, up: bool) -> Column:
        pos = (F.col("n") - 1) * F.lit(q)
        rank = F.ceil(pos) if up else F.floor(pos)
        return F.max(F.when((F.col("first") <= rank) & (rank < F.col("upto")), F.col("x")))

    picks = ranked.groupBy(*group).agg(*(at(q, up).alias(f"{k}_{int(up)}") for k, q in _QUANTILES.items() for up in (False, True)))
    totals = parts.groupBy(*group).agg(F.sum("part_distinct").alias("n_distinct"), F.min("lo").alias("min_value"), F.max("hi").alias("max_value"))
    out = head.drop("points").alias("a")
    for other, name in ((picks, "b"), (totals, "c")):
        on = F.lit(True)
        for k in group:
            on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"{name}.{k}"))
        out = out.join(other.alias(name), on, "left").select("a.*", *(F.col(f"{name}.{c}") for c in other.columns if c not in group)).alias("a")
    quantile = {k: F.col(f"{k}_0") + (F.col(f"{k}_1") - F.col(f"{k}_0")) * ((F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))) for k, q in _QUANTILES.items()}
    return out.select(
        *keys, "load_at", "column_name", "n_rows", (F.col("n_rows") - F.col("n")).alias("n_missing"), F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct"), "min_value", *(v.alias(k) for k, v in quantile.items()), "max_value"
    )


def number_profile(rows: DataFrame, stream: Sequence[str], label: str, ts: str, columns: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """stream, label, load_at, column_name, n_rows, n_missing, n_distinct, min_value, q1, median, q3, max_value.

    One row per load and number column. Null and NaN are missing, 0 and -0 the same; the figures of a column without
    values are null. Quantiles interpolate linearly and are exact. Rows without a label belong to no load.
    """
    keys = [*stream, label]
    own = rows.filter(F.col(label).isNotNull()).select(*keys, ts, *columns)
    hot = own.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows).drop("_n")
    n_hot = hot.limit(MOST_HOT + 1).count()
    if not n_hot:
        return _by_load(own, keys, ts, columns)
    few = n_hot <= MOST_HOT
    on = lambda how: own.alias("o").join((F.broadcast(hot) if few else hot).alias("t"), [F.col(f"o.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys], how)
    return _by_load(on("left_anti"), keys, ts, columns).unionByName(_by_range(on("left_semi"), keys, ts, columns, few))


def text_masks(rows: DataFrame, stream: Sequence[str], label: str, patterns: dict[str, str | None]) -> DataFrame:
    """stream, label, column_name, mask, n, n_values, n_bad, lo, hi: each load's masks by text column.

    ``patterns`` names the columns, with the pattern that a value must match in full or None. Blank texts are missing
    and have the mask ''. Values are counted before they are masked, so a value that fills a third of all rows is one
    row; ``lo`` and ``hi`` are null.
    """
    keys = [*stream, label]
    cells = rows.filter(F.col(label).isNotNull()).select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in patterns))).alias("_c")).select(*keys, "_c.*")
    blank = F.coalesce(F.col("value").rlike(r"(?U)\A\s*\z"), F.lit(True))
    values = cells.withColumn("value", F.when(~blank, F.col("value"))).groupBy(*keys, "column_name", "value").agg(F.count("*").alias("n"))
    bad = F.lit(False)
    for c, p in patterns.items():
        if p is not None:
            bad = F.when(F.col("column_name") == c, ~F.col("value").rlike(rf"\A(?:{p})\z")).otherwise(bad)
    return (
        values.select(*keys, "column_name", F.coalesce(value_mask(F.col("value")), F.lit("")).alias("mask"), "n", F.coalesce(bad, F.lit(False)).alias("bad"))
        .groupBy(*keys, "column_name", "mask")
        .agg(F.sum("n").alias("n"), F.count(F.when(F.col("mask") != "", 1)).alias("n_values"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("n_bad"))
        .withColumns({"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double")})
    )


def number_masks(rows: DataFrame, stream: Sequence[str], label: str, columns: Sequence[str]) -> DataFrame:
    """stream, label, column_name, mask, n, n_values (null), n_bad (0), lo, hi: each load's masks by number column.

    Null and NaN are missing and have the mask ''. Counted as the rows are read: few masks stand for many values.
    """
    keys = [*stream, label]
    whole = {f.name: isinstance(f.dataType, T.IntegralType) for f in rows.schema.fields}
    # a column and a mask are one small number while cells are counted
    masks = sorted({"", *(sign + m for sign in ("", "-") for m in NUMBER_MASKS)})
    cells = rows.filter(F.col(label).isNotNull()).select(*keys, F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("_i", "_x"))
    cells = cells.select(*keys, "_i", normal_double(F.col("_x")).alias("x"))
    code, x, is_whole = F.lit(masks.index("")), F.col("x"), F.col("_i").isin([i for i, c in enumerate(columns) if whole[c]])
    for m in NUMBER_MASKS:
        plus, minus = (F.lit(masks.index(sign + m)) for sign in ("", "-"))
        form = F.when(is_whole, _has_form(x, m, True)).otherwise(_has_form(x, m, False)) if any(whole[c] for c in columns) else _has_form(x, m, False)
        code = F.when(form, F.when(x < 0, minus).otherwise(plus)).otherwise(code)
    cells = cells.select(*keys, (F.col("_i") * len(masks) + code).alias("code"), "x")
    counted = cells.groupBy(*keys, "code").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    name = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i.cast("int") + 1)
    named = name(columns, F.floor(F.col("code") / len(masks))).alias("column_name"), name(masks, F.col("code") % len(masks)).alias("mask")
    return counted.select(*keys, *named, "n", F.lit(None).cast("bigint").alias("n_values"), F.lit(0).cast("bigint").alias("n_bad"), "lo", "hi")


def mask_counts(rows: DataFrame, stream: Sequence[str], label: str, patterns: dict[str, str | None], numbers: Sequence[str] = ()) -> DataFrame:
    """The masks of text columns (``patterns``) and of ``numbers``, missing values under ''."""
    parts = [text_masks(rows, stream, label, patterns)] if patterns else []
    parts += [number_masks(rows, stream, label, numbers)] if numbers else []
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def mask_profile(masks: DataFrame, stream: Sequence[str], label: str) -> DataFrame:
    """stream, label, column_name, n_rows, n_missing, n_values, n_masks, n_bad, min_value, max_value: a column's figures from its masks."""
    seen = F.col("mask") != ""
    return masks.groupBy(*stream, label, "column_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(~seen, F.col("n")).otherwise(0)).alias("n_missing"),
        F.sum("n_values").alias("n_values"),
        F.count_if(seen).alias("n_masks"),
        F.sum("n_bad").alias("n_bad"),
        F.min("lo").alias("min_value"),
        F.max("hi").alias("max_value"),
    )


def text_profile(rows: DataFrame, stream: Sequence[str], label: str, ts: str, patterns: dict[str, str | None]) -> DataFrame:
    """stream, label, load_at, column_name, n_rows, n_missing, n_distinct, n_masks, n_bad: one row per load and column."""
    keys = [*stream, label]
    seen = mask_profile(text_masks(rows, stream, label, patterns), stream, label)
    return with_load_time(seen, rows, stream, label, ts).select(*keys, "load_at", "column_name", "n_rows", "n_missing", F.col("n_values").alias("n_distinct"), "n_masks", "n_bad")


def with_load_time(profile: DataFrame, rows: DataFrame, stream: Sequence[str], label: str, ts: str) -> DataFrame:
    """``profile`` with load_at, the load's earliest time."""
    loads, p = _loads(rows, stream, label, ts).alias("l"), profile.alias("s")
    return p.join(loads, [F.col(f"l.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*stream, label]]).select("s.*", "l.load_at")


def mask_report(rows: DataFrame, stream: Sequence[str], label: str, ts: str, patterns: dict[str, str | None], numbers: Sequence[str] = ()) -> DataFrame:
    """stream, label, column_name, n_masks, dominant_mask, rare_values, divergence: one row per load and column with values.

    ``rare_values`` counts the values whose mask has less than ``RARE_SHARE`` of the column's values in the whole
    stream; ``divergence`` is the Jensen-Shannon divergence (base 2) from the preceding load's masks, null at the first.
    """
    keys = [*stream, label]
    masks = mask_counts(rows, stream, label, patterns, numbers).filter(F.col("mask") != "")
    stream_all = Window.partitionBy(*stream, "column_name")
    by_mask = masks.groupBy(*stream, "column_name", "mask").agg(F.sum("n").alias("stream_n"))
    rare = by_mask.withColumn("rare", F.col("stream_n") < RARE_SHARE * F.sum("stream_n").over(stream_all)).alias("y")
    m = masks.alias("x")
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in [*stream, "column_name", "mask"]]
    told = m.join(rare, on).select("x.*", "y.rare")
    order = _loads(rows, stream, label, ts)
    w = Window.partitionBy(*stream).orderBy(F.col("load_at").asc_nulls_first(), label)
    order = order.select(*keys, F.row_number().over(w).alias("seq")).alias("o")
    seq = told.alias("t").join(order, [F.col(f"t.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]).select("t.*", "o.seq")
    share = seq.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "column_name")))
    wm = Window.partitionBy(*stream, "column_name", "mask").orderBy("seq")
    # a mask's share in the load before: 0 unless it was there
    share = share.withColumn("q", F.when(F.lag("seq").over(wm) == F.col("seq") - 1, F.lag("p").over(wm)).otherwise(0.0)).withColumn("next_has", F.coalesce(F.lead("seq").over(wm) == F.col("seq") + 1, F.lit(False)))
    mid = (F.col("p") + F.col("q")) / 2
    term = lambda a: F.when(a > 0, a * F.log2(a / mid)).otherwise(0.0)
    own = share.groupBy(*stream, "column_name", label, "seq").agg(
        F.count("*").alias("n_masks"),
        F.max_by("mask", F.struct("n", "mask")).alias("dominant_mask"),
        F.sum(F.when(F.col("rare"), F.col("n")).otherwise(0)).alias("rare_values"),
        F.sum((term(F.col("p")) + term(F.col("q"))) / 2).alias("met"),
        F.sum(F.when(~F.col("next_has"), F.col("p")).otherwise(0.0)).alias("lost"),  # leaves after this load: adds half its share
    )
    wl = Window.partitionBy(*stream, "column_name").orderBy("seq")
    return own.select(*stream, label, "column_name", "n_masks", "dominant_mask", "rare_values", F.when(F.lag("seq").over(wl).isNotNull(), F.col("met") + F.lag("lost").over(wl) / 2).alias("divergence"))


def issues(profile: DataFrame, limits: DataFrame, stream: Sequence[str], label: str) -> DataFrame:
    """stream, label, column_name, issue: the columns that break their limits or differ from the preceding load.

    ``profile`` has mask_profile's figures, load_at, and for numbers the quantiles; a text column's n_distinct is the sum
    over its masks. ``limits`` has column_name, min_ok and max_ok, one row per checked column, a fixed table.
    """
    w = Window.partitionBy(*stream, "column_name").orderBy(F.col("load_at").asc_nulls_first(), label)
    last = lambda c: F.lag(c).over(w)
    n = F.col("n_rows") - F.col("n_missing")
    p = profile.join(F.broadcast(limits), "column_name").withColumn("n_values", n)
    p = p.select("*", *(last(c).alias(f"last_{c}") for c in ("n_rows", "n_missing", "n_values", "n_distinct", "q1", "median", "q3")))
    c = F.col
    iqr = c("last_q3") - c("last_q1")
    enough = c("n_values") >= 5
    found = {
        "range": (c("min_value") < c("min_ok")) | (c("max_value") > c("max_ok")),
        "pattern": c("n_bad") > 0,
        "missing": c("n_missing") / c("n_rows") - c("last_n_missing") / c("last_n_rows") > 0.33,
        "constant": enough & (c("n_distinct") == 1) & (c("last_n_distinct") >= 5),
        "shift": enough & (c("last_n_values") >= 5) & (iqr > 0) & (F.abs(c("median") - c("last_median")) > 2 * iqr),
    }
    told = F.array_compact(F.array(*(F.when(cond, F.lit(k)) for k, cond in found.items())))
    return p.select(*stream, label, "column_name", F.explode(told).alias("issue"))
