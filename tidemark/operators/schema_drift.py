"""Schemas that drift between files, by rescue-column ingestion.

Every record is read into one target schema. What the target does not know, or cannot cast, stays as JSON in
``_rescued``. Approved fields are promoted later: their rescued values are replayed into typed columns. The drift report
comes from the same rows: fields from the headers, types from what was cast and what was rescued, renames from numbers
that old and new field share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.csvline import split_fields, without_cr
from tidemark.functions.text import is_missing, normal_name, to_number, trim_blanks
from tidemark.sources import checkpoint

# The board's fields besides the models' columns.
KEY = ["road", "home"]
BASE_NUMBERS = ["lineopen", "line", "linemidweek", "neutral", "phcover", "phwin"]

#: Line numbers of a file that share one copy of the file's list of candidates.
BLOCK = 20_000
_RESCUED = "map<string,string>"


def file_headers(files: DataFrame, stream: Sequence[str], ts: str) -> DataFrame:
    """stream, file_id, seq, previous_id, names, n_lines: each file once, in its stream's order (ts, then file_id).

    Rows without a file_id or content are no files.
    """
    lines = F.split(F.col("content"), "\n")
    one = (
        files.filter(F.col("file_id").isNotNull() & F.col("content").isNotNull())
        .select(*stream, "file_id", F.col(ts).alias("_ts"), F.substring_index("content", "\n", 1).alias("_header"), F.size(lines).alias("n_lines"))
        .groupBy("file_id")
        .agg(F.min(F.struct("_ts", *stream, "_header", "n_lines")).alias("_f"))
        .select("file_id", "_f.*")
    )
    w = Window.partitionBy(*stream).orderBy(F.col("_ts").asc_nulls_first(), "file_id")
    names = F.array_distinct(F.transform(split_fields(without_cr(F.col("_header"))), lambda x: F.lower(trim_blanks(x))))
    return one.select(*stream, "file_id", F.row_number().over(w).alias("seq"), F.lag("file_id").over(w).alias("previous_id"), names.alias("names"), "n_lines")


def records(files: DataFrame, numbers: Sequence[str], texts: Sequence[str] = KEY) -> DataFrame:
    """file_id, line_no, values (trimmed) of each record, with what is found once per file: its names, each field's kind
    (1 for a target number, 2 for an unknown field, 0 for others), the targets' places, and the unknown fields' places.
    """
    targets = [*texts, *numbers]
    lines = files.filter(F.col("file_id").isNotNull() & F.col("content").isNotNull()).select("file_id", F.split("content", "\n").alias("_lines"))
    header = F.transform(split_fields(without_cr(F.element_at("_lines", 1))), lambda x: F.lower(trim_blanks(x)))
    named = lines.select("file_id", "_lines", header.alias("_names"))
    number_names, known = (F.array(*(F.lit(n) for n in names)).cast("array<string>") for names in (numbers, targets))
    kind = F.transform("_names", lambda n, i: F.when(F.array_position("_names", n) != i + 1, 0).when(F.array_contains(number_names, n), 1).when(F.array_contains(known, n), 0).otherwise(2))
    at = F.transform(known, lambda t: F.array_position("_names", t).cast("int") - 1)
    placed = named.select("file_id", "_lines", "_names", kind.alias("_kinds"), at.alias("_at"))
    unknown = F.filter(F.transform("_names", lambda n, i: F.named_struct(F.lit("key"), n, F.lit("at"), i, F.lit("kind"), F.get("_kinds", i))), lambda x: x["kind"] == 2)
    rows = placed.select("file_id", "_names", "_kinds", "_at", unknown.alias("_unknown"), F.posexplode("_lines").alias("_pos", "_line")).filter(F.col("_pos") > 0)
    rows = rows.withColumn("_line", without_cr(F.col("_line"))).filter(F.col("_line") != "")
    fields = F.when(F.contains("_line", F.lit('"')), split_fields(F.col("_line"))).otherwise(F.split("_line", ","))
    return rows.select("file_id", (F.col("_pos") + 1).alias("line_no"), "_names", "_kinds", "_at", "_unknown", F.transform(fields, trim_blanks).alias("_values"))


def ingest(files: DataFrame, numbers: Sequence[str], texts: Sequence[str] = KEY) -> DataFrame:
    """file_id, line_no, the texts, the numbers (double) and ``_rescued``: all records in the target schema.

    ``_rescued`` is a JSON object of the fields that the target lacks and of values that are neither numbers nor missing
    tokens in a number column; null when there is none. Fields beyond the header are rescued as ``_field_<n>``. Of
    fields with the same name the first counts. Blank lines are no records.
    """
    rows = records(files, numbers, texts)
    # NaN, which no text gives, marks a value that should be a number and is none
    nan = F.lit(float("nan"))
    rows = rows.withColumn("_numbers", F.zip_with("_values", "_kinds", lambda v, k: F.when((k == 1) & ~is_missing(v), F.coalesce(to_number(v), nan))))
    unknown = F.filter(F.transform("_unknown", lambda u: F.named_struct(F.lit("key"), u["key"], F.lit("value"), F.get("_values", u["at"]))), lambda e: e["value"].isNotNull())
    cells = F.arrays_zip("_values", "_numbers", "_names")
    uncast = F.transform(F.filter(cells, lambda c: F.isnan(c["_numbers"])), lambda c: F.named_struct(F.lit("key"), c["_names"], F.lit("value"), c["_values"]))
    beyond = F.transform(F.slice("_values", F.size("_names") + 1, F.size("_values")), lambda v, i: F.named_struct(F.lit("key"), F.concat(F.lit("_field_"), (F.size("_names") + i + 1).cast("string")), F.lit("value"), v))
    none = F.array().cast("array<struct<key:string,value:string>>")
    # most records have neither: these parts are then not looked at
    kept = F.concat(unknown, F.when(F.array_contains("_numbers", nan), uncast).otherwise(none), F.when(F.size("_values") > F.size("_names"), beyond).otherwise(none))
    rows = rows.select("file_id", "line_no", "_at", "_values", "_numbers", kept.alias("_kept"))

    def place(values: str, i: int) -> Column:
        where = F.get("_at", F.lit(i))
        return F.when(where >= 0, F.get(values, where))

    def text(i: int) -> Column:
        return F.when(~is_missing(place("_values", i)), place("_values", i))

    return rows.select(
        "file_id",
        "line_no",
        *(text(i).alias(t) for i, t in enumerate(texts)),
        *(F.nanvl(place("_numbers", i + len(texts)), F.lit(None).cast("double")).alias(n) for i, n in enumerate(numbers)),
        F.when(F.size("_kept") > 0, F.to_json(F.map_from_entries("_kept"))).alias("_rescued"),
    )


def promote(ingested: DataFrame, fields: dict[str, str], aliases: str | None = None) -> DataFrame:
    """``ingested`` with rescued fields replayed into typed columns and taken out of ``_rescued``.

    ``fields`` gives for each rescued field the number column that takes its values: a new one, or an old one under
    which the field was known before. A column ``aliases`` (a map by field) says so for its record instead. A value that
    is no number stays rescued, and so does a number whose column has one already in the record; of several fields of
    one column the first that is given counts.
    """
    if not fields:
        return ingested.drop(aliases) if aliases else ingested
    order, default = F.array(*(F.lit(f) for f in fields)), F.create_map(*(F.lit(x) for f in fields.items() for x in f))
    told = lambda key: F.coalesce(F.try_element_at(F.col(aliases), key), F.try_element_at(default, key)) if aliases else F.try_element_at(default, key)
    entry = lambda e: F.named_struct(F.lit("rank"), F.array_position(order, e["key"]), F.lit("key"), e["key"], F.lit("column"), told(e["key"]), F.lit("number"), to_number(trim_blanks(e["value"])), F.lit("value"), e["value"])
    own = [c for c in ingested.columns if c not in ("_rescued", aliases)]
    # in the order of the fields; others, ranked 0, come first and have no column
    rows = ingested.withColumn("_r", F.array_sort(F.transform(F.map_entries(F.from_json("_rescued", _RESCUED)), entry)))
    held = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(F.col(c).isNotNull(), F.lit(c)) for c in own)))
    rows = rows.withColumn("_held", F.when(F.col("_r").isNotNull(), held))
    free = F.filter("_r", lambda e: e["number"].isNotNull() & e["column"].isNotNull() & ~F.array_contains("_held", e["column"]))
    rows = rows.withColumn("_free", free)
    taken = F.filter("_free", lambda e, i: F.array_position(F.transform("_free", lambda x: x["column"]), e["column"]) == i + 1)
    rows = rows.withColumn("_taken", taken)
    named = F.transform("_taken", lambda e: e["key"])
    left = F.filter("_r", lambda e: ~F.array_contains(named, e["key"]) & (e["column"].isNull() | ~is_missing(trim_blanks(e["value"]))))
    replayed = lambda c: F.get(F.filter("_taken", lambda e: e["column"] == c), F.lit(0))["number"]
    columns = {c: F.coalesce(F.col(c), replayed(c)) if dict(ingested.dtypes)[c] == "double" else F.col(c) for c in own} | {c: replayed(c) for c in dict.fromkeys(fields.values()) if c not in own}
    rest = F.map_from_entries(F.transform(left, lambda e: F.struct(e["key"], e["value"])))
    return rows.select(*(v.alias(c) for c, v in columns.items()), F.when(F.size(left) > 0, F.to_json(rest)).alias("_rescued"))


def _numbers(numbers: Sequence[str]) -> Column:
    """Of an ingested record, array<struct<field, number>>: its cast and its rescued numbers; null where it has none."""
    typed = F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("number")) for n in numbers))
    rescued = F.transform(F.map_entries(F.from_json("_rescued", _RESCUED)), lambda e: F.struct(e["key"].alias("field"), to_number(trim_blanks(e["value"])).alias("number")))
    return F.concat(typed, F.coalesce(rescued, F.array().cast("array<struct<field:string,number:double>>")))


def field_types(ingested: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """file_id, field, kind: ``number`` or ``text`` for each field with a value in a file, by cast and rescued values."""
    cast = F.transform(F.filter(_numbers(numbers), lambda c: c["number"].isNotNull()), lambda c: F.struct(c["field"].alias("field"), F.lit(0).alias("is_text")))
    texts = F.filter(F.map_entries(F.from_json("_rescued", _RESCUED)), lambda e: ~is_missing(trim_blanks(e["value"])) & to_number(trim_blanks(e["value"])).isNull())
    texts = F.coalesce(F.transform(texts, lambda e: F.struct(e["key"].alias("field"), F.lit(1).alias("is_text"))), F.array().cast("array<struct<field:string,is_text:int>>"))
    cells = ingested.select("file_id", F.explode(F.concat(cast, texts)).alias("c")).select("file_id", "c.*")
    return cells.groupBy("file_id", "field").agg(F.max("is_text").alias("t")).select("file_id", "field", F.when(F.col("t") == 1, "text").otherwise("number").alias("kind"))


def renames(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """file_id, old_field, new_field: fields that went and came under another name, at the later file.

    Over the records (road, home) of both files, the old and the new field must hold the same number in at least half,
    and in one at least. If several fields fit, the pair with most equal numbers is taken first, then by name. ``lines``
    has the files' ``records``; only fields that went or came are read as numbers.
    """
    before = heads.select(F.col("file_id").alias("previous_id"), F.col("names").alias("old_names"), F.col("n_lines").alias("old_lines"))
    keys = F.array(*(F.lit(k) for k in KEY))
    pairs = heads.filter(F.col("previous_id").isNotNull()).join(before, "previous_id").select(
        "file_id", "previous_id", "n_lines", "old_lines", F.array_except(F.array_except("old_names", "names"), keys).alias("went"), F.array_except(F.array_except("names", "old_names"), keys).alias("came")
    ).filter((F.size("went") > 0) & (F.size("came") > 0))
    sides = pairs.select(
        F.col("file_id").alias("pair_id"),
        F.explode(
            F.array(
                F.struct(F.col("previous_id").alias("file_id"), F.col("old_lines").alias("n"), F.col("went").alias("fields"), F.lit(0).alias("side")),
                F.struct(F.col("file_id"), F.col("n_lines").alias("n"), F.col("came").alias("fields"), F.lit(1).alias("side")),
            )
        ).alias("_s"),
    ).select("pair_id", "_s.*")
    sides = sides.withColumn("_block", F.explode(F.sequence(F.lit(0), ((F.col("n") + 1) / BLOCK).cast("int"))))
    value = lambda name: F.get("_values", F.array_position("_names", name).cast("int") - 1)
    key = {k: F.when(F.array_contains("_names", k), value(F.lit(k))) for k in KEY}
    rows = lines.select("file_id", (F.col("line_no") / BLOCK).cast("int").alias("_block"), "_names", "_values", *(F.when(~is_missing(v), v).alias(k) for k, v in key.items()))
    rows = rows.filter(F.col("road").isNotNull() & F.col("home").isNotNull())
    cells = rows.join(sides, ["file_id", "_block"]).select(
        "pair_id",
        "side",
        normal_name(F.col("road")).alias("road"),
        normal_name(F.col("home")).alias("home"),
        F.filter(F.transform("fields", lambda f: F.named_struct(F.lit("field"), f, F.lit("number"), to_number(value(f)))), lambda c: c["number"].isNotNull()).alias("cells"),
    )
    # a record's cells are bounded by its fields, and by the same record's repetitions within the two files
    of = lambda side: F.array_distinct(F.flatten(F.collect_set(F.when(F.col("side") == side, F.col("cells")))))
    records = cells.groupBy("pair_id", "road", "home").agg(F.count_distinct("side").alias("n_sides"), of(0).alias("old"), of(1).alias("new")).filter(F.col("n_sides") == 2)
    equal = F.flatten(
        F.transform(
            "old",
            lambda o: F.transform(F.filter("new", lambda n: n["number"] + 0.0 == o["number"] + 0.0), lambda n: F.struct(o["field"].alias("old_field"), n["field"].alias("new_field"))),
        )
    )
    # the pair without names counts the records of both files
    met = records.select("pair_id", F.explode(F.concat(F.array_distinct(equal), F.array(F.struct(F.lit("").alias("old_field"), F.lit("").alias("new_field"))))).alias("p"))
    n = met.groupBy("pair_id", "p").agg(F.count("*").alias("n"))
    held = n.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "p.old_field", "p.new_field"))).alias("all"))
    of_both = F.filter("all", lambda x: (x["old_field"] == "") & (x["new_field"] == ""))[0]["less"]
    ranked = held.select("pair_id", F.filter("all", lambda x: ((x["old_field"] != "") | (x["new_field"] != "")) & (2 * x["less"] <= of_both)).alias("all"))
    taken = F.aggregate(
        "all",
        F.slice("all", 1, 0),
        lambda acc, x: F.when(F.exists(acc, lambda t: (t["old_field"] == x["old_field"]) | (t["new_field"] == x["new_field"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return ranked.select(F.col("pair_id").alias("file_id"), F.explode(taken).alias("t")).select("file_id", "t.old_field", "t.new_field")


def drift_report(files: DataFrame, stream: Sequence[str], ts: str, numbers: Sequence[str]) -> DataFrame:
    """file_id, change_kind, old_field, new_field: what became of the fields since the stream's preceding file.

    Kinds are ``renamed``, ``removed``, ``added`` and ``retyped``. A field without values has no type in a file and
    keeps its last one; a renamed field takes its type along. A stream's first file and an empty table give no rows.
    """
    heads = checkpoint(file_headers(files, stream, ts))
    # small tables, one row per file and field, each used several times
    named, kinds = checkpoint(renames(records(files, numbers), heads)), checkpoint(field_types(ingest(files, numbers), numbers))
    before = heads.select(F.col("file_id").alias("previous_id"), F.col("names").alias("old_names"))
    pairs = heads.filter(F.col("previous_id").isNotNull()).join(before, "previous_id")
    gone = named.groupBy("file_id").agg(F.collect_set("old_field").alias("olds"), F.collect_set("new_field").alias("news"))
    none = F.array().cast("array<string>")
    moved = pairs.join(gone, "file_id", "left")
    removed = moved.select("file_id", F.lit("removed").alias("change_kind"), F.explode(F.array_except(F.array_except("old_names", "names"), F.coalesce("olds", none))).alias("old_field"), F.lit("").alias("new_field"))
    added = moved.select("file_id", F.lit("added").alias("change_kind"), F.lit("").alias("old_field"), F.explode(F.array_except(F.array_except("names", "old_names"), F.coalesce("news", none))).alias("new_field"))
    # the types that each name had; a renamed field's new name first gets the type that the old one has just had
    seen = kinds.join(heads.select("file_id", "seq", "previous_id", *stream), "file_id")
    inherited = named.join(heads.select("file_id", "seq", "previous_id", *stream), "file_id").join(
        kinds.select(F.col("file_id").alias("previous_id"), F.col("field").alias("old_field"), "kind"), ["previous_id", "old_field"]
    )
    history = seen.select(*stream, "field", "seq", F.lit(1).alias("own"), "kind", "file_id").unionByName(
        inherited.select(*stream, F.col("new_field").alias("field"), "seq", F.lit(0).alias("own"), "kind", "file_id")
    )
    w = Window.partitionBy(*stream, "field").orderBy("seq", "own")
    retyped = (
        history.withColumn("last", F.lag("kind").over(w))
        .filter((F.col("own") == 1) & (F.col("last") != F.col("kind")))
        .select("file_id", F.lit("retyped").alias("change_kind"), F.col("field").alias("old_field"), F.col("field").alias("new_field"))
    )
    renamed = named.select("file_id", F.lit("renamed").alias("change_kind"), "old_field", "new_field")
    return renamed.unionByName(removed).unionByName(added).unionByName(retyped)


def _roots(edges: Sequence[tuple[str, str]], known: set[str]) -> dict[str, str]:
    """For each name that leads by renames, old or new, to exactly one known name: that one."""
    of: dict[str, set[str]] = {}
    for old, new in edges:
        of.setdefault(new, set()).add(old)
        of.setdefault(old, set()).add(new)
    out = {}
    for name in of.keys() - known:
        reached, todo = {name}, [name]
        while todo:
            for other in of.get(todo.pop(), set()) - reached:
                reached.add(other)
                if other not in known:
                    todo.append(other)
        found = reached & known
        if len(found) == 1:
            out[name] = found.pop()
    return out


def one_table(files: DataFrame, stream: Sequence[str], ts: str, numbers: Sequence[str], approved: Sequence[str] = (), most_fields: int = 2000, most_renames: int = 200_000) -> DataFrame:
    """All files in one table, a column per field, and ``_rescued`` for what is no number.

    Unknown fields are promoted: a field that its stream's files show to be a renamed target column goes into that
    column in this stream, another one with numbers into a column of its own. ``approved`` limits the promoted names;
    empty approves all. The names and renames are few and are brought to the driver, the streams' aliases back by
    broadcast; beyond ``most_fields`` or ``most_renames`` the call fails rather than leaving some out.
    """
    heads = checkpoint(file_headers(files, stream, ts))
    known = {*numbers, *KEY}
    edges = renames(records(files, numbers), heads).join(heads.select("file_id", *stream), "file_id").select(*stream, "old_field", "new_field").distinct().limit(most_renames + 1).collect()
    found = heads.select(F.explode("names").alias("n")).distinct().limit(most_fields + 1).collect()
    rows = ingest(files, numbers)
    if len(edges) > most_renames or len(found) > most_fields:
        raise ValueError(f"more than {most_fields} field names or {most_renames} renames")
    # of the names in the headers, those with a number somewhere get a column
    typed = rows.filter(F.col("_rescued").isNotNull()).select(F.explode(F.map_entries(F.from_json("_rescued", _RESCUED))).alias("e")).filter(to_number(trim_blanks(F.col("e.value"))).isNotNull())
    unknown = {r[0] for r in typed.select("e.key").distinct().limit(2 * most_fields + 1).collect()} - known
    by_stream: dict[tuple, list[tuple[str, str]]] = {}
    for r in edges:
        by_stream.setdefault(tuple(r[c] for c in stream), []).append((r["old_field"], r["new_field"]))
    chosen = sorted(unknown if not approved else unknown & set(approved))
    aliases = [(*k, {f: c for f, c in _roots(v, known).items() if f in chosen}) for k, v in by_stream.items()]
    schema = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in stream) + ", _aliases map<string,string>"
    told = files.sparkSession.createDataFrame([a for a in aliases if a[-1]], schema)
    a, h = told.alias("a"), heads.alias("h")
    on = F.lit(True)
    for c in stream:
        on = on & F.col(f"h.{c}").eqNullSafe(F.col(f"a.{c}"))
    of_file = h.join(F.broadcast(a), on).select("h.file_id", "a._aliases")
    return promote(rows.join(of_file, "file_id", "left"), {f: f for f in chosen}, "_aliases")
