"""What changed between full snapshots, by gaps and islands.

Over key and row hash, runs of consecutive snapshots with an unchanged record become validity intervals. An interval's
start, its end and the interval that adjoins it are the change events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One snapshot may hold a third of all rows: its entry in the snapshot order is repeated this often, and records join
#: on (snapshot, salt).
SALTS = 16


def _seal(values: Sequence[Column]) -> Column:
    """A fingerprint of the compared values; null and the empty text differ."""
    parts = [F.coalesce(F.concat(F.lit("="), v.cast("string")), F.lit("~")) for v in values]
    lengths = [F.coalesce(F.length(v.cast("string")).cast("string"), F.lit("~")) for v in values]
    return F.md5(F.concat_ws(",", *lengths, *parts).cast("binary"))


def snapshot_order(rows: DataFrame, stream: Sequence[str], label: str, ts: str) -> DataFrame:
    """The stream's columns, label, seq (from 1) and next_label (null at the last): a stream's snapshots in order.

    Snapshots follow each other by time, then by label; a label's earliest time counts. Rows without label are left out.
    """
    per = rows.filter(F.col(label).isNotNull()).groupBy(*stream, label).agg(F.min(ts).alias("_ts"))
    w = Window.partitionBy(*stream).orderBy(F.col("_ts").asc_nulls_first(), label)
    return per.select(*stream, label, F.row_number().over(w).alias("seq"), F.lead(label).over(w).alias("next_label"))


def validity_intervals(
    rows: DataFrame, stream: Sequence[str], label: str, ts: str, key: Sequence[Column], key_names: Sequence[str], values: Sequence[Column], latest: str
) -> DataFrame:
    """stream, key, seal, first_seq, last_seq, first_label, next_label: how long each record stayed as it was.

    A record that a snapshot lists more than once counts once, as in its row of the highest ``latest`` (of equal ones
    the greatest values). Rows with a null in the key or the label are no records.
    """
    named = rows.filter(F.col(label).isNotNull()).select(
        *[F.col(c) for c in [*stream, label]], *(k.alias(n) for k, n in zip(key, key_names, strict=True)), F.col(latest).alias("_latest"), _seal(values).alias("_seal")
    )
    records = named.dropna(subset=list(key_names)).groupBy(*stream, label, *key_names).agg(F.max(F.struct("_latest", "_seal"))["_seal"].alias("seal"))
    order = snapshot_order(rows, stream, label, ts).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # null parts of a stream's name are a stream of their own
    there, here = order.alias("o"), records.withColumn("_salt", F.pmod(F.xxhash64(*key_names), F.lit(SALTS)).cast("int")).alias("r")
    on = F.col("r._salt") == F.col("o._salt")
    for c in [*stream, label]:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}"))
    placed = here.join(there, on).select(*(F.col(f"r.{c}") for c in [*stream, label, *key_names, "seal"]), "o.seq", "o.next_label")
    w = Window.partitionBy(*stream, *key_names).orderBy("seq")
    starts = F.coalesce((F.lag("seal").over(w) != F.col("seal")) | (F.lag("seq").over(w) != F.col("seq") - 1), F.lit(True))
    island = placed.withColumn("_starts", starts).withColumn("_island", F.sum(F.col("_starts").cast("int")).over(w))
    return island.groupBy(*stream, *key_names, "_island").agg(
        F.first("seal").alias("seal"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.min_by(label, "seq").alias("first_label"),
        F.max_by("next_label", "seq").alias("next_label"),
    )


def change_events(intervals: DataFrame, stream: Sequence[str], key_names: Sequence[str], label: str) -> DataFrame:
    """stream, label, key, change_kind: ``added``, ``removed`` or ``changed``, told at the later snapshot's label."""
    w = Window.partitionBy(*stream, *key_names).orderBy("first_seq")
    adjoins_before = F.coalesce(F.lag("last_seq").over(w) == F.col("first_seq") - 1, F.lit(False))
    adjoins_after = F.coalesce(F.lead("first_seq").over(w) == F.col("last_seq") + 1, F.lit(False))
    begun = F.when(F.col("first_seq") > 1, F.struct(F.col("first_label").alias("label"), F.when(adjoins_before, "changed").otherwise("added").alias("kind")))
    ended = F.when(~adjoins_after & F.col("next_label").isNotNull(), F.struct(F.col("next_label").alias("label"), F.lit("removed").alias("kind")))
    events = intervals.select(*stream, *key_names, F.array_compact(F.array(begun, ended)).alias("_events"))
    events = events.select(*stream, *key_names, F.explode("_events").alias("_e"))
    return events.select(*stream, F.col("_e.label").alias(label), *key_names, F.col("_e.kind").alias("change_kind"))


def snapshot_changes(
    rows: DataFrame, stream: Sequence[str], label: str, ts: str, key: Sequence[Column], key_names: Sequence[str], values: Sequence[Column], latest: str
) -> DataFrame:
    """The change events between consecutive full snapshots of each stream.

    ``values`` are the compared columns, ``key`` the record's columns as they shall be compared and given. Extra columns
    are ignored; an empty table gives no rows; a stream's first snapshot gives none.
    """
    return change_events(validity_intervals(rows, stream, label, ts, key, key_names, values, latest), stream, key_names, label)
