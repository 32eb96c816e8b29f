"""Readers of the feeds' file forms and the writers that append only what is new."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import is_missing, to_number, trim_blanks

# The part of a scoreboard's JSON that is read.
SCOREBOARD = (
    "struct<events:array<struct<id:string,date:string,competitions:array<struct<status:struct<type:struct<name:string>>,broadcasts:array<struct<names:array<string>>>,"
    "competitors:array<struct<homeAway:string,team:struct<displayName:string,shortDisplayName:string,name:string,location:string,abbreviation:string>>>>>>>>"
)


def read_csv_texts(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV files as texts, with each row's file; gzip files too. No type is inferred."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").csv(paths).withColumn("_file", F.col("_metadata.file_path"))


def typed(rows: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """With missing tokens as null and the named columns as doubles, by the feeds' number grammar; null if they are none."""
    out = []
    for f in rows.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            t = trim_blanks(c)
            c = F.when(~is_missing(t), to_number(t) if f.name.lower() in {n.lower() for n in numbers} else t)
        out.append(c.alias(f.name))
    return rows.select(*out)


def season_from_name(path: str = "_file"):
    """The four-digit year in a file's name; null without one."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")


def union_files(frames: Sequence[DataFrame]) -> DataFrame:
    """All frames by column name; columns that some lack are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def scoreboard_games(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """event_id, kickoff_utc, away, home, away_names, home_names, broadcast, status: a row per event with both sides."""
    e = payloads.select(F.explode(F.from_json(column, SCOREBOARD)["events"]).alias("e"))
    c = F.col("e.competitions")[0]
    side = lambda s: F.filter(c["competitors"], lambda x: x["homeAway"] == s)[0]["team"]
    names = lambda t: F.array_distinct(F.filter(F.array(t["displayName"], t["shortDisplayName"], t["location"], t["name"], t["abbreviation"]), lambda x: x.isNotNull() & (x != "")))
    home, away = side("home"), side("away")
    rows = e.select(
        F.col("e.id").alias("event_id"), F.try_to_timestamp(F.col("e.date")).alias("kickoff_utc"), away["displayName"].alias("away"), home["displayName"].alias("home"), names(away).alias("away_names"), names(home).alias("home_names"),
        F.array_join(F.flatten(F.transform(c["broadcasts"], lambda b: b["names"])), ", ").alias("broadcast"), c["status"]["type"]["name"].alias("status"),
    )
    return rows.filter(F.col("home").isNotNull() & F.col("away").isNotNull())


def fixed_width_rows(pages: DataFrame, pattern: str, names: Sequence[str], column: str = "page") -> DataFrame:
    """A row per line of a page that the pattern matches in full; its groups are the named columns."""
    line = pages.select(F.explode(F.split(column, "\r?\n")).alias("_l")).filter(F.col("_l").rlike(rf"\A(?:{pattern})\z"))
    return line.select(*(trim_blanks(F.regexp_extract("_l", pattern, i + 1)).alias(n) for i, n in enumerate(names)))


def length_prefixed(streams: DataFrame, column: str = "content") -> DataFrame:
    """pos, message: messages of the form ``<length>;<text>`` one after another; a broken rest is left out.

    One stream is one row and is read in one task; a stream is a response, of bounded size.
    """

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for text in pdf[column].dropna():
                at, n = 0, 0
                while (cut := text.find(";", at)) > at and text[at:cut].isdigit() and cut + 1 + int(text[at:cut]) <= len(text):
                    end = cut + 1 + int(text[at:cut])
                    rows.append((n, text[cut + 1 : end]))
                    at, n = end, n + 1
            yield pd.DataFrame(rows, columns=["pos", "message"])

    return streams.select(column).mapInPandas(parse, "pos int, message string")


def fingerprint(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """With sha: a hash of the named columns in order, nulls told from empty texts."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    return rows.withColumn("sha", F.sha2(F.concat_ws("\u001f", *parts), 256))


def new_rows(rows: DataFrame, there: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys the target does not have yet; an append of these can be repeated safely."""
    return rows.dropDuplicates(list(keys)).join(there.select(*keys).distinct(), list(keys), "left_anti")


def _has_files(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(p))


def append_new(rows: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Appends to a Parquet folder what it lacks by its keys; gives the number of rows appended.

    Only a missing folder, or one without files, is an empty target; one that cannot be read fails.
    """
    spark = rows.sparkSession
    there = spark.read.schema(rows.schema).parquet(path) if _has_files(spark, path) else rows.limit(0)
    fresh = new_rows(rows, there, keys).persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n
