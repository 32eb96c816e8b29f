"""Encoding of a corpus with a public byte-level BPE vocabulary, by a table of distinct words.

A word is a stretch of text that begins at a blank before a character that is not white space (or at the text's start).
The tokenizer never merges across such a place, so a text's ids are its words' ids in order. Texts are split on the JVM;
each distinct word is encoded once, and its ids are joined back to the words' positions. Decoding joins ids with a table
of the vocabulary's pieces.

A few words fill most of all positions. The most frequent ones, a fixed number of bounded length, are known to every
task and looked up within a text's list of words, by Arrow batches without a loop; texts keep their row. Only the words
left over, which are rare each, are joined by shuffle and put into the gaps of their texts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import checkpoint

#: Where the vocabularies lie; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words that every task knows, and the most characters that one of them may have: some tens of MB at most.
HEAD_WORDS, HEAD_CHARS = 20_000, 256
#: Longer words may be frequent too: their rows are spread over so many copies of the table's.
SALTS = 16

# White space, spelled out for the JVM; the pattern that splits texts before the merges.
_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD_START = rf"(?= [^{_WS}])"
PYTHON_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_IDS = T.ArrayType(T.IntegerType())


@lru_cache(maxsize=4)
def _pieces(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=PYTHON_PATTERN, mergeable_ranks=_pieces(path), special_tokens={})


def words(docs: DataFrame) -> DataFrame:
    """doc_id, seal, words: of every text that has one, its words in order, which together are the text.

    ``seal`` is a hash of the text.
    """
    own = docs.filter(F.col("text").isNotNull() & (F.col("text") != ""))
    return own.select("doc_id", F.xxhash64("text").alias("seal"), F.split("text", WORD_START).alias("words"))


def word_table(split: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """word, n, ids: each distinct word, how often it occurs, and its ids; every word is encoded once."""

    @F.pandas_udf(_IDS)
    def encode(word: pd.Series) -> pd.Series:
        one = encoder(vocabulary).encode_ordinary
        return pd.Series([one(w) for w in word])

    return split.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).select("word", "n", encode("word").alias("ids"))


class Known(NamedTuple):
    """The distinct words, checkpointed, and the frequent ones as Arrow arrays."""

    table: DataFrame
    head: pa.Table


def known_words(split: DataFrame, vocabulary: str = VOCABULARY) -> Known:
    table = checkpoint(word_table(split, vocabulary))
    head = table.filter(F.length("word") <= HEAD_CHARS).orderBy(F.col("n").desc(), "word").limit(HEAD_WORDS)
    return Known(table, head.select("word", "ids").toArrow())


def _ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places of stretches that begin at ``starts``, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _looked_up(batch: pa.RecordBatch, head_words: pa.Array, head_ids: np.ndarray, head_starts: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """Of a batch's lists of words, the ids of the frequent words and, as (at, word), the others with their places.

    ``at`` is how many ids of frequent words stand before the word.
    """
    lists = batch.column("words")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    found = pc.index_in(flat, value_set=head_words.cast(flat.type))
    rare = pc.is_null(found)
    place = found.fill_null(0).to_numpy().astype(np.int64)
    is_rare = rare.to_numpy(zero_copy_only=False)
    size = np.where(is_rare, 0, head_starts[place + 1] - head_starts[place])
    before = np.concatenate([[0], np.cumsum(size)])
    ids = head_ids[_ragged(size, head_starts[place])]
    id_offsets = before[offsets]
    doc = np.repeat(np.arange(len(lists)), np.diff(offsets))
    at = (before[:-1] - id_offsets[doc])[is_rare].astype(np.int32)
    rare_offsets = np.concatenate([[0], np.cumsum(is_rare)])[offsets]
    gaps = pa.StructArray.from_arrays([pa.array(at), flat.filter(rare)], ["at", "word"])
    as_list = lambda o, v: pa.ListArray.from_arrays(pa.array(o, type=pa.int32()), v)
    return as_list(id_offsets, pa.array(ids.astype(np.int32))), as_list(rare_offsets, gaps)


def placed(split: DataFrame, known: Known) -> DataFrame:
    """doc_id, seal, ids, gaps: the ids of a text's frequent words, and its other words with their places among them."""
    spark = split.sparkSession
    ids = known.head.column("ids").combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    starts, flat = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy().astype(np.int64)
    names = known.head.column("word").cast(pa.string()).combine_chunks()
    shared = spark.sparkContext.broadcast((names.to_pylist(), flat, starts))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, flat, starts = shared.value
        head_words = pa.array(names, type=pa.string())
        if not len(starts) or len(starts) == 1:  # no frequent word at all
            starts, flat = np.zeros(2, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                lists, gaps = _looked_up(b, head_words, flat, starts)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("seal"), lists, gaps], ["doc_id", "seal", "ids", "gaps"])

    schema = T.StructType([split.schema["doc_id"], T.StructField("seal", T.LongType()), T.StructField("ids", _IDS), T.StructField("gaps", T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("word", T.StringType())])))])
    return split.mapInArrow(look_up, schema)


def _filled(ids: str, gaps: str):
    """ids with the gaps' ids at their places; ``gaps`` is sorted."""
    end = lambda i: F.coalesce(F.get(gaps, i)["at"], F.size(ids))
    parts = F.transform(gaps, lambda g, i: F.concat(g["ids"], F.slice(ids, g["at"] + 1, end(i + 1) - g["at"])))
    return F.when(F.col(gaps).isNull(), F.col(ids)).otherwise(F.concat(F.slice(ids, F.lit(1), F.get(gaps, F.lit(0))["at"]), F.flatten(parts)))


def _once(at: DataFrame) -> DataFrame:
    """Without rows that repeat a doc_id with the same text; only keys are shuffled if none does."""
    first = at.groupBy("doc_id", "seal").agg(F.min("row").alias("first"), F.count("*").alias("k")).filter("k > 1").drop("k")
    if first.isEmpty():
        return at
    a, f = at.alias("a"), first.alias("f")
    both = a.join(f, F.col("a.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("a.seal") == F.col("f.seal")), "left")
    return both.filter(F.col("first").isNull() | (F.col("row") == F.col("first"))).select("a.*")


def texts_with_gaps(docs: DataFrame, known: Known) -> DataFrame:
    """doc_id, seal, row, ids, gaps: every text that has words, once for each doc_id and text, checkpointed."""
    return _once(checkpoint(placed(words(docs), known).withColumn("row", F.monotonically_increasing_id())))


def gap_ids(texts: DataFrame, known: Known, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` and pos, at, ids: each word in a gap with its ids."""
    salt = lambda other: F.when(F.length("word") > HEAD_CHARS, other).otherwise(F.lit(0))
    rare = texts.select(*keep, F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"), F.posexplode("gaps").alias("pos", "gap")).select(*keep, "salt", "pos", "gap.at", "gap.word")
    table = known.table.select("word", "ids", F.explode(F.sequence(F.lit(0), salt(F.lit(SALTS - 1)))).alias("salt"))
    return rare.withColumn("salt", salt(F.col("salt"))).join(table, ["word", "salt"]).select(*keep, "pos", "at", "ids")


def encoded_texts(docs: DataFrame, known: Known) -> DataFrame:
    """doc_id, seal, ids: the ids of every text that has some, once for each doc_id and text.

    Texts whose words are all frequent are not shuffled.
    """
    at = texts_with_gaps(docs, known)
    met = gap_ids(at, known, ["row"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "at", "ids"))).alias("gaps"))
    open_ = at.filter(F.size("gaps") > 0).select("row", "doc_id", "seal", "ids").join(met, "row")
    whole = at.filter(F.size("gaps") == 0).select("doc_id", "seal", "ids")
    return whole.unionByName(open_.select("doc_id", "seal", _filled("ids", "gaps").alias("ids")))


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids: the ids of every text, without special tokens; null and empty texts have an empty list.

    Strings that look like special tokens are ordinary text. Rows that repeat a doc_id with the same text give one row;
    different texts under one doc_id give a row each. Other columns are ignored; an empty table gives no rows.
    """
    none = docs.filter(F.col("text").isNull() | (F.col("text") == "")).select("doc_id").distinct().select("doc_id", F.array().cast(_IDS).alias("ids"))
    return encoded_texts(docs, known_words(words(docs), vocabulary)).select("doc_id", "ids").unionByName(none)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, seal, n_tokens: the number of ids of every text that has some; repeated rows count once."""
    return encoded_texts(docs, known_words(words(docs), vocabulary)).select("doc_id", "seal", F.size("ids").cast("bigint").alias("n_tokens"))


def piece_table(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """id, piece (binary): the vocabulary, a fixed table of some 50,000 rows."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in _pieces(vocabulary).items()], "id int, piece binary")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text: texts from their ids by a join with the pieces; an empty list gives an empty text.

    Ids outside of the vocabulary fail. Each list must have its own doc_id.
    """
    pieces = F.broadcast(piece_table(encoded.sparkSession, vocabulary))
    spread = encoded.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(pieces, "id", "left")
    checked = F.when(F.col("piece").isNull(), F.raise_error(F.lit("an id outside of the vocabulary"))).otherwise(F.hex("piece"))
    held = spread.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", checked.alias("h")))).alias("p"))
    texts = held.select("doc_id", F.unhex(F.array_join("p.h", "")).cast("string").alias("text"))
    none = encoded.filter(F.size("ids") == 0).select("doc_id", F.lit("").alias("text"))
    return texts.unionByName(none)
