"""Fixed-capacity containers filled by lexical retrieval over a sharded BM25 index.

Texts are spread over shards by hash, as many as keep a shard near ``SHARD_TOKENS`` tokens. Each shard has its own
inverted index, whose terms are the tokenizer's ids: they exist for every script, and a text's ids are its size too. The
largest unused text is a container's seed; the index returns its unused neighbours by BM25 score, which fill the window
greedily. When little is left, the largest of the retrieved neighbours that fits closes the gap. Only what no neighbour
fills is closed by size alone.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.encoding import VOCABULARY, gap_ids, known_words, texts_with_gaps, words

CAPACITY = 2048
#: Tokens in a shard, on average: it bounds what one task holds; each shard may waste part of its last containers.
SHARD_TOKENS = 1_000_000
#: BM25's usual parameters.
K1, B = 1.2, 0.75
#: Terms in more than this share of a shard's texts are stop terms: no postings, as they tell no text from another.
STOP_SHARE = 0.2
#: Below this share of the capacity a gap is closed by the neighbours' sizes rather than in the order of their scores.
CLOSE_SHARE = 0.1


class Index:
    """An inverted index with BM25 weights over the texts, given as ids, of one shard."""

    def __init__(self, texts: list[np.ndarray]):
        self.n = len(texts)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=self.n)
        flat = np.concatenate(texts).astype(np.int64) if self.n else np.zeros(0, np.int64)
        own, term = np.unique(flat, return_inverse=True)
        docs, terms = np.repeat(np.arange(self.n), lengths), max(1, len(own))
        key, tf = np.unique(docs * terms + term, return_counts=True)
        docs, term = np.divmod(key, terms)
        df = np.bincount(term, minlength=terms)
        kept = df[term] <= max(2.0, STOP_SHARE * self.n)
        docs, term, tf = docs[kept], term[kept], tf[kept]
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(lengths.mean(), 1e-9)) if self.n else lengths
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[docs])
        self.terms, self.text_starts = term, np.searchsorted(docs, np.arange(self.n + 1))
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = docs[order], weight[order]
        self.starts = np.searchsorted(term[order], np.arange(terms + 1))

    def drop_used(self, unused: np.ndarray) -> None:
        """Postings of used texts are taken out."""
        kept = unused[self.docs]
        self.starts = np.concatenate([[0], np.cumsum(kept)])[self.starts]
        self.docs, self.weights = self.docs[kept], self.weights[kept]

    def scores(self, text: int) -> np.ndarray:
        """The score of every text for the terms of text ``text``."""
        terms = self.terms[self.text_starts[text] : self.text_starts[text + 1]]
        first, size = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        ends = np.cumsum(size)
        if not len(ends) or not ends[-1]:
            return np.zeros(self.n)
        at = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
        return np.bincount(self.docs[at], self.weights[at], self.n)


def fill(texts: list[np.ndarray], capacity: int = CAPACITY) -> tuple[list[list[int]], int, int]:
    """Containers, as lists of the texts' numbers, and how many texts retrieval and size alone have placed.

    Every text has 1 to ``capacity`` ids.
    """
    index = Index(texts)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    unused = np.ones(len(texts), dtype=bool)
    by_size = sorted((s, -i) for i, s in enumerate(size.tolist()))  # of equal sizes the first text is taken first
    out, retrieved, sized, held = [], 0, 0, len(texts)

    def take(i: int) -> int:
        unused[i] = False
        del by_size[bisect_right(by_size, (int(size[i]), -i)) - 1]
        return int(size[i])

    while by_size:
        seed = -by_size[-1][1]
        window, gap = [seed], capacity - take(seed)
        if by_size and gap >= by_size[0][0]:
            score = index.scores(seed)
            near = np.flatnonzero(unused & (score > 0) & (size <= gap))
            near = near[np.lexsort((near, -score[near]))]
            for n in near.tolist():
                if gap <= capacity * CLOSE_SHARE:
                    break
                if size[n] <= gap:
                    gap -= take(n)
                    window.append(n)
            near = near[unused[near]]
            while len(near := near[size[near] <= gap]):
                best = int(np.argmax(size[near]))  # of equal sizes the nearest
                gap -= take(int(near[best]))
                window.append(int(near[best]))
                near = np.delete(near, best)
            retrieved += len(window) - 1
        while by_size and gap >= by_size[0][0]:
            n = -by_size[bisect_right(by_size, (gap, 1)) - 1][1]
            gap -= take(n)
            window.append(n)
            sized += 1
        out.append(window)
        if len(by_size) < held * 0.6:
            index.drop_used(unused)
            held = len(by_size)
    return out, retrieved, sized


def _whole_texts(texts: pd.DataFrame, gaps: pd.DataFrame) -> list[np.ndarray]:
    """The ids of each text, its gaps filled; ``gaps`` has each text's words in order."""
    order = np.lexsort((gaps["gap_pos"].to_numpy(), gaps["gap_row"].to_numpy()))
    row, at = gaps["gap_row"].to_numpy()[order], gaps["gap_at"].to_numpy()[order]
    words = gaps["gap_ids"].to_numpy()[order].tolist()
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.concatenate(words) if words else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(size)])
    first, last = np.searchsorted(row, texts["row"].to_numpy(), "left"), np.searchsorted(row, texts["row"].to_numpy(), "right")
    out = []
    for ids, lo, hi in zip(texts["ids"], first.tolist(), last.tolist(), strict=True):
        out.append(np.insert(ids, np.repeat(at[lo:hi], size[lo:hi]), flat[starts[lo] : starts[hi]]) if lo < hi else np.asarray(ids))
    return out


def _pack_shard(capacity: int):
    def pack(key: tuple, texts: pd.DataFrame, gaps: pd.DataFrame) -> pd.DataFrame:
        texts = texts.sort_values(["doc_id", "seal"], kind="stable")
        shard = int(key[0]) << 32
        rows, at = [], 0
        items = []
        for doc, ids in zip(texts["doc_id"], _whole_texts(texts, gaps), strict=True):
            whole, rest = divmod(len(ids), capacity)
            for piece in range(whole):
                rows.append((doc, piece, shard + at, capacity))
                at += 1
            if rest:
                items.append((doc, whole, ids[-rest:]))
        for window in fill([x[2] for x in items], capacity)[0]:
            for i in window:
                doc, piece, ids = items[i]
                rows.append((doc, piece, shard + at, len(ids)))
            at += 1
        return pd.DataFrame(rows, columns=["doc_id", "piece_no", "container_id", "n_tokens"])

    return pack


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, piece_no, container_id, n_tokens: every token of every text in exactly one container.

    A text of more than ``capacity`` tokens is cut into full pieces, a container each, and a rest that is packed like
    other texts. Texts without tokens are left out. Rows that repeat a doc_id with the same text count once; other
    columns are ignored; an empty table gives no rows.
    """
    known = known_words(words(docs), vocabulary)
    total = known.table.agg(F.sum(F.col("n") * F.size("ids"))).first()[0] or 0
    shards = max(1, round(total / shard_tokens))
    # ids as texts: in Python, where a null would turn integers into floats, they stay texts
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("\0"))
    texts = texts_with_gaps(docs, known).withColumn("shard", F.pmod(F.xxhash64(name, "seal"), F.lit(shards)).cast("int"))
    gaps = gap_ids(texts, known, ["shard", "row"]).select(*(F.col(c).alias(f"gap_{c}") for c in ("shard", "row", "pos", "at", "ids")))
    both = texts.select("shard", name.alias("doc_id"), "seal", "row", "ids").groupBy("shard").cogroup(gaps.groupBy("gap_shard"))
    packed = both.applyInPandas(_pack_shard(capacity), "doc_id string, piece_no int, container_id bigint, n_tokens int")
    return packed.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit("\0")).cast(docs.schema["doc_id"].dataType))
