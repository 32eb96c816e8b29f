"""p6, p7 and p8: exact encoding, round trips, whole packing, and sentence units by hand."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest

encoding = pytest.importorskip("tidemark.llm.encoding")
packing = pytest.importorskip("tidemark.llm.packing")
sentences = pytest.importorskip("tidemark.llm.sentences")
plans = pytest.importorskip("tidemark.llm.plans")

TEXTS = [
    None, "", " ", "\n\n", "Hello  world\n\n don't 'tis <|endoftext|> 123４５", "नमस्ते दुनिया। ไทย 中文，标点。", "a" * 50_000, " ".join(["word"] * 20_000), "͸ new 🏈🏽👩‍🏫 \U0001fae8ೳ", "x y z　w\x1cq\x85r", "é é ß İ ﬁ",
]


def _docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "s", 1, "w") for i, t in enumerate(texts)], "doc_id bigint, text string, seal string, pos int, word string")


def test_ids_equal_the_library(spark, sf):
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(encoding.VOCABULARY.replace(".tiktoken", ".json"))
    tok.encode_special_tokens = True
    for docs in (_docs(spark), spark.read.parquet(f"{sf}/documents.parquet")):
        got = {r.doc_id: list(r.ids) for r in encoding.encode(docs).collect()}
        want = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids for r in docs.select("doc_id", "text").collect()}
        assert got == want


def test_round_trip(spark):
    docs = _docs(spark)
    back = {r.doc_id: r.text for r in encoding.decode(encoding.encode(docs)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    with pytest.raises(Exception, match="outside"):
        encoding.decode(spark.createDataFrame([(1, [99_999])], "doc_id bigint, ids array<int>")).collect()


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "d"), (2, None), (2, "")], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, len(r.ids)) for r in encoding.encode(docs).collect())
    assert got == [(-1, 1), (1, 1), (1, 2), (2, 0)]
    assert sorted(r.n_tokens for r in encoding.token_counts(docs).collect()) == [1, 1, 2]
    assert encoding.encode(docs.limit(0)).count() == 0


def test_packing_keeps_every_token(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = {r.doc_id: len(r.ids) for r in encoding.encode(docs).collect()}
    p = packing.pack(docs, shard_tokens=20_000).toPandas()
    assert p.groupby("doc_id").n_tokens.sum().to_dict() == {k: v for k, v in n.items() if v}
    assert p.groupby("container_id").n_tokens.sum().max() <= 2048
    for doc, g in p.groupby("doc_id"):
        assert sorted(g.piece_no) == list(range(len(g))) and (len(g) == 1 or (n[doc] > 2048 and sorted(g.n_tokens)[-1] == 2048 and len(g) == -(-n[doc] // 2048)))
    whole = packing.pack(docs).toPandas()
    assert whole.container_id.nunique() <= -(-sum(n.values()) // 2048) * 1.03 + 1


def test_packing_edges(spark):
    docs = _docs(spark, [None, "", "a b", "a b", " x" * 5000])
    p = packing.pack(docs, capacity=2048).toPandas()
    assert set(p.doc_id) == {2, 3, 4} and sorted(p[p.doc_id == 4].n_tokens) == [904, 2048, 2048]
    assert packing.pack(docs.limit(0)).count() == 0
    nulls = packing.pack(spark.createDataFrame([(None, "a"), (2**60 + 1, "b")], "doc_id bigint, text string")).toPandas()
    assert sorted(nulls.doc_id.dropna().astype("int64")) == [2**60 + 1] or len(nulls) == 2


def _text(*parts):
    """Ids of a text: (id, how often) each."""
    return np.concatenate([np.full(n, i) for i, n in parts]) if parts else np.zeros(0, int)


def test_fill_takes_neighbours_first():
    # 0 and 3 share id 1, 1 and 2 share id 2; by size alone 0 would be filled with 2
    texts = [_text((1, 600), (9, 10)), _text((2, 650)), _text((2, 300), (8, 20)), _text((1, 200))]
    texts += [_text((100 + i, 900)) for i in range(6)]
    out, retrieved, sized = packing.fill(texts, 1000)
    of = {i: k for k, w in enumerate(out) for i in w}
    assert of[0] == of[3] and of[1] == of[2] and (retrieved, sized) == (2, 0)
    assert sorted(i for w in out for i in w) == list(range(10))
    assert packing.fill([], 10) == ([], 0, 0)
    out, retrieved, sized = packing.fill([_text((1, 6)), _text((2, 5)), _text((3, 4))], 10)
    assert sorted(map(sorted, out)) == [[0, 2], [1]] and (retrieved, sized) == (0, 1)


def test_fill_is_mostly_by_retrieval(spark, sf):
    docs = [np.asarray(r.ids)[:2048] for r in encoding.encode(spark.read.parquet(f"{sf}/documents.parquet")).orderBy("doc_id").collect() if len(r.ids)]
    out, retrieved, sized = packing.fill(docs)
    assert sorted(i for w in out for i in w) == list(range(len(docs))) and all(sum(len(docs[i]) for i in w) <= 2048 for w in out)
    assert retrieved + sized + len(out) == len(docs) and retrieved >= 0.8 * (retrieved + sized)


def test_many_rare_words_and_long_ones(spark):
    """Words beyond the table of frequent ones, also long and repeated, come back to their places."""
    long = "x" * 300
    texts = [" ".join(f"w{i}q{j}" for j in range(40)) + " " + long for i in range(50)] + [f"{long} {long}  {long}\n {long} ", " a", "a ", "  ", "\u00a0 b \u3000 c"]
    docs = _docs(spark, texts)
    head, encoding.HEAD_WORDS = encoding.HEAD_WORDS, 5
    try:
        got = {r.doc_id: list(r.ids) for r in encoding.encode(docs).collect()}
        encoding.HEAD_WORDS = 0
        assert {r.doc_id: list(r.ids) for r in encoding.encode(docs).collect()} == got
    finally:
        encoding.HEAD_WORDS = head
    want = dict(enumerate(encoding.encoder(encoding.VOCABULARY).encode_ordinary_batch(texts)))
    assert got == want


CASES = {
    "Mr. Orsk won. It closed at 3.5. No. 3 fell to No. 28. See fig. 4 resp. table 2, col. 1.": ["Mr. Orsk won.", "It closed at 3.5.", "No. 3 fell to No. 28.", "See fig. 4 resp. table 2, col. 1."],
    '"Take it!" read the note. “Why?” asked Orsk, “when?” (It starts in wk. 16.) Done': ['"Take it!" read the note.', "“Why?” asked Orsk, “when?”", "(It starts in wk. 16.)", "Done"],
    "Played at Zelly St. The rest of Zelly St. slid, W. Obrund did not.": ["Played at Zelly St.", "The rest of Zelly St. slid, W. Obrund did not."],
    "The market … did not. On attend… et non. Sure...": ["The market … did not.", "On attend… et non.", "Sure..."],
    "Die Linie fiel z. B. von 0,7 auf 6. Am 27. Oktober, d. h. in der 16. Woche! „Wer?“, fragte er.": ["Die Linie fiel z. B. von 0,7 auf 6.", "Am 27. Oktober, d. h. in der 16. Woche!", "„Wer?“, fragte er."],
    "«\xa0Quoi\xa0!\xa0», a noté M. Orsk. Quelle surprise ! Voir p. 3.": ["«\xa0Quoi\xa0!\xa0», a noté M. Orsk.", "Quelle surprise !", "Voir p. 3."],
    "См. табл. 2 и рис. 3, т. е. мало. Какой финал! «Ждём», — записал он.": ["См. табл. 2 и рис. 3, т. е. мало.", "Какой финал!", "«Ждём», — записал он."],
    "Γιατί έπεσε; Τι νύχτα! Βλ. σελ. 4, π.χ. εδώ.": ["Γιατί έπεσε;", "Τι νύχτα!", "Βλ. σελ. 4, π.χ. εδώ."],
    "“谁动了盘口？”记录员问道。真是恶战！第1周……没有到。": ["“谁动了盘口？”记录员问道。", "真是恶战！", "第1周……没有到。"],
    "「誰が？」と聞かれた。なんという接戦だ！": ["「誰が？」と聞かれた。", "なんという接戦だ！"],
    "पृ. 7 पर देखें। डॉ. वेलमार ने लिखा।": ["पृ. 7 पर देखें।", "डॉ. वेलमार ने लिखा।"],
    "انظر ص. 26 من الجدول. كتب د. فلمار. لماذا؟ نعم": ["انظر ص. 26 من الجدول.", "كتب د. فلمار.", "لماذا؟", "نعم"],
    "เกมนี้สูสีมากครับ ไฟล์ของสัปดาห์ที่ 21 มาช้า  โมเดล Elo มองว่า S. Zelly นำอยู่ 7 แต้ม": ["เกมนี้สูสีมากครับ", "ไฟล์ของสัปดาห์ที่ 21 มาช้า", "โมเดล Elo มองว่า S. Zelly นำอยู่ 7 แต้ม"],
    "1. Data\n\n• One. Two.\n2. Three? Four!\n \nEnd\r\nnext": ["1. Data", "• One. Two.", "2. Three? Four!", "End", "next"],
}


@pytest.mark.parametrize("text", list(CASES))
def test_sentences_by_hand(text):
    assert [text[a:b] for a, b in sentences.segment(text)] == CASES[text]


def test_names_in_lower_case():
    text = "It fell at Orsk. linedial stayed blank. lineup did not."
    assert [text[a:b] for a, b in sentences.segment(text)] == [text]
    assert [text[a:b] for a, b in sentences.segment(text, None, ("linedial",))] == ["It fell at Orsk.", "linedial stayed blank. lineup did not."]


def test_language_of_a_block():
    german, english = "Siehe Abb. 4 und die Tab. 5 ist neu.", "This is the Abb. 4 of it."
    assert [german[a:b] for a, b in sentences.segment(german)] == [german]
    assert [english[a:b] for a, b in sentences.segment(english)] == ["This is the Abb.", "4 of it."]  # no German in it


def test_further_scripts():
    for text, n in {"Մեկ։ Երկու։": 2, "አንድ። ሁለት።": 2, "တစ်။ နှစ်။": 2, "មួយ។ ពីរ។": 2, "གཅིག། གཉིས།": 2}.items():
        assert len(sentences.segment(text)) == n, text


@pytest.mark.parametrize("part", ["ก A" + " aa bb" * 40_000, "ก " * 40_000, "a." * 40_000, "A. " * 40_000, '" ' * 40_000, ".\u00a0\u201d" * 20_000, "\u2026" * 80_000, " " * 80_000 + ".", "1) " * 30_000, "St. 5.5" * 15_000])
def test_long_texts_take_linear_time(part):
    def took(text):
        began = time.process_time()
        sentences.segment(text)
        return time.process_time() - began

    took("a. b")
    assert took(part * 2) < 3.5 * took(part) + 0.5 and took(part) < 8


def test_layout_by_source():
    text = "skip it. now. A\nB. C"
    assert len(sentences.segment(text, "bet_memo")) == 2 and len(sentences.segment(text, "status_log")) == 2
    text = "The\nend. Of\nit.\n\nAll"
    assert [text[a:b] for a, b in sentences.segment(text, "mail_digest")] == ["The\nend.", "Of\nit.", "All"]
    assert [text[a:b] for a, b in sentences.segment(text, "forum_post")] == ["The", "end.", "Of", "it.", "All"]


def test_every_character_in_one_unit(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = plans.p8_found(spark, sf).toPandas()
    for doc, g in got.groupby("doc_id"):
        spans = sorted(zip(g.start_char, g.end_char, strict=True))
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert all(not text[doc][a].isspace() and not text[doc][b - 1].isspace() for a, b in spans)
        assert "".join("".join(text[doc][a:b].split()) for a, b in spans) == "".join(text[doc].split())
    assert set(got.doc_id) == {k for k, t in text.items() if t and t.strip()}
    assert sentences.segment(None) == sentences.segment("") == sentences.segment(" \n\t") == []
    assert len(sentences.segment("A b. " * 20_000)) == 20_000


def test_counts_are_plain_integers(spark):
    assert isinstance(packing.pack(_docs(spark, ["a"])).toPandas(), pd.DataFrame)
