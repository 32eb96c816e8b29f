"""Sentence units by cascading tables of segmentation rules.

A rule has a pattern for what stands before a position and one for what follows, and says break or no break. At every
candidate position the tables are gone through in order, and the first rule whose two patterns match decides. The layout
comes first: blank lines and line breaks part blocks, and a log line, memo line or list entry is one unit. Then come the
tables of the languages that the block may be in, then the common rules.

A table applies to a block where its script occurs. Of languages that share a script, one does not apply where the block
has function words of others and none of its own; the language tag decides nothing else, for tags are missing or wrong
and texts mix languages. Texts are read whole; the work per text is linear in its length: no pattern reads a stretch
twice, and rules that cannot match are passed over in groups by one pattern.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache, lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Rule(NamedTuple):
    """``far``: what follows may be a long stretch; else it has at most REACH characters after white space."""

    breaks: bool
    before: str
    after: str
    far: bool = False


class Table(NamedTuple):
    """Rules of a language or a script; ``language`` is set for languages that share their script with others."""

    name: str
    script: str | None
    rules: list[Rule]
    language: str | None = None


# Marks that end sentences, marks that may close them, and abbreviations by language.
STOPS = r".!?…。！？।॥؟۔｡．;։።፧။។៕།"
CLOSERS = r"""(?:["'”’»」』）)\]}】》›]|“(?=[\s,.;:!?)]|\Z))"""
OPENERS = r"""["'“‘«„「『（(\[{【《‹¿¡]"""
TITLES = {
    "en": "Mr Mrs Ms Dr Prof Rev Gen Sen Gov Capt Lt Col Sgt Messrs Hon",
    "de": "Hr Fr Dr Prof Dipl Ing",
    "fr": "Mme Mlle Mgr Dr Prof",
    "es": "Sr Sra Srta Sres Dr Dra Prof Ud Uds Dña",
    "ru": "Проф проф Им им Акад акад Гр гр Тов тов",
    "el": "κ κα κκ Κ Κα Δρ δρ Καθ καθ",
    "ar": "د أ م",
    "hi": "डॉ श्री प्रो कु सुश्री",
}
# Always go on, whatever follows.
INNER = {
    "en": "vs e.g i.e cf approx resp viz al incl esp",
    "de": "bzw vgl Vgl ca evtl ggf inkl sog usf zzgl",
    "fr": "env c.-à-d cf",
    "es": "aprox p.ej cf",
    "ru": "т.е т.н см См ср Ср напр Напр",
    "el": "π.χ δηλ βλ Βλ πρβλ",
    "ar": "",
    "hi": "",
}
# Go on before a number.
NUMBERED = {
    "en": "No Nos no nos Fig Figs fig figs Sec sec Col col Wk wk Ch ch Vol vol Eq eq Tab tab p pp Art art ver v Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec",
    "de": "Nr Nrn Abb Tab Kap Bd Abs Art S Ziff Anm Aufl",
    "fr": "p pp art chap fig vol tabl nº no env",
    "es": "pág págs núm núms cap caps fig figs vol art tab",
    "ru": "табл рис стр с п пп гл ст Рис Табл",
    "el": "σελ αρ κεφ εικ πίν",
    "ar": "ص ج ف",
    "hi": "पृ क्र सं अ",
}
SCRIPTS = {"en": "Latin", "de": "Latin", "fr": "Latin", "es": "Latin", "ru": "Cyrillic", "el": "Greek", "ar": "Arabic", "hi": "Devanagari"}
GERMAN_COUNTED = "Woche|Wochen|Spieltag|Spieltags|Spieltages|Platz|Rang|Runde|Mal|Tag|Jahr|Jahrhundert|Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
CHINESE_SAYING = "说|道|问|写|答|称|喊|表示|认为|指出"


# Common function words, by which a block's language is told.
FUNCTION_WORDS = {
    "en": "the of and to in is was for on with that it at by from are this not but",
    "de": "der die das und ist nicht ein eine zu den von mit auf für im sich dem war auch",
    "fr": "le la les et des du une est dans pour pas que qui sur au avec il ce",
    "es": "el la los las y de una es en que por con se del al no para su",
}


def _words(names: str) -> str:
    return "|".join(sorted(map(regex.escape, names.split()), key=len, reverse=True))


def _abbreviations(lang: str) -> list[Rule]:
    # names in Latin letters stand in sentences of other scripts without a blank before them
    start = rf"(?<![\p{{{SCRIPTS[lang]}}}\p{{M}}\p{{N}}])"
    rules = [Rule(False, rf"{start}(?:{_words(TITLES[lang] + ' ' + INNER[lang])})\.", r"\s")]
    if NUMBERED[lang]:
        rules.append(Rule(False, rf"{start}(?:{_words(NUMBERED[lang])})\.", r"\s+[\p{N}#(]"))
    return rules


TABLES = [
    *(Table(lang, SCRIPTS[lang], _abbreviations(lang), lang if lang in FUNCTION_WORDS else None) for lang in SCRIPTS),
    Table(
        "de",
        "Latin",
        [
            Rule(False, r"(?<![\p{L}\p{N}])\p{N}{1,4}\.", rf"\s+(?:{GERMAN_COUNTED})(?!\p{{L}})"),
            Rule(False, r"(?<!\p{L})[zZ]\.", r"\s+B\."),
        ],
        "de",
    ),
    Table(
        "names",
        "Latin",
        [
            # a short form of State, Saint or Street within a sentence
            Rule(False, r"(?<!\p{Latin})St\.", r"\s*\p{Lo}|\s+(?:[&@/+\-−–]|\([\p{Ll}\p{N}+\-−])"),
            Rule(False, r"(?<!\p{Latin})St\.", r"\s+\p{N}[\p{N}.,]*\s+[\p{Lo}]"),
            Rule(False, r"(?<![\p{Latin}&])(?:N|S|E|W|No|So|Ft|Mt)\.", r"\s+\p{Lu}"),
        ],
    ),
    Table("zh", "Han", [Rule(False, r"[。！？!?…][”」』]", rf"\p{{Han}}{{0,10}}(?:{CHINESE_SAYING})"), Rule(False, r"…+", r"[^\s]")]),
    Table("ja", "Hiragana|Katakana", [Rule(False, r"[。！？!?][」』”]", r"(?:と|って|など|の|を|は|が)")]),
    Table("ko", "Hangul", [Rule(False, r"[.!?。！？][”’」』\"']", r"\p{Hangul}")]),
    Table("el", "Greek", [Rule(False, r";", r"\s+\p{Ll}"), Rule(True, rf"\p{{Greek}}\p{{M}}*;{CLOSERS}*", r"\s")]),
    Table("hi", "Devanagari", [Rule(True, rf"[।॥]{CLOSERS}*", r"\s*[^\s,;]")]),
    Table(
        "th",
        "Thai",
        [
            Rule(False, r"\p{Thai}", r"\s+ๆ"),
            Rule(True, r"\p{Thai}", r"\s+[“\"(«]?\p{Thai}"),
            # a sentence in Latin letters follows: it has two plain words in a row and its own end mark
            Rule(True, r"\p{Thai}", r"\s+[“\"(]?\p{Lu}(?>[^\p{Thai}\n]*?\p{Ll} \p{Ll})(?>[^\p{Thai}\n]*?[.!?])", far=True),
            Rule(True, r"(?:ครับ|ค่ะ|คะ)", r"\s+[“\"(]?\p{Lu}"),
            Rule(False, r"\p{Thai}", r"\s"),
        ],
    ),
    Table(
        "common",
        None,
        [
            Rule(False, r";", r""),
            Rule(False, r"．", r"\p{N}"),
            Rule(False, rf"[{STOPS}](?:\s?{CLOSERS})*", r"\s*\p{Ll}"),
            Rule(False, rf"[{STOPS}](?:\s?{CLOSERS})*", r"\s*[\-–—]+\s*\p{Ll}"),
            Rule(False, rf"[{STOPS}](?:\s?{CLOSERS})*", r"\s*[,;:)\]}»”%]"),
            Rule(False, rf"[.…](?:\s?{CLOSERS})*", r"\s+[(\[]\p{Ll}"),
            Rule(False, r"\.", r"\s+[@=/&%<>|+\-−]"),
            # initials, and letters that stand for words
            Rule(False, r"(?<![\p{Latin}\p{Cyrillic}\p{Greek}\p{M}\p{N}.&])\p{Lu}\.", r"\s+[\p{Lu}\p{N}]"),
            Rule(False, r"(?<![\p{L}\p{M}\p{N}])\p{L}\p{M}*\.", r"\s+\p{L}\p{M}*\."),
            Rule(False, r"(?<![\p{L}\p{M}\p{N}])[\p{Arabic}\p{Devanagari}]\p{M}*\.", r"\s"),
            Rule(True, rf"[.!?…؟۔।॥](?:\s?{CLOSERS})*", r"\s"),
            Rule(True, rf"[。！？｡．][”」』）)\"']*", r""),
            # full stops of further scripts; a Tibetan one also parts clauses that a blank does not follow
            Rule(True, rf"[։።፧။។៕]{CLOSERS}*", r""),
            Rule(True, r"།", r"\s"),
            # the blank between two sentences is missing
            Rule(True, rf"[\p{{L}}\p{{N}}&)”\"»%][\p{{L}}\p{{N}})”\"»][.!?…؟]{CLOSERS}*", r"[“„«\"(¿¡]*\p{Lu}(?:\p{Ll}|\s)"),
            Rule(True, rf"[\p{{L}}\p{{N}}][\p{{L}}\p{{M}}\p{{N}}][.!?؟]", r"[\p{Devanagari}\p{Arabic}\p{Hangul}\p{Thai}\p{Han}]"),
        ],
    ),
]

#: Where a break may be: after an end mark and what closes it (a blank of French typography may stand between), or at a
#: blank after a Thai letter.
_CANDIDATE = regex.compile(rf"[{STOPS}]+(?:[  ]?{CLOSERS})*|\p{{Thai}}(?=\s)")
_LINE = regex.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_BLANK_LINES = regex.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85  ])(?:[^\S\r\n]*(?:\r\n|[\n\r\x0b\x0c\x85  ]))+")
_ENTRY = regex.compile(r"\s*(?:[•‣▪◦∙·*\-–—]\s+|\(?\d{1,3}[.)]\s+|\(?[a-zA-Z]\)\s+|#+\s)")
_LOG = regex.compile(r"\s*(?:\d{4}-\d{2}-\d{2}[T ]\S*\s*(?:\p{Lu}{3,})\b|\[\d+/\d+\]|sha=|(?:ERROR|WARN|WARNING|INFO|DEBUG)\b)")
#: Sources whose lines are units, and those where a single line break is a space.
LINE_SOURCES = frozenset({"status_log", "bet_memo"})
WRAPPED_SOURCES = frozenset({"mail_digest"})


_SCRIPTS = {s: regex.compile("[" + "".join(rf"\p{{{x}}}" for x in s.split("|")) + "]") for s in {t.script for t in TABLES if t.script}}
_FUNCTION = regex.compile(rf"(?i)\b(?:{_words(' '.join(sorted({w for ws in FUNCTION_WORDS.values() for w in ws.split()})))})\b")
_SPEAKERS = {w: [lang for lang, ws in FUNCTION_WORDS.items() if w in ws.split()] for ws in FUNCTION_WORDS.values() for w in ws.split()}


#: How far a rule looks before a candidate's marks and after the white space behind it. Without an end, the matcher may
#: search a whole text for a letter that a rule needs, at every candidate.
REACH = 128
_SPACE = regex.compile(r"\s*+")


class _Ready(NamedTuple):
    breaks: bool
    before: regex.Pattern
    after: regex.Pattern
    language: str | None
    far: bool


class _Group(NamedTuple):
    """Rules that follow each other, with a pattern that any of them needs: before the position, or after it."""

    before: regex.Pattern | None
    after: regex.Pattern | None
    rules: list[_Ready]


#: What rules that hang on the text after a mark or a number have before it.
_ANY_MARK = (f"[{STOPS}]", "[.…]", r"\.", r"(?<![\p{L}\p{N}])\p{N}")


def _names_table(names: tuple[str, ...]) -> list[Table]:
    """A name that is written in lower case may begin a sentence."""
    return [Table("lower-case names", None, [Rule(True, rf"[.!?…]{CLOSERS}*", rf"\s+(?:{_words(' '.join(names))})\s")])] if names else []


@lru_cache(maxsize=256)
def _groups(scripts: frozenset[str], names: tuple[str, ...]) -> list[_Group]:
    """The rules of a block's tables in order. Whether rules hang on what stands before or after decides the group's pattern."""
    kinds: list[tuple[str, list[tuple[Rule, str | None]]]] = []
    for t in [*TABLES[:-1], *_names_table(names), TABLES[-1]]:
        if t.script is None or t.script in scripts:
            for r in t.rules:
                kind = "single" if r.breaks else "after" if r.before.startswith(_ANY_MARK) else "before"
                if kind == "single" or not kinds or kinds[-1][0] != kind:
                    kinds.append((kind, []))
                kinds[-1][1].append((r, t.language))
    out = []
    for kind, rules in kinds:
        ready = [_Ready(r.breaks, _pattern("(?r)" + r.before), _pattern(r.after), lang, r.far) for r, lang in rules]
        one = lambda part: "|".join(f"(?:{getattr(r, part)})" for r, _ in rules)  # noqa: B023, E731
        out.append(_Group(_pattern("(?r)" + one("before")) if kind == "before" else None, _pattern(one("after")) if kind == "after" else None, ready))
    return out


@cache
def _pattern(p: str) -> regex.Pattern:
    return regex.compile(p)


def _scripts(block: str) -> frozenset[str]:
    if block.isascii():
        return frozenset(["Latin"])
    return frozenset(s for s, p in _SCRIPTS.items() if p.search(block))


def _other_languages(block: str) -> frozenset[str]:
    """Languages of the Latin script that the block is not in: it has two function words of others and none of theirs."""
    n = dict.fromkeys(FUNCTION_WORDS, 0)
    for word in _FUNCTION.findall(block):
        for lang in _SPEAKERS.get(word.lower(), ()):
            n[lang] += 1
    return frozenset(lang for lang, k in n.items() if not k) if max(n.values()) >= 2 else frozenset()


def _breaks(text: str, start: int, end: int, names: tuple[str, ...]) -> list[int]:
    """Offsets in a block where a unit ends and another begins, by the first rule that matches at each candidate."""
    candidates = [(m.start(), m.end()) for m in _CANDIDATE.finditer(text, start, end)]
    if not candidates or (len(candidates) == 1 and candidates[0][1] == end):
        return []
    block, others = text[start:end], None
    groups = _groups(_scripts(block), names)
    out = []
    for mark, at in candidates:
        if at >= end:
            continue
        found = None
        first, last = max(start, mark - REACH), min(end, _SPACE.match(text, at, end).end() + REACH)
        for g in groups:
            if (g.before and not g.before.match(text, first, at)) or (g.after and not g.after.match(text, at, last)):
                continue
            for r in g.rules:
                # first the side that fails more often
                stop = end if r.far else last
                if (r.before.match(text, first, at) and r.after.match(text, at, stop)) if g.before else (r.after.match(text, at, stop) and r.before.match(text, first, at)):
                    if r.language:
                        others = _other_languages(block) if others is None else others
                        if r.language in others:
                            continue
                    found = r
                    break
            if found:
                break
        if found and found.breaks:
            out.append(at)
    return out


def _blocks(text: str, wrapped: bool) -> Iterator[tuple[int, int]]:
    """Lines, or the paragraphs between blank lines where line breaks are spaces."""
    at = 0
    for m in (_BLANK_LINES if wrapped else _LINE).finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def _trimmed(text: str, start: int, end: int) -> tuple[int, int] | None:
    part = text[start:end]
    left = part.lstrip()
    if not left:
        return None
    start = end - len(left)
    return start, start + len(left.rstrip())


def segment(text: str | None, source: str | None = None, names: tuple[str, ...] = ()) -> list[tuple[int, int]]:
    """(start, end) of each unit of a text, in code points, without white space at either end.

    Null, empty and blank texts have no units. An unknown source is prose whose line breaks end units. ``names`` are
    words that are in lower case at a sentence's start too.
    """
    if not text:
        return []
    out = []
    for start, end in _blocks(text, source in WRAPPED_SOURCES):
        whole = _trimmed(text, start, end)
        if whole is None:
            continue
        start, end = whole
        if source in LINE_SOURCES or _ENTRY.match(text, start, end) or _LOG.match(text, start, end):
            out.append(whole)
            continue
        for at in [*_breaks(text, start, end, names), end]:
            unit = _trimmed(text, start, at)
            if unit:
                out.append(unit)
            start = at
    return out


def sentences(docs: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """doc_id, start_char, end_char: the units of every text, by the rule tables.

    ``docs`` needs doc_id, text and source; other columns are ignored. ``names``, a short list, are words that are in
    lower case at a sentence's start too, such as the fields of the data that the texts are about. Null, empty and blank
    texts give no rows; repeated rows give their units each time. An empty table gives no rows.
    """
    known = tuple(sorted({n for n in names if n and not n.isspace()}))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, first, last = [], [], []
            for i, (text, source) in enumerate(zip(b.column("text").to_pylist(), b.column("source").to_pylist(), strict=True)):
                for start, end in segment(text, source, known):
                    doc.append(i)
                    first.append(start)
                    last.append(end)
            ids = b.column("doc_id").take(pa.array(doc, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(first, type=pa.int32()), pa.array(last, type=pa.int32())], ["doc_id", "start_char", "end_char"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())])
    return docs.filter(F.col("text").isNotNull()).select("doc_id", "text", "source").mapInArrow(units, schema)
