"""Matching records across sources without keys: hand-typed bets to the games they were placed on.

Names are encoded as fixed bit vectors of their character pairs. Vectors within a Hamming radius are found exactly by
multi-index hashing: of ``CHUNKS`` chunks one at least differs in no more than one bit. Two chunks do so if they are
equal, or if one without one of its set bits is the other, so both sides look up their chunks whole and with a bit less,
and no two names are compared that share none. Vectors have few set bits, so these are few. Dates and numbers are encoded as the
set of their neighbours, so that their Dice score falls with the distance.

The fields' scores, in levels, are weighted by how often true and other pairs show them. These shares are fitted without
labels, by expectation maximisation over the counts of all level combinations, a table of bounded size. A bet's
confidences over its candidates and over "none of them" add up to one.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import trim_blanks
from tidemark.sources import checkpoint

#: Bit vectors: chunks of 16 bits, and bits that a character pair sets. One flipped bit in each of the chunks is
#: searched, so pairs up to RADIUS differing bits are found without exception.
CHUNKS, BITS, HASHES = 8, 16, 2
RADIUS = 2 * CHUNKS - 1
#: Names below this Dice score are no candidates: none within RADIUS, as one swap leaves a short name half its pairs.
LEAST_DICE = 0.0
#: Copies of each name and game; a bet meets those of its own hash.
SALTS = 8
#: Rounds of the fit.
ROUNDS = 40
#: How likely a bet is to have no game among its candidates, against that it has one, before anything is known.
NONE_ODDS = 0.5
#: A pair is reported when its confidence is above this.
THRESHOLD = 0.5

# Short forms in names, words that a name may be given without, the lines' margins, and months.
SHORT = {"st": "state", "n": "north", "no": "north", "s": "south", "so": "south", "e": "east", "w": "west", "u": "university"}
DIRECTIONS = ["north", "south", "east", "west"]
SUFFIXES = ["state", "tech", "southern", "a m"]
MARGINS = ["open_home_margin_raw", "midweek_home_margin_raw", "close_home_margin_raw", "actual_home_margin"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_STAKE = r"(?i)\s*(?:\b(?:ml|moneyline|money line|pick'?em|pick|pk|ev(?:en)?)|[+\-−–]\s*[0-9]+(?:[.,][0-9]+)?\s*½?|[+\-−–]\s*½)\s*$"
_SIDES = r"(?i)\s+(?:@|v|vs|v\.|vs\.|at)\s+|\s*@\s*"


def normal_name(name: str) -> str:
    """Without accents, in lower case, short forms written out, one blank between words."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c)).lower()
    words = re.sub(r"[^\w]+|_", " ", plain).split()
    return " ".join(SHORT.get(w, w) if i in (0, len(words) - 1) and len(words) > 1 else w for i, w in enumerate(words))


def bit_vector(name: str) -> list[int]:
    """The chunks of a name's vector; a name's ends count as characters."""
    out = [0] * CHUNKS
    padded = f" {name} "
    for pair in {padded[i : i + 2] for i in range(len(padded) - 1)}:
        h = zlib.crc32(pair.encode("utf-8"))
        for k in range(HASHES):
            bit = zlib.crc32(bytes([k]) + h.to_bytes(4, "little")) % (CHUNKS * BITS)
            out[bit // BITS] |= 1 << (bit % BITS)
    return out


def aliases(name: str, other: str | None, long: str | None) -> dict[str, str]:
    """What a team may be called, with the kind: by its own spellings, with and by its nickname, in part, by letters."""
    full = normal_name(name)
    found = {full: "full"}
    other = normal_name(other) if other else full
    found.setdefault(other, "full")
    if long:
        whole = normal_name(long)
        found.setdefault(whole, "full")
        if whole.startswith(other + " "):
            found.setdefault(whole[len(other) + 1 :], "nickname")
    words = other.split()
    base = other
    if words and words[0] in DIRECTIONS and len(words) > 1:
        base = " ".join(words[1:])
        found.setdefault(base, "part")
    for end in SUFFIXES:
        for text in (base, other):
            if text.endswith(" " + end):
                found.setdefault(text[: -len(end) - 1], "part")
    if len(words) > 1:
        letters = "".join(w[0] for w in words)
        found.setdefault(letters + "u", "letters")
        found.setdefault(letters, "letters")
    elif words:
        found.setdefault(words[0][:3], "letters")
    return found


def _normal_mentions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["name"] = pdf["mention"].map(normal_name)
        yield pdf


def _team_aliases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            for alias, kind in aliases(r.team, r.schedule_name, r.espn_name).items():
                if alias:
                    rows.append((r.sport_key, r.season, r.team, alias, kind))
        yield pd.DataFrame(rows, columns=["sport_key", "season", "team", "alias", "kind"])


#: Bits of a vector's half, a long.
_HALF = CHUNKS * BITS // 2


def _keys(asks: bool):
    """Of names, their vectors as two longs and the keys by which near ones meet: chunk, value, and which side has a bit less.

    0: both sides whole; 1: the side that is asked for has a bit less; 2: the side that asks has.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sport, name in zip(pdf["sport_key"], pdf["name"], strict=True):
                chunks = bit_vector(name)
                whole = sum(x << (BITS * i) for i, x in enumerate(chunks))
                lo, hi = ((whole >> k) & ((1 << _HALF) - 1) for k in (0, _HALF))
                lo, hi = (x - (1 << _HALF) if x >> (_HALF - 1) else x for x in (lo, hi))
                for c, v in enumerate(chunks):
                    rows.append((sport, name, lo, hi, c, v, 0))
                    rows.append((sport, name, lo, hi, c, v, 1 if asks else 2))
                    left = v
                    while left:
                        bit = left & -left
                        rows.append((sport, name, lo, hi, c, v ^ bit, 2 if asks else 1))
                        left ^= bit
            yield pd.DataFrame(rows, columns=["sport_key", "name", "lo", "hi", "c", "v", "less"])

    return spread


def parsed_bets(matches: DataFrame, unmatched: DataFrame) -> DataFrame:
    """bet_id, sport_key, season, bet_on, result, team, opponent, spread, is_ml: one row per distinct bet_id.

    Of repeated rows the one with most text counts. The label is read anew; the earlier pass's fields serve where the
    label is missing. Rows without bet_id are no bets.
    """
    both = matches.unionByName(unmatched, allowMissingColumns=True).filter(F.col("bet_id").isNotNull())
    cols = ["sport_key", "season", "bet", "bet_date", "win_loss", "profit_1u", "bet_team", "bet_spread", "is_moneyline"]
    filled = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    one = both.groupBy("bet_id").agg(F.max(F.struct(filled.alias("filled"), *cols)).alias("b")).select("bet_id", "b.*")
    label = F.trim(F.regexp_replace("bet", r"\s+", " "))
    against = F.regexp_extract(label, r"(?i)\(\s*(?:opp|opponent|vs|v|against)\.?:?\s+([^)]*)\)", 1)
    bare = F.trim(F.regexp_replace(label, r"\([^)]*\)", " "))
    names = F.trim(F.regexp_replace(bare, _STAKE, ""))
    parts = F.split(names, _SIDES)
    sign = F.regexp_extract(bare, r"([+\-−–])\s*(?:[0-9]+(?:[.,][0-9]+)?\s*½?|½)\s*$", 1)
    amount = F.regexp_extract(bare, r"[+\-−–]\s*([0-9]+(?:[.,][0-9]+)?)\s*½?\s*$", 1)
    half = F.when(bare.rlike(r"½\s*$"), 0.5).otherwise(0.0)
    typed = F.when(sign != "", F.when(sign == "+", 1.0).otherwise(-1.0) * (F.coalesce(F.replace(amount, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0)) + half))
    pick = bare.rlike(r"(?i)\b(?:pk|pick'?em|pick)\s*$")
    ml = bare.rlike(r"(?i)\b(?:ml|moneyline|money line)\s*$")
    team = F.coalesce(F.when(F.trim(parts[0]) != "", F.trim(parts[0])), F.col("bet_team"))
    opponent = F.coalesce(F.when(against != "", F.trim(against)), F.when(F.size(parts) > 1, F.trim(F.get(parts, F.lit(1)))))
    result = F.when(F.upper(F.trim("win_loss")).isin("W", "L", "P"), F.upper(F.trim("win_loss"))).when(F.col("profit_1u") > 0, "W").when(F.col("profit_1u") < 0, "L").when(F.col("profit_1u") == 0, "P")
    return one.select(
        "bet_id",
        "sport_key",
        "season",
        typed_date(F.col("bet_date"), F.col("season")).alias("bet_on"),
        result.alias("result"),
        team.alias("team"),
        F.when(opponent != "", opponent).alias("opponent"),
        F.coalesce(typed, F.when(pick, 0.0), F.when(~F.coalesce(ml, F.lit(False)), F.col("bet_spread"))).alias("spread"),
        F.coalesce(ml, F.col("is_moneyline"), F.lit(False)).alias("is_ml"),
    )


def typed_date(text: Column, season: Column) -> Column:
    """A date typed by hand; without a year it falls into the season, which goes from summer to the next winter."""
    t = F.lower(trim_blanks(text))
    part = lambda p, i: F.regexp_extract(t, p, i).try_cast("int")
    p_slash, p_iso = r"^([0-9]{1,2})[/.]([0-9]{1,2})(?:[/.]([0-9]{2,4}))?$", r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$"
    p_day, p_month = r"^([0-9]{1,2})[- ]([a-z]{3})[a-z]*\.?(?:[-, ]+([0-9]{2,4}))?$", r"^([a-z]{3})[a-z]*\.?[- ]([0-9]{1,2})(?:[-, ]+([0-9]{2,4}))?$"
    number = lambda p, i: F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(t, p, i)), F.lit(0)).cast("int")
    month = F.coalesce(part(p_slash, 1), part(p_iso, 2), number(p_day, 2), number(p_month, 1))
    day = F.coalesce(part(p_slash, 2), part(p_iso, 3), part(p_day, 1), part(p_month, 2))
    year = F.coalesce(part(p_iso, 1), part(p_slash, 3), part(p_day, 3), part(p_month, 3))
    year = F.when(year < 100, year + 2000).otherwise(year)
    whole = F.coalesce(year, F.when(month >= 6, season).otherwise(season + 1))
    return F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", whole, month, day), F.lit("yyyy-MM-dd")))


def _merge(df: DataFrame) -> DataFrame:
    """To be joined by sorting, whatever its size: a broadcast would be gathered in the driver."""
    return df.hint("merge")


def numbered(lines: DataFrame) -> DataFrame:
    """One row per game_key (of repeated ones the one with the greatest values), with no: its place among its stream's keys."""
    rest = ["sport_key", "season", "pt_road", "pt_home", *MARGINS]
    own = lines.filter(F.col("game_key").isNotNull()).groupBy("game_key").agg(F.max(F.struct(*rest)).alias("_r")).select("game_key", "_r.*")
    return own.withColumn("no", F.row_number().over(Window.partitionBy("sport_key", "season").orderBy("game_key")))


def games(lines: DataFrame, schedule: DataFrame) -> DataFrame:
    """no, sport_key, season, side, team, other, schedule_name, espn_name, kickoff_on, margins: two rows per game.

    A game's latest row in the schedule counts; its sides are set to the lines' by name. A kickoff counts to the evening
    before if it is in the first hours of a UTC day.
    """
    plan = schedule.filter(F.col("game_join_key").isNotNull()).groupBy(F.col("game_join_key").alias("game_key")).agg(
        F.max(F.struct("loaded_ts", "kickoff_utc", "away", "home", "espn_away", "espn_home")).alias("p"), F.max_by("kickoff_utc", F.when(F.col("kickoff_utc").isNotNull(), F.col("loaded_ts"))).alias("kickoff_utc")
    )
    own = numbered(lines).join(_merge(plan), "game_key", "left")
    stem = lambda c: F.lower(F.regexp_extract(F.regexp_replace(c, r"^(?:[NSEWnsew][a-z]*\.?\s+)", ""), r"^(\w+)", 1))
    swapped = F.coalesce((stem(F.col("p.away")) == stem(F.col("pt_home"))) & (stem(F.col("p.away")) != stem(F.col("pt_road"))), F.lit(False))
    sides = []
    for name, team, other, plain, sign in (("road", "pt_road", "pt_home", ("away", "home"), -1.0), ("home", "pt_home", "pt_road", ("home", "away"), 1.0)):
        a, b = plain
        sides.append(
            F.struct(
                F.lit(name).alias("side"),
                F.col(team).alias("team"),
                F.col(other).alias("other"),
                F.when(swapped, F.col(f"p.{b}")).otherwise(F.col(f"p.{a}")).alias("schedule_name"),
                F.when(swapped, F.col(f"p.espn_{b}")).otherwise(F.col(f"p.espn_{a}")).alias("espn_name"),
                *((F.col(m) * sign).alias(n) for m, n in zip(MARGINS, ("open", "midweek", "close", "actual"), strict=True)),
            )
        )
    on = F.to_date(F.col("kickoff_utc") - F.expr("interval 8 hours")).alias("kickoff_on")
    return own.select("no", "sport_key", "season", on, F.explode(F.array(*sides)).alias("s")).select("no", "sport_key", "season", "kickoff_on", "s.*").filter(F.col("team").isNotNull())


def near_vectors(asked: DataFrame, held: DataFrame) -> DataFrame:
    """sport_key, name, alias, dice: all pairs of a sport's names whose vectors are within RADIUS bits; each name once."""
    schema = "sport_key string, name string, lo bigint, hi bigint, c int, v int, less int"
    a = asked.select("sport_key", "name").distinct().mapInPandas(_keys(True), schema)
    b = held.select("sport_key", F.col("alias").alias("name")).distinct().mapInPandas(_keys(False), schema).select("sport_key", "c", "v", "less", F.col("name").alias("alias"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    ones = lambda x, y: F.bit_count(x) + F.bit_count(y)
    apart = ones(F.col("lo").bitwiseXOR(F.col("lo2")), F.col("hi").bitwiseXOR(F.col("hi2")))
    shared = ones(F.col("lo").bitwiseAND(F.col("lo2")), F.col("hi").bitwiseAND(F.col("hi2")))
    both = ones(F.col("lo"), F.col("hi")) + ones(F.col("lo2"), F.col("hi2"))
    return a.join(_merge(b), ["sport_key", "c", "v", "less"]).filter(apart <= RADIUS).select("sport_key", "name", "alias", (2.0 * shared / both).alias("dice")).distinct()


def close_names(mentions: DataFrame, teams: DataFrame) -> DataFrame:
    """sport_key, season, mention, team, dice, kind: all pairs of a stream whose vectors are within RADIUS bits.

    Exact by multi-index hashing; of a team's aliases the closest counts. Aliases of letters must be met fully. A name is
    searched once per sport, however many seasons and spellings lead to it.
    """
    stream = ["sport_key", "season"]
    said = mentions.select(*stream, "mention").distinct().mapInPandas(_normal_mentions, "sport_key string, season int, mention string, name string").filter("name != ''")
    called = teams.groupBy(*stream, "team").agg(F.max("schedule_name").alias("schedule_name"), F.max("espn_name").alias("espn_name"))
    called = called.mapInPandas(_team_aliases, "sport_key string, season int, team string, alias string, kind string")
    met = said.join(_merge(near_vectors(said, called)), ["sport_key", "name"]).join(_merge(called), [*stream, "alias"])
    kept = met.filter((F.col("kind") != "letters") | (F.col("name") == F.col("alias")))
    rank = F.when(F.col("name") == F.col("alias"), F.lit(1.0)).otherwise(F.col("dice") * 0.999)
    order = F.struct(rank.alias("dice"), F.when(F.col("kind") == "full", 3).when(F.col("kind") == "nickname", 2).when(F.col("kind") == "part", 1).otherwise(0).alias("o"), "kind")
    return kept.groupBy(*stream, "mention", "team").agg(F.max(order).alias("best")).select(*stream, "mention", "team", "best.dice", "best.kind")


def _neighbour_dice(gap: Column, reach: float) -> Column:
    """The Dice score of two numbers' sets of neighbours: 1 when equal, 0 from ``reach`` on."""
    return F.greatest(F.lit(0.0), 1.0 - F.abs(gap) / reach)


FIELDS = ["name_level", "opponent_level", "date_level", "spread_level", "result_level"]
#: Pairs whose weights come from the anchors: fields of which bets that name both teams in full show the true levels.
ANCHORED = ["date_level", "spread_level", "result_level"]
ANCHOR = ("full", "same")
#: How many pairs the values below count as beside the anchors.
PRIOR = 20.0
# How a true pair's levels are thought to be shared out before any data are seen.
START = {
    "name_level": {"full": 0.45, "full~": 0.18, "full~~": 0.02, "nickname": 0.1, "nickname~": 0.02, "nickname~~": 0.005, "part": 0.08, "part~": 0.02, "part~~": 0.005, "letters": 0.12},
    "opponent_level": {"none": 0.7, "same": 0.2, "same~": 0.08, "other": 0.02},
    "date_level": {"-2": 0.02, "-1": 0.04, "0": 0.2, "1": 0.2, "2": 0.2, "3": 0.19, "4": 0.12, "5": 0.01, "6": 0.008, "far": 0.002},
    "spread_level": {"0.0": 0.45, "0.5": 0.27, "1.0": 0.14, "1.5": 0.06, "2.0": 0.03, "2.5": 0.015, "3.0": 0.01, "4.0": 0.01, "far": 0.015},
    "result_level": {"same": 0.97, "other": 0.03},
}


#: The levels of each field by number, in which a pair's levels are held.
LEVELS = {
    "name_level": [kind + near for kind in ("full", "nickname", "part", "letters") for near in ("", "~", "~~")],
    "opponent_level": ["none", "same", "same~", "other"],
    "date_level": ["none", "-2", "-1", "0", "1", "2", "3", "4", "5", "6", "far"],
    "spread_level": ["none", "0.0", "0.5", "1.0", "1.5", "2.0", "2.5", "3.0", "4.0", "far"],
    "result_level": ["none", "same", "other"],
}
SIDES = ["road", "home"]


def levels_of(code: int) -> tuple[str, ...]:
    """The levels of FIELDS that a code stands for."""
    code, out = code // len(SIDES), []
    for f in reversed(FIELDS):
        code, i = divmod(code, len(LEVELS[f]))
        out.append(LEVELS[f][i])
    return tuple(reversed(out))


def candidates(bets: DataFrame, sides: DataFrame) -> DataFrame:
    """bet_id, no, code, score: every bet with every game of every team that it may name.

    A game is given by its number in the bet's stream, its side and the levels of FIELDS by one code.
    """
    stream = ["sport_key", "season"]
    own = bets.filter(F.col("team").isNotNull())
    mentions = own.select(*stream, F.explode(F.array_compact(F.array("team", "opponent"))).alias("mention"))
    names = checkpoint(close_names(mentions, sides))
    # one team may have a third of all bets: names and games are repeated for every salt, and a bet meets those of its own
    salted = lambda df: df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    level = lambda f, c: F.array_position(F.lit(LEVELS[f]), c).cast("int") - 1
    called = level("name_level", F.concat(F.col("kind"), F.when(F.col("dice") < 0.8, "~~").when(F.col("dice") < 1.0, "~").otherwise("")))
    meant = salted(names.select(*stream, F.col("mention").alias("team"), F.col("team").alias("_team"), "dice", called.alias("name_level")))
    g = salted(sides.select(*stream, F.col("team").alias("_team"), F.col("other").alias("_other"), "no", "side", "kickoff_on", "open", "midweek", "close", "actual"))
    # the teams that the opponent's name may mean, where the bet gives one, and whether they are met in full
    rivals = names.groupBy(*stream, F.col("mention").alias("opponent")).agg(F.map_from_entries(F.collect_list(F.struct("team", (F.col("dice") == 1.0) & (F.col("kind") == "full")))).alias("_rivals"))
    own = own.withColumn("_salt", F.pmod(F.xxhash64("bet_id"), F.lit(SALTS)).cast("int")).join(_merge(salted(rivals)), [*stream, "opponent", "_salt"], "left")
    pairs = own.join(_merge(meant), [*stream, "team", "_salt"]).join(_merge(g), [*stream, "_team", "_salt"]).withColumn("_met", F.try_element_at("_rivals", F.col("_other")))
    days = F.date_diff("kickoff_on", "bet_on")
    apart = F.least(*(F.abs(F.col("spread") + F.col(m)) for m in ("open", "midweek", "close")))
    halves = F.ceil(apart * 2)
    margin = F.col("actual") + F.when(F.col("is_ml"), F.lit(0.0)).otherwise(F.col("spread"))
    graded = F.when(margin > 0, "W").when(margin < 0, "L").when(margin == 0, "P")
    numbers = {
        "name_level": F.col("name_level"),
        "opponent_level": F.when(F.col("opponent").isNull(), 0).when(F.col("_met"), 1).when(F.col("_met").isNotNull(), 2).otherwise(3),
        "date_level": F.when(days.isNull(), 0).when(days.between(-2, 6), days + 3).otherwise(10),
        "spread_level": F.when(F.col("is_ml") | apart.isNull(), 0).when(halves <= 6, halves.cast("int") + 1).when(halves <= 8, 8).otherwise(9),
        "result_level": F.when(graded.isNull() | F.col("result").isNull(), 0).when(graded == F.col("result"), 1).otherwise(2),
    }
    code = F.lit(0)
    for f in FIELDS:
        code = code * len(LEVELS[f]) + numbers[f]
    score = F.col("dice") + F.coalesce(_neighbour_dice(days - 2, 7.0), F.lit(0.5)) + F.coalesce(_neighbour_dice(apart, 7.0), F.lit(0.5))
    return pairs.select("bet_id", "no", (code * len(SIDES) + (F.col("side") == "home").cast("int")).alias("code"), score.alias("score"))


def fit(counts: list[tuple[tuple[str, ...], float]], share: float) -> dict[str, dict[str, float]]:
    """The weight of each level of each field: the log of its share in true pairs over its share in others.

    ``counts`` has every level combination with its number of pairs, ``share`` the part of pairs thought true at first.
    The ANCHORED fields' shares in true pairs are counted over the anchors; the others' are fitted. An anchor far from
    its date may be another meeting of the two, so these are not counted and that level keeps its given share. A level
    ``none`` weighs nothing: what is missing is missing alike from true and other pairs.
    """
    total = sum(n for _, n in counts)
    at = {f: i for i, f in enumerate(FIELDS)}
    seen: dict[str, dict[str, float]] = {f: {} for f in FIELDS}
    for levels, n in counts:
        for f, x in zip(FIELDS, levels, strict=True):
            seen[f][x] = seen[f].get(x, 0.0) + n
    m = {f: {x: START[f].get(x, 1e-3) for x in seen[f]} for f in FIELDS}
    for f in ANCHORED:
        own = {x: PRIOR * START[f].get(x, 1e-3) for x in seen[f] if x != "none"}
        for levels, n in counts:
            if levels[: len(ANCHOR)] == ANCHOR and levels[at["date_level"]] not in ("none", "far") and levels[at[f]] != "none":
                own[levels[at[f]]] += n
        whole = sum(own.values())
        m[f] |= {x: v / whole for x, v in own.items()}
        if "far" in m[f] and f == "date_level":
            m[f]["far"] = START[f]["far"]
    u = {f: {x: n / max(1.0, sum(k for y, k in seen[f].items() if y != "none")) for x, n in seen[f].items()} for f in FIELDS}
    weight = lambda f, x: 0.0 if x == "none" else math.log(max(m[f][x], 1e-6) / max(u[f][x], 1e-6))
    fitted = [f for f in FIELDS if f not in ANCHORED]
    for _ in range(ROUNDS):
        sums: dict[str, dict[str, float]] = {f: {} for f in FIELDS}
        rest: dict[str, dict[str, float]] = {f: {} for f in FIELDS}
        true = 0.0
        for levels, n in counts:
            odds = math.log(max(share, 1e-9) / max(1 - share, 1e-9)) + sum(weight(f, x) for f, x in zip(FIELDS, levels, strict=True))
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
            true += n * p
            for f, x in zip(FIELDS, levels, strict=True):
                if x != "none":
                    sums[f][x] = sums[f].get(x, 0.0) + n * p
                    rest[f][x] = rest[f].get(x, 0.0) + n * (1 - p)
        share = true / total
        for f in FIELDS:
            for table, into in ((sums, m), (rest, u)):
                if into is m and f not in fitted:
                    continue
                whole = sum(table[f].values()) + 0.5 * len(table[f])
                into[f] |= {x: (v + 0.5) / whole for x, v in table[f].items()}
    return {f: {x: weight(f, x) for x in seen[f]} for f in FIELDS} | {"": {"share": share}}


def match(matches: DataFrame, unmatched: DataFrame, lines: DataFrame, schedule: DataFrame) -> DataFrame:
    """bet_id, game_key, side, confidence, score: each bet's most likely game, with the confidence that it is this one.

    Bets without any candidate give no row. Equal candidates are taken by game_key; their confidences are low, for they
    share it. Null names, dates, spreads and results are levels of their own that tell little. An empty table gives no
    rows; other columns are ignored.
    """
    bets = parsed_bets(matches, unmatched)
    pairs = checkpoint(candidates(bets, games(lines, schedule)))
    rows = pairs.groupBy((F.col("code") - F.col("code") % len(SIDES)).alias("code")).agg(F.count("*").alias("n")).collect()  # at most some thousand combinations
    n_bets = pairs.agg(F.count_distinct("bet_id")).first()[0]
    counts = [(levels_of(r["code"]), float(r["n"])) for r in sorted(rows)]
    weights = fit(counts, min(0.5, 0.6 * n_bets / max(1.0, sum(n for _, n in counts)))) if counts else {}
    odds, rest = F.lit(0.0), F.floor(F.col("code") / len(SIDES)).cast("int")
    for f in reversed(FIELDS):
        level = rest % len(LEVELS[f])
        odds = odds + F.get(F.lit([weights.get(f, {}).get(x, 0.0) for x in LEVELS[f]]), level)
        rest = F.floor(rest / len(LEVELS[f])).cast("int")
    told = pairs.withColumn("odds", F.exp(F.least(odds, F.lit(60.0))))
    # each candidate against "none of them"; how often that holds is taken from a first round over all bets
    first = told.groupBy("bet_id").agg(F.avg("odds").alias("each")).agg(F.avg(F.lit(NONE_ODDS) / (F.col("each") + NONE_ODDS))).first()[0] or 0.0
    none = min(max(first, 1e-3), 0.5) / (1 - min(max(first, 1e-3), 0.5))
    w = Window.partitionBy("bet_id")
    side = F.element_at(F.lit(SIDES), F.max_by("code", "odds") % len(SIDES) + 1)
    by_game = told.repartition("bet_id").groupBy("bet_id", "no").agg(F.sum("odds").alias("odds"), F.count("*").alias("n"), F.max("score").alias("score"), side.alias("side"))
    all_n = F.sum("n").over(w)
    best = by_game.withColumn("confidence", F.col("odds") / all_n / (F.sum("odds").over(w) / all_n + F.lit(none)))
    by = Window.partitionBy("bet_id").orderBy(F.col("confidence").desc(), "no")
    best = best.withColumn("_r", F.row_number().over(by)).filter("_r = 1").join(_merge(bets.select("bet_id", "sport_key", "season")), "bet_id")
    keys = numbered(lines).select("sport_key", "season", "no", "game_key")
    return best.join(_merge(keys), ["sport_key", "season", "no"]).select("bet_id", "game_key", "side", "confidence", "score")
