"""Plain Python versions of the ingestion problems, row by row, to hold the operators against."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

MISSING = {"", ".", "NA", "N/A", "null", "None"}
NUMBER = re.compile(r"[+\-−]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+\-−]?[0-9]+)?")


def number(text):
    text = text.strip(" \t")
    if text.lower() == "pk" and text.isascii():
        return 0.0
    return float(text.replace("−", "-")) if NUMBER.fullmatch(text) else None


def fields(line):
    """The fields of a line, or None if it is wrongly quoted; by a character machine."""
    out, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i += 1
            got = []
            while True:
                if i >= n:
                    return None
                if line[i] == '"':
                    if i + 1 < n and line[i + 1] == '"':
                        got.append('"')
                        i += 2
                        continue
                    i += 1
                    break
                got.append(line[i])
                i += 1
            if i < n and line[i] != ",":
                return None
            out.append("".join(got))
        else:
            j = line.find(",", i)
            j = n if j < 0 else j
            if '"' in line[i:j]:
                return None
            out.append(line[i:j])
            i = j
        if i >= n:
            return out
        i += 1


def bad(name, value):
    value = value.strip(" \t")
    missing = value in MISSING
    x = number(value)
    if name in ("road", "home", "bet"):
        return missing
    if missing:
        return False
    if name.startswith("line"):
        return x is None or abs(x) > 100
    if name in ("phcover", "phwin"):
        return x is None or not 0 <= x <= 1
    if name == "neutral":
        return x not in (0, 1)
    if name == "american odds":
        if value.lower() == "even" and value.isascii():
            return False
        m = re.fullmatch(r"[+\-−]?([0-9]+)", value)
        return not m or not 100 <= int(m[1]) <= 10000
    if name in ("decimal odds", "profit if risk 1u"):
        return x is None
    if name == "win/loss":
        return value not in ("W", "L", "P")
    return False


def parse_failures(rows):
    """rows: (file_id, line_no, raw_line). Gives {(file_id, line_no): reason}."""
    cut = lambda s: s[:-1] if s.endswith("\r") else s
    heads = {f: [x.strip(" \t").lower() for x in fields(cut(s))] for f, n, s in rows if n == 1}
    out = {}
    for f, n, s in rows:
        if n <= 1:
            continue
        if s is None:
            out[f, n] = "column_count"
            continue
        got = fields(cut(s))
        if got is None:
            out[f, n] = "quoting"
        elif len(got) != len(heads[f]):
            out[f, n] = "column_count"
        elif any(bad(h, v) for h, v in zip(heads[f], got)):
            out[f, n] = "bad_value"
    return out


def snapshot_changes(rows):
    """rows: (sport_key, season, label, ts, row_id, road, home, line)."""
    name = lambda s: re.sub("[ \t]+", " ", s).strip(" ").lower()
    streams = defaultdict(dict)
    snaps = defaultdict(dict)
    for sport, season, label, ts, row_id, road, home, line in rows:
        streams[sport, season][label] = min(ts, streams[sport, season].get(label, ts))
        if road is not None and home is not None:
            line = None if line is None or math.isnan(line) else line + 0.0
            k = (name(road), name(home))
            at = snaps[sport, season, label]
            if k not in at or row_id > at[k][0]:
                at[k] = (row_id, line)
    out = set()
    for s, labels in streams.items():
        order = sorted(labels, key=lambda x: (labels[x], x))
        for a, b in zip(order, order[1:]):
            old, new = snaps[(*s, a)], snaps[(*s, b)]
            for k in old.keys() | new.keys():
                kind = "added" if k not in old else "removed" if k not in new else "changed" if old[k][1] != new[k][1] else None
                if kind:
                    out.add((*s, b, *k, kind))
    return out


def drift(rows):
    """rows: (file_id, sport_key, season, delivered_ts, content)."""
    out = set()
    streams = defaultdict(list)
    for f, sport, season, ts, content in rows:
        lines = [x for x in content.split("\n")]
        head = [x.strip(" \t").lower() for x in fields(lines[0].rstrip("\r"))]
        recs = [dict(zip(head, fields(x.rstrip("\r")))) for x in lines[1:] if x.rstrip("\r")]
        streams[sport, season].append((ts, f, head, recs))
    ratios = []
    for files in streams.values():
        last = {}
        before = None
        for _, f, head, recs in sorted(files, key=lambda x: x[:2]):
            kinds = {}
            for h in head:
                vals = [r[h].strip(" \t") for r in recs]
                vals = [v for v in vals if v not in MISSING]
                if vals:
                    kinds[h] = "number" if all(number(v) is not None for v in vals) else "text"
            if before is not None:
                bh, brecs = before
                went, came = [h for h in bh if h not in head], [h for h in head if h not in bh]
                key = lambda r: (re.sub("[ \t]+", " ", r["road"]).strip().lower(), re.sub("[ \t]+", " ", r["home"]).strip().lower())
                old, new = {key(r): r for r in brecs}, {key(r): r for r in recs}
                common = old.keys() & new.keys()
                fit = []
                for w in went:
                    for c in came:
                        n = sum(1 for k in common if (x := number(old[k][w])) is not None and old[k][w].strip(" \t") not in MISSING and x == number(new[k][c]))
                        ratios.append(n / max(1, len(common)))
                        if n and 2 * n >= len(common):
                            fit.append((-n, w, c))
                for _, w, c in sorted(fit):
                    if w in went and c in came:
                        went.remove(w)
                        came.remove(c)
                        out.add((f, "renamed", w, c))
                        if w in last:
                            last[c] = last[w]
                out |= {(f, "removed", w, "") for w in went} | {(f, "added", "", c) for c in came}
            for h, k in kinds.items():
                if before is not None and h in last and last[h] != k:
                    out.add((f, "retyped", h, h))
                last[h] = k
            before = head, recs
    return out, ratios


def quantile(v, q):
    at = (len(v) - 1) * q
    lo = math.floor(at)
    hi = math.ceil(at)
    return v[lo] + (v[hi] - v[lo]) * (at - lo)


def issues(rows, columns, limits):
    """rows: (sport_key, season, label, ts, {column: value}); limits: {column: (lo, hi, pattern)}."""
    loads = defaultdict(list)
    at = {}
    for sport, season, label, ts, values in rows:
        loads[sport, season, label].append(values)
        at[sport, season, label] = min(ts, at.get((sport, season, label), ts))
    out = set()
    streams = defaultdict(list)
    for k, ts in at.items():
        streams[k[:2]].append((ts, k[2]))
    for s, order in streams.items():
        last = {}
        for _, label in sorted(order):
            own = loads[(*s, label)]
            for c in columns:
                lo, hi, pattern = limits[c]
                v = [r[c] for r in own]
                text = pattern is not None
                v = [x for x in v if x is not None and not (text and not x.strip()) and not (not text and math.isnan(x))]
                miss = (len(own) - len(v)) / len(own)
                found = []
                if not text:
                    v = sorted(float(x) + 0.0 for x in v)
                    if v and (v[0] < lo or v[-1] > hi):
                        found.append("range")
                elif any(not re.fullmatch(pattern, x) for x in v):
                    found.append("pattern")
                if c in last:
                    lmiss, lv, ldist = last[c]
                    if miss - lmiss > 0.33:
                        found.append("missing")
                    if len(v) >= 5 and len(set(v)) == 1 and ldist >= 5:
                        found.append("constant")
                    if not text and len(v) >= 5 and len(lv) >= 5:
                        iqr = quantile(lv, 0.75) - quantile(lv, 0.25)
                        if iqr > 0 and abs(quantile(v, 0.5) - quantile(lv, 0.5)) > 2 * iqr:
                            found.append("shift")
                last[c] = (miss, v, len(set(v)))
                out |= {(*s, label, c, i) for i in found}
    return out


def counted(rows):
    return Counter(map(tuple, rows))
