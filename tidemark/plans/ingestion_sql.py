"""DuckDB SQL for the ingestion queries that SQL can express."""

from __future__ import annotations

_NAME = "lower(trim(regexp_replace({0}, '[ \\t]+', ' ', 'g'), ' '))"

P3 = f"""WITH o AS (SELECT sport_key, season, snapshot_label, row_number() OVER (PARTITION BY sport_key, season ORDER BY min(snapshot_ts), snapshot_label) AS seq
  FROM ncaapredictions GROUP BY sport_key, season, snapshot_label),
r AS (SELECT sport_key, season, seq, {_NAME.format("road")} AS road, {_NAME.format("home")} AS home, arg_max(struct_pack(l := CASE WHEN isnan(line) THEN NULL ELSE line + 0.0 END), row_id).l AS line
  FROM ncaapredictions JOIN o USING (sport_key, season, snapshot_label) WHERE road IS NOT NULL AND home IS NOT NULL GROUP BY ALL),
b AS (SELECT o.sport_key, o.season, o.snapshot_label, r.road, r.home, r.line, 0 AS side FROM r JOIN o ON o.sport_key = r.sport_key AND o.season = r.season AND o.seq = r.seq + 1
  UNION ALL SELECT o.sport_key, o.season, o.snapshot_label, r.road, r.home, r.line, 1 FROM r JOIN o USING (sport_key, season, seq) WHERE seq > 1),
c AS (SELECT sport_key, season, snapshot_label, road, home, min(side) AS lo, max(side) AS hi, max(line) FILTER (WHERE side = 0) AS l0, max(line) FILTER (WHERE side = 1) AS l1 FROM b GROUP BY ALL)
SELECT sport_key, season, snapshot_label, road, home, CASE WHEN lo = 1 THEN 'added' WHEN hi = 0 THEN 'removed' ELSE 'changed' END AS change_kind FROM c WHERE lo = hi OR l0 IS DISTINCT FROM l1"""

_F = r'("[^"]*(""[^"]*)*"|[^",]*)'
_NUM = r"^[+\-−]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+\-−]?[0-9]+)?$"
P1 = rf"""WITH t AS (SELECT file_id, line_no, raw_line, regexp_replace(raw_line, '\r$', '') AS line FROM raw_lines),
f AS (SELECT *, regexp_full_match(line, '(?s){_F}(,{_F})*') AS quoted, regexp_extract_all(',' || line, ',{_F}', 1) AS raw FROM t),
v AS (SELECT *, list_transform(raw, lambda x: trim(CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END, ' ' || chr(9))) AS vals FROM f),
h AS (SELECT file_id, list_transform(vals, lambda x: lower(x)) AS names FROM v WHERE line_no = 1),
r AS (SELECT v.file_id, v.line_no, raw_line, quoted, vals, names FROM v LEFT JOIN h USING (file_id) WHERE line_no > 1),
x AS (SELECT file_id, line_no, unnest(list_zip(names, vals)) AS z FROM r WHERE quoted AND len(vals) = len(names)),
y AS (SELECT file_id, line_no, z[1] AS n, z[2] AS val, z[2] IN ('', '.', 'NA', 'N/A', 'null', 'None') AS missing,
  CASE WHEN regexp_matches(z[2], '{_NUM}') THEN replace(z[2], '−', '-')::DOUBLE WHEN upper(z[2]) = 'PK' THEN 0 END AS num FROM x),
bad AS (SELECT DISTINCT file_id, line_no FROM y WHERE CASE WHEN n IN ('road', 'home', 'bet') THEN missing WHEN missing THEN FALSE
  WHEN n LIKE 'line%' THEN NOT coalesce(abs(num) <= 100, FALSE) WHEN n IN ('phcover', 'phwin') THEN NOT coalesce(num BETWEEN 0 AND 1, FALSE) WHEN n = 'neutral' THEN NOT coalesce(num IN (0, 1), FALSE)
  WHEN n = 'american odds' THEN NOT (upper(val) = 'EVEN' OR coalesce(regexp_matches(val, '^[+\-−]?[0-9]+$') AND abs(num) BETWEEN 100 AND 10000, FALSE))
  WHEN n IN ('decimal odds', 'profit if risk 1u') THEN num IS NULL WHEN n = 'win/loss' THEN val NOT IN ('W', 'L', 'P') ELSE FALSE END)
SELECT r.file_id, r.line_no, CASE WHEN raw_line IS NULL THEN 'column_count' WHEN NOT quoted THEN 'quoting' WHEN len(vals) <> len(names) THEN 'column_count' ELSE 'bad_value' END AS fail_reason
FROM r LEFT JOIN bad ON r.file_id = bad.file_id AND r.line_no = bad.line_no WHERE raw_line IS NULL OR NOT quoted OR len(vals) <> len(names) OR bad.file_id IS NOT NULL"""



def _cells(table: str, label: str, ts: str, condition: str, kind: str) -> str:
    return f"""(SELECT '{table}' AS table_name, * FROM (SELECT sport_key, season, {label} AS load_label, {ts} AS load_at, COLUMNS(lambda x: {condition})::{kind} FROM {table} WHERE {label} IS NOT NULL)
      UNPIVOT INCLUDE NULLS (v FOR column_name IN (COLUMNS(* EXCLUDE (sport_key, season, load_label, load_at)))))"""


_NUMBERS = " UNION ALL ".join(
    (
        _cells("ncaapredictions", "snapshot_label", "snapshot_ts", "x LIKE 'line%' OR x IN ('phcover', 'phwin', 'neutral')", "DOUBLE"),
        _cells("model_ranking_2026", "load_label", "load_ts", "x IN ('model_mse', 'model_mae', 'history_n', 'coverage_fraction')", "DOUBLE"),
    )
)
_TEXTS = " UNION ALL ".join(
    (
        _cells("ncaapredictions", "snapshot_label", "snapshot_ts", "x IN ('road', 'home')", "VARCHAR"),
        _cells("model_ranking_2026", "load_label", "load_ts", "x IN ('canonical_model_id', 'selection_tier')", "VARCHAR"),
    )
)
_KEYS = "table_name, sport_key, season, load_label, column_name"
P5 = f"""WITH n0 AS (SELECT {_KEYS}, load_at, CASE WHEN isnan(v) THEN NULL ELSE v + 0.0 END AS v FROM ({_NUMBERS})),
np AS (SELECT {_KEYS}, min(load_at) AS load_at, count(*) AS n_rows, count(*) - count(v) AS n_missing, count(DISTINCT v) AS n_distinct, min(v) AS lo, max(v) AS hi,
  quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3, 0 AS n_bad FROM n0 GROUP BY {_KEYS}),
t0 AS (SELECT x.*, text_pattern FROM ({_TEXTS}) x JOIN column_limits USING (table_name, column_name)),
tp AS (SELECT {_KEYS}, min(load_at) AS load_at, count(*) AS n_rows, count(*) FILTER (WHERE v IS NULL OR regexp_full_match(v, '[\\s\\x0b\\x{{85}}\\p{{Z}}]*')) AS n_missing,
  count(DISTINCT v) FILTER (WHERE NOT regexp_full_match(v, '[\\s\\x0b\\x{{85}}\\p{{Z}}]*')) AS n_distinct, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, NULL::DOUBLE AS q1, NULL::DOUBLE AS median, NULL::DOUBLE AS q3,
  count(*) FILTER (WHERE NOT regexp_full_match(v, '[\\s\\x0b\\x{{85}}\\p{{Z}}]*') AND NOT regexp_full_match(v, text_pattern)) AS n_bad FROM t0 GROUP BY {_KEYS}),
p AS (SELECT u.*, min_ok, max_ok, n_rows - n_missing AS n, lag(n_missing / n_rows) OVER w AS m0, lag(n_rows - n_missing) OVER w AS n0, lag(n_distinct) OVER w AS d0, lag(q3 - q1) OVER w AS iqr, lag(median) OVER w AS med0
  FROM (FROM np UNION ALL FROM tp) u JOIN column_limits USING (table_name, column_name) WINDOW w AS (PARTITION BY table_name, sport_key, season, column_name ORDER BY load_at, load_label)),
i AS (SELECT {_KEYS}, unnest([CASE WHEN lo < min_ok OR hi > max_ok THEN 'range' END, CASE WHEN n_bad > 0 THEN 'pattern' END, CASE WHEN n_missing / n_rows - m0 > 0.33 THEN 'missing' END,
  CASE WHEN n >= 5 AND n_distinct = 1 AND d0 >= 5 THEN 'constant' END, CASE WHEN n >= 5 AND n0 >= 5 AND iqr > 0 AND abs(median - med0) > 2 * iqr THEN 'shift' END]) AS issue FROM p)
SELECT * FROM i WHERE issue IS NOT NULL"""

SQL: dict[str, str] = {"p3_found": P3, "p1_found": P1, "p5_found": P5}
