"""DuckDB SQL with the same rows as the panel queries, over the same whole tables."""

from __future__ import annotations

import itertools

_CLEAN = "CASE WHEN isnan({0}) THEN NULL ELSE {0} + 0.0 END AS {0}"
_PANEL = (
    "p0 AS (SELECT game_key, canonical_model_id, loaded_ts, selected_source, sport_key, season, wk, model_name, road, home, "
    + ", ".join(_CLEAN.format(c) for c in ("prediction_home_margin", "market_home_margin", "actual_home_margin", "pair_orientation"))
    + " FROM panel WHERE game_key IS NOT NULL AND canonical_model_id IS NOT NULL)"
)
_LATEST = """lp AS (SELECT *, prediction_home_margin * coalesce(pair_orientation, 1) AS pred, market_home_margin * coalesce(pair_orientation, 1) AS market,
  actual_home_margin * coalesce(pair_orientation, 1) AS actual FROM (SELECT *, row_number() OVER (PARTITION BY game_key, canonical_model_id ORDER BY loaded_ts DESC NULLS LAST,
  prediction_home_margin DESC NULLS LAST, market_home_margin DESC NULLS LAST, actual_home_margin DESC NULLS LAST, pair_orientation DESC NULLS LAST, selected_source DESC NULLS LAST) AS rn FROM p0) WHERE rn = 1)"""
_REF = """gr AS (SELECT game_key, min(sport_key) AS sport_key, mode(season) AS season, mode(wk) AS wk,
  coalesce(median(market) FILTER (WHERE selected_source LIKE 'pt%'), median(market)) AS market,
  coalesce(median(actual) FILTER (WHERE selected_source LIKE 'pt%'), median(actual)) AS actual FROM lp GROUP BY game_key)"""
_CELLS = """c AS (SELECT gr.game_key, gr.sport_key, gr.season, gr.wk, canonical_model_id AS model, pred, gr.market, gr.actual FROM lp JOIN gr USING (game_key) WHERE pred IS NOT NULL)"""
_CONS = """g0 AS (SELECT game_key, sport_key, season, wk, market, actual, count(*) AS n, round(avg(pred), 9) AS mean, round(median(pred), 9) AS median, round(stddev_samp(pred), 9) AS sd
  FROM c GROUP BY ALL)"""
_GRADE = "CASE WHEN {e} IS NULL OR {c} IS NULL THEN NULL WHEN abs({e}) < 1e-12 THEN 'no_bet' WHEN abs({c}) < 1e-12 THEN 'push' WHEN {e} * {c} > 0 THEN 'win' ELSE 'loss' END"
_GRADED = f"""g1 AS (SELECT *, round(mean - market, 9) AS edge, round(actual - market, 9) AS cover FROM g0 WHERE n >= 3),
g AS (SELECT *, CASE WHEN sd IS NULL OR edge IS NULL THEN NULL WHEN sd > 1e-12 THEN abs(edge) / sd WHEN abs(edge) > 1e-12 THEN 'Infinity'::DOUBLE ELSE 0 END AS signal,
  {_GRADE.format(e="edge", c="cover")} AS grade FROM g1)"""
_P = f"WITH {_PANEL}, {_LATEST}"
_R = f"{_P}, {_REF}"
_C = f"{_R}, {_CELLS}"
_G0 = f"{_C}, {_CONS}"
_G = f"{_G0}, {_GRADED}"
_MODEL = f"{_C}, m AS (SELECT *, round(pred - market, 9) AS edge, {_GRADE.format(e='round(pred - market, 9)', c='round(actual - market, 9)')} AS grade FROM c)"
_RECORD = "count(*) FILTER (WHERE grade = 'win') AS wins, count(*) FILTER (WHERE grade = 'loss') AS losses, count(*) FILTER (WHERE grade = 'push') AS pushes"
_Z = 1.959963984540054
_P_HAT = "(wins::DOUBLE / nullif(wins + losses, 0))"
_N = "(wins + losses)::DOUBLE"
_RATES = f"round({_P_HAT}, 6) AS ats, round(CASE WHEN wins + losses > 0 THEN ({_P_HAT} + {_Z * _Z} / (2 * {_N}) - {_Z} * sqrt(({_P_HAT} * (1 - {_P_HAT}) + {_Z * _Z} / (4 * {_N})) / {_N})) / (1 + {_Z * _Z} / {_N}) END, 6) AS wilson"
_BETS = f"{_G}, b AS (SELECT game_key, season, wk, n, round(mean, 6) AS mean, market, actual, round(edge, 6) AS edge, CASE WHEN edge > 0 THEN 'home' ELSE 'road' END AS side, grade FROM g WHERE signal + 1e-12 >= 0.75 AND grade IN ('win', 'loss', 'push'))"
_LEDGER = f"{_BETS}, l AS (SELECT *, CASE WHEN grade = 'win' THEN 1 ELSE -1 END AS unit FROM b WHERE grade <> 'push')"


def _grid(steps, column, by="", where="TRUE", keep=False):
    t = f"t AS (SELECT unnest([{', '.join(f'{float(x)}' for x in steps)}]::DOUBLE[]) AS threshold)"
    keys = f"{by}, " if by else ""
    groups = f", k AS (SELECT DISTINCT {by} FROM q)" if by else ""
    base = f"q AS (SELECT * FROM g WHERE grade IS NOT NULL AND grade <> 'no_bet' AND {where})"
    hit = f"{column} + 1e-12 >= threshold"
    rec = ", ".join(f"count(*) FILTER (WHERE {hit} AND grade = '{a}') AS {b}" for a, b in (("win", "wins"), ("loss", "losses"), ("push", "pushes")))
    having = "" if keep else f" HAVING count(*) FILTER (WHERE {hit}) > 0"
    return f"{_G}, {t}, {base}{groups}, z AS (SELECT {keys}threshold, {rec} FROM q CROSS JOIN t GROUP BY {keys}threshold{having}) SELECT *, {_RATES} FROM z"


K_GRID = [0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0]
SD_GRID = [0.5, 0.7, 0.9, 1.1, 1.3, 1.5]

# lines
_LH = """lh AS (SELECT game_key, max(struct_pack(s := sport_key, y := season, w := wk, o := open_margin, m := midweek_margin, c := close_margin, a := actual_home_margin * coalesce(pair_orientation, 1))) AS r
  FROM line_history WHERE game_key IS NOT NULL GROUP BY game_key),
lw AS (SELECT game_key, r.s AS sport_key, r.y AS season, r.w AS wk, r.o + 0.0 AS "open", r.m + 0.0 AS midweek, r.c + 0.0 AS "close", r.a AS actual FROM lh)"""
_QC = """qc AS (SELECT game_key,
  concat_ws('; ', CASE WHEN "open" IS NULL THEN 'missing open' END, CASE WHEN midweek IS NULL THEN 'missing midweek' END, CASE WHEN "close" IS NULL THEN 'missing close' END,
    CASE WHEN abs("close" - "open") >= 10 THEN 'large move' END, CASE WHEN abs("open") >= 50 THEN 'large open' END) AS review,
  concat_ws('; ', CASE WHEN abs("close" - "open") >= 10 AND sign("open") <> sign("close") AND abs("open") >= 2.5 AND abs("close") >= 2.5 THEN 'favorite flip' END,
    CASE WHEN abs("close" - "open") >= 30 THEN 'gross gap' END, CASE WHEN abs("open") >= 50 AND abs("close") <= 25 AND abs("close" - "open") >= 25 THEN 'magnitude mismatch' END,
    CASE WHEN abs(midweek - "close") <= 2.5 AND abs("open" - (midweek + "close") / 2) >= 20 THEN 'far from stable' END) AS suspect FROM lw)"""
_LL = """cl AS (SELECT lw.game_key, actual, CASE WHEN suspect = '' THEN "open" END AS "open", midweek, "close" FROM lw JOIN qc USING (game_key)),
ll AS (SELECT game_key, actual, 'open' AS reference, "open" AS line FROM cl WHERE "open" IS NOT NULL UNION ALL SELECT game_key, actual, 'midweek', midweek FROM cl WHERE midweek IS NOT NULL
  UNION ALL SELECT game_key, actual, 'close', "close" FROM cl WHERE "close" IS NOT NULL)"""
_SEL = """s0 AS (SELECT game_key, reference, line, sd, ll.actual, round(mean - line, 9) AS edge FROM g0 JOIN ll USING (game_key) WHERE n >= 3),
s1 AS (SELECT *, CASE WHEN sd IS NULL THEN NULL WHEN sd > 1e-12 THEN abs(edge) / sd WHEN abs(edge) > 1e-12 THEN 'Infinity'::DOUBLE ELSE 0 END AS signal FROM s0),
sel AS (SELECT *, CASE WHEN coalesce(signal + 1e-12 >= 0.75 AND abs(edge) >= 1e-12, FALSE) THEN sign(edge)::INT ELSE 0 END AS side FROM s1)"""
_S = f"{_G0}, {_LH}, {_QC}, {_LL}, {_SEL}"
_WIDE = """pw AS (SELECT game_key, """ + ", ".join(f"coalesce(max(side) FILTER (WHERE reference = '{r}'), 0) AS s_{r}, max(line) FILTER (WHERE reference = '{r}') AS l_{r}" for r in ("open", "midweek", "close")) + " FROM sel GROUP BY game_key)"


def _overlap():
    parts = []
    for a, b in itertools.combinations(("open", "midweek", "close"), 2):
        parts.append(
            f"SELECT '{a}' AS reference_a, '{b}' AS reference_b, count(*) FILTER (WHERE s_{a} <> 0 AND s_{b} <> 0) AS \"both\", count(*) FILTER (WHERE s_{a} <> 0 AND s_{b} = 0) AS only_a, "
            f"count(*) FILTER (WHERE s_{a} = 0 AND s_{b} <> 0) AS only_b, count(*) FILTER (WHERE s_{a} <> 0 AND s_{b} <> 0 AND s_{a} <> s_{b}) AS flipped FROM pw"
        )
    return f"{_S}, {_WIDE}, o AS ({' UNION ALL '.join(parts)}) SELECT *, round(\"both\"::DOUBLE / nullif(\"both\" + only_a + only_b, 0), 6) AS jaccard FROM o"


# pairs and priors
_CORR = """e AS (SELECT game_key, model, round(pred - market, 9) AS x FROM c WHERE market IS NOT NULL),
pr AS (SELECT a.model AS model_a, b.model AS model_b, count(*) AS shared, sum(a.x) AS sx, sum(b.x) AS sy, sum(a.x * a.x) AS sxx, sum(b.x * b.x) AS syy, sum(a.x * b.x) AS sxy
  FROM e a JOIN e b ON a.game_key = b.game_key AND a.model < b.model GROUP BY 1, 2),
corr AS (SELECT model_a, model_b, shared, round(CASE WHEN shared * sxx - sx * sx > 1e-9 AND shared * syy - sy * sy > 1e-9 THEN greatest(-1.0, least(1.0, (shared * sxy - sx * sy) / sqrt((shared * sxx - sx * sx) * (shared * syy - sy * sy)))) END, 6) AS r
  FROM pr WHERE shared >= 30)"""
_PRIOR = """ps AS (SELECT sport_key, season, wk, model, count(actual) AS n, coalesce(sum(round(pred - actual, 9)), 0) AS e, coalesce(sum(round(pred - actual, 9) * round(pred - actual, 9)), 0) AS ee,
  coalesce(sum(abs(round(pred - actual, 9))), 0) AS ae FROM c GROUP BY ALL),
pc AS (SELECT sport_key, season, wk, model, coalesce(sum(n) OVER w, 0) AS pn, coalesce(sum(e) OVER w, 0) AS pe, coalesce(sum(ee) OVER w, 0) AS pee, coalesce(sum(ae) OVER w, 0) AS pae
  FROM ps WINDOW w AS (PARTITION BY sport_key, model ORDER BY season, wk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
prior AS (SELECT sport_key, season, wk, model, pn::BIGINT AS prior_n, round(pe / nullif(pn, 0), 6) AS prior_bias, round(pee / nullif(pn, 0), 6) AS prior_mse, round(pae / nullif(pn, 0), 6) AS prior_mae FROM pc)"""
_PERIODS = """pd AS (SELECT sport_key, season, wk, count(DISTINCT game_key) AS games, count(DISTINCT model) AS models,
  count(DISTINCT CASE WHEN market IS NOT NULL AND actual IS NOT NULL THEN game_key END) AS scorable FROM c GROUP BY ALL),
per AS (SELECT *, row_number() OVER (PARTITION BY sport_key ORDER BY season, wk) AS period FROM pd WHERE scorable >= 1)"""

# boards
_BR = """br AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sport_key, season, snapshot_label, road, home ORDER BY row_id DESC) AS rn FROM ncaapredictions
  WHERE road IS NOT NULL AND home IS NOT NULL AND row_id IS NOT NULL AND snapshot_label IS NOT NULL AND sport_key IS NOT NULL AND season IS NOT NULL) WHERE rn = 1)"""
_LAST = """last AS (SELECT sport_key, season, max(struct_pack(a := snapshot_ts, b := snapshot_label)).b AS snapshot_label FROM br GROUP BY ALL)"""
_UNP = """un AS (UNPIVOT (SELECT sport_key, season, wk, snapshot_label, road, home, COLUMNS(lambda x: x LIKE 'line%' AND x NOT IN ('line', 'lineopen', 'linemidweek')) FROM {src})
  ON COLUMNS(lambda x: x LIKE 'line%') INTO NAME board_column VALUE pred)"""
_SLUG = "trim(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


def _sched(x):
    s = f"regexp_replace({_SLUG.format(x)}, ' st$', ' state')"
    for a, b in (("n", "north"), ("s", "south"), ("e", "east"), ("w", "west")):
        s = f"regexp_replace({s}, '^{a} ', '{b} ')"
    return s


def _pair(a, b):
    return f"least({_sched(a)}, {_sched(b)}) || '__' || greatest({_sched(a)}, {_sched(b)})"


_TOP8 = "top8 AS (SELECT model FROM c GROUP BY model ORDER BY count(*) DESC, model LIMIT 8)"
_COMBOS = f"""{_C}, {_TOP8}, ids AS (SELECT model, row_number() OVER (ORDER BY model) AS i FROM top8),
sub AS (SELECT [a.model, b.model, d.model] AS models, 3 AS size FROM ids a JOIN ids b ON a.i < b.i JOIN ids d ON b.i < d.i
  UNION ALL SELECT [a.model, b.model, d.model, f.model], 4 FROM ids a JOIN ids b ON a.i < b.i JOIN ids d ON b.i < d.i JOIN ids f ON d.i < f.i),
mem AS (SELECT array_to_string(models, '|') AS models, size, unnest(models) AS model FROM sub),
cg AS (SELECT models, size, game_key, market, actual, count(*) AS n, sum(pred) AS s, sum(pred * pred) AS ss FROM mem JOIN c USING (model) WHERE market IS NOT NULL AND actual IS NOT NULL GROUP BY ALL),
ce AS (SELECT *, round(s / n - market, 9) AS edge, round(actual - market, 9) AS cover, round(sqrt(greatest(0, (ss - s * s / n) / (n - 1))), 6) AS sd FROM cg WHERE n >= 2),
cb AS (SELECT *, {_GRADE.format(e="edge", c="cover")} AS grade FROM ce WHERE abs(edge) >= 1e-12 AND CASE WHEN sd > 1e-6 THEN round(abs(edge) / sd, 6) >= 0.75 ELSE TRUE END),
ct AS (SELECT sub2.models, sub2.size, count(grade) AS bets, {_RECORD} FROM (SELECT array_to_string(models, '|') AS models, size FROM sub) sub2 LEFT JOIN cb USING (models, size) GROUP BY ALL),
combos AS (SELECT *, {_RATES} FROM ct)"""
_BOARD = f"{_COMBOS}, lb AS (SELECT *, row_number() OVER (ORDER BY wilson DESC NULLS LAST, bets DESC, models) AS rank FROM combos WHERE bets >= 5 QUALIFY rank <= 25)"

SQL: dict[str, str] = {
    "panel_latest": f"{_P} SELECT game_key, canonical_model_id, round(pred, 6) AS pred, round(market, 6) AS market, round(actual, 6) AS actual, selected_source FROM lp",
    "game_reference": f"{_R} SELECT * FROM gr",
    "consensus_games": f"{_G0} SELECT game_key, n, round(mean, 6) AS mean, round(median, 6) AS median, round(sd, 6) AS sd FROM g0",
    "consensus_robust": f"""{_C}, q AS (SELECT game_key, count(*) AS n, quantile_cont(pred, 0.1) AS lo, quantile_cont(pred, 0.5) AS mid, quantile_cont(pred, 0.9) AS hi FROM c GROUP BY game_key),
      j AS (SELECT c.game_key, q.n, mid, CASE WHEN n >= 3 THEN least(greatest(pred, lo), hi) ELSE pred END AS w, abs(pred - mid) AS d FROM c JOIN q USING (game_key))
      SELECT game_key, n, round(avg(w), 6) AS winsorized, round(0.5 * mid + 0.5 * avg(w), 6) AS hybrid, round(median(d), 6) AS mad FROM j GROUP BY game_key, n, mid""",
    "consensus_agreement": f"""{_C}, mm AS (SELECT game_key, round(avg(pred), 9) AS mean FROM c GROUP BY game_key)
      SELECT game_key, round(avg(CASE WHEN abs(mean - market) > 1e-12 THEN (sign(round(pred - market, 9)) = sign(round(mean - market, 9)))::INT END), 6) AS agreement FROM c JOIN mm USING (game_key) WHERE market IS NOT NULL GROUP BY game_key""",
    "cohort_bets": f"{_BETS} SELECT * FROM b",
    "cohort_summary_k": _grid(K_GRID, "signal", keep=True),
    "sd_threshold_by_season": _grid(SD_GRID, "signal", "season"),
    "edge_threshold_grid": _grid([0, 1, 2, 3, 4, 5], "abs(edge)", "sport_key"),
    "follow_fade": f"SELECT threshold, wins AS follow_wins, losses AS follow_losses, losses AS fade_wins, wins AS fade_losses, pushes, round(1 - ats, 6) AS fade_ats FROM ({_grid(SD_GRID, 'signal')})",
    "threshold_monotone": f"""WITH t AS ({_grid(K_GRID, "signal", "season", keep=True)}), u AS (SELECT *, wins + losses + pushes AS bets FROM t),
      v AS (SELECT *, coalesce(bets > lag(bets) OVER (PARTITION BY season ORDER BY threshold), FALSE) AS up FROM u) SELECT season, max(bets) AS most, min(bets) AS least, NOT bool_or(up) AS monotone FROM v GROUP BY season""",
    "availability_signatures": f"{_C}, s AS (SELECT game_key, string_agg(model, '|' ORDER BY model) AS signature, count(*) AS n FROM c GROUP BY game_key) SELECT signature, n, count(*) AS games FROM s GROUP BY ALL",
    "available_model_counts": f"{_C}, s AS (SELECT game_key, count(*) AS n FROM c GROUP BY game_key) SELECT n, count(*) AS games, round(count(*)::DOUBLE / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY n",
    "min_model_sensitivity": _grid([3, 5, 7, 9, 11], "n", where="signal + 1e-12 >= 0.7"),
    "individual_performance": f"{_MODEL}, z AS (SELECT model, count(*) AS games, round(avg(abs(pred - actual)), 6) AS mae, round(sqrt(avg((pred - actual) * (pred - actual))), 6) AS rmse, {_RECORD} FROM m WHERE actual IS NOT NULL GROUP BY model) SELECT *, {_RATES} FROM z",
    "individual_by_season": f"{_MODEL}, z AS (SELECT model, season, count(*) AS games, round(avg(abs(pred - actual)), 6) AS mae, {_RECORD} FROM m WHERE actual IS NOT NULL GROUP BY model, season) SELECT *, {_RATES} FROM z",
    "model_quality": f"""{_MODEL}, z AS (SELECT model, count(*) AS games, round(avg(abs(pred - actual)), 6) AS mae, {_RECORD} FROM m WHERE actual IS NOT NULL GROUP BY model), y AS (SELECT *, {_RATES} FROM z),
      x AS (SELECT * FROM y WHERE games >= 5 AND wilson IS NOT NULL), r AS (SELECT model, round((rank() OVER (ORDER BY mae DESC) + (count(*) OVER (PARTITION BY mae) - 1) / 2.0) / count(*) OVER (), 6) AS mae_rank,
      round((rank() OVER (ORDER BY wilson) + (count(*) OVER (PARTITION BY wilson) - 1) / 2.0) / count(*) OVER (), 6) AS wilson_rank FROM x) SELECT *, round(0.55 * mae_rank + 0.45 * wilson_rank, 5) AS score FROM r""",
    "season_diagnostics": f"{_G}, z AS (SELECT sport_key, season, count(*) AS games, round(avg(abs(mean - actual)), 6) AS mae, round(avg(abs(market - actual)), 6) AS market_mae, {_RECORD} FROM g WHERE actual IS NOT NULL GROUP BY ALL) SELECT *, {_RATES} FROM z",
    "pairwise_edge_corr": f"{_C}, {_CORR} SELECT * FROM corr",
    "effective_n_by_game": f"""{_C}, {_CORR}, n AS (SELECT game_key, count(*) AS n FROM c GROUP BY game_key),
      o AS (SELECT a.game_key, sum(abs(coalesce(r, 0))) AS s FROM c a JOIN corr ON a.model = model_a JOIN c b ON b.game_key = a.game_key AND b.model = model_b GROUP BY 1)
      SELECT game_key, n, round(greatest(1.0, least(n, n * n / (n + 2 * coalesce(s, 0)))), 6) AS effective_n FROM n LEFT JOIN o USING (game_key)""",
    "corr_components": f"""{_C.replace("WITH", "WITH RECURSIVE", 1)}, {_CORR}, ed AS (SELECT model_a AS a, model_b AS b FROM corr WHERE abs(r) >= 0.5 UNION SELECT model_b, model_a FROM corr WHERE abs(r) >= 0.5),
      reach AS (SELECT DISTINCT model AS node, model AS other FROM c UNION SELECT reach.node, ed.b FROM reach JOIN ed ON ed.a = reach.other) SELECT node, min(other) AS component FROM reach GROUP BY node""",
    "leave_one_out": f"""{_C}, s AS (SELECT game_key, sum(pred) AS s, count(*) AS n FROM c GROUP BY game_key HAVING count(*) > 2),
      j AS (SELECT model, actual, round(s / n, 9) AS a, round((s - pred) / (n - 1), 9) AS b FROM c JOIN s USING (game_key) WHERE actual IS NOT NULL)
      SELECT model, count(*) AS games, round(avg(abs(a - actual)), 6) AS mae_with, round(avg(abs(b - actual)), 6) AS mae_without, round(avg(abs(a - b)), 6) AS mean_shift FROM j GROUP BY model""",
    "contribution_common": f"""{_G0} SELECT c.model, count(*) AS games, round(avg(abs(pred - c.actual)), 6) AS mae, round(avg(abs(c.market - c.actual)), 6) AS market_mae, round(avg(abs(mean - c.actual)), 6) AS consensus_mae
      FROM c JOIN g0 USING (game_key) WHERE c.actual IS NOT NULL AND c.market IS NOT NULL AND g0.n >= 3 GROUP BY c.model""",
    "open_line_qc": f"WITH {_LH}, {_QC} SELECT * FROM qc",
    "reference_performance": f"{_S}, sg AS (SELECT *, {_GRADE.format(e='edge', c='round(actual - line, 9)')} AS grade FROM sel WHERE side <> 0 AND actual IS NOT NULL), z AS (SELECT reference, {_RECORD} FROM sg GROUP BY reference) SELECT *, {_RATES} FROM z",
    "fixed_bet_repricing": f"""{_S}, pk AS (SELECT sel.reference AS chosen_at, ll.reference AS graded_at, side, sel.line AS l0, ll.line AS l1, round(side * (sel.actual - ll.line), 9) AS o FROM sel JOIN ll USING (game_key) WHERE side <> 0 AND sel.actual IS NOT NULL),
      gg AS (SELECT *, CASE WHEN abs(o) < 1e-12 THEN 'push' WHEN o > 0 THEN 'win' ELSE 'loss' END AS grade FROM pk) SELECT chosen_at, graded_at, {_RECORD}, round(avg(side * (l1 - l0)), 6) AS mean_move FROM gg GROUP BY 1, 2""",
    "bet_set_overlap": _overlap(),
    "signal_migration": f"""{_S}, {_WIDE}, pt AS (SELECT CASE WHEN s_open <> 0 THEN 'o' ELSE '-' END || CASE WHEN s_midweek <> 0 THEN 'm' ELSE '-' END || CASE WHEN s_close <> 0 THEN 'c' ELSE '-' END AS pattern,
      CASE WHEN s_open <> 0 THEN s_open * (l_close - l_open) WHEN s_midweek <> 0 THEN s_midweek * (l_close - l_midweek) WHEN s_close <> 0 THEN s_close * (l_close - l_close) END AS clv FROM pw)
      SELECT pattern, count(*) AS games, round(avg(clv), 6) AS mean_clv, count(*) FILTER (WHERE clv > 0) AS positive FROM pt WHERE pattern <> '---' GROUP BY pattern""",
    "spread_regimes": f"""{_G}, x AS (SELECT *, CASE WHEN abs(market) <= 3 THEN '0-3' WHEN abs(market) <= 7 THEN '3-7' WHEN abs(market) <= 10 THEN '7-10' WHEN abs(market) <= 14 THEN '10-14' WHEN abs(market) <= 21 THEN '14-21' WHEN abs(market) <= 28 THEN '21-28' ELSE '28+' END AS regime,
      CASE WHEN market * edge > 0 THEN 'favorite' ELSE 'underdog' END AS kind FROM g WHERE market IS NOT NULL AND signal + 1e-12 >= 0.75), z AS (SELECT regime, kind, {_RECORD} FROM x GROUP BY ALL) SELECT *, {_RATES} FROM z""",
    "period_coverage": f"{_C}, {_PERIODS} SELECT * FROM per",
    "oos_folds": f"""{_C}, {_PERIODS}, t AS (SELECT *, max(period) OVER (PARTITION BY sport_key) AS total FROM per), n AS (SELECT *, greatest(0, least(8, floor((total - 4) / 2.0)))::INT AS n FROM t),
      f AS (SELECT *, unnest(generate_series(1, n)) AS fold FROM n WHERE n > 0), r AS (SELECT *, total - (n - fold + 1) * 2 AS start FROM f)
      SELECT sport_key, fold::INT AS fold, CASE WHEN period <= start THEN 'discovery' ELSE 'validation' END AS role, season, wk, period FROM r WHERE period <= start + 2""",
    "prior_model_stats": f"{_C}, {_PRIOR} SELECT * FROM prior",
    "bias_corrected_walkforward": f"{_C}, {_PRIOR} SELECT game_key, count(*) AS n, round(avg(pred - coalesce(prior_bias * prior_n / (prior_n + 200.0), 0)), 6) AS bias_corrected FROM c JOIN prior USING (sport_key, season, wk, model) GROUP BY game_key",
    "inverse_mse_walkforward": f"""{_C}, {_PRIOR}, j AS (SELECT game_key, pred, CASE WHEN prior_n >= 20 AND prior_mse > 0 THEN 1 / prior_mse END AS inv FROM c JOIN prior USING (sport_key, season, wk, model)),
      k AS (SELECT game_key, avg(inv) AS m FROM j GROUP BY game_key), w AS (SELECT game_key, pred, CASE WHEN inv IS NULL THEN 1 ELSE greatest(0.5, least(2.0, inv / m)) END AS w FROM j JOIN k USING (game_key))
      SELECT game_key, count(*) AS n, round(sum(w * pred) / sum(w), 6) AS weighted FROM w GROUP BY game_key""",
    "market_lambda_walkforward": f"""{_G}, s AS (SELECT sport_key, season, wk, count(*) FILTER (WHERE edge IS NOT NULL AND cover IS NOT NULL) AS n, coalesce(sum(edge * cover), 0) AS xy, coalesce(sum(CASE WHEN cover IS NOT NULL THEN edge * edge END), 0) AS xx FROM g GROUP BY ALL),
      t AS (SELECT sport_key, season, wk, coalesce(sum(n) OVER w, 0) AS pn, coalesce(sum(xy) OVER w, 0) AS pxy, coalesce(sum(xx) OVER w, 0) AS pxx FROM s WINDOW w AS (PARTITION BY sport_key ORDER BY season, wk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT sport_key, season, wk, pn::BIGINT AS prior_games, round(CASE WHEN pn >= 30 AND pxx > 1e-12 THEN greatest(0.0, least(1.5, pxy / pxx)) ELSE 1.0 END, 6) AS lam FROM t""",
    "market_anchored_ols": f"""{_G}, s AS (SELECT sport_key, season, count(*) AS n, avg(market) AS m, avg(edge) AS e, avg(actual) AS y, avg(market * market) AS mm, avg(edge * edge) AS ee, avg(market * edge) AS me, avg(market * actual) AS my, avg(edge * actual) AS ey
      FROM g WHERE edge IS NOT NULL AND cover IS NOT NULL GROUP BY ALL), v AS (SELECT *, mm - m * m AS smm, ee - e * e AS see, me - m * e AS sme, my - m * y AS smy, ey - e * y AS sey FROM s),
      d AS (SELECT *, smm * see - sme * sme AS det FROM v), f AS (SELECT *, CASE WHEN n >= 11 AND det > 1e-9 THEN (smy * see - sey * sme) / det END AS b, CASE WHEN n >= 11 AND det > 1e-9 THEN (sey * smm - smy * sme) / det END AS g FROM d)
      SELECT sport_key, season, n, round(y - b * m - g * e, 5) AS alpha, round(b, 5) AS beta, round(g, 5) AS gamma FROM f""",
    "incremental_rank": f"""{_C}, x AS (SELECT model, round(pred - market, 9) AS x, round(actual - market, 9) AS y FROM c WHERE market IS NOT NULL AND actual IS NOT NULL),
      s AS (SELECT model, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM x GROUP BY model HAVING count(*) >= 25),
      r AS (SELECT model, n, round(CASE WHEN n * sxx - sx * sx > 1e-9 AND n * syy - sy * sy > 1e-9 THEN greatest(-1.0, least(1.0, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)))) END, 6) AS r FROM s),
      t AS (SELECT *, round(r * sqrt(n / (n + 50.0)), 5) AS score FROM r) SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, model) AS rank FROM t""",
    "edge_calibration": f"""{_G}, b AS (SELECT unnest(['<0.50', '0.50-0.75', '0.75-1.00', '1.00-1.25', '>=1.25']) AS bin),
      x AS (SELECT CASE WHEN signal < 0.5 THEN '<0.50' WHEN signal < 0.75 THEN '0.50-0.75' WHEN signal < 1 THEN '0.75-1.00' WHEN signal < 1.25 THEN '1.00-1.25' ELSE '>=1.25' END AS bin, edge, cover, grade FROM g WHERE signal IS NOT NULL AND cover IS NOT NULL),
      z AS (SELECT b.bin, count(x.bin) AS games, count_if(grade = 'win') AS wins, count_if(grade = 'loss') AS losses, count_if(grade = 'push') AS pushes, round(avg(abs(edge)), 6) AS mean_edge, round(avg(sign(edge) * cover), 6) AS mean_cover
        FROM b LEFT JOIN x USING (bin) GROUP BY b.bin) SELECT *, {_RATES} FROM z""",
    "equity_drawdown": f"""{_LEDGER}, r AS (SELECT *, sum(unit) OVER w AS cum FROM l WINDOW w AS (PARTITION BY season ORDER BY wk, game_key ROWS UNBOUNDED PRECEDING)),
      q AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY season ORDER BY wk, game_key ROWS UNBOUNDED PRECEDING)) AS peak FROM r) SELECT season, count(*) AS bets, sum(unit)::BIGINT AS final, min(cum - peak)::BIGINT AS max_drawdown FROM q GROUP BY season""",
    "losing_streak": f"""{_LEDGER}, i AS (SELECT season, grade, row_number() OVER (PARTITION BY season ORDER BY wk, game_key) - row_number() OVER (PARTITION BY season, grade ORDER BY wk, game_key) AS k FROM l),
      r AS (SELECT season, grade, k, count(*) AS n FROM i GROUP BY ALL) SELECT season, coalesce(max(n) FILTER (WHERE grade = 'loss'), 0) AS longest_loss, coalesce(max(n) FILTER (WHERE grade = 'win'), 0) AS longest_win FROM r GROUP BY season""",
    "combo_search": f"{_COMBOS} SELECT * FROM combos",
    "combo_leaderboard": f"{_BOARD} SELECT * FROM lb",
    "combo_pair_frequency": f"{_BOARD}, u AS (SELECT rank, unnest(string_split(models, '|')) AS model FROM lb) SELECT a.model AS model_a, b.model AS model_b, count(*) AS subsets FROM u a JOIN u b ON a.rank = b.rank AND a.model < b.model GROUP BY 1, 2",
    "jaccard_pairs": f"""{_BOARD} SELECT a.rank AS rank_a, b.rank AS rank_b, round(len(list_intersect(string_split(a.models, '|'), string_split(b.models, '|')))::DOUBLE / len(list_distinct(string_split(a.models, '|') || string_split(b.models, '|'))), 6) AS jaccard
      FROM lb a JOIN lb b ON a.rank < b.rank""",
    "stable_k": f"""WITH z AS ({_grid(K_GRID, "signal", "sport_key", keep=True)}), p AS (SELECT *, wins + losses + pushes AS bets, wins + losses + pushes >= 10 AND wilson IS NOT NULL AS enough FROM z),
      q AS (SELECT *, CASE WHEN enough AND lag(enough) OVER w AND lead(enough) OVER w THEN least(lag(wilson) OVER w, wilson, lead(wilson) OVER w) END AS worst FROM p WINDOW w AS (PARTITION BY sport_key ORDER BY threshold)),
      r AS (SELECT *, max(worst) OVER (PARTITION BY sport_key) AS best FROM q),
      centred AS (SELECT sport_key, threshold AS k, bets, worst AS plateau, TRUE AS centred FROM r WHERE worst >= best - 0.01 QUALIFY row_number() OVER (PARTITION BY sport_key ORDER BY bets DESC, threshold) = 1),
      other AS (SELECT sport_key, threshold AS k, bets, wilson AS plateau, FALSE AS centred FROM r WHERE best IS NULL AND bets > 0 QUALIFY row_number() OVER (PARTITION BY sport_key ORDER BY bets >= 10 DESC, bets DESC, abs(threshold - 0.75), wilson DESC NULLS LAST, threshold) = 1)
      FROM centred UNION ALL FROM other""",
    "board_long": f"WITH {_BR}, {_UNP.format(src='br')} SELECT snapshot_label, board_column, count(*) AS n, round(avg(pred), 6) AS mean FROM un WHERE NOT isnan(pred) GROUP BY ALL",
    "board_consensus": f"""WITH {_BR}, {_LAST}, cur AS (SELECT br.* FROM br JOIN last USING (sport_key, season, snapshot_label)), {_UNP.format(src="cur")}
      SELECT sport_key, season, road, home, count(*) AS n, round(avg(pred), 6) AS mean, round(stddev_samp(pred), 6) AS sd FROM un JOIN (SELECT lower(board_column) AS board_column FROM models WHERE board_column IS NOT NULL) USING (board_column) WHERE NOT isnan(pred) GROUP BY ALL""",
    "line_moves": f"""WITH {_BR}, r AS (SELECT *, line + 0.0 AS l, coalesce(lag(line + 0.0) OVER (PARTITION BY sport_key, season, road, home ORDER BY snapshot_ts, snapshot_label) <> line + 0.0, FALSE) AS moved FROM br WHERE line IS NOT NULL AND NOT isnan(line))
      SELECT sport_key, season, road, home, arg_min(l, struct_pack(a := snapshot_ts, b := snapshot_label)) AS first_line, arg_max(l, struct_pack(a := snapshot_ts, b := snapshot_label)) AS last_line, count(*) AS snapshots, sum(moved::INT)::BIGINT AS moves FROM r GROUP BY ALL""",
    "source_precedence": f"""{_P}, r AS (SELECT game_key, selected_source, CASE selected_source WHEN 'pt_mirror' THEN 1 WHEN 'cfbp_feed' THEN 2 ELSE 3 END AS k FROM lp WHERE prediction_home_margin IS NOT NULL),
      f AS (SELECT *, min(k) OVER (PARTITION BY game_key) AS first FROM r) SELECT game_key, selected_source, count(*) AS models FROM f WHERE k = first GROUP BY ALL""",
    "completed_excluded": f"""WITH {_BR}, {_LAST}, cur AS (SELECT DISTINCT br.sport_key, br.season, {_SLUG.format("road")} AS road_slug, {_SLUG.format("home")} AS home_slug FROM br JOIN last USING (sport_key, season, snapshot_label))
      SELECT * FROM cur WHERE NOT EXISTS (SELECT 1 FROM line_history l WHERE actual_home_margin IS NOT NULL AND l.sport_key = cur.sport_key AND l.season = cur.season AND {_SLUG.format("l.pt_road")} = road_slug AND {_SLUG.format("l.pt_home")} = home_slug)""",
    "schedule_matches": f"""WITH s AS (SELECT DISTINCT sport_key, season, {_pair("away", "home")} AS pair, {_sched("away")} AS away_slug, game_join_key AS target FROM schedule WHERE away IS NOT NULL AND home IS NOT NULL),
      l AS (SELECT DISTINCT game_key, sport_key, season, {_pair("pt_road", "pt_home")} AS pair, {_sched("pt_road")} AS road_slug FROM line_history WHERE game_key IS NOT NULL)
      SELECT game_key, count(DISTINCT target) AS matches, count(DISTINCT CASE WHEN away_slug <> road_slug THEN target END) AS reversed FROM l LEFT JOIN s USING (sport_key, season, pair) GROUP BY game_key""",
    "orientation_votes": f"""{_R}, {_LH}, j AS (SELECT lw.sport_key, lw.season, "close" * gr.market AS p FROM lw JOIN gr USING (game_key)), v AS (SELECT sport_key, season, count(*) AS games, count(*) FILTER (WHERE p > 0) AS same, count(*) FILTER (WHERE p < 0) AS opposite FROM j GROUP BY ALL)
      SELECT *, CASE WHEN same > opposite THEN 1 WHEN same < opposite THEN -1 ELSE 0 END AS sign FROM v""",
    "model_registry": f"{_P}, u AS (SELECT canonical_model_id, count(*) AS \"rows\", count(DISTINCT game_key) AS games FROM lp GROUP BY 1) SELECT u.*, model_name AS registry_name, source_coverage, include_default FROM u LEFT JOIN models USING (canonical_model_id)",
    "ranking_latest": """WITH l AS (SELECT sport_key, season, max(struct_pack(a := load_ts, b := load_label)).b AS load_label FROM model_ranking_2026 GROUP BY ALL)
      SELECT DISTINCT sport_key, season, load_label, canonical_model_id, quality_rank FROM model_ranking_2026 JOIN l USING (sport_key, season, load_label)""",
    "edge_slope": f"""{_MODEL}, x AS (SELECT model, edge AS x, round(actual - market, 9) AS y FROM m WHERE edge IS NOT NULL AND actual IS NOT NULL AND market IS NOT NULL),
      s AS (SELECT model, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM x GROUP BY model), t AS (SELECT model, n, CASE WHEN n * sxx - sx * sx > 1e-9 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) END AS slope FROM s)
      SELECT model, n, round(slope, 5) AS slope, round(slope * n / (n + 100.0), 5) AS shrunk FROM t""",
    "posting_models": f"""{_C}, {_PERIODS}, p AS (SELECT DISTINCT c.sport_key, period, model FROM c JOIN per USING (sport_key, season, wk)), q AS (SELECT *, lag(period) OVER (PARTITION BY sport_key, model ORDER BY period) AS last FROM p)
      SELECT sport_key, period, count(*) AS models, count(*) FILTER (WHERE last = period - 1) AS stayed, count(*) FILTER (WHERE last IS NULL) AS "new" FROM q GROUP BY ALL""",
    "holdout_split": f"""{_G}, {_PERIODS}, r AS (SELECT sport_key, season, wk, CASE WHEN period > max(period) OVER (PARTITION BY sport_key) - 3 THEN 'holdout' ELSE 'discovery' END AS role FROM per),
      z AS (SELECT sport_key, role, count(*) AS games, {_RECORD} FROM g JOIN r USING (sport_key, season, wk) GROUP BY ALL) SELECT *, {_RATES} FROM z""",
    "forward_stability": f"""{_MODEL}, b AS (SELECT model, season, (wk - 1) // 4 AS block, avg((grade = 'win')::INT) AS ats FROM m WHERE grade IN ('win', 'loss') GROUP BY ALL HAVING count(*) >= 5),
      w AS (SELECT *, pow(0.5, (row_number() OVER (PARTITION BY model ORDER BY season DESC, block DESC) - 1) / 2.0) AS w FROM b)
      SELECT model, count(*) AS blocks, round(avg(ats), 6) AS mean_ats, round(avg(ats) - coalesce(stddev_samp(ats), 0), 6) AS stable, round(sum(w * ats) / sum(w), 6) AS recent FROM w GROUP BY model""",
    "paired_references": f"""{_S}, x AS (SELECT gr.season, gr.wk, reference, round(side * (sel.actual - line), 9) AS o FROM sel JOIN gr USING (game_key) WHERE side <> 0 AND sel.actual IS NOT NULL),
      r AS (SELECT season, wk, reference, avg(CASE WHEN o > 0 THEN 1.0::DOUBLE WHEN o < 0 THEN 0 END) AS ats FROM x GROUP BY ALL)
      SELECT a.reference AS reference_a, b.reference AS reference_b, count(*) AS weeks, count(*) FILTER (WHERE a.ats > b.ats) AS a_better, count(*) FILTER (WHERE a.ats < b.ats) AS b_better
      FROM r a JOIN r b ON a.season = b.season AND a.wk = b.wk AND a.reference < b.reference GROUP BY 1, 2""",
    "board_matrix": f"""WITH {_BR}, {_LAST}, cur AS (SELECT br.* FROM br JOIN last USING (sport_key, season, snapshot_label)), {_UNP.format(src="cur")}
      SELECT sport_key, season, road, home, max(pred) FILTER (WHERE board_column = 'linenewbury') AS linenewbury, max(pred) FILTER (WHERE board_column = 'linemoore') AS linemoore, max(pred) FILTER (WHERE board_column = 'linedial') AS linedial
      FROM un WHERE NOT isnan(pred) GROUP BY ALL""",
}
