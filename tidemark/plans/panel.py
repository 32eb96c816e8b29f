"""Queries over forecast panels, lines, boards and schedules, each with DuckDB SQL for the same rows where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import boards, fitted, lines, pairs, search, walkforward
from tidemark.operators import consensus as C
from tidemark.sources import checkpoint, table

# The grids of the summaries.
K_GRID = [0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0]
EDGE_GRID = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
SD_GRID = [0.5, 0.7, 0.9, 1.1, 1.3, 1.5]
LEAST = 3


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return C.cells(table(spark, d, "panel"))


def _graded(spark: SparkSession, d: str) -> DataFrame:
    return C.graded(C.consensus(_cells(spark, d), LEAST))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.clean(table(spark, d, "line_history"))


def _selections(spark: SparkSession, d: str) -> DataFrame:
    return lines.selections(C.consensus(_cells(spark, d), LEAST), _lines(spark, d))


def _model_games(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    e = C.edge(F.col("pred"), F.col("market"))
    return c.withColumn("edge", e).withColumn("grade", C.grade(e, F.round(F.col("actual") - F.col("market"), C.DIGITS)))


def panel_latest(spark, d):
    return C.oriented(C.latest_panel(table(spark, d, "panel"))).select("game_key", "canonical_model_id", *(F.round(c, 6).alias(c) for c in ("pred", "market", "actual")), "selected_source")


def game_reference(spark, d):
    return C.game_reference(C.oriented(C.latest_panel(table(spark, d, "panel"))))


def consensus_games(spark, d):
    return C.consensus(_cells(spark, d)).select("game_key", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "sd")))


def consensus_robust(spark, d):
    return C.robust_consensus(_cells(spark, d))


def consensus_agreement(spark, d):
    return C.agreement(_cells(spark, d)).select("game_key", "agreement")


def cohort_bets(spark, d):
    """The ledger of the consensus of all models at k = 0.75: the panel's flagship query."""
    g = _graded(spark, d).filter((F.col("signal") + C.EPS >= 0.75) & F.col("grade").isin("win", "loss", "push"))
    side = F.when(F.col("edge") > 0, "home").otherwise("road")
    return g.select("game_key", "season", "wk", "n", F.round("mean", 6).alias("mean"), "market", "actual", F.round("edge", 6).alias("edge"), side.alias("side"), "grade")


def cohort_summary_k(spark, d):
    return C.threshold_grid(_graded(spark, d), "signal", K_GRID, keep_empty=True)


def sd_threshold_by_season(spark, d):
    return C.threshold_grid(_graded(spark, d), "signal", SD_GRID, ["season"])


def edge_threshold_grid(spark, d):
    return C.threshold_grid(_graded(spark, d).withColumn("abs_edge", F.abs("edge")), "abs_edge", EDGE_GRID, ["sport_key"])


def follow_fade(spark, d):
    g = C.threshold_grid(_graded(spark, d), "signal", SD_GRID)
    return g.select("threshold", F.col("wins").alias("follow_wins"), F.col("losses").alias("follow_losses"), F.col("losses").alias("fade_wins"), F.col("wins").alias("fade_losses"), "pushes", F.round(1 - F.col("ats"), 6).alias("fade_ats"))


def threshold_monotone(spark, d):
    g = C.threshold_grid(_graded(spark, d), "signal", K_GRID, ["season"], keep_empty=True).withColumn("bets", F.col("wins") + F.col("losses") + F.col("pushes"))
    w = Window.partitionBy("season").orderBy("threshold")
    m = g.withColumn("up", F.coalesce((F.col("bets") > F.lag("bets").over(w)).cast("int"), F.lit(0)))
    return m.groupBy("season").agg(F.max("bets").alias("most"), F.min("bets").alias("least"), (F.sum("up") == 0).alias("monotone"))


def availability_signatures(spark, d):
    sig = _cells(spark, d).groupBy("game_key").agg(F.array_join(F.array_sort(F.collect_set("model")), "|").alias("signature"), F.count("*").alias("n"))
    return sig.groupBy("signature", "n").agg(F.count("*").alias("games"))


def available_model_counts(spark, d):
    n = _cells(spark, d).groupBy("game_key").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("games"))
    total = n.agg(F.sum("games").alias("all"))
    return n.crossJoin(F.broadcast(total)).select("n", "games", F.round(F.col("games") / F.col("all"), 6).alias("share"))


def min_model_sensitivity(spark, d):
    g = _graded(spark, d).withColumn("available", F.col("n").cast("double"))
    picked = g.filter(F.col("signal") + C.EPS >= 0.7)
    return C.threshold_grid(picked, "available", [3.0, 5.0, 7.0, 9.0, 11.0])


def individual_performance(spark, d):
    m = _model_games(spark, d).filter(F.col("actual").isNotNull())
    err = F.col("pred") - F.col("actual")
    s = m.groupBy("model").agg(F.count("*").alias("games"), F.round(F.avg(F.abs(err)), 6).alias("mae"), F.round(F.sqrt(F.avg(err * err)), 6).alias("rmse"), *C.record())
    return C.rates(s)


def individual_by_season(spark, d):
    m = _model_games(spark, d).filter(F.col("actual").isNotNull())
    return C.rates(m.groupBy("model", "season").agg(F.count("*").alias("games"), F.round(F.avg(F.abs(F.col("pred") - F.col("actual"))), 6).alias("mae"), *C.record()))


def model_quality(spark, d):
    """Average percent ranks of MAE and Wilson's lower end, 0.55 and 0.45; ties share their average rank."""
    p = individual_performance(spark, d).filter((F.col("games") >= 5) & F.col("wilson").isNotNull())
    all_ = Window.partitionBy(F.lit(1))  # one row per model of the registry

    def pct(c, up):
        w = all_.orderBy(F.col(c).asc() if up else F.col(c).desc())
        same = Window.partitionBy(F.lit(1), c)
        return (F.rank().over(w) + (F.count("*").over(same) - 1) / 2) / F.count("*").over(all_)

    return p.select("model", F.round(pct("mae", False), 6).alias("mae_rank"), F.round(pct("wilson", True), 6).alias("wilson_rank")).withColumn("score", F.round(0.55 * F.col("mae_rank") + 0.45 * F.col("wilson_rank"), 5))


def season_diagnostics(spark, d):
    g = _graded(spark, d).filter(F.col("actual").isNotNull())
    mae = lambda a: F.round(F.avg(F.abs(F.col(a) - F.col("actual"))), 6)
    return C.rates(g.groupBy("sport_key", "season").agg(F.count("*").alias("games"), mae("mean").alias("mae"), mae("market").alias("market_mae"), *C.record()))


def pairwise_edge_corr(spark, d):
    return pairs.pairwise_correlation(_cells(spark, d))


def effective_n_by_game(spark, d):
    c = _cells(spark, d)
    return pairs.effective_n(c, pairs.pairwise_correlation(c))


def corr_components(spark, d):
    """Connected components of the graph of |r| >= 0.5 over all models of the panel."""
    c = _cells(spark, d)
    r = pairs.pairwise_correlation(c).filter(F.abs("r") >= 0.5)
    return pairs.components(c.select(F.col("model").alias("node")).distinct(), r.select(F.col("model_a").alias("a"), F.col("model_b").alias("b")))


def upgma_clusters(spark, d):
    c = _cells(spark, d)
    return pairs.average_linkage(pairs.pairwise_correlation(c), 0.3, nodes=c.select("model").distinct())


def greedy_cohort(spark, d):
    c = _cells(spark, d)
    rank = individual_performance(spark, d).filter(F.col("games") >= 30).select("model", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("mae"), "model")).alias("rank"))
    return pairs.greedy_diverse(rank, pairs.pairwise_correlation(c))


def leave_one_out(spark, d):
    return pairs.leave_one_out(_cells(spark, d))


def contribution_common(spark, d):
    """Per model: its MAE against the MAE of the market and of the consensus over the same games."""
    c = _cells(spark, d).filter(F.col("actual").isNotNull() & F.col("market").isNotNull())
    j = c.join(C.consensus(_cells(spark, d), LEAST).select("game_key", "mean"), "game_key")
    mae = lambda a: F.round(F.avg(F.abs(F.col(a) - F.col("actual"))), 6)
    return j.groupBy("model").agg(F.count("*").alias("games"), mae("pred").alias("mae"), mae("market").alias("market_mae"), mae("mean").alias("consensus_mae"))


def open_line_qc(spark, d):
    return lines.open_line_qc(table(spark, d, "line_history"))


def reference_performance(spark, d):
    return lines.reference_performance(_selections(spark, d))


def fixed_bet_repricing(spark, d):
    return lines.repricing(_selections(spark, d), _lines(spark, d))


def bet_set_overlap(spark, d):
    return lines.overlap(_selections(spark, d))


def signal_migration(spark, d):
    return lines.migration(_selections(spark, d))


def spread_regimes(spark, d):
    g = _graded(spark, d).filter(F.col("market").isNotNull() & (F.col("signal") + C.EPS >= 0.75))
    fav = F.when(F.col("market") * F.col("edge") > 0, "favorite").otherwise("underdog")
    return C.rates(g.groupBy(lines.regime(F.col("market")).alias("regime"), fav.alias("kind")).agg(*C.record()))


def period_coverage(spark, d):
    return walkforward.period_coverage(_cells(spark, d))


def oos_folds(spark, d):
    return walkforward.folds(walkforward.period_coverage(_cells(spark, d)), 8, 2, 4)


def prior_model_stats(spark, d):
    return walkforward.prior_model_stats(_cells(spark, d))


def bias_corrected_walkforward(spark, d):
    return walkforward.bias_corrected(_cells(spark, d))


def inverse_mse_walkforward(spark, d):
    return walkforward.inverse_mse(_cells(spark, d))


def market_lambda_walkforward(spark, d):
    return walkforward.market_lambda(_graded(spark, d))


def market_anchored_ols(spark, d):
    return walkforward.market_anchored(_graded(spark, d))


def incremental_rank(spark, d):
    return walkforward.incremental_rank(_cells(spark, d))


def edge_calibration(spark, d):
    """Left-closed bins of the signal, empty ones too: games, record, mean edge towards the pick, mean cover towards it."""
    bins = ["<0.50", "0.50-0.75", "0.75-1.00", "1.00-1.25", ">=1.25"]
    g = _graded(spark, d).filter(F.col("signal").isNotNull() & F.col("cover").isNotNull())
    at = F.element_at(F.array(*map(F.lit, bins)), 1 + sum((F.when(F.col("signal") >= t, 1).otherwise(0) for t in (0.5, 0.75, 1.0, 1.25)), F.lit(0)))
    s = F.signum("edge")
    found = g.groupBy(at.alias("bin")).agg(F.count("*").alias("games"), *C.record(), F.round(F.avg(F.abs("edge")), 6).alias("mean_edge"), F.round(F.avg(s * F.col("cover")), 6).alias("mean_cover"))
    every = spark.createDataFrame([(b,) for b in bins], "bin string").join(F.broadcast(found), "bin", "left")
    return C.rates(every.fillna(0, ["games", "wins", "losses", "pushes"]))


def _ledger(spark, d):
    return cohort_bets(spark, d).filter(F.col("grade") != "push").withColumn("unit", F.when(F.col("grade") == "win", F.lit(1)).otherwise(-1).cast("bigint"))


def equity_drawdown(spark, d):
    """Per season: bets, final sum of +1 and -1, and the deepest fall from a peak."""
    r = C.running(_ledger(spark, d), ["season"], ["wk", "game_key"], "unit")
    return r.groupBy("season").agg(F.count("*").alias("bets"), F.sum("unit").alias("final"), F.min("drawdown").alias("max_drawdown"))


def losing_streak(spark, d):
    """Per season: the longest run of losses, by gaps and islands."""
    w = Window.partitionBy("season").orderBy("wk", "game_key")
    v = Window.partitionBy("season", "grade").orderBy("wk", "game_key")
    isl = _ledger(spark, d).withColumn("island", F.row_number().over(w) - F.row_number().over(v))
    runs = isl.groupBy("season", "grade", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("season").agg(F.coalesce(F.max(F.when(F.col("grade") == "loss", F.col("n"))), F.lit(0)).alias("longest_loss"), F.coalesce(F.max(F.when(F.col("grade") == "win", F.col("n"))), F.lit(0)).alias("longest_win"))


def sign_test(spark, d):
    s = cohort_bets(spark, d).groupBy("season").agg(F.count_if(F.col("grade") == "win").alias("wins"), F.count_if(F.col("grade") == "loss").alias("losses"))
    return s.withColumn("p", F.round(walkforward.sign_test(F.col("wins"), F.col("losses")), 9))


def _searched(spark, d):
    """The eight models with most games, in all subsets of three and four."""
    c = _cells(spark, d)
    top = [r[0] for r in c.groupBy("model").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "model").limit(8).collect()]
    return c, search.score_subsets(c, top, 3, 4, 0.75, 2)


def _searched_widely(spark, d):
    """The models with most games, as many as the search takes (45), in all subsets of three to six."""
    c = _cells(spark, d)
    n = search.largest_pool(3, 6)
    top = [r[0] for r in c.groupBy("model").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "model").limit(n).collect()]
    return c, search.score_subsets(c, top, 3, 6, 0.75, 3)


def _wide_board(spark, d):
    return checkpoint(search.leaderboard(_searched_widely(spark, d)[1], 5, 100))


def combo_search(spark, d):
    return _searched(spark, d)[1].withColumn("models", F.array_join("models", "|"))


def combo_leaderboard(spark, d):
    return search.leaderboard(_searched(spark, d)[1], 5, 25).withColumn("models", F.array_join("models", "|"))


def combo_pair_frequency(spark, d):
    return search.pair_frequency(search.leaderboard(_searched(spark, d)[1], 5, 25))


def jaccard_pairs(spark, d):
    return search.jaccard_pairs(checkpoint(search.leaderboard(_searched(spark, d)[1], 5, 25)))


def wide_combo_search(spark, d):
    return _searched_widely(spark, d)[1].withColumn("models", F.array_join("models", "|"))


def wide_combo_leaderboard(spark, d):
    return _wide_board(spark, d).withColumn("models", F.array_join("models", "|"))


def wide_combo_pair_frequency(spark, d):
    return search.pair_frequency(_wide_board(spark, d))


def wide_jaccard_pairs(spark, d):
    return search.jaccard_pairs(_wide_board(spark, d))


def meta_frame(spark, d):
    return search.meta(_cells(spark, d), search.communities(_wide_board(spark, d)), 3).drop("market", "actual")


def stable_k(spark, d):
    return search.stable_k(C.threshold_grid(_graded(spark, d), "signal", K_GRID, ["sport_key"], keep_empty=True), ["sport_key"], 10)


def board_long(spark, d):
    b = table(spark, d, "ncaapredictions")
    cols = boards.model_columns(b)
    return boards.wide_to_long(boards.board_records(b), cols).groupBy("snapshot_label", "board_column").agg(F.count("*").alias("n"), C.settled(F.avg("pred")).alias("mean"))


def board_consensus(spark, d):
    """The last snapshot's board per stream: the consensus of its models, with names from the registry."""
    b = table(spark, d, "ncaapredictions")
    long = boards.wide_to_long(boards.latest_snapshot(boards.board_records(b)), boards.model_columns(b))
    reg = table(spark, d, "models").filter("board_column is not null").select(F.lower("board_column").alias("board_column"), "canonical_model_id")
    j = long.join(F.broadcast(reg), "board_column")
    return j.groupBy("sport_key", "season", "road", "home").agg(F.count("*").alias("n"), F.round(F.avg("pred"), 6).alias("mean"), F.round(F.stddev_samp("pred"), 6).alias("sd"))


def line_moves(spark, d):
    return boards.line_moves(boards.board_records(table(spark, d, "ncaapredictions")))


def source_precedence(spark, d):
    """Per game: models by the source that comes first where a game has both."""
    rows = C.latest_panel(table(spark, d, "panel")).filter(F.col("prediction_home_margin").isNotNull())
    own = boards.by_precedence(rows, ["game_key"], ["pt_mirror", "cfbp_feed"])
    return own.groupBy("game_key", "selected_source").agg(F.count("*").alias("models"))


def completed_excluded(spark, d):
    """Games on the board's last snapshot that have no result yet in the lines: an anti-join by slugs."""
    last = boards.latest_snapshot(boards.board_records(table(spark, d, "ncaapredictions")))
    done = table(spark, d, "line_history").filter("actual_home_margin is not null").select("sport_key", "season", boards.team_slug(F.col("pt_road")).alias("road_slug"), boards.team_slug(F.col("pt_home")).alias("home_slug")).distinct()
    own = last.select("sport_key", "season", boards.team_slug(F.col("road")).alias("road_slug"), boards.team_slug(F.col("home")).alias("home_slug")).distinct()
    return own.join(done, ["sport_key", "season", "road_slug", "home_slug"], "left_anti")


def schedule_matches(spark, d):
    return boards.schedule_matches(table(spark, d, "line_history"), table(spark, d, "schedule"))


def orientation_votes(spark, d):
    return boards.orientation_votes(lines.games(table(spark, d, "line_history")).join(C.game_reference(C.oriented(C.latest_panel(table(spark, d, "panel")))).select("game_key", F.col("market").alias("panel_market")), "game_key"), "close", "panel_market")


def model_registry(spark, d):
    """Models of the panel with their registry rows; models without one are kept."""
    used = C.latest_panel(table(spark, d, "panel")).groupBy("canonical_model_id").agg(F.count("*").alias("rows"), F.count_distinct("game_key").alias("games"))
    reg = table(spark, d, "models").select("canonical_model_id", F.col("model_name").alias("registry_name"), "source_coverage", "include_default")
    return used.join(F.broadcast(reg), "canonical_model_id", "left")


def ranking_latest(spark, d):
    """The last load of each stream's ranking, without repeated rows."""
    t = table(spark, d, "model_ranking_2026")
    last = t.groupBy("sport_key", "season").agg(F.max(F.struct("load_ts", "load_label"))["load_label"].alias("load_label"))
    return t.join(last, ["sport_key", "season", "load_label"]).select("sport_key", "season", "load_label", "canonical_model_id", "quality_rank").distinct()


def edge_slope(spark, d):
    """Per model: the slope of cover on edge, shrunk by n / (n + 100); null where its edges do not vary."""
    m = _model_games(spark, d).withColumn("cover", F.round(F.col("actual") - F.col("market"), C.DIGITS)).filter(F.col("edge").isNotNull() & F.col("cover").isNotNull())
    x, y = F.col("edge"), F.col("cover")
    s = m.groupBy("model").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    n, v = F.col("n"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(v > 1e-9, (n * F.col("sxy") - F.col("sx") * F.col("sy")) / v)
    return s.select("model", "n", F.round(slope, 5).alias("slope"), F.round(slope * n / (n + 100.0), 5).alias("shrunk"))


def posting_models(spark, d):
    """Per period: models that post, that posted in the period before too, and that are new since all earlier ones."""
    c = _cells(spark, d).select("sport_key", "season", "wk", "model").distinct()
    per = walkforward.period_coverage(_cells(spark, d)).select("sport_key", "season", "wk", "period")
    p = c.join(per, ["sport_key", "season", "wk"])
    w = Window.partitionBy("sport_key", "model").orderBy("period")
    q = p.withColumn("last", F.lag("period").over(w))
    return q.groupBy("sport_key", "period").agg(F.count("*").alias("models"), F.count_if(F.col("last") == F.col("period") - 1).alias("stayed"), F.count_if(F.col("last").isNull()).alias("new"))


def holdout_split(spark, d):
    """The last three scorable periods of each sport held out: games and the consensus' record on either side."""
    per = walkforward.period_coverage(_cells(spark, d))
    role = F.when(F.col("period") > F.max("period").over(Window.partitionBy("sport_key")) - 3, "holdout").otherwise("discovery")
    return C.rates(_graded(spark, d).join(per.select("sport_key", "season", "wk", role.alias("role")), ["sport_key", "season", "wk"]).groupBy("sport_key", "role").agg(F.count("*").alias("games"), *C.record()))


def forward_stability(spark, d):
    """Per model: win rates of its seasons' blocks of four weeks, their mean and spread, and weighted by recency."""
    m = _model_games(spark, d).filter(F.col("grade").isin("win", "loss"))
    b = m.groupBy("model", "season", F.floor((F.col("wk") - 1) / 4).cast("int").alias("block")).agg(F.avg((F.col("grade") == "win").cast("double")).alias("ats"), F.count("*").alias("n")).filter(F.col("n") >= 5)
    age = F.row_number().over(Window.partitionBy("model").orderBy(F.col("season").desc(), F.col("block").desc())) - 1
    b = b.withColumn("w", F.pow(F.lit(0.5), age / 2.0))
    mean, sd = F.avg("ats"), F.coalesce(F.stddev_samp("ats"), F.lit(0.0))
    return b.groupBy("model").agg(F.count("*").alias("blocks"), F.round(mean, 6).alias("mean_ats"), F.round(mean - sd, 6).alias("stable"), F.round(F.sum(F.col("w") * F.col("ats")) / F.sum("w"), 6).alias("recent"))


def paired_references(spark, d):
    """Per pair of line references: weeks in which the picks at either line won more often."""
    s = _selections(spark, d).filter((F.col("side") != 0) & F.col("actual").isNotNull()).select("game_key", "reference", "line", "side", "actual")
    s = s.join(C.game_reference(C.oriented(C.latest_panel(table(spark, d, "panel")))).select("game_key", "season", "wk"), "game_key")
    won = F.round(F.col("side") * (F.col("actual") - F.col("line")), C.DIGITS)
    r = s.groupBy("season", "wk", "reference").agg(F.avg(F.when(won > 0, 1.0).when(won < 0, 0.0)).alias("ats"))
    a, b = r.select("season", "wk", F.col("reference").alias("reference_a"), F.col("ats").alias("x")), r.select("season", "wk", F.col("reference").alias("reference_b"), F.col("ats").alias("y"))
    j = a.join(b, ["season", "wk"]).filter(F.col("reference_a") < F.col("reference_b"))
    return j.groupBy("reference_a", "reference_b").agg(F.count("*").alias("weeks"), F.count_if(F.col("x") > F.col("y")).alias("a_better"), F.count_if(F.col("x") < F.col("y")).alias("b_better"))


def board_matrix(spark, d):
    """The last snapshots' games by three of the models: a pivot over known columns."""
    b = table(spark, d, "ncaapredictions")
    long = boards.wide_to_long(boards.latest_snapshot(boards.board_records(b)), boards.model_columns(b))
    cols = ["linenewbury", "linemoore", "linedial"]
    return long.groupBy("sport_key", "season", "road", "home").pivot("board_column", cols).agg(F.max("pred"))


def wide_board_matrix(spark, d):
    """The last snapshots' games by all models of the board."""
    b = table(spark, d, "ncaapredictions")
    cols = boards.model_columns(b)
    long = boards.wide_to_long(boards.latest_snapshot(boards.board_records(b)), cols)
    return long.groupBy("sport_key", "season", "road", "home").pivot("board_column", cols).agg(F.max("pred"))


def _registry(spark, d):
    """The models of the panel that the registry names: a fixed table."""
    return sorted(r[0] for r in table(spark, d, "models").select("canonical_model_id").filter("canonical_model_id is not null").distinct().collect())


def ridge_consensus(spark, d):
    """Each season's games with weights from the seasons before."""
    return fitted.ridge_consensus(_cells(spark, d), _registry(spark, d), prior=True)


def bayes_consensus(spark, d):
    """Each season's games with error covariances from the seasons before."""
    return fitted.bayes_consensus(_cells(spark, d), _registry(spark, d), prior=True)


def density_grid(spark, d):
    return fitted.density(_cells(spark, d))


NAMES = [
    "panel_latest", "game_reference", "consensus_games", "consensus_robust", "consensus_agreement", "cohort_bets", "cohort_summary_k", "sd_threshold_by_season", "edge_threshold_grid", "follow_fade", "threshold_monotone",
    "availability_signatures", "available_model_counts", "min_model_sensitivity", "individual_performance", "individual_by_season", "model_quality", "season_diagnostics", "pairwise_edge_corr", "effective_n_by_game",
    "corr_components", "upgma_clusters", "greedy_cohort", "leave_one_out", "contribution_common", "open_line_qc", "reference_performance", "fixed_bet_repricing", "bet_set_overlap", "signal_migration", "spread_regimes",
    "period_coverage", "oos_folds", "prior_model_stats", "bias_corrected_walkforward", "inverse_mse_walkforward", "market_lambda_walkforward", "market_anchored_ols", "incremental_rank", "edge_calibration", "equity_drawdown",
    "losing_streak", "sign_test", "combo_search", "combo_leaderboard", "combo_pair_frequency", "jaccard_pairs", "wide_combo_search", "wide_combo_leaderboard", "wide_combo_pair_frequency", "wide_jaccard_pairs", "meta_frame", "stable_k", "board_long", "board_consensus", "line_moves", "source_precedence", "completed_excluded",
    "schedule_matches", "orientation_votes", "model_registry", "ranking_latest", "ridge_consensus", "bayes_consensus", "density_grid", "edge_slope", "posting_models", "holdout_split",
    "forward_stability", "paired_references", "board_matrix", "wide_board_matrix",
]
QUERIES = {n: globals()[n] for n in NAMES}
