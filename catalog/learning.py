"""Model operators.

Candidates are variants of the search space as they are, on all feature columns; only boosting has fewer rounds.
All fits learn from every labelled row and score every row. Oracles check what a fit must give whatever its
coefficients: rows, sums, class totals, round trips.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timezone
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog.common import Registry, day, r6, with_views
from catalog.evaluation import GRID_SQL, SEGMENTED_SQL, frame
from catalog.features import FEATURES_SQL, HISTORY_SQL, LATEST_SQL, featured, history
from formline import views
from formline.operators import metrics, monitor, ordered, rollups, snapshots, standard, thresholds
from formline.plans import build, formulas, models, scoring, search, training
from formline.plans.models import Candidate
from formline.plans.preparation import prepared_by
from formline.sources import sinks
from formline.sources.folders import shared_folder, stored

QUERIES = Registry()
add = QUERIES.add

TARGET = "target_multiclass"

LOGISTIC = Candidate("logistic", "logistic", {"c": 1.0})
FOREST = Candidate("forest", "forest", {"trees": 300, "depth": 12, "leaf": 4}, 1.15)
# The search space has 350 rounds; a round of small jobs takes over a second on one machine, however few the rows.
BOOSTED = Candidate("boosting", "boosting", {"trees": 24, "depth": 4, "rate": 0.05, "penalty": 1.0})
TWO_STAGE = Candidate("two_stage", "two_stage", {"stage1_c": 2.0, "stage2_c": 1.0, "scale": 1.0}, 1.6)
SEGMENTED = Candidate("segmented", "segment_aware_hybrid", {
    "segments": {"friendlies": (0.38, 0.58), "worldcup": (0.52, 0.62), "continental": (0.44, 0.58), "qualifiers": (0.48, 0.60)},
    "default": (0.45, 0.55)}, 1.2)


def learned_from(rows):
    """What a fit reads of every labelled row: its key, its class and the inputs."""
    return rows.filter(F.col(TARGET).isNotNull()).select("match_id", TARGET, *metrics.feature_columns(rows))


def fitted(candidate, rows):
    # Written once, so that the passes of the fit read the narrow table.
    return models.fit(candidate, stored(learned_from(rows)), metrics.feature_columns(rows))


def feature_rows(spark, sf_dir):
    """The feature table, written and read back as a job would."""
    return stored(build.feature_table(views.matches(spark, sf_dir), ["pool_id"]).drop("goal_diff"))


def _rounded(scored):
    return scored.select("match_id", "predicted", *[r6(p).alias(p) for p in metrics.PROBABILITIES])


_ROW_SUMS_SQL = with_views("matches", body="select match_id, 1.0::double as probability_sum, true as label_is_largest from matches")


def _row_sums(scored):
    """What every scored row must satisfy: probabilities add up and the label is the largest one (or an override)."""
    p = [F.col(c) for c in metrics.PROBABILITIES]
    largest = F.element_at(F.array(*p), F.col("predicted") + 2) >= F.greatest(*p) - 1e-12
    if "is_override" in scored.columns:
        largest = largest | F.col("is_override")
    return scored.select("match_id", r6(p[0] + p[1] + p[2]).alias("probability_sum"), largest.alias("label_is_largest"))


def _saved_and_loaded(spark, candidate, rows):
    """A fitted model, and the same read back from its folder."""
    folder = shared_folder(spark)
    model = fitted(candidate, rows)
    models.save(model, folder, spark)
    return model, models.load(folder, spark)[0], folder


def _formula_query(name, candidate):
    """Every score equals the formula over the saved values (and rows are what row sums demand)."""
    sql = with_views("matches", body="select match_id, true as equals_formula, 1.0::double as probability_sum, true as label_is_largest from matches")

    @add(name, sql)
    def query(spark, sf_dir):
        rows = feature_rows(spark, sf_dir)
        model, loaded, folder = _saved_and_loaded(spark, candidate, rows)
        scored = stored(model.score(rows))
        if candidate.family == "forest":
            expected = formulas.forest_scores(formulas.node_table(spark, f"{folder}/model/model"), loaded, rows)
        else:
            expected = formulas.scores(loaded, rows)
        return formulas.same_scores(scored, expected).join(_row_sums(scored), "match_id")


def _fit_query(name, candidate):
    @add(name, _ROW_SUMS_SQL)
    def query(spark, sf_dir):
        rows = feature_rows(spark, sf_dir)
        return _row_sums(fitted(candidate, rows).score(rows))


_IMPUTED = ("home_win_rate_last5", "away_win_rate_last5", "elo_diff")


@add(
    "M1_median_imputation",
    with_views("matches", recursive=True, ctes=FEATURES_SQL + ",\nmed as (select median(home_win_rate_last5) as a, median(away_win_rate_last5) as b from features)",
               body="select match_id, round(coalesce(home_win_rate_last5,a),6) as home_win_rate_last5, round(coalesce(away_win_rate_last5,b),6) as away_win_rate_last5, round(elo_home-elo_away,6) as elo_diff from features, med"),
)
def m1(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    filled = Pipeline(stages=models.preparation(list(_IMPUTED), False)).fit(rows).transform(rows)
    values = vector_to_array("_features")
    return filled.select("match_id", *[r6(values[i]).alias(c) for i, c in enumerate(_IMPUTED)])


@add(
    "M2_standard_scaling",
    with_views("predictions", body="""select match_id, round((g_home-avg(g_home) over ())/stddev_pop(g_home) over (),6) as g_home, round((g_draw-avg(g_draw) over ())/stddev_pop(g_draw) over (),6) as g_draw from predictions"""),
)
def m2(spark, sf_dir):
    p = views.predictions(spark, sf_dir)
    scaled = Pipeline(stages=models.preparation(["g_home", "g_draw"], True)).fit(p).transform(p)
    values = vector_to_array("_features")
    return scaled.select("match_id", F.round(values[0], 6).alias("g_home"), F.round(values[1], 6).alias("g_draw"))


@add(
    "M3_prior_baseline",
    with_views("predictions", ctes="""cc as (select actual, count(*)::double as c, sum(count(*)) over ()::double as n from predictions group by actual),
w as (select actual, c, n/(3*c)*case when actual=0 then 1.2 else 1 end as w from cc), s as (select actual, w*c/sum(w*c) over () as p from w)""",
        body="""select match_id, round((select p from s where actual=-1),6) as p_away, round((select p from s where actual=0),6) as p_draw, round((select p from s where actual=1),6) as p_home, 0::int as predicted from predictions"""),
)
def m3(spark, sf_dir):
    p = views.predictions(spark, sf_dir).withColumnRenamed("actual", TARGET)
    fitted = models.fit(Candidate("prior", "dummy", {}, 1.2), p, ["g_home"])
    return _rounded(fitted.score(p))


@add(
    "M4_multinomial_logistic",
    # With a free intercept, a converged fit gives each class its weighted total; balanced weights make them equal.
    with_views("matches", body="""select cast(c as int) as class, round(1/3.0,3)::double as share, count(*) as rows
 from matches, (values (-1),(0),(1)) v(c) group by c"""),
)
def m4(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    scored = metrics.with_class_weights(models.fit(LOGISTIC, rows, metrics.feature_columns(rows)).score(rows), TARGET, 1.0)
    each = F.array(*[F.struct(F.lit(c).alias("class"), (F.col("weight") * F.col(p)).alias("mass"), F.col("weight").alias("w"))
                     for c, p in zip((-1, 0, 1), metrics.PROBABILITIES)])
    return scored.select(F.inline(each)).groupBy("class").agg(
        F.round(F.sum("mass") / F.sum("w"), 3).alias("share"), F.count("*").alias("rows"))


_formula_query("M5_random_forest", FOREST)


@add("M6_gradient_boosting", with_views("matches", body="""select match_id, true as equals_formula, true as losses_fall,
 1.0::double as probability_sum, true as label_is_largest from matches"""))
def m6(spark, sf_dir):
    """Learned from all rows; every score of the saved model equals its trees as nested conditions."""
    rows = feature_rows(spark, sf_dir)
    folder = shared_folder(spark)
    models.save(models.fit(BOOSTED, rows, metrics.feature_columns(rows)), folder, spark)
    model = models.load(folder, spark)[0]
    scored = stored(model.score(rows))
    losses = model.constants["boosting"]["losses"]
    falling = len(losses) == BOOSTED.params["trees"] and all(a > b for a, b in zip(losses, losses[1:]))
    return (formulas.same_scores(scored, formulas.boosting_scores(model, rows)).withColumn("losses_fall", F.lit(falling))
            .join(_row_sums(scored), "match_id"))


_formula_query("M7_two_stage_draw_model", TWO_STAGE)
_formula_query("M9_fitted_segment_ensemble", SEGMENTED)
# A base of every kind. Each is fitted six times, so the trees are few.
STACK = Candidate("stack", "stacking", {"folds": 5, "bases": [
    LOGISTIC, Candidate("forest", "forest", {"trees": 20, "depth": 6, "leaf": 4}),
    Candidate("boosting", "boosting", {"trees": 3, "depth": 3, "rate": 0.05, "penalty": 1.0})]})


@add("M21_stacking", with_views("matches", body="""select match_id, 1.0::double as probability_sum, true as label_is_largest, true as equals_formula, true as same_when_loaded from matches"""))
def m21(spark, sf_dir):
    """Scores equal the softmax of the saved meta coefficients over the bases' scores, and those of the model read back."""
    rows = feature_rows(spark, sf_dir)
    model, loaded, _ = _saved_and_loaded(spark, STACK, rows)
    scored, again = stored(model.score(rows)), stored(loaded.score(rows))
    inputs = rows
    for i in range(3):
        names = {p: f"_{i}_{p}" for p in metrics.PROBABILITIES}
        part = loaded.parts[f"base{i}"].score(rows).select("match_id", *[F.col(p).alias(n) for p, n in names.items()])
        inputs = inputs.join(part, "match_id")
    expected = formulas.scores(loaded.parts["meta"], stored(inputs))
    same = again.select("match_id", *[F.col(p).alias("x_" + p) for p in metrics.PROBABILITIES])
    equal = F.greatest(*[F.abs(F.col(p) - F.col("x_" + p)) for p in metrics.PROBABILITIES]) < 1e-12
    return (formulas.same_scores(scored, expected).join(_row_sums(scored), "match_id")
            .join(scored.join(same, "match_id").select("match_id", equal.alias("same_when_loaded")), "match_id"))


def _calibrated(method):
    def query(spark, sf_dir):
        scored = frame(spark, sf_dir).withColumn(TARGET, F.col("actual"))
        fitted = models.calibrate(scored, method)
        return _rounded(fitted.apply(scored))

    return query


# Distinct scores of every class with their hits.
_COUNTS_SQL = """counts as materialized (select class, score, sum(hit)::double as hits, count(*)::double as n from (
 select 'away' as class, g_away as score, (actual=-1)::int as hit from predictions union all
 select 'draw', g_draw, (actual=0)::int from predictions union all
 select 'home', g_home, (actual=1)::int from predictions) group by 1, 2)"""
_MAPPED_SQL = """mapped as (select match_id, {away} as a, {draw} as d, {home} as h from predictions p{joins}),
normal as (select match_id, a/(a+d+h) as p_away, d/(a+d+h) as p_draw, h/(a+d+h) as p_home from mapped)"""
_ROW_SQL = """select match_id, case when p_away>=p_draw and p_away>=p_home then -1 when p_draw>=p_home then 0 else 1 end as predicted,
 round(p_away,6) as p_away, round(p_draw,6) as p_draw, round(p_home,6) as p_home from normal"""


def _newton_sql(steps: int) -> str:
    """Newton steps written out one by one."""
    ctes = [_COUNTS_SQL, """aims as (select class, (sum(hits)+1)/(sum(hits)+2) as hi, 1/(sum(n)-sum(hits)+2) as lo,
 0::double as a0, ln((sum(hits)+1)/(sum(n)-sum(hits)+1)) as b0 from counts group by class)""",
            "s0 as materialized (select class, a0 as a, b0 as b from aims)"]
    for k in range(steps):
        ctes.append(f"""s{k + 1} as materialized (select class, a+(h00*g1-h01*g0)/(h00*h11-h01*h01) as a, b+(h11*g0-h01*g1)/(h00*h11-h01*h01) as b from (
 select class, any_value(a) as a, any_value(b) as b, sum(r) as g0, sum(r*score) as g1, sum(w) as h00, sum(w*score) as h01, sum(w*score*score) as h11 from (
  select class, a, b, score, hits*hi+(n-hits)*lo-n*p as r, n*p*(1-p) as w from (
   select class, a, b, hi, lo, score, hits, n, 1/(1+exp(-(a*score+b))) as p from counts join aims using (class) join s{k} using (class)))
 group by class))""")
    last = "(select {v} from s%d where class='{c}')" % steps
    terms = {c: f"1/(1+exp(-({last.format(v='a', c=c)}*g_{c}+{last.format(v='b', c=c)})))" for c in ("away", "draw", "home")}
    return ",\n".join([*ctes, _MAPPED_SQL.format(joins="", **terms)])


# Max-min formula: the largest over starts of the least mean of any stretch that holds the score.
_ISOTONIC_SQL = _COUNTS_SQL + """,
run as materialized (select class, score, row_number() over w as i, sum(hits) over w as h, sum(n) over w as m, hits, n from counts window w as (partition by class order by score)),
means as (select j.class, j.i as j, k.i as k, (k.h-j.h+j.hits)/(k.m-j.m+j.n) as mean from run j join run k on j.class=k.class and j.i<=k.i),
least as (select class, j, k as i, min(mean) over (partition by class, j order by k desc) as v from means),
fit as materialized (select class, i, max(v) as v from least group by 1, 2),
points as materialized (select run.class, run.score, fit.v from run join fit using (class, i)),
""" + _MAPPED_SQL.format(away="x.v", draw="y.v", home="z.v", joins="""
 join points x on x.class='away' and x.score=p.g_away join points y on y.class='draw' and y.score=p.g_draw join points z on z.class='home' and z.score=p.g_home""")

add("M10_sigmoid_calibration", with_views("predictions", ctes=_newton_sql(12), body=_ROW_SQL))(_calibrated("sigmoid"))
add("M11_isotonic_calibration", with_views("predictions", ctes=_ISOTONIC_SQL, body=_ROW_SQL))(_calibrated("isotonic"))


# The search space without its forests and boosting, whose 300 to 400 trees take hours on one machine.
SEARCHED = ("dummy", *search.LINEAR)


def _searched():
    return [c for c in models.candidate_list() if c.family in SEARCHED]


@add(
    "M13_temporal_backtest",
    with_views("matches", body="""select model_name, cast(fold as int) as fold, count(*) // 6 as fold_rows, true as in_range, true as settled, true as agrees_where_fitted_apart
 from matches, range(1, 6) r(fold), (values """ + ", ".join(f"('{c.name}')" for c in _searched()) + """) v(model_name) group by 1, 2"""),
)
def m13(spark, sf_dir):
    """Every linear candidate over five folds from shared fits. In the first fold, one of each ensemble family and every
    other candidate are fitted apart by the library's own solver as well; its stopping rule leaves 0.002 of log loss.
    Ensembles that differ in thresholds only have one such fit."""
    rows = feature_rows(spark, sf_dir)
    columns, candidates = metrics.feature_columns(rows), _searched()
    scores = search.out_of_fold([c for c in candidates if search.shared(c)], rows, columns, TARGET, training.ORDER, 5)
    folds, _ = training.backtest(candidates, rows, columns, 5, scores=scores)
    past, valid = ordered.expanding_folds(rows, training.ORDER, 5)[0]
    hybrids = [[c for c in candidates if c.family == f][0] for f in search.ENSEMBLES]
    apart = [c for c in candidates if c.family not in search.ENSEMBLES] + hybrids
    past = stored(learned_from(past))
    # Their inputs are prepared alike; draws are part 1.
    used = models.usable_features(past, columns)
    prepared = prepared_by(models.as_doubles(past, used), used, (F.col(TARGET) == 0).cast("int"), [[0, 1], [0]], True)

    def parts_of(c):
        # A given iteration limit calls the library's solver.
        return models.fit(replace(c, params={**c.params, "max_iter": models.MAX_ITER, "prepared": prepared}), past, columns)

    # The longest fits go first.
    several = {tuple(search.fits_of(c).values()) if search.shared(c) else c.name: c for c in reversed(apart)}
    with ThreadPool(8) as pool:
        fits = dict(zip(several, pool.map(parts_of, several.values(), 1)))

    def scored(c):
        fit = fits[tuple(search.fits_of(c).values()) if search.shared(c) else c.name]
        return replace(fit, candidate=c, constants=fit.constants | {k: v for k, v in c.params.items() if k == "scale"}).score(valid).select(
            F.lit(c.name).alias("model_name"), F.col(TARGET).alias("actual"), "predicted", *metrics.PROBABILITIES)

    parts = [scored(c) for c in apart]
    alone = metrics.evaluate(reduce(DataFrame.unionByName, parts), "model_name").select(
        "model_name", F.lit(1).alias("fold"), F.col("log_loss").alias("alone"))
    settled = all(f.gradient <= search.TOLERANCE for f in scores.learned)
    return folds.join(alone, ["model_name", "fold"], "left").select(
        "model_name", F.col("fold").cast("int").alias("fold"), F.col("n").alias("fold_rows"),
        (F.col("macro_f1").between(0, 1) & (F.col("log_loss") > 0)).alias("in_range"), F.lit(settled).alias("settled"),
        F.coalesce(F.abs(F.col("log_loss") - F.col("alone")) < 0.002, F.lit(True)).alias("agrees_where_fitted_apart"))


@add(
    "M16_training_job",
    with_views("matches", body="""select cast(floor(count(*)*0.2) as bigint) as n, true as in_range, 16::bigint as candidates, 5::bigint as folds,
 true as chosen_is_first from matches"""),
)
def m16(spark, sf_dir):
    """The job without given candidates: thresholds tuned from the out-of-fold table, then every candidate of SEARCHED."""
    rows = feature_rows(spark, sf_dir)
    out = training.train_and_select(rows, splits=5, calibration_size=0.25, families=SEARCHED)
    tried = out["fold_metrics"].agg(F.count_distinct("model_name").alias("candidates"), F.count_distinct("fold").alias("folds"))
    first = out["ranking"].filter("selection_rank = 1").select(
        (F.col("model_name") == out["summary"]["selected_model_name"]).alias("chosen_is_first"))
    return out["test_metrics"].select(
        "n", (F.col("accuracy").between(0, 1) & (F.col("log_loss") > 0)).alias("in_range")).crossJoin(tried).crossJoin(first)


@add(
    "M15_tuned_segments",
    with_views("matches", body="""select distinct match_segment, true as equals_sql, true as equals_job from (select case tournament when 'FIFA World Cup' then 'worldcup' when 'Friendly' then 'friendlies'
 when 'FIFA World Cup qualification' then 'qualifiers' when 'UEFA Euro' then 'continental' end as match_segment from matches) where match_segment is not null"""),
)
def m15_tuned(spark, sf_dir):
    """Thresholds of the standing log-loss budget from out-of-fold scores, next to plain SQL that tries every cell on every row."""
    rows = feature_rows(spark, sf_dir)
    scores = search.out_of_fold([training.PROBE], rows, metrics.feature_columns(rows), TARGET, training.ORDER, 5)
    pairs = stored(scores.pairs(training.PROBE))
    pairs.createOrReplaceTempView("out_of_fold_pairs")
    cells = GRID_SQL.replace(SEGMENTED_SQL, "segmented as (select * from out_of_fold_pairs)").replace("filter (", "filter (where ")
    expected = spark.sql(f"""with {cells}, allowed as (select *, row_number() over (partition by match_segment order by draw_f1 desc, i, j) as rn
 from scored_cells where overrides>0 and draw_f1>base_draw_f1 and log_loss<=base_log_loss+{thresholds.LOG_LOSS_BUDGET})
select s.match_segment, coalesce(a.u,0.01d) as u, coalesce(a.c,0.99d) as c from (select distinct match_segment from scored_cells) s
 left join (select * from allowed where rn=1) a using (match_segment)""")
    job = thresholds.threshold_table(spark, training.tuned_segments(pairs)).withColumnsRenamed({"uncertainty": "ju", "conviction": "jc"})
    best = thresholds.tune_thresholds(pairs)

    def same(u, c):
        return (F.abs(F.col("uncertainty") - F.col(u)) < 1e-9) & (F.abs(F.col("conviction") - F.col(c)) < 1e-9)

    return best.join(expected, "match_segment").join(job, "match_segment").select(
        "match_segment", same("u", "c").alias("equals_sql"), same("ju", "jc").alias("equals_job"))


@add("M17_shadow_candidate", with_views("matches", body="select match_id, 1.0::double as probability_sum, 'segmented' as model_name from matches"))
def m17(spark, sf_dir):
    """The whole job, split to test, on every row."""
    rows = feature_rows(spark, sf_dir)
    folder = shared_folder(spark)
    training.train_and_select(rows, [Candidate("prior", "dummy"), SEGMENTED], splits=5, calibration_size=0.25, model_folder=folder, tag="v1")
    shadow, _, about = models.load(f"{folder}/shadow", spark)
    return _row_sums(shadow.score(rows)).select("match_id", "probability_sum", F.lit(about["model"]["name"]).alias("model_name"))


@add("S8_K7_model_save_and_load", with_views("matches", body="select match_id, true as same from matches"))
def s8(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    folder = shared_folder(spark)
    before = fitted(TWO_STAGE, rows)
    models.save(before, f"{folder}/production", spark, feature_columns=metrics.feature_columns(rows))
    loaded, _, _ = models.load(f"{folder}/production", spark)
    again = loaded.score(rows).select("match_id", F.struct("predicted", *metrics.PROBABILITIES).alias("after"))
    both = before.score(rows).join(again, "match_id")
    return both.select("match_id", (F.struct("predicted", *metrics.PROBABILITIES) == F.col("after")).alias("same"))


@add(
    "M18_batch_scoring",
    with_views("predictions", ctes=SEGMENTED_SQL, body="select coalesce(match_segment,'none') as match_segment, count(*) as rows, count(*) as labelled, count(*) as shadowed from segmented group by 1"),
)
def m18(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    requests = rows.select("match_id", "match_date", F.lower("away_team").alias("home_team"), F.concat(F.lit(" "), F.col("home_team")).alias("away_team"), "tournament", "neutral")
    scored, _ = scoring.score_requests(requests, snapshots.team_snapshots(rows), fitted(LOGISTIC, rows), fitted(SEGMENTED, rows))
    return scored.groupBy(F.coalesce("match_segment", F.lit("none")).alias("match_segment")).agg(
        F.count("*").alias("rows"), F.count("predicted_outcome").alias("labelled"),
        F.count("shadow_predicted_outcome").alias("shadowed"))


@add(
    "M18_served_and_logged",
    with_views("predictions", ctes=SEGMENTED_SQL, body="""select coalesce(match_segment,'none') as match_segment, count(*) as logged, 0::bigint as violations,
 true as logged_as_scored, true as states_agree from segmented group by 1"""),
)
def m18_served(spark, sf_dir):
    """A run with a retry under its id: the log holds each result once as scored, and the hourly states say the same."""
    rows = feature_rows(spark, sf_dir)
    requests = rows.select("match_id", "match_date", "home_team", "away_team", "tournament", "neutral")
    folder, history = shared_folder(spark), snapshots.team_snapshots(rows)
    primary, shadow = fitted(LOGISTIC, rows), fitted(SEGMENTED, rows)
    for _ in range(2):
        run = scoring.serve(requests, history, primary, shadow, folder=folder, artifact_path="models/production",
                            at=datetime(2024, 1, 30, 12, 30, tzinfo=timezone.utc), run_id="run-18", model_version="v1")
    if run.error:
        raise RuntimeError(run.error)
    log = sinks.read_log(spark, f"{folder}/log")
    kept = ["home_team", "away_team", "predicted_class", "predicted_outcome", "class_probabilities_json", "match_segment",
            "shadow_predicted_outcome", "shadow_class_probabilities_json", "shadow_model_name", "feature_source"]
    as_scored = log.select(*kept).exceptAll(run.scored.select(*kept)).isEmpty() and run.scored.select(*kept).exceptAll(log.select(*kept)).isEmpty()
    states, values = rollups.window(spark, f"{folder}/rollups", "2024-01-31 00:00:00", 24)
    names = monitor.inference_statistics(log).columns
    agree = rollups.inference_statistics(states, values).select(*names).first() == monitor.inference_statistics(log).first()
    return log.groupBy(F.coalesce("match_segment", F.lit("none")).alias("match_segment")).agg(F.count("*").alias("logged")).select(
        "*", F.lit(run.violations.count()).alias("violations"), F.lit(as_scored).alias("logged_as_scored"), F.lit(agree).alias("states_agree"))


@add("M24_fixture_forecast", _ROW_SUMS_SQL)
def m24(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    requests = rows.select("match_id", F.col("away_team").alias("home_team"), F.col("home_team").alias("away_team"), "tournament", "neutral")
    return _row_sums(scoring.forecast(requests, snapshots.team_snapshots(rows), fitted(TWO_STAGE, rows), rows))


@add(
    "M23_complete_cases",
    with_views("matches", recursive=True, ctes=FEATURES_SQL, body="select match_id from features where home_avg_goals_last5 is not null and away_avg_goals_last5 is not null"),
)
def m23(spark, sf_dir):
    return training.complete_cases(feature_rows(spark, sf_dir), ["home_avg_goals_last5", "away_avg_goals_last5"]).select("match_id")


@add(
    "T7_feature_importances",
    # Every listed importance equals the one from the saved trees, and the list is the first 15 of those in order.
    "select r::int as rank, true as equals_node_table from range(1, 16) t(r)",
)
def t7(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    model, _, folder = _saved_and_loaded(spark, FOREST, rows)
    nodes = formulas.node_table(spark, f"{folder}/model/model")
    wanted = formulas.importances(nodes, model.features).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))
    listed = models.feature_importances(model, spark).withColumn(
        "listed_rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))).withColumnRenamed("importance", "listed")
    # Features whose importances agree to 1e-12 may change places.
    value = wanted.select("rank", F.col("importance").alias("at_rank"))
    return listed.join(wanted.drop("rank"), "feature").join(value, F.col("rank") == F.col("listed_rank")).select(
        "rank", ((F.abs(F.col("listed") - F.col("importance")) < 1e-9) & (F.abs(F.col("listed") - F.col("at_rank")) < 1e-9)).alias("equals_node_table"))


@add(
    "T9_strongest_pairs",
    with_views("matches", recursive=True, ctes=HISTORY_SQL + ",\n" + LATEST_SQL + """,
top as (select team, row_number() over (order by elo desc, team)-1 as r from latest where team_role='overall' order by elo desc, team limit 16)""",
        body="select r//2 as pair, max(case when r%2=0 then team end) as home_team, max(case when r%2=1 then team end) as away_team from top group by 1"),
)
def t9(spark, sf_dir):
    return scoring.strongest_pairs(snapshots.latest_snapshots(history(spark, sf_dir)))


@add(
    "M25_full_job",
    # The CSV feed lacks every tenth score, and every fifth document is of a club competition.
    with_views("matches", body="""select stage, 'done' as status, cast(case when stage='train' then floor(n*0.2) else n end as bigint) as rows
 from (select count(*) as n from (select distinct match_date, home_team, away_team, home_goals, away_goals from matches where match_id%10<>0)),
  (values ('ingest'),('process'),('train')) v(stage)"""),
)
def m25(spark, sf_dir):
    from catalog import storage
    from formline.plans import job

    folder = shared_folder(spark)
    storage._historical(spark, sf_dir).write.option("header", True).csv(f"{folder}/csv")
    code = F.when(F.col("id") % 5 == 0, "PL").otherwise("WC")
    documents = storage._documents(spark, sf_dir).withColumn(
        "competition", F.struct(code.alias("code"), F.col("competition.name").alias("name")))
    documents.select(F.array(F.struct(*documents.columns)).alias("matches")).write.json(f"{folder}/json")
    stages = job.from_sources(
        spark, f"{folder}/csv", f"{folder}/json", f"{folder}/layers", multi_line=False,
        candidates=[Candidate("prior", "dummy"), TWO_STAGE], splits=3, calibration_size=0.25, run_id="run-25")
    return stages.select("stage", "status", "rows")


@add(
    "M25_run_reports",
    with_views("matches", body="""select report, cast(case report when 'fold_metrics' then 10 when 'segments' then floor(n*0.2) else 3*floor(n*0.2) end as bigint) as covered, true as sound
 from (select count(*) as n from matches), (values ('fold_metrics'),('segments'),('calibration_curves')) v(report)"""),
)
def m25_reports(spark, sf_dir):
    """Reports of a training run, read back: folds of both candidates, time windows that cover the test rows, and curves whose
    bins hold every row once and keep the mean score and the class share of the test rows."""
    rows = feature_rows(spark, sf_dir)
    folder = shared_folder(spark)
    out = training.train_and_select(rows, [Candidate("prior", "dummy"), LOGISTIC], splits=5, calibration_size=0.25)
    for name, table in training.report_tables(out).items():
        sinks.write_report(table, f"{folder}/{name}")
    folds, segments, curves = (spark.read.json(f"{folder}/{n}") for n in ("fold_metrics", "segments", "calibration_curves"))
    scored = training.evaluation_frame(out["test_scored"])
    means = scored.select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("class"), F.col(p).alias("p"), (F.col("actual") == c).cast("double").alias("hit"))
        for c, label, p in zip((-1, 0, 1), ("away_win", "draw", "home_win"), metrics.PROBABILITIES)]))).groupBy("class").agg(
            F.avg("p").alias("p"), F.avg("hit").alias("hit"))
    found = curves.groupBy("class").agg(
        (F.sum(F.col("mean_predicted") * F.col("rows")) / F.sum("rows")).alias("curve_p"),
        (F.sum(F.col("observed") * F.col("rows")) / F.sum("rows")).alias("curve_hit"), F.sum("rows").alias("n"))
    agreed = found.join(means, "class").agg(
        F.sum("n").alias("covered"), F.bool_and((F.abs(F.col("p") - F.col("curve_p")) < 1e-6) & (F.abs(F.col("hit") - F.col("curve_hit")) < 1e-6)).alias("sound"))
    parts = [
        folds.agg(F.count("*").alias("covered"), F.bool_and(F.col("log_loss") > 0).alias("sound")).withColumn("report", F.lit("fold_metrics")),
        segments.filter("segment_type = 'time_window'").agg(
            F.sum("n").alias("covered"), F.bool_and(F.col("accuracy").between(0, 1)).alias("sound")).withColumn("report", F.lit("segments")),
        agreed.withColumn("report", F.lit("calibration_curves"))]
    return reduce(DataFrame.unionByName, parts).select("report", "covered", "sound")
