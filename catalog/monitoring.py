"""Inference log, freshness, contracts, training runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import AS_OF, Registry, day, r6, with_views
from formline import views
from formline.operators import check_states, monitor, quality, report, rollups, snapshots
from formline.sources.folders import shared_folder

QUERIES = Registry()
add = QUERIES.add


def _stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _stamp_sql(column):
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


_P = {o: f"cast(json_extract_string(class_probabilities_json,'$.{o}') as double)" for o in ("home_win", "draw", "away_win")}
_AGREE = "count(*) filter (shadow_predicted_outcome is not null and predicted_outcome=shadow_predicted_outcome)"


def recent(spark, sf_dir, days=30):
    return monitor.look_back(views.inference_log(spark, sf_dir), AS_OF, days=days)


def _recent_cte(days=30):
    return f"recent as (select * from inference_log where timestamp_utc > timestamp '{AS_OF}' - interval {days} day)"


@add(
    "P22_look_back",
    with_views("inference_log", body=f"""select match_id, predicted_outcome from inference_log where timestamp_utc > timestamp '{AS_OF}' - interval 720 hour"""),
)
def p22(spark, sf_dir):
    return monitor.look_back(views.inference_log(spark, sf_dir), AS_OF, hours=720).select("match_id", "predicted_outcome")


@add(
    "P24_uncertainty_band",
    with_views("inference_log", ctes=_recent_cte(), body=f"""select match_id, home_team, away_team, predicted_outcome, is_override_triggered,
 greatest({', '.join(_P.values())}) as max_prob, least({', '.join(_P.values())}) as min_prob from recent
 where match_segment='friendlies' and greatest({', '.join(_P.values())}) between 0.45 and 0.55"""),
)
def p24(spark, sf_dir):
    return monitor.uncertain_predictions(recent(spark, sf_dir), "friendlies").select(
        "match_id", "home_team", "away_team", "predicted_outcome", "is_override_triggered", "max_prob", "min_prob")


@add(
    "T5_most_uncertain",
    with_views("inference_log", ctes=_recent_cte(), body=f"""select match_id, greatest({', '.join(_P.values())}) as max_prob from recent
 where match_segment='qualifiers' and greatest({', '.join(_P.values())}) between 0.45 and 0.55 order by max_prob, timestamp_utc, match_id limit 20"""),
)
def t5(spark, sf_dir):
    return monitor.uncertain_predictions(recent(spark, sf_dir), "qualifiers").select("match_id", "max_prob").limit(20)


@add(
    "A18_inference_statistics",
    with_views("inference_log", ctes=_recent_cte(), body=f"""select count(*) as total_inferences, count(distinct home_team||'_'||away_team) as unique_matchups, count(distinct feature_source) as feature_sources_used,
 round(avg({_P['home_win']}),4) as avg_home_win_prob, round(avg({_P['away_win']}),4) as avg_away_win_prob, round(avg({_P['draw']}),4) as avg_draw_prob,
 count(requested_match_date) as historical_requests, count(*)-count(requested_match_date) as latest_requests,
 count(*) filter (predicted_outcome='home_win') as home_wins_predicted, count(*) filter (predicted_outcome='away_win') as away_wins_predicted, count(*) filter (predicted_outcome='draw') as draws_predicted,
 {_AGREE} as shadow_agreement_count, count(*) filter (shadow_predicted_outcome='draw') as shadow_draws_predicted, count(*) filter (shadow_is_override_triggered) as shadow_overrides_triggered,
 count(distinct tournament) as tournaments_predicted, {_stamp_sql('min(timestamp_utc)')} as earliest_request, {_stamp_sql('max(timestamp_utc)')} as latest_request from recent"""),
)
def a18(spark, sf_dir):
    out = monitor.inference_statistics(recent(spark, sf_dir))
    return out.withColumns({c: _stamp(F.col(c)) for c in ("earliest_request", "latest_request")})


@add(
    "A19_segment_shadow_performance",
    with_views("inference_log", ctes=_recent_cte(), body=f"""select match_segment, count(*) as segment_inferences, {_AGREE} as shadow_agreement_count,
 count(*) filter (shadow_predicted_outcome='draw') as shadow_draws_predicted, count(*) filter (shadow_is_override_triggered) as shadow_overrides_triggered
 from recent where match_segment is not null group by match_segment"""),
)
def a19(spark, sf_dir):
    return monitor.segment_shadow_performance(recent(spark, sf_dir))


@add(
    "A20_hourly_performance",
    with_views("inference_log", ctes=_recent_cte(), body=f"""select {_stamp_sql("date_trunc('hour', timestamp_utc)")} as hour, coalesce(match_segment,'none') as match_segment, count(*) as total_predictions,
 count(*) filter (is_override_triggered) as specialist_overrides, round(100.0::double*count(*) filter (is_override_triggered)/count(*),2) as override_rate_pct,
 count(*) filter (predicted_outcome='home_win') as home_wins, count(*) filter (predicted_outcome='draw') as draws, count(*) filter (predicted_outcome='away_win') as away_wins,
 round(avg({_P['home_win']}),6) as avg_home_win_prob, round(avg({_P['draw']}),6) as avg_draw_prob, round(avg({_P['away_win']}),6) as avg_away_win_prob from recent group by 1,2"""),
)
def a20(spark, sf_dir):
    out = monitor.hourly_performance(recent(spark, sf_dir))
    return out.withColumns({
        "hour": _stamp(F.col("hour")), "match_segment": F.coalesce("match_segment", F.lit("none")),
        **{c: r6(c) for c in ("avg_home_win_prob", "avg_draw_prob", "avg_away_win_prob")}})


@add(
    "A21_outcome_distribution",
    with_views("inference_log", ctes=_recent_cte(), body="""select coalesce(match_segment,'none') as match_segment, is_override_triggered, predicted_outcome, count(*) as count,
 round(100.0::double*count(*)/sum(count(*)) over (partition by match_segment, is_override_triggered),2) as pct from recent group by match_segment, is_override_triggered, predicted_outcome"""),
)
def a21(spark, sf_dir):
    return monitor.outcome_distribution(recent(spark, sf_dir)).withColumn("match_segment", F.coalesce("match_segment", F.lit("none")))


@add(
    "A22_shadow_matrix",
    with_views("inference_log", ctes=_recent_cte(2), body="""select predicted_outcome, shadow_predicted_outcome, count(*) as matches, round(100.0::double*count(*)/sum(count(*)) over (),2) as pct
 from recent where match_segment='qualifiers' and shadow_predicted_outcome is not null group by 1,2"""),
)
def a22(spark, sf_dir):
    return monitor.shadow_matrix(recent(spark, sf_dir, days=2), "qualifiers")


@add(
    "A23_model_version_summary",
    with_views("inference_log", ctes=_recent_cte(7), body=f"select model_version, round(avg({_P['home_win']}),6) as avg_win_prob, count(*) as prediction_count from recent group by 1"),
)
def a23(spark, sf_dir):
    return monitor.version_summary(recent(spark, sf_dir, days=7)).withColumn("avg_win_prob", r6("avg_win_prob"))


# ---- the same from hourly states --------------------------------------------


def _rolled(spark, sf_dir, days=30):
    """States of the whole log, appended in three runs of which one is repeated, then the window."""
    log, folder = views.inference_log(spark, sf_dir), shared_folder(spark)
    for run in (0, 1, 2, 1):
        rollups.append(log.filter(F.pmod("match_id", F.lit(3)) == run), folder, f"run-{run}")
    return rollups.window(spark, folder, AS_OF, 24 * days)


def _from_states(name, of, days, made, finish=lambda df: df):
    @add(name, QUERIES[of][1])
    def query(spark, sf_dir):
        return finish(made(*_rolled(spark, sf_dir, days)))


_from_states("A18_statistics_from_states", "A18_inference_statistics", 30, rollups.inference_statistics,
             lambda df: df.withColumns({c: _stamp(F.col(c)) for c in ("earliest_request", "latest_request")}))
_from_states("A19_shadow_from_states", "A19_segment_shadow_performance", 30, lambda s, _: rollups.segment_shadow_performance(s))
_from_states("A20_hours_from_states", "A20_hourly_performance", 30, lambda s, _: rollups.hourly_performance(s), lambda df: df.withColumns({
    "hour": _stamp(F.col("hour")), "match_segment": F.coalesce("match_segment", F.lit("none")),
    **{c: r6(c) for c in ("avg_home_win_prob", "avg_draw_prob", "avg_away_win_prob")}}))
_from_states("A21_outcomes_from_states", "A21_outcome_distribution", 30, lambda s, _: rollups.outcome_distribution(s),
             lambda df: df.withColumn("match_segment", F.coalesce("match_segment", F.lit("none"))))
_from_states("A22_matrix_from_states", "A22_shadow_matrix", 2, lambda s, _: rollups.shadow_matrix(s, "qualifiers"))
_from_states("A23_versions_from_states", "A23_model_version_summary", 7, lambda s, _: rollups.version_summary(s),
             lambda df: df.withColumn("avg_win_prob", r6("avg_win_prob")))


@add(
    "D13_override_usage",
    with_views("inference_log", body="""select coalesce(match_segment,'none') as match_segment, is_override_triggered, predicted_outcome, count(*) as prediction_count from inference_log group by 1,2,3"""),
)
def d13(spark, sf_dir):
    return monitor.override_usage(views.inference_log(spark, sf_dir)).withColumn(
        "match_segment", F.coalesce("match_segment", F.lit("none")))


@add(
    "W10_share_of_group",
    with_views("inference_log", body="""select predicted_outcome, model_version, count(*) as rows, round(100.0::double*count(*)/sum(count(*)) over (partition by model_version),2) as pct
 from inference_log group by 1,2"""),
)
def w10(spark, sf_dir):
    from formline.operators.metrics import class_distribution

    shares = class_distribution(views.inference_log(spark, sf_dir), "predicted_outcome", "model_version")
    return shares.select("predicted_outcome", "model_version", "rows", F.round("percent", 2).alias("pct"))


@add(
    "T3_recent_inferences",
    with_views("inference_log", body=f"select match_id, {_stamp_sql('timestamp_utc')} as timestamp_utc, predicted_outcome, class_probabilities_json from inference_log order by inference_log.timestamp_utc desc, match_id desc limit 50"),
)
def t3(spark, sf_dir):
    out = monitor.recent_inferences(views.inference_log(spark, sf_dir), 50)
    return out.select("match_id", _stamp(F.col("timestamp_utc")).alias("timestamp_utc"), "predicted_outcome", "class_probabilities_json")


@add(
    "F7_json_functions",
    with_views("inference_log", body=f"select match_id, {_P['draw']} as draw, round({_P['home_win']}+{_P['draw']}+{_P['away_win']},6) as total from inference_log"),
)
def f7(spark, sf_dir):
    parts = [monitor.json_number("class_probabilities_json", o) for o in _P]
    return views.inference_log(spark, sf_dir).select(
        "match_id", monitor.json_number("class_probabilities_json", "draw").alias("draw"),
        F.round(parts[0] + parts[1] + parts[2], 6).alias("total"))


# ---- freshness --------------------------------------------------------------


@add(
    "Q15_source_freshness",
    """select cast(cast(max(o_orderdate) as date) as varchar) as latest, cast(date '2002-01-01'-cast(max(o_orderdate) as date) as int) as age_days,
 case when date '2002-01-01'-cast(max(o_orderdate) as date)>30 then 'error' when date '2002-01-01'-cast(max(o_orderdate) as date)>7 then 'warn' else 'pass' end as status from orders""",
)
def q15(spark, sf_dir):
    orders = views.read_table(spark, sf_dir, "orders")
    return monitor.source_freshness(orders, "o_orderdate", "2002-01-01").withColumn("latest", day("latest"))


_LATEST_DAYS = """team_days as (select team, max(match_date) as d from (select home_team as team, match_date-cast(pool_id*7 as int) as match_date from matches union all select away_team, match_date-cast(pool_id*7 as int) from matches) group by 1),
aged as (select m.match_id, m.home_team, m.away_team, h.d as hd, a.d as ad, date '2024-02-12'-h.d as ha, date '2024-02-12'-a.d as aa from matches m join team_days h on h.team=m.home_team join team_days a on a.team=m.away_team)"""


@add(
    "Q16_feature_freshness",
    with_views("matches", ctes=_LATEST_DAYS, body="""select match_id, not (ha>30 or aa>30) as is_fresh,
 nullif(concat_ws(' | ', case when ha>30 then 'home_team: '||ha||' days old' end, case when aa>30 then 'away_team: '||aa||' days old' end),'') as warning from aged"""),
)
def q16(spark, sf_dir):
    m = views.matches(spark, sf_dir)
    moved = F.expr("date_sub(match_date, cast(pool_id * 7 as int))")
    rows = snapshots.team_snapshots(m.withColumns({"match_date": moved, "kickoff_ts": moved.cast("timestamp_ntz")}))
    days = snapshots.latest_overall(rows).select("team", F.col("snapshot_date").alias("d"))
    asked = m
    for side in ("home", "away"):
        asked = asked.join(days.select(F.col("team").alias(f"{side}_team"), F.col("d").alias(f"{side}_snapshot_date")), f"{side}_team")
    return monitor.feature_freshness(asked, "2024-02-12").select("match_id", "is_fresh", "warning")


# ---- contracts --------------------------------------------------------------

_BROKEN_SQL = """broken as (select match_id, case when match_id%23=0 then 'someday' else cast(match_date as varchar) end as match_date, home_team,
 case when match_id%31=0 then null else away_team end as away_team, case when match_id%37=0 then -1 else home_goals end as home_goals,
 case when match_id%41=0 then 'x' else cast(away_goals as varchar) end as away_goals, tournament,
 case when match_id%43=0 then 7 else cast(sign(home_goals-away_goals) as int) end as target_multiclass from matches)"""


def _broken(spark, sf_dir):
    m = views.matches(spark, sf_dir)
    i = F.col("match_id")
    return m.select(
        "match_id",
        F.when(i % 23 == 0, "someday").otherwise(F.col("match_date").cast("string")).alias("match_date"),
        "home_team",
        F.when(i % 31 != 0, F.col("away_team")).alias("away_team"),
        F.when(i % 37 == 0, -1).otherwise(F.col("home_goals")).alias("home_goals"),
        F.when(i % 41 == 0, "x").otherwise(F.col("away_goals").cast("string")).alias("away_goals"),
        "tournament",
        F.when(i % 43 == 0, 7).otherwise(F.signum((F.col("home_goals") - F.col("away_goals")).cast("double")).cast("int")).alias("target_multiclass"),
    )


def _report_sql(rows):
    return with_views("matches", ctes=_BROKEN_SQL, body=" union all ".join(
        f"select '{check}' as \"check\", '{column}' as column_name, {failing} as failing from broken" for check, column, failing in rows))


_NULLS = [("non_null", c, f"count(*)-count({c})") for c in ("match_date", "home_team", "away_team", "tournament")]
_REQUIRED = [("required_column", c, "cast(0*count(*) as bigint)") for c in ("match_date", "home_team", "away_team", "home_goals", "away_goals", "tournament")]
_RANGES = [("numeric_range", c, f"count(*) filter (try_cast({c} as double) is null or try_cast({c} as double)<0)") for c in ("home_goals", "away_goals")]
_DATES = [("parseable_date", "match_date", "count(*) filter (try_cast(match_date as timestamp) is null)")]
_EMPTY = [("non_empty", "*", "cast(case when count(*)=0 then 1 else 0 end as bigint)")]


@add("Q7_match_contract", _report_sql(_REQUIRED + _EMPTY + _NULLS + _DATES + _RANGES))
def q7(spark, sf_dir):
    return quality.check(_broken(spark, sf_dir), quality.STANDARD_MATCHES)


@add("Q7_checks_from_day_states", QUERIES["Q7_match_contract"][1])
def q7_days(spark, sf_dir):
    """States of a table without its last three days, then of those days alone, twice."""
    broken, folder = _broken(spark, sf_dir), shared_folder(spark)
    late = [r[0] for r in broken.select("match_date").filter("match_date is not null").distinct().orderBy(F.desc("match_date")).limit(3).collect()]
    before = broken.filter(~F.coalesce(F.col("match_date").isin(late), F.lit(False)))
    check_states.refresh(before, quality.STANDARD_MATCHES, "match_date", folder)
    for _ in range(2):
        check_states.refresh(broken, quality.STANDARD_MATCHES, "match_date", folder, late)
    return check_states.report(spark, folder)


for _name, _rows, _contract in (
    ("Q1_required_columns", [("required_column", "match_id", "cast(0*count(*) as bigint)"), ("required_column", "referee", "cast(1+0*count(*) as bigint)")],
     quality.Contract("q1", required=("match_id", "referee"))),
    ("Q3_non_null", _NULLS, quality.Contract("q3", required=(), non_null=("match_date", "home_team", "away_team", "tournament"))),
    ("Q4_parseable_dates", _DATES, quality.Contract("q4", required=(), dates=("match_date",))),
    ("Q5_numeric_minimum", _RANGES, quality.Contract("q5", required=(), minimum={"home_goals": 0, "away_goals": 0})),
):
    def _query(spark, sf_dir, contract=_contract):
        return quality.check(_broken(spark, sf_dir), contract).filter("check <> 'non_empty'")

    add(_name, _report_sql(_rows))(_query)


@add(
    "Q2_non_empty",
    with_views("matches", body="select 'non_empty' as \"check\", '*' as column_name, cast(case when count(*)=0 then 1 else 0 end as bigint) as failing from matches where tournament='No Such Cup'"),
)
def q2(spark, sf_dir):
    nothing = views.matches(spark, sf_dir).filter("tournament = 'No Such Cup'")
    return quality.check(nothing, quality.Contract("q2", required=()))


@add(
    "Q6_allowed_values",
    with_views("matches", ctes=_BROKEN_SQL, body="select target_multiclass as value, count(*) as rows from broken where target_multiclass not in (-1,0,1) group by 1"),
)
def q6(spark, sf_dir):
    return quality.offenders(_broken(spark, sf_dir), "target_multiclass", (-1, 0, 1))


@add(
    "Q8_contract_by_table",
    _report_sql(_REQUIRED + _EMPTY + _NULLS + _DATES + _RANGES),
)
def q8(spark, sf_dir):
    return quality.check(_broken(spark, sf_dir), quality.BY_TABLE["silver", "matches_cleaned"])


@add(
    "Q9_prediction_contract",
    with_views("inference_log", body=f"select match_id, round({_P['home_win']}+{_P['draw']}+{_P['away_win']}+case when match_id%10=0 then 0.5 else 0 end,6) as probability_sum from inference_log where match_id%10=0"),
)
def q9(spark, sf_dir):
    log = views.inference_log(spark, sf_dir)
    spoiled = F.when(F.col("match_id") % 10 == 0, F.replace("class_probabilities_json", F.lit("}"), F.lit(', "other": 0.5}')))
    log = log.withColumns({
        "class_probabilities_json": F.coalesce(spoiled, F.col("class_probabilities_json")),
        "predicted_class": F.when(F.col("predicted_outcome") == "home_win", 1).when(F.col("predicted_outcome") == "draw", 0).otherwise(-1),
        "neutral": F.col("match_id") % 4 == 0,
        "feature_snapshot_dates": F.create_map(F.lit("home"), F.to_date("timestamp_utc"), F.lit("away"), F.to_date("timestamp_utc")),
        "model_artifact_path": F.concat(F.lit("models/"), "model_version")})
    return quality.prediction_violations(log).select("match_id", r6("probability_sum").alias("probability_sum"))


@add(
    "Q10_schema_tests",
    with_views("matches", ctes=_BROKEN_SQL, body="""select 'non_null' as test, 'away_team' as column_name, count(*)-count(away_team) as failing from broken
 union all select 'allowed_values','target_multiclass', count(*) filter (target_multiclass not in (-1,0,1)) from broken
 union all select 'unique','home_team', count(*) from (select home_team from broken group by 1 having count(*)>1)
 union all select 'unique','match_id', count(*) from (select match_id from broken group by 1 having count(*)>1)"""),
)
def q10(spark, sf_dir):
    return quality.schema_tests(_broken(spark, sf_dir), not_null=("away_team",), unique=("home_team", "match_id"),
                                accepted={"target_multiclass": (-1, 0, 1)})


@add(
    "Q11_duplicate_keys",
    with_views("matches", body="select home_team as team, away_team as opponent, count(*) as row_count from matches group by 1,2 having count(*)>1"),
)
def q11(spark, sf_dir):
    m = views.matches(spark, sf_dir).select(F.col("home_team").alias("team"), F.col("away_team").alias("opponent"))
    return quality.duplicates(m, "team", "opponent")


@add(
    "Q12_single_run",
    with_views("matches", body="select count(distinct pool_id) as distinct_pipeline_runs from matches having count(distinct pool_id)>1"),
)
def q12(spark, sf_dir):
    runs = views.matches(spark, sf_dir).select(F.concat(F.lit("run-"), F.col("pool_id").cast("string")).alias("pipeline_run_id"))
    return quality.several_runs(runs)


# ---- training runs: one run per nation, metrics from the customers' balances ---

RUNS_SQL = """runs as (select 'run-'||lpad(cast(c_nationkey as varchar),2,'0') as pipeline_run_id, count(*) as training_rows, round(avg(c_acctbal)/5000,6) as accuracy,
 round(max(c_acctbal)/10000,6) as macro_f1, round(avg(c_acctbal)/6000,6) as weighted_f1, round(min(c_acctbal)/1000,6) as log_loss,
 case when c_nationkey%5=0 then null else timestamp '2024-01-01 00:00:00'+interval 1 hour*(c_nationkey*7%25) end as trained_at_utc,
 timestamp '2024-02-01 00:00:00' as persisted_at_utc from customer group by c_nationkey)"""


def runs(spark, sf_dir):
    c = views.read_table(spark, sf_dir, "customer")
    key = F.col("c_nationkey")
    grouped = c.groupBy(key).agg(
        F.count("*").alias("training_rows"), F.round(F.avg("c_acctbal") / 5000, 6).alias("accuracy"),
        F.round(F.max("c_acctbal") / 10000, 6).alias("macro_f1"), F.round(F.avg("c_acctbal") / 6000, 6).alias("weighted_f1"),
        F.round(F.min("c_acctbal") / 1000, 6).alias("log_loss"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    trained = start + F.make_dt_interval(hours=key * 7 % 25)
    return grouped.select(
        F.concat(F.lit("run-"), F.lpad(key.cast("string"), 2, "0")).alias("pipeline_run_id"),
        "training_rows", "accuracy", "macro_f1", "weighted_f1", "log_loss",
        F.when(key % 5 != 0, trained).alias("trained_at_utc"),
        F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("persisted_at_utc"))


_RUN_PICK = "pipeline_run_id, training_rows, accuracy, strftime(trained_at_utc, '%Y-%m-%dT%H:%M:%S') as trained_at_utc"


@add(
    "W3_latest_training_run",
    "with " + RUNS_SQL + f" select {_RUN_PICK} from runs order by runs.trained_at_utc desc nulls last, persisted_at_utc desc nulls last, pipeline_run_id desc limit 1",
)
def w3(spark, sf_dir):
    out = report.serialise_run(report.latest_run(runs(spark, sf_dir)))
    return out.select("pipeline_run_id", "training_rows", "accuracy", "trained_at_utc")


@add(
    "T4_latest_raw_run_nulls_last",
    "with " + RUNS_SQL + " select pipeline_run_id from runs order by trained_at_utc desc nulls last, pipeline_run_id desc limit 1",
)
def t4(spark, sf_dir):
    return report.latest_run(runs(spark, sf_dir)).select("pipeline_run_id")


@add(
    "P26_serialised_runs",
    "with " + RUNS_SQL + f" select {_RUN_PICK}, round(log_loss,6) as log_loss from runs",
)
def p26(spark, sf_dir):
    out = report.serialise_run(runs(spark, sf_dir))
    return out.select("pipeline_run_id", "training_rows", "accuracy", "trained_at_utc", r6("log_loss").alias("log_loss"))


@add(
    "P26_typed_runs",
    "with " + RUNS_SQL + """ select pipeline_run_id, cast(date '2024-01-01' + cast(training_rows as int) as varchar) as train_date_start, 2 as features, 'b' as second_feature,
 training_rows as draws from runs""",
)
def p26_typed(spark, sf_dir):
    raw = runs(spark, sf_dir).select(
        "pipeline_run_id", F.date_add(F.lit("2024-01-01").cast("date"), F.col("training_rows").cast("int")).cast("string").alias("train_date_start"),
        F.lit('["a", "b"]').alias("feature_columns_json"),
        F.concat(F.lit('{"0": '), F.col("training_rows").cast("string"), F.lit("}")).alias("class_distribution_train_json"))
    typed = report.typed_runs(raw)
    return typed.select("pipeline_run_id", day("train_date_start").alias("train_date_start"),
                        F.size("feature_columns_json").alias("features"), F.col("feature_columns_json")[1].alias("second_feature"),
                        F.col("class_distribution_train_json")["0"].alias("draws"))


@add(
    "Q13_metrics_in_range",
    "with " + RUNS_SQL + """ select pipeline_run_id, log_loss from runs where accuracy<0 or accuracy>1 or macro_f1<0 or macro_f1>1 or weighted_f1<0 or weighted_f1>1 or log_loss<0""",
)
def q13(spark, sf_dir):
    return quality.metrics_out_of_range(runs(spark, sf_dir)).select("pipeline_run_id", "log_loss")


@add(
    "J6_lineage_alignment",
    "with " + RUNS_SQL + ", served as (select distinct 'run-'||lpad(cast(s_nationkey*2 as varchar),2,'0') as pipeline_run_id from supplier) "
    "select pipeline_run_id from runs where pipeline_run_id not in (select pipeline_run_id from served)",
)
def j6(spark, sf_dir):
    return quality.unaligned_lineage(runs(spark, sf_dir), _served(spark, sf_dir, 0))


def _served(spark, sf_dir, shift):
    """Runs behind served rows: every supplier at its doubled nation number, so that some runs never served."""
    key = (F.col("s_nationkey") * 2 + shift).cast("string")
    return views.read_table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("run-"), F.lpad(key, 2, "0")).alias("pipeline_run_id"))


@add(
    "Q14_lineage_of_latest_run",
    "with " + RUNS_SQL + ", latest as (select pipeline_run_id from runs order by trained_at_utc desc nulls last, pipeline_run_id desc limit 1) "
    "select pipeline_run_id from latest where pipeline_run_id not in (select 'run-'||lpad(cast(s_nationkey*2+1 as varchar),2,'0') from supplier)",
)
def q14(spark, sf_dir):
    return quality.unaligned_lineage(report.latest_run(runs(spark, sf_dir)), _served(spark, sf_dir, 1))
