"""Sources, sinks and streaming jobs: written from the sample tables, read back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from catalog.common import AS_OF, Registry, day, r6, with_views
from catalog.monitoring import RUNS_SQL, runs
from formline import views
from formline.operators import monitor, quality, ratings, report, standard
from formline.sources import readers, sinks
from formline.sources.folders import shared_folder
from formline.streaming import jobs

QUERIES = Registry()
add = QUERIES.add

FLAT_SQL = "select match_id, cast(match_date as varchar) as match_date, home_team, away_team, home_goals, away_goals, tournament from matches"


def _historical(spark, sf_dir):
    """Historical feed as text: some scores are NA."""
    m = views.matches(spark, sf_dir)
    return m.select(
        F.col("match_date").cast("string").alias("date"), "home_team", "away_team",
        F.when(F.col("match_id") % 10 == 0, "NA").otherwise(F.col("home_goals").cast("string")).alias("home_score"),
        F.col("away_goals").cast("string").alias("away_score"),
        "tournament", F.lit("Town").alias("city"), "country", F.upper(F.col("neutral").cast("string")).alias("neutral"),
    )


def _feed_summary(df):
    return df.groupBy("tournament").agg(
        F.count("*").alias("matches"), F.sum("home_goals").alias("home_goals"), F.sum("away_goals").alias("away_goals"),
        day(F.min("match_date")).alias("first_day"), day(F.max("match_date")).alias("last_day"))


_FEED_SUMMARY = """count(*) as matches, cast(sum(home_goals) as bigint) as home_goals, cast(sum(away_goals) as bigint) as away_goals,
 cast(min(match_date) as varchar) as first_day, cast(max(match_date) as varchar) as last_day"""


@add(
    "S1_historical_csv_scan",
    with_views("matches", body=f"select tournament, count(*) filter (neutral) as neutral_matches, {_FEED_SUMMARY} from matches where match_id%10<>0 group by tournament"),
)
def s1(spark, sf_dir):
    path = shared_folder(spark)
    _historical(spark, sf_dir).write.option("header", True).csv(path)
    rows = standard.standardize_historical(readers.read_historical(spark, path))
    neutral = rows.groupBy("tournament").agg(F.count_if("neutral").alias("neutral_matches"))
    return _feed_summary(rows).join(neutral, "tournament")


def _documents(spark, sf_dir):
    m = views.matches(spark, sf_dir)
    return m.select(
        F.col("match_id").alias("id"),
        F.concat(F.col("match_date").cast("string"), F.lit("T18:00:00Z")).alias("utcDate"),
        F.lit("FINISHED").alias("status"),
        F.struct(F.col("home_team").alias("name")).alias("homeTeam"),
        F.struct(F.col("away_team").alias("name")).alias("awayTeam"),
        F.struct(F.struct(F.col("home_goals").alias("home"), F.col("away_goals").alias("away")).alias("fullTime")).alias("score"),
        F.struct(F.lit("WC").alias("code"), F.when(F.col("match_id") % 7 != 0, F.col("tournament")).alias("name")).alias("competition"),
        F.struct(F.col("country").alias("name")).alias("area"),
    )


_DOCUMENTS_SQL = f"select case when match_id%7=0 then 'Unknown' else tournament end as tournament, {_FEED_SUMMARY} from matches group by 1"


@add("S2_api_snapshot_scan", with_views("matches", body=_DOCUMENTS_SQL))
def s2(spark, sf_dir):
    path = shared_folder(spark)
    packed = _documents(spark, sf_dir).select(F.array(F.struct("*")).alias("matches"))
    # One broken record per readable one: broken records contribute nothing.
    text = packed.select(F.explode(F.array(F.to_json(F.struct("matches")), F.lit('{"matches": [{]'))).alias("value"))
    text.write.text(path)
    return _feed_summary(readers.read_api_matches(spark, path, multi_line=False))


@add(
    "S3_document_standardiser",
    with_views("matches", body="""select cast(match_date as varchar) as match_date, home_team, away_team, home_goals, away_goals,
 case when match_id%7=0 then 'Unknown' else tournament end as tournament, 'Unknown' as city, country, false as neutral from matches"""),
)
def s3(spark, sf_dir):
    return standard.standardize_documents(_documents(spark, sf_dir)).withColumn("match_date", day("match_date"))


@add(
    "S4_feature_source_fallback",
    with_views("matches", body="select 'file' as feature_source, count(*) as rows, cast(sum(home_goals) as bigint) as home_goals from matches"),
)
def s4(spark, sf_dir):
    path = shared_folder(spark)
    views.matches(spark, sf_dir).write.parquet(path)
    rows, _ = readers.read_features(spark, path, table="gold.table_that_is_not_there", source="auto")
    return rows.groupBy("feature_source").agg(F.count("*").alias("rows"), F.sum("home_goals").alias("home_goals"))


@add(
    "S5_relation_scan",
    with_views("matches", body="select tournament, count(*) as matches from matches where home_goals>away_goals group by tournament"),
)
def s5(spark, sf_dir):
    views.matches(spark, sf_dir).createOrReplaceTempView("formline_relation")
    return readers.read_relation(
        spark, "select tournament, count(*) as matches from formline_relation where home_goals > away_goals group by tournament")


@add(
    "S7_report_scan",
    with_views("matches", body="select tournament as segment_value, count(*) as \"rows\" from matches group by tournament"),
)
def s7(spark, sf_dir):
    counts = views.matches(spark, sf_dir).groupBy(F.col("tournament").alias("segment_value")).agg(F.count("*").alias("rows"))
    payload = counts.agg(F.collect_list(F.struct("segment_value", "rows")).alias("competition_segments"))
    path = shared_folder(spark)
    sinks.write_report(payload, path)
    return readers.read_report(spark, path).select(F.explode("competition_segments").alias("s")).select("s.segment_value", "s.rows")


@add(
    "S9_latest_run_with_fallback",
    "with " + RUNS_SQL + """ select pipeline_run_id, training_rows, 'raw' as run_source from runs
 order by trained_at_utc desc nulls last, persisted_at_utc desc nulls last, pipeline_run_id desc limit 1""",
)
def s9(spark, sf_dir):
    runs(spark, sf_dir).createOrReplaceTempView("formline_raw_runs")
    row, _ = readers.read_latest_run(spark, "gold.curated_runs_that_are_not_there", "formline_raw_runs")
    return row.select("pipeline_run_id", "training_rows", "run_source")


@add(
    "K1_layer_sink",
    "select cast(year(o_orderdate) as int) as year, count(*) as rows from orders group by 1",
)
def k1(spark, sf_dir):
    orders = views.read_table(spark, sf_dir, "orders").withColumn("match_date", F.col("o_orderdate").cast("date"))
    path = shared_folder(spark)
    sinks.write_layer(orders, path)
    return spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("rows"))


def _table_query(name, schema_name, table_name):
    @add(
        name,
        with_views("matches", body=f"select tournament, 'run-7' as pipeline_run_id, {_FEED_SUMMARY} from matches group by tournament"),
    )
    def query(spark, sf_dir):
        rows = views.matches(spark, sf_dir).drop("kickoff_ts")
        written = sinks.persist_table(rows, schema_name, table_name, "replace", "run-7", location=shared_folder(spark))
        stored = spark.table(written)
        return _feed_summary(stored).withColumn("pipeline_run_id", F.lit(None).cast("string")).drop("pipeline_run_id").join(
            stored.groupBy("tournament").agg(F.max("pipeline_run_id").alias("pipeline_run_id")), "tournament")


_table_query("K2_table_sink_with_lineage", "formline_silver", "matches_cleaned")


@add(
    "S6_declared_source",
    with_views("matches", body="select count(*) as rows, count(distinct pool_id) as pools from matches"),
)
def s6(spark, sf_dir):
    rows = views.matches(spark, sf_dir).drop("kickoff_ts")
    sinks.persist_table(rows, "silver", "matches_cleaned", "replace", "run-6", location=shared_folder(spark))
    return readers.read_declared(spark, "silver.matches_cleaned").agg(
        F.count("*").alias("rows"), F.count_distinct("pool_id").alias("pools"))


@add("K3_raw_snapshot_sink", with_views("matches", body=_DOCUMENTS_SQL))
def k3(spark, sf_dir):
    path = sinks.write_snapshot(_documents(spark, sf_dir), shared_folder(spark))
    return _feed_summary(readers.read_api_matches(spark, path, multi_line=False))


@add(
    "K4_training_run_append",
    with_views("predictions", body="""select 'run-1' as pipeline_run_id, count(*) as training_rows, round(avg((actual=1)::int),6) as accuracy, '["elo_home", "elo_away"]' as feature_columns_json,
 '2024-01-01' as train_date_start, cast(max(match_date) as varchar) as train_date_end from predictions"""),
)
def k4(spark, sf_dir):
    from formline.operators.metrics import date_range

    p = views.predictions(spark, sf_dir)
    facts = date_range(p, "match_date").first()
    accuracy = p.agg(F.round(F.avg((F.col("actual") == 1).cast("double")), 6)).first()[0]
    summary = {
        "artifact_path": "model", "data_path": sf_dir, "training_rows": facts["rows"], "test_rows": 1, "feature_count": 2,
        "feature_columns": ["elo_home", "elo_away"],
        "train_date_range": {"start": str(facts["date_start"]), "end": str(facts["date_end"])},
        "metrics": {"accuracy": accuracy, "macro_f1": 0.5, "weighted_f1": 0.5, "log_loss": 1.0, "report": {"draw": 1}},
    }
    row = sinks.training_run_row(spark, summary, "run-1")
    quality.enforce(row, quality.TRAINING_RUNS)
    path = shared_folder(spark)
    row.write.mode("append").parquet(path)
    return spark.read.parquet(path).select(
        "pipeline_run_id", "training_rows", "accuracy", "feature_columns_json", "train_date_start", "train_date_end")


@add(
    "K5_inference_log_append",
    with_views("inference_log", body="""select match_segment, count(*) as rows, count(distinct home_team||'_'||away_team||'_1706659200.0') as requests, count(*) filter (is_override_triggered) as overrides
 from (select * replace (coalesce(match_segment,'none') as match_segment) from inference_log) group by 1"""),
)
def k5(spark, sf_dir):
    from datetime import datetime, timezone

    log = views.inference_log(spark, sf_dir)
    scored = log.withColumns({
        "neutral": F.lit(False), "predicted_class": F.lit(1), "home_snapshot_date": F.lit("2024-01-01"),
        "away_snapshot_date": F.lit("2024-01-02"), "shadow_class_probabilities_json": F.lit(None).cast("string"),
        "shadow_model_name": F.lit("shadow")})
    rows = sinks.log_rows(scored, "model", datetime(2024, 1, 31, tzinfo=timezone.utc))
    path = shared_folder(spark)
    error = sinks.append_log(rows, path)
    if error:
        raise RuntimeError(error)
    return sinks.read_log(spark, path).groupBy(F.coalesce("match_segment", F.lit("none")).alias("match_segment")).agg(
        F.count("*").alias("rows"), F.count_distinct("request_id").alias("requests"),
        F.count_if("is_override_triggered").alias("overrides"))


@add(
    "K6_metrics_json_sink",
    with_views("predictions", body="select actual, count(*) as rows from predictions group by actual"),
)
def k6(spark, sf_dir):
    path = shared_folder(spark)
    sinks.write_report(views.predictions(spark, sf_dir).groupBy("actual").agg(F.count("*").alias("rows")), path)
    return spark.read.schema("actual int, rows long").json(path)


@add(
    "K8_csv_table_loader",
    with_views("matches", body="select count(*) as loaded, count(*) as stored, cast(sum(home_goals) as bigint) as home_goals from matches"),
)
def k8(spark, sf_dir):
    path = shared_folder(spark)
    m = views.matches(spark, sf_dir).select("match_id", "home_team", "away_team", "home_goals", "away_goals")
    m.write.option("header", True).csv(path)
    schema = "match_id long, home_team string, away_team string, home_goals long, away_goals long"
    loaded = sinks.load_csv_table(spark, path, "formline_bronze", "csv_matches", schema, shared_folder(spark))
    return spark.table("formline_bronze.csv_matches").agg(
        F.lit(loaded).cast("long").alias("loaded"), F.count("*").alias("stored"), F.sum("home_goals").alias("home_goals"))


# ---- streaming ---------------------------------------------------------------


@add(
    "R1_streaming_ingest_dedup",
    with_views("matches", body="""select count(*) as matches, cast(sum(home_goals) as bigint) as home_goals from
 (select distinct match_date, home_team, away_team, home_goals, away_goals from matches)"""),
)
def r1(spark, sf_dir):
    """Every document lands twice."""
    folder = shared_folder(spark)
    documents = _documents(spark, sf_dir)
    packed = documents.unionByName(documents).select(F.array(F.struct("*")).alias("matches"))
    packed.write.json(f"{folder}/landed")
    jobs.run_ingest(spark, f"{folder}/landed", f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").agg(F.count("*").alias("matches"), F.sum("home_goals").alias("home_goals"))


@add(
    "R1_watermark_dedup",
    with_views("matches", body="""select count(*) as matches, cast(sum(home_goals) as bigint) as home_goals from
 (select distinct match_date, home_team, away_team, home_goals, away_goals from matches)"""),
)
def r1_watermark(spark, sf_dir):
    """The pure streaming form: state is kept inside the watermark only."""
    folder = shared_folder(spark)
    documents = _documents(spark, sf_dir)
    packed = documents.unionByName(documents).select(F.array(F.struct("*")).alias("matches"))
    packed.write.json(f"{folder}/landed")
    rows = jobs.dedup_matches(jobs.stream_match_documents(spark, f"{folder}/landed"), "60 days")
    jobs.run_to_parquet(rows, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").agg(F.count("*").alias("matches"), F.sum("home_goals").alias("home_goals"))


@add(
    "R2_streaming_hourly_performance",
    with_views("inference_log", body="""select strftime(h,'%Y-%m-%d %H') as hour, coalesce(match_segment,'none') as match_segment, count(*) as total_predictions,
 count(*) filter (is_override_triggered) as specialist_overrides, round(100.0::double*count(*) filter (is_override_triggered)/count(*),2) as override_rate_pct,
 count(*) filter (predicted_outcome='home_win') as home_wins, count(*) filter (predicted_outcome='draw') as draws, count(*) filter (predicted_outcome='away_win') as away_wins,
 """ + ", ".join(f"round(avg(cast(json_extract_string(class_probabilities_json,'$.{o}') as double)),6) as avg_{o}_prob" for o in ("home_win", "draw", "away_win")) + """
 from (select *, date_trunc('hour', timestamp_utc) as h,
  date_trunc('hour', max(timestamp_utc) over () - interval 2 hour) as closed from inference_log) where h < closed group by 1,2"""),
)
def r2(spark, sf_dir):
    """Hours that the final watermark has closed, equal to the batch view."""
    folder = shared_folder(spark)
    log = views.inference_log(spark, sf_dir).withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp"))
    log.write.parquet(f"{folder}/log")
    jobs.run_hourly(spark, f"{folder}/log", log.schema, f"{folder}/out", f"{folder}/checkpoint")
    out = spark.read.parquet(f"{folder}/out")
    return out.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), F.coalesce("match_segment", F.lit("none")).alias("match_segment"),
                      "total_predictions", "specialist_overrides", "override_rate_pct", "home_wins", "draws", "away_wins",
                      *[F.round(c, 6).alias(c) for c in ("avg_home_win_prob", "avg_draw_prob", "avg_away_win_prob")])


# Sparse pairs for period ratings: every customer pair meets along the order dates.
PAIRS_SQL = """pairs as (select o_orderkey as match_id, cast(o_orderdate as date) as match_date, 'C'||o_custkey as home_team, 'C'||(o_custkey+1) as away_team,
 cast(o_orderkey%3 as bigint) as home_goals, cast(1 as bigint) as away_goals, cast(year(o_orderdate) as int)-1995 as p from orders)"""


def pairs(spark, sf_dir):
    orders = views.read_table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").cast("date").alias("match_date"), F.col("o_orderdate").alias("kickoff_ts"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("home_team"),
        F.concat(F.lit("C"), (F.col("o_custkey") + 1).cast("string")).alias("away_team"),
        (F.col("o_orderkey") % 3).alias("home_goals"), F.lit(1).cast("long").alias("away_goals"))




def _period_sql(periods: int) -> str:
    """The period update unrolled, one pair of CTEs per period."""
    parts = [PAIRS_SQL, "s0 as (select ''::varchar as team, 1500.0::double as rating, date '1900-01-01' as last_day where false)"]
    for k in range(periods):
        rate = "case when {s}.last_day is not null and m.match_date>{s}.last_day then 1500+({s}.rating-1500)*pow(0.97,(m.match_date-{s}.last_day)/90.0) else coalesce({s}.rating,1500.0) end"
        parts.append(f"""m{k} as (select m.*, {rate.format(s='h')} as eh, {rate.format(s='a')} as ea from pairs m left join s{k} h on h.team=m.home_team left join s{k} a on a.team=m.away_team where m.p={k})""")
        parts.append(f"""g{k} as (select *, 20*(case when home_goals>away_goals then 1.0 when home_goals=away_goals then 0.5 else 0.0 end::double-1/(1+pow(10,(ea-eh)/400))) as gain from m{k})""")
        parts.append(f"""c{k} as (select team, sum(gain) as gain, max(d) as d from (select home_team as team, gain, match_date as d from g{k} union all select away_team, -gain, match_date from g{k}) group by team)""")
        parts.append(f"""s{k+1} as materialized (select coalesce(s.team,c.team) as team, case when c.team is null then s.rating else
 (case when s.last_day is not null and c.d>s.last_day then 1500+(s.rating-1500)*pow(0.97,(c.d-s.last_day)/90.0) else coalesce(s.rating,1500.0) end)+c.gain end as rating, coalesce(c.d,s.last_day) as last_day from s{k} s full join c{k} c on s.team=c.team)""")
    union = " union all ".join(f"select match_id, eh, ea from m{k}" for k in range(periods))
    return "with " + ",\n".join(parts) + f"\nselect match_id, round(eh,6) as elo_home, round(ea,6) as elo_away from ({union})"


@add("W5_period_ratings", _period_sql(7))
def w5_period(spark, sf_dir):
    m = pairs(spark, sf_dir)
    out = ratings.period_ratings(m, F.year("match_date").cast("string"))
    return out.select("match_id", r6("elo_home").alias("elo_home"), r6("elo_away").alias("elo_away"))


@add("R3_streaming_ratings", _period_sql(7))
def r3(spark, sf_dir):
    folder = shared_folder(spark)
    m = pairs(spark, sf_dir).withColumn("period", F.year("match_date"))
    m.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(m.schema).parquet(f"{folder}/in")
    job = jobs.RatingStream(spark, f"{folder}/ratings", period="period")
    job.run(stream, f"{folder}/checkpoint")
    return job.ratings().select("match_id", r6("elo_home").alias("elo_home"), r6("elo_away").alias("elo_away"))
