"""Match-shaped views over the star-schema sample tables.

The SQL runs unchanged in Spark and in DuckDB, so a query and its check start
from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MATCHES_SQL = """
select match_id, match_date, kickoff_ts, pool_id,
  concat('TEAM_', cast(pool_id*12+home_slot as string)) as home_team,
  concat('TEAM_', cast(pool_id*12+away_slot as string)) as away_team,
  home_goals, away_goals, tournament, neutral,
  concat('NATION_', cast((pool_id*12+home_slot)%25 as string)) as country
from (select event_id as match_id, cast(ts as date) as match_date, ts as kickoff_ts,
    user_id%8 as pool_id, cast(floor(user_id/8.0) as bigint)%12 as home_slot,
    (cast(floor(user_id/8.0) as bigint)%12+1+event_id%11)%12 as away_slot,
    cast(floor(value) as bigint)%5 as home_goals, cast(floor(value/5.0) as bigint)%4 as away_goals,
    case event_type when 'view' then 'Friendly' when 'click' then 'FIFA World Cup qualification'
      when 'purchase' then 'FIFA World Cup' when 'signup' then 'UEFA Euro' else 'COSAFA Cup' end as tournament,
    event_id%4=0 as neutral from {events}) e
"""

PREDICTIONS_SQL = """
select match_id, match_date, kickoff_ts, tournament, home_team, away_team, country,
  case when home_goals>away_goals then 1 when home_goals=away_goals then 0 else -1 end as actual,
  (1+(match_id*7)%13)/cast(gs as double) as g_away, (1+(match_id*5)%7)/cast(gs as double) as g_draw,
  (1+(match_id*3)%17)/cast(gs as double) as g_home,
  (1+(match_id*11)%5)/cast(ss as double) as s_away, (1+(match_id*13)%19)/cast(ss as double) as s_draw,
  (1+(match_id*17)%7)/cast(ss as double) as s_home
from (select *, 3+(match_id*7)%13+(match_id*5)%7+(match_id*3)%17 as gs,
             3+(match_id*11)%5+(match_id*13)%19+(match_id*17)%7 as ss from {matches}) m
"""

INFERENCE_LOG_SQL = """
select match_id, kickoff_ts as timestamp_utc, home_team, away_team, tournament,
  case when match_id%3=0 then cast(kickoff_ts as date) else null end as requested_match_date,
  case when g_home>=g_draw and g_home>=g_away then 'home_win' when g_draw>=g_away then 'draw' else 'away_win' end as predicted_outcome,
  case when match_id%5=0 then null when s_home>=s_draw and s_home>=s_away then 'home_win'
       when s_draw>=s_away then 'draw' else 'away_win' end as shadow_predicted_outcome,
  concat('{{"home_win": 0.', lpad(cast(cast(floor(g_home*1000) as bigint) as string),3,'0'),
    ', "draw": 0.', lpad(cast(cast(floor(g_draw*1000) as bigint) as string),3,'0'),
    ', "away_win": 0.', lpad(cast(cast(floor(g_away*1000) as bigint) as string),3,'0'), '}}') as class_probabilities_json,
  concat('v', cast(match_id%2+1 as string)) as model_version,
  case when match_id%7=0 then 'snapshot' else 'history' end as feature_source,
  match_segment,
  greatest(g_away, g_draw, g_home) < 0.45 and s_draw >= 0.5 as is_override_triggered,
  match_id%5<>0 and greatest(g_away, g_draw, g_home) < 0.45 and s_draw >= 0.5 as shadow_is_override_triggered
from (select *, case tournament when 'FIFA World Cup' then 'worldcup' when 'Friendly' then 'friendlies'
    when 'FIFA World Cup qualification' then 'qualifiers' when 'UEFA Euro' then 'continental' else null end as match_segment
  from {predictions}) p
"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MATCHES_SQL, events=read_table(spark, sf_dir, "events"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PREDICTIONS_SQL, matches=matches(spark, sf_dir))


def inference_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(INFERENCE_LOG_SQL, predictions=predictions(spark, sf_dir))


def duckdb_cte(*names: str) -> str:
    """`with ...` text that defines the views for DuckDB, dependencies first."""
    texts = {
        "matches": MATCHES_SQL.format(events="events"),
        "predictions": PREDICTIONS_SQL.format(matches="matches"),
        "inference_log": INFERENCE_LOG_SQL.format(predictions="predictions"),
    }
    needs = {"matches": ["matches"], "predictions": ["matches", "predictions"],
             "inference_log": ["matches", "predictions", "inference_log"]}
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in needs[name] if n not in wanted]
    return ",\n".join(f"{name} as ({texts[name]})" for name in wanted)
