"""Inference-log monitoring: look-back statistics, shares, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_LIMITS = (1, 720)
RECENT_LIMITS = (1, 500)


def json_number(column: str, field: str) -> Column:
    return F.get_json_object(column, f"$.{field}").cast("double")


def look_back(log: DataFrame, as_of: str, hours: int | None = None, days: int | None = None) -> DataFrame:
    """Entries later than `as_of` minus the period. `as_of` is an argument, so runs repeat."""
    if hours is not None and not HOUR_LIMITS[0] <= hours <= HOUR_LIMITS[1]:
        raise ValueError(f"hours must be within {HOUR_LIMITS[0]}..{HOUR_LIMITS[1]}")
    span = f"INTERVAL {hours} HOURS" if hours is not None else f"INTERVAL {days} DAYS"
    moment = F.lit(as_of).cast(log.schema["timestamp_utc"].dataType)
    return log.filter(F.col("timestamp_utc") > moment - F.expr(span))


def _agreement() -> Column:
    return F.count_if(
        F.col("shadow_predicted_outcome").isNotNull()
        & (F.col("predicted_outcome") == F.col("shadow_predicted_outcome"))
    )


def inference_statistics(log: DataFrame, approximate: bool = False) -> DataFrame:
    """One row of counts, distinct counts and mean probabilities."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    outcome = F.col("predicted_outcome")
    means = [
        F.round(F.avg(json_number("class_probabilities_json", o)), 4).alias(f"avg_{o}_prob")
        for o in ("home_win", "away_win", "draw")
    ]
    return log.agg(
        F.count("*").alias("total_inferences"),
        distinct(F.concat("home_team", F.lit("_"), "away_team")).alias("unique_matchups"),
        distinct(F.col("feature_source")).alias("feature_sources_used"),
        *means,
        F.count_if(F.col("requested_match_date").isNotNull()).alias("historical_requests"),
        F.count_if(F.col("requested_match_date").isNull()).alias("latest_requests"),
        F.count_if(outcome == "home_win").alias("home_wins_predicted"),
        F.count_if(outcome == "away_win").alias("away_wins_predicted"),
        F.count_if(outcome == "draw").alias("draws_predicted"),
        _agreement().alias("shadow_agreement_count"),
        F.count_if(F.col("shadow_predicted_outcome") == "draw").alias("shadow_draws_predicted"),
        F.count_if(F.col("shadow_is_override_triggered")).alias("shadow_overrides_triggered"),
        distinct(F.col("tournament")).alias("tournaments_predicted"),
        F.min("timestamp_utc").alias("earliest_request"),
        F.max("timestamp_utc").alias("latest_request"),
    )


def segment_shadow_performance(log: DataFrame) -> DataFrame:
    return (
        log.filter(F.col("match_segment").isNotNull())
        .groupBy("match_segment")
        .agg(
            F.count("*").alias("segment_inferences"),
            _agreement().alias("shadow_agreement_count"),
            F.count_if(F.col("shadow_predicted_outcome") == "draw").alias("shadow_draws_predicted"),
            F.count_if(F.col("shadow_is_override_triggered")).alias("shadow_overrides_triggered"),
        )
        .orderBy(F.desc("segment_inferences"), "match_segment")
    )


def performance_aggregates() -> list[Column]:
    """Aggregates of the hourly view, shared with its streaming form."""
    overrides = F.count_if(F.col("is_override_triggered"))
    outcome = F.col("predicted_outcome")
    return [
        F.count("*").alias("total_predictions"),
        overrides.alias("specialist_overrides"),
        F.round(100.0 * overrides / F.count("*"), 2).alias("override_rate_pct"),
        F.count_if(outcome == "home_win").alias("home_wins"),
        F.count_if(outcome == "draw").alias("draws"),
        F.count_if(outcome == "away_win").alias("away_wins"),
        F.avg(json_number("class_probabilities_json", "home_win")).alias("avg_home_win_prob"),
        F.avg(json_number("class_probabilities_json", "draw")).alias("avg_draw_prob"),
        F.avg(json_number("class_probabilities_json", "away_win")).alias("avg_away_win_prob"),
    ]


def hourly_performance(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_trunc("hour", "timestamp_utc").alias("hour"), "match_segment").agg(
        *performance_aggregates()
    )


def outcome_distribution(log: DataFrame) -> DataFrame:
    """Counts with their share of (segment, override); the window runs over the aggregate."""
    group = Window.partitionBy("match_segment", "is_override_triggered")
    counts = log.groupBy("match_segment", "is_override_triggered", "predicted_outcome").agg(
        F.count("*").alias("count")
    )
    return counts.withColumn("pct", F.round(100.0 * F.col("count") / F.sum("count").over(group), 2))


def shadow_matrix(log: DataFrame, segment: str | None = None) -> DataFrame:
    """Primary against shadow outcome with the share of all; at most nine rows."""
    rows = log.filter(F.col("shadow_predicted_outcome").isNotNull())
    if segment is not None:
        rows = rows.filter(F.col("match_segment") == segment)
    counts = rows.groupBy("predicted_outcome", "shadow_predicted_outcome").agg(F.count("*").alias("matches"))
    return counts.withColumn(
        "pct", F.round(100.0 * F.col("matches") / F.sum("matches").over(Window.partitionBy()), 2)
    )


def version_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("model_version").agg(
        F.avg(json_number("class_probabilities_json", "home_win")).alias("avg_win_prob"),
        F.count("*").alias("prediction_count"),
    )


def override_usage(log: DataFrame) -> DataFrame:
    """Counts per segment, override flag and outcome."""
    return log.groupBy("match_segment", "is_override_triggered", "predicted_outcome").agg(
        F.count("*").alias("prediction_count")
    )


def uncertain_predictions(
    log: DataFrame, segment: str, low: float = 0.45, high: float = 0.55
) -> DataFrame:
    """Entries of one segment whose top probability lies in the band, least sure first."""
    parts = [json_number("class_probabilities_json", o) for o in ("home_win", "draw", "away_win")]
    return (
        log.filter(F.col("match_segment") == segment)
        .withColumns({"max_prob": F.greatest(*parts), "min_prob": F.least(*parts)})
        .filter(F.col("max_prob").between(low, high))
        .orderBy("max_prob", "timestamp_utc", "match_id")
    )


def recent_inferences(log: DataFrame, limit: int = 50, tie: str = "match_id") -> DataFrame:
    if not RECENT_LIMITS[0] <= limit <= RECENT_LIMITS[1]:
        raise ValueError(f"limit must be within {RECENT_LIMITS[0]}..{RECENT_LIMITS[1]}")
    return log.orderBy(F.desc("timestamp_utc"), F.desc(tie)).limit(limit)


def source_freshness(
    table: DataFrame, loaded_at: str, as_of: str, warn_days: int = 7, error_days: int = 30
) -> DataFrame:
    """Latest load, its age and the verdict pass, warn or error (no rows is an error)."""
    newest = table.agg(F.max(loaded_at).alias("latest"))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("latest").cast("date"))
    status = (
        F.when(F.col("latest").isNull() | (age > error_days), "error")
        .when(age > warn_days, "warn")
        .otherwise("pass")
    )
    return newest.select("latest", age.alias("age_days"), status.alias("status"))


def feature_freshness(fixtures: DataFrame, as_of: str, max_age_days: int = 30) -> DataFrame:
    """Age of both snapshots, whether both are fresh, and the joined warning text."""
    today = F.lit(as_of).cast("date")
    ages = {side: F.datediff(today, F.col(f"{side}_snapshot_date").cast("date")) for side in ("home", "away")}
    notes = [
        F.when(age > max_age_days, F.concat(F.lit(f"{side}_team: "), age.cast("string"), F.lit(" days old")))
        for side, age in ages.items()
    ]
    text = F.concat_ws(" | ", *notes)
    return fixtures.withColumns(
        {
            "home_age_days": ages["home"],
            "away_age_days": ages["away"],
            "is_fresh": ~(F.coalesce(ages["home"] > max_age_days, F.lit(False)) | F.coalesce(ages["away"] > max_age_days, F.lit(False))),
            "warning": F.nullif(text, F.lit("")),
        }
    )
