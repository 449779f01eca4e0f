"""Hourly states of the inference log that merge, so that look-backs read them and not the log.

The append job writes two small tables next to the log: additive states (counts, sums, first and last time) by hour and
outcome columns, and the distinct values of each hour. States of any number of appends add up; distinct values are counted
once over the hours of a window. A row exactly on the hour is kept apart (`on_hour`), because a window that starts there leaves it
out. A window that starts inside an hour takes that one hour from the log, bounded by its time filter.

A run id names an append: repeating it replaces its own states and changes nothing else.
Defined cases: an empty window gives zero counts and NULL means; missing probabilities do not count in means; NULL
matchups, sources and tournaments are no values, as in a distinct count.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline.operators import monitor

OUTCOMES = ("home_win", "draw", "away_win")
HOUR = ("hour", "on_hour")
BY = ("match_segment", "is_override_triggered", "predicted_outcome", "shadow_predicted_outcome",
      "shadow_is_override_triggered", "model_version")
ADDED = ("n", "dated", *[f"{what}_{o}" for o in OUTCOMES for what in ("sum", "known")])
DISTINCT = {"unique_matchups": ("home_team", "away_team"), "feature_sources_used": ("feature_source",),
            "tournaments_predicted": ("tournament",)}
TABLES = ("states", "values")


def _with_hour(log: DataFrame) -> DataFrame:
    kind = log.schema["timestamp_utc"].dataType
    hour = F.date_trunc("hour", "timestamp_utc").cast(kind)
    return log.withColumns({"hour": hour, "on_hour": hour == F.col("timestamp_utc")})


def hourly_states(log: DataFrame) -> DataFrame:
    p = {o: monitor.json_number("class_probabilities_json", o) for o in OUTCOMES}
    return _with_hour(log).groupBy(*HOUR, *BY).agg(
        F.count("*").alias("n"), F.count("requested_match_date").alias("dated"),
        *[f(p[o]).alias(f"{what}_{o}") for o in OUTCOMES for what, f in (("sum", F.sum), ("known", F.count))],
        F.min("timestamp_utc").alias("first_at"), F.max("timestamp_utc").alias("last_at"))


def hourly_values(log: DataFrame) -> DataFrame:
    """hour, on_hour, measure, value: one row for each distinct value."""
    pairs = [F.struct(F.lit(name).alias("measure"), F.concat(*_between(columns)).alias("value")) for name, columns in DISTINCT.items()]
    return _with_hour(log).select(*HOUR, F.inline(F.array(*pairs))).filter("value is not null").distinct()


def _between(columns: tuple[str, ...]) -> list[Column]:
    parts: list[Column] = []
    for column in columns:
        parts += [F.lit("_"), F.col(column)] if parts else [F.col(column)]
    return parts


def append(rows: DataFrame, folder: str, run_id: str) -> None:
    """States of newly logged rows, by day and run."""
    for name, made in zip(TABLES, (hourly_states(rows), hourly_values(rows))):
        (made.withColumns({"day": F.to_date("hour"), "run_id": F.lit(run_id)})
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "run_id").parquet(f"{folder}/{name}"))


def window(spark: SparkSession, folder: str, as_of: str, hours: int, log: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(states, values) of the entries later than `as_of` minus the hours. `log` is read only for a start inside an hour."""
    if not monitor.HOUR_LIMITS[0] <= hours <= monitor.HOUR_LIMITS[1]:
        raise ValueError(f"hours must be within {monitor.HOUR_LIMITS[0]}..{monitor.HOUR_LIMITS[1]}")
    start = datetime.fromisoformat(as_of) - timedelta(hours=hours)
    first = start.replace(minute=0, second=0, microsecond=0)
    if start != first and log is None:
        raise ValueError("a window that starts inside an hour needs the log for that hour")
    out = []
    for name, make in zip(TABLES, (hourly_states, hourly_values)):
        kept = spark.read.parquet(f"{folder}/{name}").filter(F.col("day") >= F.lit(first.date()))
        hour, kind = F.col("hour"), kept.schema["hour"].dataType

        def at(moment: datetime, kind=kind) -> Column:
            return F.lit(moment.isoformat(sep=" ")).cast(kind)

        if start == first:
            kept = kept.filter((hour > at(first)) | ((hour == at(first)) & ~F.col("on_hour")))
        else:
            late = F.col("timestamp_utc")
            edge = log.filter((late > at(start)) & (late < at(first + timedelta(hours=1))))
            kept = kept.filter(hour > at(first)).drop("day", "run_id").unionByName(make(edge))
        out.append(kept)
    return out[0], out[1]


def _count(condition: Column | None = None, of: str = "n") -> Column:
    value = F.col(of) if condition is None else F.when(condition, F.col(of))
    return F.coalesce(F.sum(value), F.lit(0))


def _mean(outcome: str) -> Column:
    return F.try_divide(F.sum(f"sum_{outcome}"), F.sum(f"known_{outcome}"))


def _agree() -> Column:
    return _count(F.col("predicted_outcome") == F.col("shadow_predicted_outcome"))


def _shadow_measures() -> list[Column]:
    return [_agree().alias("shadow_agreement_count"),
            _count(F.col("shadow_predicted_outcome") == "draw").alias("shadow_draws_predicted"),
            _count(F.col("shadow_is_override_triggered")).alias("shadow_overrides_triggered")]


def inference_statistics(states: DataFrame, values: DataFrame) -> DataFrame:
    outcome = F.col("predicted_outcome")
    sums = states.agg(
        _count().alias("total_inferences"), *[F.round(_mean(o), 4).alias(f"avg_{o}_prob") for o in OUTCOMES],
        _count(of="dated").alias("historical_requests"), (_count() - _count(of="dated")).alias("latest_requests"),
        _count(outcome == "home_win").alias("home_wins_predicted"), _count(outcome == "away_win").alias("away_wins_predicted"),
        _count(outcome == "draw").alias("draws_predicted"), *_shadow_measures(),
        F.min("first_at").alias("earliest_request"), F.max("last_at").alias("latest_request"))
    # Values first, then their number: both sides of the join are one row.
    each = values.groupBy("measure", "value").agg(F.lit(1).alias("seen"))
    counted = each.agg(*[F.count_if(F.col("measure") == name).alias(name) for name in DISTINCT])
    return sums.join(counted, F.lit(True))


def segment_shadow_performance(states: DataFrame) -> DataFrame:
    return states.filter("match_segment is not null").groupBy("match_segment").agg(
        _count().alias("segment_inferences"), *_shadow_measures()).orderBy(F.desc("segment_inferences"), "match_segment")


def hourly_performance(states: DataFrame) -> DataFrame:
    overrides, outcome = _count(F.col("is_override_triggered")), F.col("predicted_outcome")
    return states.groupBy("hour", "match_segment").agg(
        _count().alias("total_predictions"), overrides.alias("specialist_overrides"),
        F.round(100.0 * overrides / _count(), 2).alias("override_rate_pct"),
        _count(outcome == "home_win").alias("home_wins"), _count(outcome == "draw").alias("draws"),
        _count(outcome == "away_win").alias("away_wins"), *[_mean(o).alias(f"avg_{o}_prob") for o in OUTCOMES])


def outcome_distribution(states: DataFrame) -> DataFrame:
    group = Window.partitionBy("match_segment", "is_override_triggered")
    counts = states.groupBy("match_segment", "is_override_triggered", "predicted_outcome").agg(_count().alias("count"))
    return counts.withColumn("pct", F.round(100.0 * F.col("count") / F.sum("count").over(group), 2))


def shadow_matrix(states: DataFrame, segment: str | None = None) -> DataFrame:
    rows = states.filter("shadow_predicted_outcome is not null")
    if segment is not None:
        rows = rows.filter(F.col("match_segment") == segment)
    counts = rows.groupBy("predicted_outcome", "shadow_predicted_outcome").agg(_count().alias("matches"))
    return counts.withColumn("pct", F.round(100.0 * F.col("matches") / F.sum("matches").over(Window.partitionBy()), 2))


def version_summary(states: DataFrame) -> DataFrame:
    return states.groupBy("model_version").agg(_mean("home_win").alias("avg_win_prob"), _count().alias("prediction_count"))
