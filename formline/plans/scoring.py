"""Batch scoring of fixtures with a primary and a shadow model."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.functions import outcomes
from formline.operators import dims, ordered, quality, rollups, snapshots, standard
from formline.plans.models import ROW, Calibrator, Fitted
from formline.sources import sinks
from formline.sources.folders import stored

LABELLED = tuple(zip(("away_win", "draw", "home_win"), ROW))


def edition_slice(matches: DataFrame, tournament: str, year: int, fallback_rows: int = 64) -> DataFrame:
    """Matches of one tournament edition, or the last rows when there are none."""
    edition = matches.filter((F.col("tournament") == tournament) & (F.year("match_date") == year))
    if not edition.limit(1).isEmpty():
        return edition
    return matches.orderBy(F.desc("match_date"), F.desc("kickoff_ts"), F.desc("match_id")).limit(fallback_rows)


def probabilities_json():
    return F.to_json(F.struct(*[F.col(p).alias(label) for label, p in LABELLED]))


def score_fixtures(
    fixtures: DataFrame,
    primary: Fitted,
    shadow: Fitted | None = None,
    calibrator: Calibrator | None = None,
    swap: bool = False,
) -> DataFrame:
    """Outcome, probabilities, segment and the shadow's view of feature rows.

    `swap` lets the shadow model lead and the primary follow.
    """
    if swap and shadow is not None:
        primary, shadow, calibrator = shadow, primary, None
    rows = fixtures if "match_segment" in fixtures.columns else standard.with_segment(fixtures)
    out = primary.score(rows)
    if calibrator is not None:
        out = calibrator.apply(out)
    if "is_override" not in out.columns:
        out = out.withColumn("is_override", F.lit(False))
    out = out.withColumns(
        {
            "predicted_class": F.col("predicted"),
            "predicted_outcome": outcomes.outcome_label(F.col("predicted")),
            "class_probabilities_json": probabilities_json(),
            "is_override_triggered": F.col("is_override"),
        }
    ).drop(*ROW, "predicted", "is_override")
    if shadow is None:
        return out.withColumns(
            {
                "shadow_predicted_outcome": F.lit(None).cast("string"),
                "shadow_class_probabilities_json": F.lit(None).cast("string"),
                "shadow_is_override_triggered": F.lit(None).cast("boolean"),
                "shadow_model_name": F.lit(None).cast("string"),
            }
        )
    second = shadow.score(out)
    if "is_override" not in second.columns:
        second = second.withColumn("is_override", F.lit(False))
    return second.withColumns(
        {
            "shadow_predicted_outcome": outcomes.outcome_label(F.col("predicted")),
            "shadow_class_probabilities_json": probabilities_json(),
            "shadow_is_override_triggered": F.col("is_override"),
            "shadow_model_name": F.lit(shadow.candidate.name),
        }
    ).drop(*ROW, "predicted", "is_override")


def score_requests(
    requests: DataFrame,
    snapshot_history: DataFrame,
    primary: Fitted,
    shadow: Fitted | None = None,
    calibrator: Calibrator | None = None,
    as_of_request: bool = False,
    swap: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(scored, rejected) for raw fixture requests: aliases, team check, features, models."""
    named = dims.resolve_alias(dims.resolve_alias(requests, "home_team"), "away_team")
    accepted, rejected = standard.split_distinct_teams(named)
    if as_of_request:
        rows, missing = snapshots.fixture_features_as_of(accepted, snapshot_history)
        source = "snapshots_as_of"
    else:
        latest = snapshots.latest_snapshots(snapshot_history)
        rows, missing = snapshots.fixture_features_latest(accepted, latest)
        source = "latest_snapshots"
    scored = score_fixtures(rows, primary, shadow, calibrator, swap).withColumn("feature_source", F.lit(source))
    return scored, rejected.unionByName(missing.select(*rejected.columns))


@dataclass
class Served:
    """What a scoring run leaves behind; `error` is a failure to log, which does not fail the run."""

    scored: DataFrame
    rejected: DataFrame
    violations: DataFrame
    error: str | None


def serve(
    requests: DataFrame,
    snapshot_history: DataFrame,
    primary: Fitted,
    shadow: Fitted | None = None,
    calibrator: Calibrator | None = None,
    *,
    folder: str,
    artifact_path: str,
    at: datetime,
    run_id: str,
    model_version: str | None = None,
    as_of_request: bool = False,
    swap: bool = False,
) -> Served:
    """Scores requests, checks every result against the contract, and logs the valid ones with their hourly states.

    Results are written once, so that the answer, the check and the log see the same rows. The log is
    folder/log, the states are folder/rollups; the same `run_id` again replaces its own rows in both.
    """
    scored, rejected = score_requests(requests, snapshot_history, primary, shadow, calibrator, as_of_request, swap)
    dates = F.struct(*[F.col(f"{side}_snapshot_date").cast("string").alias(f"{side}_team") for side in ("home", "away")])
    results = stored(scored.withColumns({"feature_snapshot_dates": dates, "model_artifact_path": F.lit(artifact_path)}))
    valid, violations = quality.split_predictions(results)
    rows = sinks.log_rows(valid, artifact_path, at, model_version, "match_date" if as_of_request else None)
    error = sinks.append_log(rows, f"{folder}/log", run_id)
    if error is None:
        rollups.append(rows, f"{folder}/rollups", run_id)
    return Served(results, rejected, violations, error)


def forecast(
    fixtures: DataFrame,
    snapshot_history: DataFrame,
    model: Fitted,
    training: DataFrame,
) -> DataFrame:
    """Hypothetical fixtures: latest snapshots, medians for what is still missing, scores."""
    rows, _ = snapshots.fixture_features_latest(fixtures, snapshots.latest_snapshots(snapshot_history))
    columns = [c for c in model.features if c in training.columns and c in rows.columns]
    numeric = [c for c in columns if rows.schema[c].dataType.typeName() in ("double", "float")]
    medians = ordered.exact_quantiles(training, numeric, [0.5])
    return model.score(rows.fillna({c: v[0] for c, v in medians.items() if v[0] is not None}))


def strongest_pairs(latest: DataFrame, teams: int = 16) -> DataFrame:
    """Highest-rated teams paired by rank: first against second, third against fourth."""
    top = latest.filter(F.col("team_role") == snapshots.OVERALL).orderBy(F.desc("elo"), "team").limit(teams)
    from pyspark.sql import Window

    ranked = top.select("team", "elo", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("elo"), "team")) - 1).alias("r"))
    return ranked.groupBy(F.floor(F.col("r") / 2).alias("pair")).agg(
        F.max(F.when(F.col("r") % 2 == 0, F.col("team"))).alias("home_team"),
        F.max(F.when(F.col("r") % 2 == 1, F.col("team"))).alias("away_team"),
    )
