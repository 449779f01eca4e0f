"""Serving: contract check, repeatable appends, failures to log."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from formline.operators import quality, rollups, snapshots
from formline.plans import models, scoring
from formline.plans.models import Candidate
from formline.sources import sinks

AT = datetime(2024, 1, 30, 12, 30, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def parts(features):
    asked = features.select("match_id", "match_date", "home_team", "away_team", "tournament", "neutral").limit(200)
    prior = models.fit(Candidate("prior", "dummy"), features, ["elo_diff"])
    return asked.persist(), snapshots.team_snapshots(features).persist(), prior


def test_a_repeated_run_changes_nothing(spark, parts, tmp_path):
    asked, history, prior = parts
    for run_id, rows in (("a", asked), ("b", asked.limit(50)), ("a", asked)):
        run = scoring.serve(rows, history, prior, prior, folder=str(tmp_path), artifact_path="m", at=AT, run_id=run_id)
        assert run.error is None and run.violations.isEmpty()
    log = sinks.read_log(spark, f"{tmp_path}/log")
    assert {r["run_id"]: r["count"] for r in log.groupBy("run_id").count().collect()} == {"a": 200, "b": 50}
    states, values = rollups.window(spark, f"{tmp_path}/rollups", "2024-01-31 00:00:00", 24)
    assert rollups.inference_statistics(states, values).first()["total_inferences"] == 250


def test_results_off_the_contract_are_not_logged(spark, parts, tmp_path):
    class Wrong(models.Fitted):
        def score(self, df):
            return models.Fitted.score(self, df).withColumn("p_draw", F.when(F.col("match_id") % 2 == 0, F.lit(0.9)).otherwise(F.col("p_draw")))

    asked, history, prior = parts
    wrong = Wrong(prior.candidate, prior.features, prior.parts, prior.constants)
    run = scoring.serve(asked, history, wrong, folder=str(tmp_path), artifact_path="m", at=AT, run_id="a")
    even = asked.filter("match_id % 2 = 0").count()
    assert run.violations.count() == even > 0
    assert run.scored.count() == 200
    assert sinks.read_log(spark, f"{tmp_path}/log").count() == 200 - even


def test_a_log_that_cannot_be_written_does_not_fail_the_run(parts, tmp_path):
    asked, history, prior = parts
    (tmp_path / "log").write_text("a file where the folder should be")
    run = scoring.serve(asked, history, prior, folder=str(tmp_path), artifact_path="m", at=AT, run_id="a")
    assert run.error and run.scored.count() == 200
    assert not (tmp_path / "rollups").exists()


def test_split_predictions(spark):
    rows = [("A", "B", 1, "home_win", False, "d", "s", "m", p) for p in
            ('{"home_win":0.5,"draw":0.3,"away_win":0.2}', '{"home_win":0.5}', "{}", None, "no json")]
    df = spark.createDataFrame(rows, "home_team string, away_team string, predicted_class int, predicted_outcome string, neutral boolean, "
                                     "feature_snapshot_dates string, feature_source string, model_artifact_path string, class_probabilities_json string")
    valid, broken = quality.split_predictions(df)
    assert valid.count() == 1 and broken.count() == 4
