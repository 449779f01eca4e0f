import pytest
from pyspark.sql import functions as F

from formline.operators import quality, snapshots


@pytest.fixture(scope="module")
def history(features):
    return snapshots.team_snapshots(features).persist()


def test_latest_is_unique_and_has_all_roles(history):
    latest = snapshots.latest_snapshots(history)
    assert quality.duplicates(latest, "team", "team_role").isEmpty()
    teams = history.select("team").distinct().count()
    assert latest.filter("team_role = 'overall'").count() == teams


def test_one_aggregation_equals_the_two_views(history):
    both = snapshots.latest_by_role(history).unionByName(snapshots.latest_overall(history))
    one = snapshots.latest_snapshots(history).select(*both.columns)
    assert both.exceptAll(one).isEmpty() and one.exceptAll(both).isEmpty()


def _requests(features):
    return features.select("match_id", "match_date", F.col("away_team").alias("home_team"),
                           F.col("home_team").alias("away_team"), "tournament", "neutral")


def test_as_of_the_last_day_equals_latest(features, history):
    end = features.agg(F.max("match_date")).first()[0]
    asked = _requests(features).withColumn("match_date", F.lit(end))
    now, none = snapshots.fixture_features_as_of(asked, history)
    latest, _ = snapshots.fixture_features_latest(asked, snapshots.latest_snapshots(history))
    columns = [c for c in now.columns if c in latest.columns]
    assert none.isEmpty()
    assert now.select(*columns).exceptAll(latest.select(*columns)).isEmpty()


@pytest.mark.parametrize("limit", [25, 120])
def test_sliced_as_of_equals_whole(features, history, limit):
    whole, _ = snapshots.fixture_features_as_of(_requests(features), history)
    sliced, _ = snapshots.fixture_features_as_of(_requests(features), history, rows_per_slice=limit)
    assert whole.count() == sliced.count()
    assert whole.exceptAll(sliced).isEmpty()


def test_as_of_never_looks_ahead(features, history):
    rows, _ = snapshots.fixture_features_as_of(_requests(features), history)
    late = rows.filter("home_snapshot_date > match_date or away_snapshot_date > match_date")
    assert late.isEmpty()


def test_unknown_and_identical_teams_are_unresolved(spark, history):
    team = history.first()["team"]
    asked = spark.createDataFrame(
        [(1, team.lower(), "Nowhere", "Friendly", False), (2, team, f" {team} ", "Friendly", False)],
        "match_id long, home_team string, away_team string, tournament string, neutral boolean",
    )
    good, bad = snapshots.fixture_features_latest(asked, snapshots.latest_snapshots(history))
    assert good.isEmpty() and bad.count() == 2


def test_neutral_ground_has_no_home_advantage(features, history):
    rows, _ = snapshots.fixture_features_latest(
        _requests(features).withColumn("neutral", F.lit(True)), snapshots.latest_snapshots(history)
    )
    assert rows.filter("home_advantage_effect <> 0").isEmpty()
