"""Form windows: literal cases, leakage, per-team independence, hot teams."""

import pytest
from pyspark.sql import functions as F

from formline.operators import form, hotkeys
from tests.conftest import by_id


def test_window_of_three_for_one_home_team(make_matches):
    goals = [1, 2, 3, 2, 1, 2]
    m = make_matches([(i, f"2020-01-{i + 1:02d}", "A", f"B{i}", g, 0) for i, g in enumerate(goals)])
    got = by_id(form.with_form(m, window=3), "home_avg_goals_last5")
    assert got[0] is None
    assert [got[i] for i in (1, 2, 3)] == [1.0, 1.5, 2.0]
    assert got[5] == pytest.approx(2.0)


def test_role_windows_do_not_mix_teams(make_matches):
    m = make_matches([
        (0, "2020-01-01", "A", "B", 5, 0), (1, "2020-01-02", "C", "D", 1, 1),
        (2, "2020-01-03", "A", "D", 0, 0), (3, "2020-01-04", "C", "B", 2, 2),
        (4, "2020-01-05", "B", "A", 3, 1), (5, "2020-01-06", "A", "C", 1, 1),
    ])
    wide = form.with_form(m)
    assert by_id(wide, "home_avg_goals_last5")[5] == 2.5
    assert by_id(wide, "home_draw_rate_last5")[5] == 0.5
    assert by_id(wide, "away_draw_rate_last5")[3] == 0.0
    assert by_id(wide, "home_global_avg_goals_last5")[5] == pytest.approx((5 + 0 + 1) / 3)
    assert by_id(wide, "away_global_avg_goals_last5")[5] == pytest.approx(1.5)


def test_only_draws_give_rate_one(make_matches):
    m = make_matches([(i, f"2020-01-{i + 1:02d}", "A", "B", 1, 1) for i in range(7)])
    assert by_id(form.with_form(m), "home_draw_rate_last5")[6] == 1.0


def test_a_result_changes_no_feature_of_its_own_or_earlier_matches(sample):
    cut = sample.agg(F.expr("percentile(match_id, 0.5)").cast("long")).first()[0]
    moment = sample.filter(F.col("match_id") == cut).first()["kickoff_ts"]
    late = F.col("kickoff_ts") >= F.lit(moment)
    changed = sample.withColumns({c: F.when(late, F.col(c) + 3).otherwise(F.col(c)) for c in ("home_goals",)})
    names = [f"{s}_{n}" for s in ("home", "away") for n in (*form.ROLE_FEATURES, *form.TEAM_FEATURES)]
    early = F.col("kickoff_ts") <= F.lit(moment)
    left, right = (form.with_form(d).filter(early).select("match_id", *names) for d in (sample, changed))
    assert left.exceptAll(right).isEmpty()


def test_other_teams_do_not_matter(sample):
    own = sample.filter("home_team = 'TEAM_1' or away_team = 'TEAM_1'")
    names = ["home_avg_goals_last5", "home_avg_goals_conceded_last5"]
    whole = form.with_form(sample).filter("home_team = 'TEAM_1'").select("match_id", *names)
    alone = form.with_form(own).filter("home_team = 'TEAM_1'").select("match_id", *names)
    assert whole.exceptAll(alone).isEmpty() and alone.exceptAll(whole).isEmpty()


@pytest.mark.parametrize("limit", [7, 30, 90])
def test_sliced_hot_teams_equal_whole_windows(features, sample, limit):
    rated = features.select(*sample.columns, "elo_home", "elo_away")
    plain, sliced = form.team_form(rated), form.team_form(rated, rows_per_slice=limit)
    names = ["match_id", "role", *[F.round(n, 9).alias(n) for n in form.feature_names(plain)]]
    assert hotkeys.has_hot_keys(form.team_rows(rated), "team", limit)
    left, right = plain.select(*names), sliced.select(*names)
    assert left.count() == right.count()
    assert left.exceptAll(right).isEmpty()


def test_slices_stay_near_the_limit(sample):
    rows = form.team_rows(sample)
    slices = hotkeys.time_slices(rows, "team", "kickoff_ts", 20)
    sizes = hotkeys.assign_slices(rows, "team", "kickoff_ts", slices).groupBy("team", hotkeys.SLICE).count()
    assert sizes.agg(F.max("count")).first()[0] <= 40


def test_pair_features(spark):
    row = form.with_pair_features(spark.createDataFrame([(1600.0, 0.0)], "elo_home double, elo_away double")).first()
    assert row["elo_diff"] == 1600.0 and row["combined_elo_strength"] == 1600.0
    assert row["elo_ratio_home"] == pytest.approx(1600.0 / 1e-6)
