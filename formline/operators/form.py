"""Form features: means over a team's previous matches, before the match itself.

All windows run over the team perspective (two rows per match). Role windows are
partitioned by team and role, which the exchange on team already satisfies, so
the whole feature set costs one exchange on team and one on match id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.functions import outcomes
from formline.operators import hotkeys

START_RATING = 1500.0

# output suffix -> (value expression name, scope)
ROLE_FEATURES = {
    "avg_goals_last5": "goals_for",
    "avg_goals_conceded_last5": "goals_against",
    "win_rate_last5": "points",
    "draw_rate_last5": "drawn",
}
TEAM_FEATURES = {
    "global_avg_goals_last5": "goals_for",
    "global_avg_conceded_last5": "goals_against",
    "global_win_rate_last5": "points",
}
RATED_FEATURES = {
    "avg_opponent_elo_last5": "opponent_elo",
    "weighted_win_rate_last5": "weighted_points",
    "elo_form": "elo",
}


def team_rows(matches: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Two rows per match, one per team, from a single scan."""
    rated = "elo_home" in matches.columns
    sides = []
    for role, own, other in (("home", "home", "away"), ("away", "away", "home")):
        fields = [
            F.lit(role).alias("role"),
            F.col(f"{own}_team").alias("team"),
            F.col(f"{other}_team").alias("opponent"),
            F.col(f"{own}_goals").alias("goals_for"),
            F.col(f"{other}_goals").alias("goals_against"),
        ]
        if rated:
            fields += [
                F.col(f"elo_{own}").alias("elo"),
                F.col(f"elo_{other}").alias("opponent_elo"),
            ]
        sides.append(F.struct(*fields))
    return matches.select(
        "match_id", "match_date", "kickoff_ts", *extra, F.explode(F.array(*sides)).alias("_side")
    ).select("match_id", "match_date", "kickoff_ts", *extra, "_side.*")


def with_role_results(rows: DataFrame) -> DataFrame:
    """Points, draw marker and, when ratings are present, opponent-weighted points."""
    goals = F.col("goals_for"), F.col("goals_against")
    out = rows.withColumns(
        {"points": outcomes.result_points(*goals), "drawn": outcomes.is_draw(*goals)}
    )
    if "opponent_elo" in rows.columns:
        out = out.withColumn("weighted_points", F.col("points") * F.col("opponent_elo") / START_RATING)
    return out


def team_form(
    matches: DataFrame,
    window: int = 5,
    include_current: bool = False,
    rows_per_slice: int = hotkeys.ROWS_PER_SLICE,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Team rows with all form columns, one row per match and role.

    `include_current` ends the frame at the current match instead of before it
    (for serving from the latest match). `counted` holds the same matches before
    expensive columns were added; rows per team are counted there.
    """
    rows = with_role_results(team_rows(matches))
    plain = team_rows(matches if counted is None else counted)
    slices = hotkeys.time_slices(plain, "team", "kickoff_ts", rows_per_slice)
    rows = hotkeys.assign_slices(rows, "team", "kickoff_ts", slices)
    rows = hotkeys.with_halo(
        rows, "team", [["team"], ["team", "role"]], ["kickoff_ts", "match_id"], window, slices
    )
    frame = (1 - window, 0) if include_current else (-window, -1)
    parts = ["team"] if slices is None else ["team", hotkeys.SLICE]
    by_team = Window.partitionBy(*parts).orderBy("kickoff_ts", "match_id").rowsBetween(*frame)
    by_role = Window.partitionBy(*parts, "role").orderBy("kickoff_ts", "match_id").rowsBetween(*frame)

    columns: dict[str, Column] = {}
    for name, value in TEAM_FEATURES.items():
        columns[name] = F.avg(value).over(by_team)
    role_features = dict(ROLE_FEATURES)
    if "opponent_elo" in rows.columns:
        role_features.update(RATED_FEATURES)
    for name, value in role_features.items():
        columns[name] = F.avg(value).over(by_role)
    return hotkeys.without_halo(rows.withColumns(columns))


def feature_names(form: DataFrame) -> list[str]:
    return [n for n in (*ROLE_FEATURES, *TEAM_FEATURES, *RATED_FEATURES) if n in form.columns]


def reattach(matches: DataFrame, form: DataFrame) -> DataFrame:
    """Team-perspective columns back on the match row as home_* and away_*."""
    # One value per match and role; max keeps the aggregate hash-based.
    flat = form.groupBy("match_id").agg(
        *[
            F.max(F.when(F.col("role") == side, F.col(n))).alias(f"{side}_{n}")
            for side in ("home", "away") for n in feature_names(form)
        ]
    )
    return matches.join(flat, "match_id", "left")


def with_form(
    matches: DataFrame,
    window: int = 5,
    rows_per_slice: int = hotkeys.ROWS_PER_SLICE,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Match rows with every form column and the home advantage effect."""
    form = team_form(matches, window, rows_per_slice=rows_per_slice, counted=counted)
    joined = reattach(matches, form)
    out = joined.withColumn(
        "home_advantage_effect", F.col("home_win_rate_last5") - F.col("away_win_rate_last5")
    )
    if "elo_home" in matches.columns:
        out = out.withColumns(
            {
                "home_opponent_elo_form": F.col("home_avg_opponent_elo_last5"),
                "away_opponent_elo_form": F.col("away_avg_opponent_elo_last5"),
            }
        )
    return out


def with_pair_features(rated: DataFrame) -> DataFrame:
    home, away = F.col("elo_home"), F.col("elo_away")
    return rated.withColumns(
        {
            "elo_diff": home - away,
            "home_opponent_elo": away,
            "away_opponent_elo": home,
            "elo_ratio_home": home / F.greatest(away, F.lit(1e-6)),
            "combined_elo_strength": home + away,
        }
    )
