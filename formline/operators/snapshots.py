"""Team snapshots: long-form history, latest rows, as-of lookup, fixture features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.functions.names import fold_key
from formline.functions.tournaments import training_flags
from formline.operators import hotkeys

SIDE_VALUES = (
    "avg_goals_last5", "avg_goals_conceded_last5", "global_avg_goals_last5",
    "global_avg_conceded_last5", "win_rate_last5", "global_win_rate_last5", "draw_rate_last5",
    "avg_opponent_elo_last5", "weighted_win_rate_last5", "opponent_elo_form", "elo_form",
)
SHARED_VALUES = (
    "home_advantage_effect", "is_friendly", "is_world_cup", "is_qualifier", "is_continental",
    "pipeline_run_id", "persisted_at_utc",
)
OVERALL = "overall"


def team_snapshots(features: DataFrame) -> DataFrame:
    """Two rows per match (home and away perspective) from one scan.

    Columns the feature table does not have are left out.
    """
    present = set(features.columns)
    sides = []
    for own, other in (("home", "away"), ("away", "home")):
        fields = [
            F.col(f"{own}_team").alias("team"),
            F.col(f"{other}_team").alias("opponent"),
            F.lit(own).alias("team_role"),
        ]
        if "elo_home" in present:
            fields += [F.col(f"elo_{own}").alias("elo"), F.col(f"elo_{other}").alias("opponent_elo")]
        fields += [F.col(f"{own}_{v}").alias(v) for v in SIDE_VALUES if f"{own}_{v}" in present]
        sides.append(F.struct(*fields))
    shared = [c for c in SHARED_VALUES if c in present]
    long = features.select(
        F.col("match_date").alias("snapshot_date"), "match_id", "kickoff_ts", *shared,
        F.explode(F.array(*sides)).alias("_side"),
    )
    return long.select("snapshot_date", "match_id", "kickoff_ts", "_side.*", *shared)


def _recency(snapshots: DataFrame) -> Column:
    """Ordering struct; a NULL persist time is the oldest, ties end at the match id."""
    parts = [F.col("snapshot_date")]
    if "persisted_at_utc" in snapshots.columns:
        parts += [F.col("persisted_at_utc").isNotNull(), F.col("persisted_at_utc")]
    if "kickoff_ts" in snapshots.columns:
        parts.append(F.col("kickoff_ts"))
    return F.struct(*parts, F.col("match_id"))


def _latest(snapshots: DataFrame, *keys: str) -> DataFrame:
    """One row per key, combined map-side before the shuffle."""
    newest = F.max_by(F.struct(*snapshots.columns), _recency(snapshots)).alias("_row")
    return snapshots.groupBy(*keys).agg(newest).select("_row.*")


def latest_by_role(snapshots: DataFrame) -> DataFrame:
    return _latest(snapshots, "team", "team_role")


def latest_overall(snapshots: DataFrame) -> DataFrame:
    return _latest(snapshots, "team").withColumn("team_role", F.lit(OVERALL))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Latest row per team and role, and per team as `overall`, in one aggregation."""
    both = snapshots.withColumn("team_role", F.explode(F.array(F.col("team_role"), F.lit(OVERALL))))
    return _latest(both, "team", "team_role")


def on_or_before(snapshots: DataFrame, day) -> DataFrame:
    """History up to a day, inclusive. The filter reaches the scan."""
    return snapshots.filter(F.col("snapshot_date") <= F.lit(day).cast("date"))


def as_of(
    requests: DataFrame,
    snapshots: DataFrame,
    values: list[str],
    rows_per_slice: int = hotkeys.ROWS_PER_SLICE,
    counted: DataFrame | None = None,
) -> DataFrame:
    """For every request (any unique request_id, team, request_date): the latest snapshot with
    snapshot_date <= request_date, as one struct column per role and overall. Team
    names match without regard to case.

    Requests and snapshots are unioned and the last snapshot is carried forward
    inside each team, so each row is visited once; there is no range join. Teams
    with very many rows are cut into time slices that start from the last
    snapshot of the slices before.
    """
    roles = ("home", "away", OVERALL)
    packed = F.struct("snapshot_date", *values)
    history = snapshots.select(
        fold_key(F.col("team")).alias("team"), F.col("snapshot_date").alias("_day"), F.lit(0).alias("_ask"),
        F.col("kickoff_ts").alias("_ts"), F.col("match_id").alias("_id"),
        F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"),
        *[
            (packed if role == OVERALL else F.when(F.col("team_role") == role, packed)).alias(f"_{role}")
            for role in roles
        ],
    )
    asked = requests.select(
        fold_key(F.col("team")).alias("team"), F.col("request_date").alias("_day"), F.lit(1).alias("_ask"),
        F.lit(None).cast(snapshots.schema["kickoff_ts"].dataType).alias("_ts"),
        F.lit(None).cast("long").alias("_id"), "request_id",
        *[F.lit(None).cast(history.schema[f"_{role}"].dataType).alias(f"_{role}") for role in roles],
    )
    rows = history.unionByName(asked).withColumn("_time", F.col("_day").cast("timestamp_ntz"))
    days = (snapshots if counted is None else counted).select("team", F.col("snapshot_date").alias("_day"))
    days = days.unionByName(requests.select("team", F.col("request_date").alias("_day"))).select(
        fold_key(F.col("team")).alias("team"), F.col("_day").cast("timestamp_ntz").alias("_time")
    )
    slices = hotkeys.time_slices(days, "team", "_time", rows_per_slice)
    rows = hotkeys.assign_slices(rows, "team", "_time", slices)
    order = ("_day", "_ask", "_ts", "_id", "request_id")
    if slices is None:
        upto = Window.partitionBy("team").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        filled = rows.withColumns({f"_{r}": F.last(f"_{r}", ignorenulls=True).over(upto) for r in roles})
    else:
        filled = _carry_across_slices(rows, roles, order)
    found = filled.filter("_ask = 1")
    return found.select("request_id", "team", *[F.col(f"_{r}").alias(r) for r in roles])


def _carry_across_slices(rows: DataFrame, roles: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    part = ["team", hotkeys.SLICE]
    position = F.struct(*order)
    ends = rows.groupBy(*part).agg(
        *[F.max_by(f"_{r}", F.when(F.col(f"_{r}").isNotNull(), position)).alias(f"_{r}") for r in roles]
    )
    before = Window.partitionBy("team").orderBy(hotkeys.SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *part, *[F.last(f"_{r}", ignorenulls=True).over(before).alias(f"_before_{r}") for r in roles]
    )
    upto = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({f"_{r}": F.last(f"_{r}", ignorenulls=True).over(upto) for r in roles})
    joined = inside.join(carried, part, "left")
    return joined.withColumns({f"_{r}": F.coalesce(f"_{r}", f"_before_{r}") for r in roles})


def assemble(fixtures: DataFrame) -> DataFrame:
    """Model columns of fixtures that carry home_role, away_role, home_overall and
    away_overall snapshot structs. Missing role snapshots give NULLs."""
    elo_home, elo_away = F.col("home_overall.elo"), F.col("away_overall.elo")
    rate = {
        side: F.coalesce(f"{side}_role.win_rate_last5", f"{side}_overall.global_win_rate_last5")
        for side in ("home", "away")
    }
    columns: dict[str, Column] = {
        "elo_home": elo_home,
        "elo_away": elo_away,
        "elo_diff": elo_home - elo_away,
        "home_opponent_elo": elo_away,
        "away_opponent_elo": elo_home,
        "elo_ratio_home": elo_home / F.greatest(elo_away, F.lit(1e-6)),
        "combined_elo_strength": elo_home + elo_away,
        "home_advantage_effect": F.when(F.col("neutral"), 0.0).otherwise(rate["home"] - rate["away"]),
    }
    for side in ("home", "away"):
        for value in SIDE_VALUES:
            source = "overall" if value.startswith("global_") else "role"
            columns[f"{side}_{value}"] = F.col(f"{side}_{source}.{value}")
        columns[f"{side}_snapshot_date"] = F.col(f"{side}_overall.snapshot_date")
    columns.update(training_flags(F.col("tournament")))
    return fixtures.withColumns(columns).drop("home_role", "away_role", "home_overall", "away_overall")


SNAPSHOT_VALUES = ["elo", *SIDE_VALUES]


def _resolved() -> Column:
    """Both teams have an overall snapshot and are not the same team."""
    known = F.col("home_overall").isNotNull() & F.col("away_overall").isNotNull()
    differ = fold_key(F.col("home_team")) != fold_key(F.col("away_team"))
    return F.coalesce(known & differ, F.lit(False))


def fixture_features_latest(fixtures: DataFrame, latest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features, unresolved) from the latest-snapshot table (role and overall rows).

    Team names match without regard to case. A fixture whose team has no overall
    row is unresolved; a missing role row only leaves its columns NULL. The joins
    carry no hint: the measured size of the snapshot table picks the strategy.
    """
    table = latest.select(
        fold_key(F.col("team")).alias("_key"), "team_role", F.col("team").alias("_team"),
        F.struct("snapshot_date", *SNAPSHOT_VALUES).alias("_row"),
    )
    per_team = table.groupBy("_key").agg(
        F.first("_team").alias("_team"),
        *[
            F.first(F.when(F.col("team_role") == role, F.col("_row")), ignorenulls=True).alias(f"_{role}")
            for role in ("home", "away", OVERALL)
        ],
    )
    out = fixtures
    for side in ("home", "away"):
        dim = per_team.select(
            F.col("_key").alias(f"_{side}_key"),
            F.col("_team").alias(f"resolved_{side}_team"),
            F.col(f"_{side}").alias(f"{side}_role"),
            F.col(f"_{OVERALL}").alias(f"{side}_overall"),
        )
        out = out.join(dim, fold_key(F.col(f"{side}_team")) == F.col(f"_{side}_key"), "left").drop(f"_{side}_key")
    good = _resolved()
    return assemble(out.filter(good)), out.filter(~good).select(*fixtures.columns)


def fixture_features_as_of(
    fixtures: DataFrame,
    snapshots: DataFrame,
    fixture_id: str = "match_id",
    request_date: str = "match_date",
    rows_per_slice: int = hotkeys.ROWS_PER_SLICE,
    counted: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(features, unresolved) with every snapshot taken on or before the request date."""
    sides = [
        F.struct(
            F.col(f"{side}_team").alias("team"),
            F.struct(F.col(fixture_id).alias("fixture"), F.lit(side).alias("side")).alias("request_id"),
        )
        for side in ("home", "away")
    ]
    asks = fixtures.select(
        F.explode(F.array(*sides)).alias("a"), F.col(request_date).alias("request_date")
    ).select("a.*", "request_date")
    answers = as_of(asks, snapshots, ["team", *SNAPSHOT_VALUES], rows_per_slice, counted)
    home = F.col("request_id.side") == "home"
    row = F.struct("home", "away", OVERALL)
    per_fixture = answers.groupBy(F.col("request_id.fixture").alias(fixture_id)).agg(
        F.first(F.when(home, row), ignorenulls=True).alias("_h"),
        F.first(F.when(~home, row), ignorenulls=True).alias("_a"),
    )
    joined = fixtures.join(per_fixture, fixture_id, "left").withColumns(
        {
            "home_role": F.col("_h.home"), "home_overall": F.col(f"_h.{OVERALL}"),
            "away_role": F.col("_a.away"), "away_overall": F.col(f"_a.{OVERALL}"),
            "resolved_home_team": F.col(f"_h.{OVERALL}.team"),
            "resolved_away_team": F.col(f"_a.{OVERALL}.team"),
        }
    ).drop("_h", "_a")
    good = _resolved()
    return assemble(joined.filter(good)), joined.filter(~good).select(*fixtures.columns)
