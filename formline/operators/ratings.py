"""Sequential pair ratings with inactivity decay.

Every match moves the ratings of two teams, so matches of teams that are
connected through opponents form one chain in time. Two modes:

* exact: matches are folded in order inside each pool (teams never meet across
  pools). Pools run in parallel. A pool with more rows than `rows_per_step` is cut
  into consecutive steps, so that no task ever reads more than one step of one
  pool, a batch at a time; the ratings between steps are written to the checkpoint folder. Without
  pool columns and with a connected graph above that size, steps follow dependency
  levels: matches of one level share no team, so a level above `rows_per_step` rows is one
  joined update spread over all tasks, and shorter levels run together in one fold.
* period: all matches of a period start from the ratings at the start of the
  period; one join and one grouped sum per period, spread over all teams. Equal
  to exact when no team plays twice in a period.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.operators.components import components
from formline.operators.ordered import Ranked
from formline.sources.folders import shared_folder, stored

# Fixed values of the rating scheme.
START_RATING = 1500.0
K_FACTOR = 20.0
SCALE = 400.0
DECAY_RATE = 0.97
DECAY_DAYS = 90.0

ROWS_PER_STEP = 1_000_000


def expected_score(own: Column, other: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - own) / SCALE))


def decayed(rating: Column, idle_days: Column) -> Column:
    """Drift towards the start rating; unchanged for a first or same-day match."""
    moved = START_RATING + (rating - START_RATING) * F.pow(F.lit(DECAY_RATE), idle_days / DECAY_DAYS)
    return F.when(idle_days > 0, moved).otherwise(rating)


_STATE = "team string, rating double, last_day int"
_OUT = "kind string, pool string, match_id long, team string, elo_home double, elo_away double, rating double, last_day int"
_SCHEMA = pa.schema([
    ("kind", pa.string()), ("pool", pa.string()), ("match_id", pa.int64()), ("team", pa.string()), ("elo_home", pa.float64()),
    ("elo_away", pa.float64()), ("rating", pa.float64()), ("last_day", pa.int32())])


def _fold(decay: bool):
    """Rows of whole pools, in order, a batch at a time; of each pool only the ratings of its teams are held.

    Rows that are not `played` give a team's rating and last day. Each match returns with the ratings before it, and each pool
    ends with its teams' ratings.
    """

    def ended(pool: str | None, state: dict) -> pa.RecordBatch:
        n = len(state)
        values = list(state.values())
        columns = [["team"] * n, [pool] * n, [None] * n, list(state), [None] * n, [None] * n, [v[0] for v in values], [v[1] for v in values]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, {}
        for batch in batches:
            out = [[] for _ in range(4)]
            names = "pool", "played", "match_id", "home_team", "away_team", "day", "points"
            for pool, played, match, h, a, day, points in zip(*[batch.column(name).to_pylist() for name in names]):
                if pool != at:
                    if state:
                        yield ended(at, state)
                    at, state = pool, {}
                day = -1 if day is None else day
                if not played:
                    state[h] = points, day
                    continue
                pair = []
                for team in (h, a):
                    r, last = state.get(team, (START_RATING, -1))
                    if decay and last >= 0 and day > last:
                        r = START_RATING + (r - START_RATING) * DECAY_RATE ** ((day - last) / DECAY_DAYS)
                    pair.append(r)
                rh, ra = pair
                gain = K_FACTOR * (points - 1 / (1 + 10 ** ((ra - rh) / SCALE)))
                state[h] = rh + gain, day
                state[a] = ra - gain, day
                for values, value in zip(out, (pool, match, rh, ra)):
                    values.append(value)
            pools, matches, home, away = out
            n = len(matches)
            columns = [["match"] * n, pools, matches, [None] * n, home, away, [None] * n, [None] * n]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)
        if state:
            yield ended(at, state)

    return run


def _folded(rows: DataFrame, state: DataFrame | None, decay: bool) -> DataFrame:
    """Prepared rows with `pool` through the fold, after the ratings of the pool's teams if `state` is given. Pools without a
    match keep their ratings."""
    values = "match_id", "home_team", "away_team", "day", "points"
    both = rows.select("pool", F.lit(True).alias("played"), "kickoff_ts", *values)
    if state is not None:
        types = {f.name: f.dataType for f in both.schema}
        nothing = {name: F.lit(None).cast(types[name]) for name in ("kickoff_ts", "match_id", "away_team")}
        both = both.union(state.select(
            "pool", F.lit(False), nothing["kickoff_ts"], nothing["match_id"], "team", nothing["away_team"], "last_day", "rating"))
    # The sort spills; Python sees batches.
    order = F.col("pool"), F.col("played"), F.col("kickoff_ts").asc_nulls_last(), F.col("match_id").asc_nulls_last()
    return both.repartition("pool").sortWithinPartitions(*order).select("pool", "played", *values).mapInArrow(_fold(decay), _OUT)


def _prepared(matches: DataFrame, pool: list[str], *more: Column) -> DataFrame:
    """Scored matches with a text key of the pool columns; unscored ones move no rating."""
    key = F.to_json(F.array(*[F.col(c).cast("string") for c in pool]))
    points = (
        F.when(F.col("home_goals") > F.col("away_goals"), 1.0)
        .when(F.col("home_goals") < F.col("away_goals"), 0.0)
        .otherwise(0.5)
    )
    scored = matches.filter(F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull())
    return scored.select(
        key.alias("pool"), "match_id", "kickoff_ts", "home_team", "away_team",
        F.unix_date("match_date").alias("day"), points.alias("points"), *more,
    )


def with_components(rows: DataFrame) -> DataFrame:
    """Replaces `pool` by the component of the team graph: teams connected through opponents.

    Ratings of different components never meet, so they can be folded side by side.
    """
    pairs = rows.select(
        F.least("home_team", "away_team").alias("a"), F.greatest("home_team", "away_team").alias("b")).distinct()
    teams = components(pairs).select(F.col("node").alias("home_team"), F.col("root").alias("pool"))
    return rows.drop("pool").join(teams, "home_team")


def _steps(rows: DataFrame, rows_per_step: int) -> tuple[DataFrame, int]:
    """Adds the step number of each row and returns the number of steps.

    A step is `rows_per_step` consecutive rows of a pool by (kickoff_ts, match_id), so it may end
    inside an instant.
    """
    biggest = rows.groupBy("pool").count().agg(F.max("count")).first()[0] or 0
    if biggest <= rows_per_step:
        return rows, 1
    placed = Ranked(rows, ["pool", "kickoff_ts", "match_id"]).positions("_position")
    starts = placed.groupBy("pool").agg(F.min("_position").alias("_first"))
    step = F.floor((F.col("_position") - F.col("_first")) / rows_per_step).cast("int")
    return placed.join(starts, "pool").withColumn("step", step).drop("_position", "_first"), -(-biggest // rows_per_step)


def _day_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Level of every row of whole days, in order; of each day only the level of its teams is held."""
    at, reached = None, {}
    for batch in batches:
        levels = []
        for day, home, away in zip(*[batch.column(name).to_pylist() for name in ("day", "home_team", "away_team")]):
            if day != at:
                at, reached = day, {}
            level = 1 + max(reached.get(home, 0), reached.get(away, 0))
            reached[home] = reached[away] = level
            levels.append(level)
        yield batch.append_column("level", pa.array(levels, pa.int32()))


def dependency_levels(rows: DataFrame) -> DataFrame:
    """Adds `level`: 1 for a match whose teams have no earlier match that day, else one more than the higher level of
    either team's match before it. Matches of one (day, level) share no team, and (day, level) order keeps
    every team's matches in time order.

    The days are independent keys, dealt over the tasks, and each is read once in order.
    """
    rows = rows.filter("match_id is not null")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = rows.repartition("day").sortWithinPartitions("day", F.col("kickoff_ts").asc_nulls_last(), "match_id")
    return placed.mapInArrow(_day_levels, f"{columns}, level int")


def _level_steps(levelled: DataFrame, rows_per_step: int, rows_per_fold: int) -> tuple[DataFrame, list[bool]]:
    """(day, level, step) of every level, and for each step whether it is one level above `rows_per_step`. The levels between
    two such run together, cut where `rows_per_fold` rows are reached."""
    spark = levelled.sparkSession
    wide = F.col("count") > rows_per_step
    sizes = levelled.filter("day is not null").groupBy("day", "level").count().select(
        "day", "level", wide.alias("wide"), F.when(wide, 0).otherwise(F.col("count")).alias("narrow"))
    sums = F.sum("narrow"), F.sum(F.col("wide").cast("long"))
    # One row for each day reaches the driver.
    days = sorted(sizes.groupBy("day").agg(*[f.alias(n) for f, n in zip(sums, ("rows", "wides"))]).collect())
    starts, rows, wides = [], 0, 0
    for day in days:
        starts.append((day["day"], rows, wides))
        rows, wides = rows + day["rows"], wides + day["wides"]
    offsets = spark.createDataFrame(starts, "day int, _rows long, _wides long")
    before = Window.partitionBy("day").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    narrow, wide_ones = (F.coalesce(f.over(before), F.lit(0)) for f in sums)
    placed = sizes.withColumns({"_narrow": narrow, "_before": wide_ones}).join(F.broadcast(offsets), "day").select(
        "day", "level", (F.col("_before") + F.col("_wides")).alias("_at"), "wide",
        F.when(F.col("wide"), 0).otherwise(F.floor((F.col("_narrow") + F.col("_rows")) / rows_per_fold)).cast("long").alias("_piece"))
    # One row for each step.
    steps = sorted((r["_at"], r["wide"], r["_piece"]) for r in placed.select("_at", "wide", "_piece").distinct().collect())
    numbers = spark.createDataFrame([(*key, n) for n, key in enumerate(steps)], "_at long, wide boolean, _piece long, step int")
    numbered = placed.join(F.broadcast(numbers), ["_at", "wide", "_piece"]).select("day", "level", "step")
    return numbered, [key[1] for key in steps]


def _by_levels(rows: DataFrame, decay: bool, rows_per_step: int, rows_per_fold: int, folder: str) -> DataFrame:
    """match_id, elo_home, elo_away of prepared rows with `pool`."""
    spark = rows.sparkSession
    levelled = stored(dependency_levels(rows), folder)
    numbers, steps = _level_steps(levelled, rows_per_step, rows_per_fold)
    levelled.join(numbers, ["day", "level"]).hint("rebalance", "step").write.partitionBy("step").parquet(f"{folder}/rows")
    kept = spark.read.parquet(f"{folder}/rows")
    pools = stored(rows.select("pool", F.explode(F.array("home_team", "away_team")).alias("team")).distinct(), folder)
    state = spark.createDataFrame([], f"pool string, {_STATE}")
    columns = ["pool", *[field.split()[0] for field in _STATE.split(", ")]]
    for number, wide in enumerate(steps):
        part = kept.filter(F.col("step") == number).drop("step", "level")
        path = f"{folder}/folded/step={number}"
        if wide:
            rate_period(state.drop("pool"), part, decay).write.parquet(path)
            rated = spark.read.parquet(path)
            moved = next_state(state.drop("pool"), rated, decay).join(pools, "team")
        else:
            _folded(part, state, decay).write.parquet(path)
            moved = spark.read.parquet(path).filter("kind = 'team'")
        moved.select(*columns).write.parquet(f"{folder}/state/step={number}")
        state = spark.read.parquet(f"{folder}/state/step={number}")
    folded = spark.read.schema("kind string, match_id long, elo_home double, elo_away double").parquet(f"{folder}/folded")
    return folded.filter("match_id is not null").select("match_id", "elo_home", "elo_away")


def exact_ratings(
    matches: DataFrame,
    pool: list[str] | None = None,
    decay: bool = True,
    rows_per_step: int = ROWS_PER_STEP,
    checkpoint_folder: str | None = None,
    rows_per_fold: int = ROWS_PER_STEP,
) -> DataFrame:
    """Adds elo_home and elo_away, the ratings before the match (NULL for matches without a score).

    Without `pool` columns the pools are the components of the team graph, and one with more than `rows_per_step`
    rows goes by dependency levels; the levels that one fold takes together have about `rows_per_fold` rows at most.
    """
    spark = matches.sparkSession
    prepared = _prepared(matches, pool or [])
    if not pool:
        rows = stored(with_components(prepared), checkpoint_folder)
        biggest = rows.groupBy("pool").count().agg(F.max("count")).first()[0] or 0
        if biggest > rows_per_step:
            rated = _by_levels(rows, decay, rows_per_step, max(rows_per_step, rows_per_fold), shared_folder(spark, checkpoint_folder))
            return matches.join(rated, "match_id", "left")
    else:
        rows = prepared
    rows, steps = _steps(rows, rows_per_step)
    if steps == 1:
        folded = _folded(rows, None, decay)
    else:
        folder = shared_folder(spark, checkpoint_folder)
        # Rebalanced, so that a step is a few files and not one per input task.
        rows.hint("rebalance", "step").write.partitionBy("step").parquet(f"{folder}/rows")
        kept = spark.read.parquet(f"{folder}/rows")
        state = spark.createDataFrame([], f"pool string, {_STATE}")
        for step in range(steps):
            part = kept.filter(F.col("step") == step).drop("step")
            _folded(part, state, decay).write.parquet(f"{folder}/folded/step={step}")
            done = spark.read.parquet(f"{folder}/folded/step={step}")
            state = done.filter("kind = 'team'").select("pool", "team", "rating", "last_day")
        folded = spark.read.parquet(f"{folder}/folded")
    rated = folded.filter("kind = 'match'").select("match_id", "elo_home", "elo_away")
    return matches.join(rated, "match_id", "left")


def rate_period(state: DataFrame, rows: DataFrame, decay: bool = True) -> DataFrame:
    """Matches of one period with elo_home, elo_away and the home side's gain.

    `state` is (team, rating, last_day); `rows` are prepared matches of one period.
    """
    rated = rows
    for name in ("home", "away"):
        side = state.select(
            F.col("team").alias(f"{name}_team"),
            F.col("rating").alias("_rating"),
            F.col("last_day").alias("_last"),
        )
        idle = F.coalesce(F.col("day") - F.col("_last"), F.lit(0))
        start = F.coalesce("_rating", F.lit(START_RATING))
        rated = (
            rated.join(side, f"{name}_team", "left")
            .withColumn(f"elo_{name}", decayed(start, idle) if decay else start)
            .drop("_rating", "_last")
        )
    gain = K_FACTOR * (F.col("points") - expected_score(F.col("elo_home"), F.col("elo_away")))
    return rated.select(
        "match_id", "home_team", "away_team", "day", "elo_home", "elo_away", gain.alias("gain")
    )


def next_state(state: DataFrame, rated: DataFrame, decay: bool = True) -> DataFrame:
    """Ratings after the period: decayed to the last match day, plus the summed gains."""
    sides = F.array(
        F.struct(F.col("home_team").alias("team"), F.col("gain"), F.col("day")),
        F.struct(F.col("away_team").alias("team"), (-F.col("gain")).alias("gain"), F.col("day")),
    )
    change = (
        rated.select(F.explode(sides).alias("s")).select("s.*")
        .groupBy("team").agg(F.sum("gain").alias("gain"), F.max("day").alias("day"))
    )
    idle = F.coalesce(F.col("day") - F.col("last_day"), F.lit(0))
    start = F.coalesce("rating", F.lit(START_RATING))
    moved = (decayed(start, idle) if decay else start) + F.col("gain")
    return state.join(change, "team", "full").select(
        "team",
        F.coalesce(moved, "rating").alias("rating"),
        # A late batch never moves the last match day backwards.
        F.greatest("day", "last_day").alias("last_day"),
    )


def prepared_periods(matches: DataFrame, period: Column) -> DataFrame:
    return _prepared(matches, [], period.alias("period")).drop("pool")


def period_ratings(
    matches: DataFrame,
    period: Column,
    decay: bool = True,
    checkpoint_folder: str | None = None,
) -> DataFrame:
    """Adds elo_home and elo_away in period mode.

    `period` is a column whose values sort in time. All matches of a period start from the ratings
    at its start, however many a team plays; the shorter the periods, the closer to the exact mode.
    """
    spark = matches.sparkSession
    rows = prepared_periods(matches, period)
    folder = shared_folder(spark, checkpoint_folder)
    rows.hint("rebalance", "period").write.partitionBy("period").parquet(f"{folder}/rows")
    kept = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    # One value per period reaches the driver, which runs two jobs per period.
    periods = sorted(r[0] for r in rows.select("period").distinct().collect())
    state = spark.createDataFrame([], _STATE)
    for number, value in enumerate(periods):
        part = kept.filter(F.col("period") == value).drop("period")
        rate_period(state, part, decay).write.parquet(f"{folder}/rated/n={number}")
        rated = spark.read.parquet(f"{folder}/rated/n={number}")
        next_state(state, rated, decay).write.parquet(f"{folder}/state/n={number}")
        state = spark.read.parquet(f"{folder}/state/n={number}")
    rated = spark.read.parquet(f"{folder}/rated").select("match_id", "elo_home", "elo_away")
    return matches.join(rated, "match_id", "left")
