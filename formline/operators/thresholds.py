"""Override thresholds per segment: lookup, grid statistics, tuning.

A generalist row gives way to the specialist when its top probability is below u,
the specialist says draw and its draw probability is at least c. Each row therefore
overrides a rectangle of the (u, c) grid. Rows are counted once per rectangle
corner, and cumulative sums over the small grid give every cell; rows are never
paired with cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline.functions import outcomes
from formline.operators.metrics import EPS, safe_ratio

# Fixed values of the search grid and of the log-loss budget.
UNCERTAINTY_GRID = [0.30 + 0.02 * i for i in range(18)]
CONVICTION_GRID = [0.40 + 0.02 * j for j in range(13)]
LOG_LOSS_BUDGET = 0.005
NEVER = (0.01, 0.99)
DEFAULTS = (0.0, 1.0)

GENERALIST = ("g_away", "g_draw", "g_home")
SPECIALIST = ("s_away", "s_draw", "s_home")


def threshold_table(spark: SparkSession, thresholds: dict[str, tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame(
        [(s, float(u), float(c)) for s, (u, c) in thresholds.items()],
        "match_segment string, uncertainty double, conviction double",
    )


def with_thresholds(
    df: DataFrame, thresholds: DataFrame, default: tuple[float, float] = DEFAULTS
) -> DataFrame:
    """Thresholds of the row's segment, else the defaults. A caller's table, so its measured size decides how it is joined."""
    joined = df.join(thresholds, "match_segment", "left")
    return joined.withColumns(
        {
            "uncertainty": F.coalesce("uncertainty", F.lit(default[0])),
            "conviction": F.coalesce("conviction", F.lit(default[1])),
        }
    )


def invalid_thresholds(thresholds: DataFrame) -> DataFrame:
    """Rows with a threshold outside [0, 1] or fewer than one required sample."""
    bad = ~F.col("uncertainty").between(0, 1) | ~F.col("conviction").between(0, 1)
    if "min_samples" in thresholds.columns:
        bad = bad | (F.col("min_samples") < 1)
    return thresholds.filter(F.coalesce(bad, F.lit(True)))


def with_override(df: DataFrame) -> DataFrame:
    """Blended row and class; needs both probability rows and the thresholds."""
    generalist = tuple(F.col(c) for c in GENERALIST)
    specialist = tuple(F.col(c) for c in SPECIALIST)
    flagged = df.withColumn(
        "is_override", outcomes.override(generalist, specialist, F.col("uncertainty"), F.col("conviction"))
    )
    row = outcomes.blend(generalist, specialist, F.col("is_override"))
    blended = flagged.withColumns(dict(zip(("p_away", "p_draw", "p_home"), row)))
    return blended.withColumn(
        "predicted", outcomes.argmax_class(F.col("p_away"), F.col("p_draw"), F.col("p_home"))
    )


def _count_not_above(value: Column, start: float, grid: list[float]) -> Column:
    """Number of grid values <= value: a guess from the even spacing, then corrected
    against the exact doubles on both sides of it."""

    def at(k: Column) -> Column:
        return F.lit(start) + F.lit(0.02) * k

    guess = F.least(F.greatest(F.floor((value - start) / 0.02) + 1, F.lit(0)), F.lit(len(grid)))
    return (
        F.when((guess > 0) & (at(guess - 1) > value), guess - 1)
        .when((guess < len(grid)) & (at(guess) <= value), guess + 1)
        .otherwise(guess)
        .cast("int")
    )


def _loss(row: tuple[str, str, str]) -> Column:
    p = outcomes.pick_probability(F.col("actual"), *[F.col(c) for c in row])
    return -F.log(F.greatest(F.least(p, F.lit(1.0 - EPS)), F.lit(EPS)))


def grid_statistics(scored: DataFrame) -> DataFrame:
    """Per segment and grid cell: overrides, draw counts and log-loss sum after overriding.

    `scored` has match_segment, actual and both probability rows.
    """
    generalist = tuple(F.col(c) for c in GENERALIST)
    specialist = tuple(F.col(c) for c in SPECIALIST)
    # Staged, so that every probability expression is evaluated once per row.
    rows = scored.filter(F.col("match_segment").isNotNull()).select(
        "match_segment",
        (F.col("actual") == 0).cast("long").alias("draw"),
        (outcomes.argmax_class(*generalist) == 0).cast("long").alias("base_draw"),
        _loss(GENERALIST).alias("base"),
        (_loss(SPECIALIST) - _loss(GENERALIST)).alias("more"),
        F.greatest(*generalist).alias("top"),
        specialist[1].alias("conviction"),
        (outcomes.argmax_class(*specialist) == 0).alias("says_draw"),
    )
    # First u index and last c index at which the row overrides.
    rows = rows.withColumns(
        {
            "u": _count_not_above(F.col("top"), 0.30, UNCERTAINTY_GRID),
            "c": _count_not_above(F.col("conviction"), 0.40, CONVICTION_GRID) - 1,
        }
    )
    fires = F.col("says_draw") & (F.col("u") < len(UNCERTAINTY_GRID)) & (F.col("c") >= 0)
    draw, base_draw = F.col("draw"), F.col("base_draw")
    corners = (
        rows.groupBy(
            "match_segment",
            F.when(fires, F.col("u")).otherwise(-1).alias("i"),
            F.when(fires, F.col("c")).otherwise(-1).alias("j"),
        )
        .agg(
            F.count("*").alias("rows"),
            F.sum(draw).alias("draws"),
            F.sum(base_draw).alias("base_predicted"),
            F.sum(draw * base_draw).alias("base_hits"),
            F.sum("base").alias("base_loss"),
            F.sum(1 - base_draw).alias("more_predicted"),
            F.sum(draw * (1 - base_draw)).alias("more_hits"),
            F.sum("more").alias("more_loss"),
        )
    )
    totals = corners.groupBy("match_segment").agg(
        F.sum("rows").alias("n"), F.sum("draws").alias("draws_total"),
        *[F.sum(c).alias(c) for c in ("base_predicted", "base_hits", "base_loss")],
    )
    cells = totals.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(len(UNCERTAINTY_GRID) - 1))).alias("i")
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(CONVICTION_GRID) - 1))).alias("j"))
    moves = ["rows", "more_predicted", "more_hits", "more_loss"]
    sparse = corners.filter("i >= 0").select("match_segment", "i", "j", *moves)
    dense = cells.join(sparse, ["match_segment", "i", "j"], "left").fillna(0, subset=moves)
    over_u = Window.partitionBy("match_segment", "j").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    over_c = Window.partitionBy("match_segment", "i").orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, 0)
    for over in (over_u, over_c):
        dense = dense.withColumns({m: F.sum(m).over(over) for m in moves})
    predicted = F.col("base_predicted") + F.col("more_predicted")
    hits = F.col("base_hits") + F.col("more_hits")
    pick = {"i": UNCERTAINTY_GRID, "j": CONVICTION_GRID}
    value = {k: F.array(*[F.lit(g) for g in grid])[F.col(k)] for k, grid in pick.items()}
    return dense.select(
        "match_segment", "i", "j", value["i"].alias("uncertainty"), value["j"].alias("conviction"),
        "n", F.col("rows").alias("overrides"),
        safe_ratio(2.0 * hits, predicted + F.col("draws_total")).alias("draw_f1"),
        ((F.col("base_loss") + F.col("more_loss")) / F.col("n")).alias("log_loss"),
        safe_ratio(2.0 * F.col("base_hits"), F.col("base_predicted") + F.col("draws_total")).alias("base_draw_f1"),
        (F.col("base_loss") / F.col("n")).alias("base_log_loss"),
    )


def tune_thresholds(scored: DataFrame, budget: float = LOG_LOSS_BUDGET) -> DataFrame:
    """Best cell per segment: highest draw F1 above the generalist's, within the log-loss
    budget; ties take the first (u, c). A segment without one gets thresholds that
    practically never fire."""
    grid = grid_statistics(scored)
    allowed = (
        (F.col("overrides") > 0)
        & (F.col("draw_f1") > F.col("base_draw_f1"))
        & (F.col("log_loss") <= F.col("base_log_loss") + budget)
    )
    key = F.when(allowed, F.struct(F.col("draw_f1"), -F.col("i"), -F.col("j")))
    picked = F.struct("uncertainty", "conviction", "draw_f1")
    best = grid.groupBy("match_segment").agg(
        F.max_by(picked, key).alias("b"), F.max("base_draw_f1").alias("base_draw_f1"), F.max(key).alias("k")
    )
    found = F.col("k").isNotNull()
    return best.select(
        "match_segment",
        F.when(found, F.col("b.uncertainty")).otherwise(NEVER[0]).alias("uncertainty"),
        F.when(found, F.col("b.conviction")).otherwise(NEVER[1]).alias("conviction"),
        "base_draw_f1",
        F.when(found, F.col("b.draw_f1")).otherwise(F.col("base_draw_f1")).alias("draw_f1"),
    )
