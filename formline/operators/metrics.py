"""Classification metrics as aggregate expressions.

A prediction frame has `actual` and `predicted` (classes -1, 0, 1) and the
probability columns p_away, p_draw, p_home. Everything an evaluation needs is one
set of partial sums, so the suite is one aggregation under any grouping.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.functions import outcomes
from formline.functions.outcomes import CLASSES, LABELS
from formline.functions.tournaments import competition_segment, two_year_window
from formline.operators import dims

EPS = 2.220446049250313e-16
ECE_BINS = 10
PROBABILITIES = ("p_away", "p_draw", "p_home")
NAME = {-1: "away", 0: "draw", 1: "home"}

SUITE = (
    "accuracy", "macro_f1", "weighted_f1", "balanced_accuracy", "matthews_corrcoef", "cohen_kappa",
    "log_loss", "multiclass_brier_score", "expected_calibration_error", "draw_f1", "draw_recall",
)
SELECTION_METRICS = (
    "macro_f1", "draw_f1", "draw_recall", "balanced_accuracy", "matthews_corrcoef", "log_loss",
    "multiclass_brier_score", "expected_calibration_error",
)


def _total(parts: list[Column]) -> Column:
    return reduce(add, parts)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """0 when the denominator is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def probability_row() -> tuple[Column, ...]:
    return tuple(F.col(p) for p in PROBABILITIES)


def true_probability() -> Column:
    return outcomes.pick_probability(F.col("actual"), *probability_row())


def log_loss_term() -> Column:
    """-ln of the (row-normalised, clipped) probability of the actual class."""
    share = true_probability() / _total(list(probability_row()))
    return -F.log(F.greatest(F.least(share, F.lit(1.0 - EPS)), F.lit(EPS)))


def brier_term() -> Column:
    return _total(
        [F.pow(p - (F.col("actual") == cls).cast("double"), 2) for cls, p in zip(CLASSES, probability_row())]
    )


def confidence_bin(confidence: Column, bins: int = ECE_BINS) -> Column:
    """0-based bin: the number of inner edges not above the value; the last bin is closed."""
    edges = [k * (1.0 / bins) for k in range(1, bins)]
    return _total([(confidence >= F.lit(e)).cast("int") for e in edges])


def partial_sums() -> list[Column]:
    """Aggregates from which every metric of the suite follows."""
    actual, predicted = F.col("actual"), F.col("predicted")
    sums = [
        F.count("*").alias("n"),
        F.sum(log_loss_term()).alias("sum_log_loss"),
        F.sum(brier_term()).alias("sum_brier"),
    ]
    for cls, name in NAME.items():
        sums += [
            F.count_if((actual == cls) & (predicted == cls)).alias(f"tp_{name}"),
            F.count_if(actual == cls).alias(f"actual_{name}"),
            F.count_if(predicted == cls).alias(f"predicted_{name}"),
        ]
    confidence = F.greatest(*probability_row())
    correct = (outcomes.argmax_class(*probability_row()) == actual).cast("double")
    which = confidence_bin(confidence)
    for k in range(ECE_BINS):
        sums.append(F.sum(F.when(which == k, correct - confidence)).alias(f"gap_{k}"))
    return sums


def class_scores(name: str) -> dict[str, Column]:
    tp, actual, predicted = (F.col(f"{kind}_{name}") for kind in ("tp", "actual", "predicted"))
    return {
        f"precision_{name}": safe_ratio(tp, predicted),
        f"recall_{name}": safe_ratio(tp, actual),
        f"f1_{name}": safe_ratio(2 * tp, actual + predicted),
        f"support_{name}": actual,
    }


def suite_columns() -> dict[str, Column]:
    """Metric name -> expression over the partial sums."""
    n = F.col("n")
    names = list(NAME.values())
    actual = {c: F.col(f"actual_{c}").cast("double") for c in names}
    predicted = {c: F.col(f"predicted_{c}").cast("double") for c in names}
    hits = _total([F.col(f"tp_{c}") for c in names]).cast("double")
    f1 = {c: class_scores(c)[f"f1_{c}"] for c in names}
    recall = {c: class_scores(c)[f"recall_{c}"] for c in names}
    seen = {c: (actual[c] + predicted[c] > 0).cast("double") for c in names}
    present = {c: (actual[c] > 0).cast("double") for c in names}
    agreement = _total([actual[c] * predicted[c] for c in names])
    actual_sq = _total([actual[c] * actual[c] for c in names])
    predicted_sq = _total([predicted[c] * predicted[c] for c in names])
    spread = F.sqrt((n * n - predicted_sq) * (n * n - actual_sq))
    expected = agreement / (n * n)
    return {
        "accuracy": hits / n,
        "macro_f1": safe_ratio(_total([f1[c] * seen[c] for c in names]), _total(list(seen.values()))),
        "weighted_f1": _total([f1[c] * actual[c] for c in names]) / n,
        "balanced_accuracy": safe_ratio(
            _total([recall[c] * present[c] for c in names]), _total(list(present.values()))
        ),
        "matthews_corrcoef": safe_ratio(hits * n - agreement, spread),
        "cohen_kappa": safe_ratio(hits / n - expected, 1 - expected),
        "log_loss": F.col("sum_log_loss") / n,
        "multiclass_brier_score": F.col("sum_brier") / n,
        "expected_calibration_error": _total(
            [F.abs(F.coalesce(f"gap_{k}", F.lit(0.0))) for k in range(ECE_BINS)]
        ) / n,
        "draw_f1": f1["draw"],
        "draw_recall": recall["draw"],
    }


def evaluate(frame: DataFrame, *group: str, extra: list[Column] | None = None) -> DataFrame:
    """The metric suite per group (one row without a group), in one aggregation."""
    sums = frame.groupBy(*group).agg(*partial_sums(), *(extra or []))
    kept = [c for c in sums.columns if c in group] + [
        c for c in sums.columns if c not in group and not c.startswith(("gap_", "sum_", "tp_", "actual_", "predicted_"))
    ]
    return sums.select(*kept, *[e.alias(name) for name, e in suite_columns().items()])


def class_report(frame: DataFrame, *group: str) -> DataFrame:
    """Precision, recall, F1 and support per class, plus macro and weighted averages."""
    sums = frame.groupBy(*group).agg(*partial_sums())
    rows = []
    for cls, name in NAME.items():
        s = class_scores(name)
        rows.append(
            F.struct(
                F.lit(LABELS[cls]).alias("label"), s[f"precision_{name}"].alias("precision"),
                s[f"recall_{name}"].alias("recall"), s[f"f1_{name}"].alias("f1_score"),
                s[f"support_{name}"].alias("support"),
            )
        )
    all_scores = {name: class_scores(name) for name in NAME.values()}

    def average(kind: str, weighted: bool) -> Column:
        parts = [
            all_scores[c][f"{kind}_{c}"] * (all_scores[c][f"support_{c}"] if weighted else 1)
            for c in NAME.values()
        ]
        return safe_ratio(_total(parts), F.col("n") if weighted else F.lit(len(NAME)))

    for label, weighted in (("macro avg", False), ("weighted avg", True)):
        rows.append(
            F.struct(
                F.lit(label).alias("label"), average("precision", weighted).alias("precision"),
                average("recall", weighted).alias("recall"), average("f1", weighted).alias("f1_score"),
                F.col("n").alias("support"),
            )
        )
    return sums.select(*group, F.explode(F.array(*rows)).alias("r")).select(*group, "r.*")


def confusion_matrix(frame: DataFrame) -> DataFrame:
    """Counts and row shares with fixed labels, one row per actual class seen."""
    counts = frame.groupBy("actual").agg(
        *[F.count_if(F.col("predicted") == cls).alias(f"predicted_{NAME[cls]}") for cls in CLASSES]
    )
    total = _total([F.col(f"predicted_{NAME[cls]}") for cls in CLASSES])
    return counts.select(
        "*", *[safe_ratio(F.col(f"predicted_{NAME[c]}"), total).alias(f"share_{NAME[c]}") for c in CLASSES]
    )


def calibration_bins(frame: DataFrame) -> DataFrame:
    """Rows, mean confidence and accuracy per confidence bin."""
    confidence = F.greatest(*probability_row())
    correct = (outcomes.argmax_class(*probability_row()) == F.col("actual")).cast("double")
    return frame.groupBy(confidence_bin(confidence).alias("bin")).agg(
        F.count("*").alias("rows"), F.avg(confidence).alias("confidence"), F.avg(correct).alias("accuracy")
    )


def class_distribution(df: DataFrame, target: str, *group: str) -> DataFrame:
    """Count and percent per class (the totals are summed over the small result)."""
    counts = df.groupBy(*group, target).agg(F.count("*").alias("rows"))
    return counts.withColumn("percent", 100 * F.col("rows") / F.sum("rows").over(Window.partitionBy(*group)))


def imbalance(df: DataFrame, target: str) -> DataFrame:
    """Largest over smallest class share, with its verdict."""
    counts = df.groupBy(target).agg(F.count("*").alias("rows"))
    ratio = counts.agg((F.max("rows") / F.min("rows")).alias("ratio"))
    verdict = F.when(F.col("ratio") < 1.5, "balanced").when(F.col("ratio") < 3, "moderate").otherwise("severe")
    return ratio.withColumn("verdict", verdict)


def date_range(df: DataFrame, day: str) -> DataFrame:
    return df.agg(F.min(day).alias("date_start"), F.max(day).alias("date_end"), F.count("*").alias("rows"))


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column, from a single pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "nulls")


def numeric_ranges(df: DataFrame, low: float = -100, high: float = 100) -> DataFrame:
    """Minimum and maximum per numeric column, with a flag for wide ranges."""
    numeric = numeric_columns(df)
    pairs = df.agg(
        *[F.struct(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c) for c in numeric]
    )
    long = pairs.unpivot([], numeric, "column_name", "range").select("column_name", "range.*")
    return long.withColumn("wide", (F.col("high") > high) | (F.col("low") < low))


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = ("byte", "short", "integer", "long", "float", "double", "boolean", "decimal")
    return [f.name for f in df.schema.fields if f.dataType.typeName() in kinds and f.dataType.typeName() != "boolean"]


# Identifiers, lineage and leakage columns that are never model features.
NON_FEATURES = (
    "match_id", "match_date", "kickoff_ts", "pool_id", "home_team", "away_team", "home_goals",
    "away_goals", "tournament", "city", "country", "pipeline_run_id", "persisted_at_utc",
    "goal_diff", "target_multiclass", "target",
)


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric and boolean columns other than identifiers, lineage and leakage."""
    booleans = [f.name for f in df.schema.fields if f.dataType.typeName() == "boolean"]
    usable = set(numeric_columns(df)) | set(booleans)
    return [c for c in df.columns if c in usable and c not in NON_FEATURES]


def fold_summary(metrics: DataFrame, *group: str) -> DataFrame:
    """Mean and population standard deviation of the selection metrics over folds."""
    return metrics.groupBy(*group).agg(
        *[F.avg(m).alias(f"mean_{m}") for m in SELECTION_METRICS],
        *[F.stddev_pop(m).alias(f"std_{m}") for m in SELECTION_METRICS],
    )


def class_weights(df: DataFrame, target: str, draw_boost: float = 1.0) -> DataFrame:
    """Balanced weight per class; a boosted draw is rescaled so that weights sum to the row count."""
    counts = df.groupBy(target).agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy()
    balanced = F.sum("_rows").over(whole) / (F.count("*").over(whole) * F.col("_rows"))
    boosted = counts.withColumn("_w", balanced * F.when(F.col(target) == 0, draw_boost).otherwise(1.0))
    scale = F.sum("_rows").over(whole) / F.sum(F.col("_w") * F.col("_rows")).over(whole)
    return boosted.select(target, (F.col("_w") * scale).alias("weight"))


def with_class_weights(df: DataFrame, target: str, draw_boost: float = 1.0) -> DataFrame:
    """Row weights; the weight table has one row per class."""
    return df.join(F.broadcast(class_weights(df, target, draw_boost)), target)


def specialist_weights(df: DataFrame, target: str, weight: str, multiplier: float = 4 / 3) -> DataFrame:
    """Draw weights times the multiplier, rescaled to sum to the row count."""
    raised = df.withColumn(weight, F.col(weight) * F.when(F.col(target) == 0, multiplier).otherwise(1.0))
    scale = raised.agg(F.count("*") / F.sum(weight)).scalar()
    return raised.withColumn(weight, F.col(weight) * scale)


def confederation_coverage(df: DataFrame) -> DataFrame:
    home = F.col("home_confederation")
    return df.agg(
        F.round(F.avg((home != dims.UNKNOWN).cast("double")), 6).alias("known_home_confederation_ratio"),
        F.round(F.avg(home.isin(dims.UNKNOWN, dims.REGIONAL).cast("double")), 6).alias("regional_or_unknown_ratio"),
    )


def prediction_frame(scored: DataFrame) -> DataFrame:
    """Labels, confidence and segment columns next to actual, predicted and probabilities.

    Needs the four flags, home_confederation and away_confederation.
    """
    return scored.withColumns(
        {
            "actual_label": outcomes.outcome_label(F.col("actual")),
            "predicted_label": outcomes.outcome_label(F.col("predicted")),
            "max_probability": F.greatest(*probability_row()),
            "competition_segment": competition_segment(
                *[F.col(c) for c in ("is_world_cup", "is_qualifier", "is_continental", "is_friendly")]
            ),
            "time_window": two_year_window(F.col("match_date")),
            "confederation_segment": dims.matchup_segment(
                F.col("home_confederation"), F.col("away_confederation")
            ),
        }
    )


# Segment column -> smallest group that is reported.
SEGMENT_MIN_ROWS = {
    "competition_segment": 60,
    "time_window": 60,
    "home_confederation": 80,
    "confederation_segment": 80,
}


def segment_analysis(frame: DataFrame, column: str, min_rows: int = 80) -> DataFrame:
    dates = [F.min("match_date").alias("date_start"), F.max("match_date").alias("date_end")]
    return (
        evaluate(frame, column, extra=dates)
        .filter(F.col("n") >= min_rows)
        .select(F.lit(column).alias("segment_type"), F.col(column).alias("segment_value"), "*")
        .drop(column)
        .orderBy(F.desc("n"), F.desc("macro_f1"), "segment_value")
    )


def all_segments(frame: DataFrame, minimum: dict[str, int] | None = None) -> DataFrame:
    """The four segment reports in one pass: grouping sets over the four columns.

    Home confederations leave out unknown and regional teams.
    """
    minimum = minimum or SEGMENT_MIN_ROWS
    columns = list(minimum)
    sums = frame.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(
        *partial_sums(),
        F.min("match_date").alias("date_start"), F.max("match_date").alias("date_end"),
        *[F.grouping(c).alias(f"_not_{c}") for c in columns],
    )
    kind = F.coalesce(*[F.when(F.col(f"_not_{c}") == 0, c) for c in columns])
    value = F.coalesce(*[F.when(F.col(f"_not_{c}") == 0, F.col(c)) for c in columns])
    least = F.coalesce(*[F.when(kind == c, m) for c, m in minimum.items()])
    left_out = (kind == "home_confederation") & value.isin(dims.UNKNOWN, dims.REGIONAL)
    return sums.filter(F.col("n") >= least).filter(~left_out).select(
        kind.alias("segment_type"), value.alias("segment_value"), "n", "date_start", "date_end",
        *[e.alias(name) for name, e in suite_columns().items()],
    )


def segment_statistics(scored: DataFrame) -> DataFrame:
    """Override rate, accuracy, draw recall and draw precision per routed segment.

    Draw recall (precision) is 0 for a segment with a single actual (predicted) class.
    """
    actual, predicted = F.col("actual"), F.col("predicted")
    hit = F.count_if((actual == 0) & (predicted == 0))
    several = {c: F.min(c) != F.max(c) for c in ("actual", "predicted")}
    return scored.filter(F.col("match_segment").isNotNull()).groupBy("match_segment").agg(
        F.count("*").alias("n_samples"),
        F.avg(F.col("is_override").cast("double")).alias("override_rate"),
        F.avg((actual == predicted).cast("double")).alias("accuracy"),
        F.when(several["actual"], safe_ratio(hit, F.count_if(actual == 0))).otherwise(0.0).alias("draw_accuracy"),
        F.when(several["predicted"], safe_ratio(hit, F.count_if(predicted == 0))).otherwise(0.0).alias("draw_precision"),
    )


def segment_coverage(df: DataFrame, segments: list[str]) -> DataFrame:
    return df.filter(F.col("match_segment").isin(*segments)).groupBy("match_segment").agg(
        F.count("*").alias("rows")
    )
