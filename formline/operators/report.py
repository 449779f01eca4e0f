"""Candidate ranking, deployment choice, promotion gate, report comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.functions.tournaments import COMPETITION_SEGMENTS, rank_in_order

TOLERANCE = 0.002

# Metric -> whether a higher value is better.
HIGHER_IS_BETTER = {
    "accuracy": True, "macro_f1": True, "weighted_f1": True, "balanced_accuracy": True,
    "matthews_corrcoef": True, "cohen_kappa": True, "log_loss": False,
    "multiclass_brier_score": False, "expected_calibration_error": False,
    "draw_f1": True, "draw_recall": True,
}
RANKED = {
    "macro_f1": True, "draw_f1": True, "draw_recall": True, "balanced_accuracy": True,
    "matthews_corrcoef": True, "log_loss": False, "multiclass_brier_score": False,
    "expected_calibration_error": False,
}


def rank_candidates(means: DataFrame, name: str = "model_name") -> DataFrame:
    """Dense rank per metric, their sum, and the final order. One row per candidate."""
    ranks = {}
    for metric, higher in RANKED.items():
        order = F.desc(metric) if higher else F.asc(metric)
        ranks[f"rank_{metric}"] = F.dense_rank().over(Window.partitionBy().orderBy(order))
    ranked = means.withColumns(ranks)
    score: Column = F.lit(0)
    for column in ranks:
        score = score + F.col(column)
    ranked = ranked.withColumn("selection_score", score)
    final = Window.partitionBy().orderBy(
        "selection_score", F.desc("macro_f1"), F.desc("draw_f1"), F.desc("draw_recall"), "log_loss", name
    )
    return ranked.withColumn("selection_rank", F.row_number().over(final))


def top_candidates(ranked: DataFrame, limit: int = 5) -> DataFrame:
    return ranked.orderBy("selection_rank").limit(limit)


def confident_errors(frame: DataFrame, limit: int = 15) -> DataFrame:
    """Wrong predictions with the highest confidence."""
    wrong = frame.filter(F.col("actual") != F.col("predicted"))
    return wrong.orderBy(F.desc("max_probability"), "match_id").limit(limit).withColumn(
        "confidence", F.round("max_probability", 4)
    )


def deployment_decisions(
    variants: DataFrame,
    baseline: str = "uncalibrated",
    max_macro_f1_drop: float = 0.015,
    max_weighted_f1_drop: float = 0.02,
    max_draw_recall_drop: float = 0.05,
    min_log_loss_gain: float = 0.005,
    min_ece_gain: float = 0.005,
) -> DataFrame:
    """One row per variant with deltas against the baseline, viability and the choice.

    A calibrated variant must keep F1 and draw recall and must clearly improve log
    loss or calibration error. Among viable ones the lowest log loss wins, then
    calibration error, then F1. Without one the baseline stays.
    """
    measures = ("macro_f1", "weighted_f1", "log_loss", "expected_calibration_error", "draw_recall")
    whole = Window.partitionBy()
    is_base = F.col("variant") == baseline
    base = {m: F.max(F.when(is_base, F.col(m))).over(whole) for m in measures}
    out = variants.withColumns({f"_base_{m}": e for m, e in base.items()}).withColumn("is_baseline", is_base)
    delta = {m: F.col(m) - F.col(f"_base_{m}") for m in measures}
    keeps = (
        (delta["macro_f1"] >= -max_macro_f1_drop)
        & (delta["weighted_f1"] >= -max_weighted_f1_drop)
        & (delta["draw_recall"] >= -max_draw_recall_drop)
    )
    gains = (-delta["log_loss"] >= min_log_loss_gain) | (-delta["expected_calibration_error"] >= min_ece_gain)
    out = out.withColumns(
        {
            "macro_f1_delta": delta["macro_f1"],
            "weighted_f1_delta": delta["weighted_f1"],
            "log_loss_improvement": -delta["log_loss"],
            "ece_improvement": -delta["expected_calibration_error"],
            "draw_recall_delta": delta["draw_recall"],
            "preserves_class_balance": keeps,
            "improves_probability_quality": gains,
            "is_viable": F.col("is_baseline") | (keeps & gains),
        }
    ).drop(*[f"_base_{m}" for m in measures])
    order = Window.partitionBy().orderBy(
        F.desc(F.col("is_viable") & ~F.col("is_baseline")),
        F.desc(F.col("is_viable")),
        "log_loss", "expected_calibration_error", F.desc("macro_f1"), F.desc("weighted_f1"), "variant",
    )
    return out.withColumn("is_chosen", F.row_number().over(order) == 1)


def promotion_gate(v1: DataFrame, v2: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Decision over two one-row metric frames (log_loss, macro_f1)."""
    pair = v1.select(F.lit(1).alias("v"), "log_loss", "macro_f1").unionByName(
        v2.select(F.lit(2).alias("v"), "log_loss", "macro_f1")
    )
    row = pair.agg(
        *[
            F.max(F.when(F.col("v") == v, F.col(m))).alias(f"{m}_v{v}")
            for m in ("log_loss", "macro_f1") for v in (1, 2)
        ]
    ).withColumns(
        {
            "delta_log_loss": F.col("log_loss_v2") - F.col("log_loss_v1"),
            "delta_macro_f1": F.col("macro_f1_v2") - F.col("macro_f1_v1"),
        }
    )
    equal = (F.abs("delta_log_loss") <= tolerance) & (F.abs("delta_macro_f1") <= tolerance)
    better = (F.col("delta_log_loss") <= 0) & (F.col("delta_macro_f1") >= 0)
    decision = F.when(equal, "EQUIVALENT_PROMOTE_V2").when(better, "PROMOTE_V2").otherwise("KEEP_V1")
    failing = F.concat_ws(
        ", ",
        F.when(F.col("delta_log_loss") > tolerance, "log_loss"),
        F.when(F.col("delta_macro_f1") < -tolerance, "macro_f1"),
    )
    return row.withColumn("decision", decision).withColumn(
        "failing", F.when(F.col("decision") == "KEEP_V1", failing).otherwise("")
    )


def long_metrics(metrics: DataFrame) -> DataFrame:
    """One row per metric."""
    present = [m for m in HIGHER_IS_BETTER if m in metrics.columns]
    return metrics.select(*present).unpivot([], present, "metric", "value")


def metric_directions(v1: DataFrame, v2: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Delta and up, down or flat per metric, by the metric's polarity."""
    left = long_metrics(v1).withColumnRenamed("value", "v1")
    right = long_metrics(v2).withColumnRenamed("value", "v2")
    delta = F.col("v2") - F.col("v1")
    higher = F.col("metric").isin(*[m for m, up in HIGHER_IS_BETTER.items() if up])
    improved = F.when(higher, delta > 0).otherwise(delta < 0)
    direction = F.when(F.abs(delta) < tolerance, "flat").when(improved, "up").otherwise("down")
    return left.join(right, "metric").select("metric", "v1", "v2", delta.alias("delta"), direction.alias("direction"))


def compare_segments(
    v1: DataFrame, v2: DataFrame, order: tuple[str, ...] = COMPETITION_SEGMENTS
) -> DataFrame:
    """Segment rows of two reports side by side; an absent side has 0 rows and NULL metrics."""
    sides = [
        df.select("segment_value", *[F.col(c).alias(f"{c}_{v}") for c in ("n", "macro_f1", "log_loss")])
        for v, df in (("v1", v1), ("v2", v2))
    ]
    joined = sides[0].join(sides[1], "segment_value", "full")
    return joined.select(
        "segment_value",
        F.coalesce("n_v1", F.lit(0)).alias("rows_v1"), "macro_f1_v1", "log_loss_v1",
        F.coalesce("n_v2", F.lit(0)).alias("rows_v2"), "macro_f1_v2", "log_loss_v2",
        (F.col("macro_f1_v2") - F.col("macro_f1_v1")).alias("delta_macro_f1"),
        (F.col("log_loss_v2") - F.col("log_loss_v1")).alias("delta_log_loss"),
        rank_in_order(F.col("segment_value"), order).alias("position"),
    ).orderBy("position", "segment_value")


def latest_run(runs: DataFrame) -> DataFrame:
    """Newest training run; a missing time is older than any other."""
    return runs.orderBy(
        F.desc_nulls_last("trained_at_utc"), F.desc_nulls_last("persisted_at_utc"), F.desc_nulls_last("pipeline_run_id")
    ).limit(1)


def typed_runs(runs: DataFrame) -> DataFrame:
    """Training runs with dates, timestamps and parsed JSON columns."""
    days = ("train_date_start", "train_date_end", "test_date_start", "test_date_end")
    typed = {d: F.col(d).try_cast("date") for d in days if d in runs.columns}
    typed |= {
        t: F.col(t).try_cast("timestamp") for t in ("trained_at_utc", "persisted_at_utc") if t in runs.columns
    }
    shapes = {
        "feature_columns_json": "array<string>",
        "class_distribution_train_json": "map<string,bigint>",
        "class_distribution_test_json": "map<string,bigint>",
    }
    typed |= {c: F.from_json(c, shape) for c, shape in shapes.items() if c in runs.columns}
    return runs.withColumns(typed)


def serialise_run(run: DataFrame) -> DataFrame:
    """A run row for output: times as ISO text, counts as long, metrics as double; NULL stays."""
    out = {}
    for field in run.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("timestamp", "timestamp_ntz"):
            out[field.name] = F.date_format(field.name, "yyyy-MM-dd'T'HH:mm:ss")
        elif kind == "date":
            out[field.name] = F.date_format(field.name, "yyyy-MM-dd")
        elif kind in ("integer", "short", "byte", "long"):
            out[field.name] = F.col(field.name).cast("long")
        elif kind in ("float", "double", "decimal"):
            out[field.name] = F.col(field.name).cast("double")
        elif kind in ("array", "map", "struct"):
            out[field.name] = F.to_json(field.name)
    return run.withColumns(out)


def flatten_candidates(candidates: DataFrame) -> DataFrame:
    """Nested mean metrics as flat columns, in rank order."""
    return candidates.select(
        "model_name", "model_family", "selection_rank", "selection_score", "mean_metrics.*"
    ).orderBy("selection_rank")


def best_by_metric(comparison: DataFrame, metric: str = "macro_f1", name: str = "model_name") -> DataFrame:
    """Models with their position by one metric."""
    order = Window.partitionBy().orderBy(F.desc(metric), name)
    return comparison.withColumn("position", F.row_number().over(order))
