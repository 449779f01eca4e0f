"""Data contracts. Every check of a table comes from one aggregation over it.

A report has one row per (check, column_name) with the number of failing rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



class ContractError(ValueError):
    """A table breaks its contract."""


@dataclass(frozen=True)
class Contract:
    name: str
    required: tuple[str, ...]
    non_null: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()
    minimum: dict[str, float] = field(default_factory=dict)
    maximum: dict[str, float] = field(default_factory=dict)
    allowed: dict[str, tuple] = field(default_factory=dict)


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    return [c for c in required if c not in df.columns]


def bad_date(column: str) -> Column:
    return F.col(column).cast("string").try_cast("timestamp").isNull()


def bad_number(column: str, low: float | None = None, high: float | None = None) -> Column:
    """True for a value that is not a number (NULL and NaN included) or out of range."""
    value = F.col(column).cast("string").try_cast("double")
    bad = value.isNull() | F.isnan(value)
    if low is not None:
        bad = bad | (value < low)
    if high is not None:
        bad = bad | (value > high)
    return bad


def not_allowed(column: str, values: tuple) -> Column:
    """True for a value outside the list; NULL passes."""
    return F.coalesce(~F.col(column).isin(*values), F.lit(False))


def _checks(df: DataFrame, contract: Contract) -> dict[tuple[str, str], Column]:
    present = set(df.columns)
    out: dict[tuple[str, str], Column] = {}
    for c in contract.non_null:
        out["non_null", c] = F.col(c).isNull()
    for c in contract.dates:
        out["parseable_date", c] = bad_date(c)
    for c in {**contract.minimum, **contract.maximum}:
        out["numeric_range", c] = bad_number(c, contract.minimum.get(c), contract.maximum.get(c))
    for c, values in contract.allowed.items():
        out["allowed_values", c] = not_allowed(c, values)
    return {key: bad for key, bad in out.items() if key[1] in present}


def check(df: DataFrame, contract: Contract) -> DataFrame:
    """(check, column_name, failing); `non_empty` fails with 1 on an empty table."""
    checks = _checks(df, contract)
    sums = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(bad).alias(f"c{i}") for i, bad in enumerate(checks.values())]
    )
    rows = [
        F.struct(
            F.lit("required_column").alias("check"), F.lit(c).alias("column_name"),
            F.lit(int(c not in df.columns)).cast("long").alias("failing"),
        )
        for c in contract.required
    ]
    rows.append(
        F.struct(
            F.lit("non_empty").alias("check"), F.lit("*").alias("column_name"),
            (F.col("_rows") == 0).cast("long").alias("failing"),
        )
    )
    for i, (name, column) in enumerate(checks):
        rows.append(
            F.struct(F.lit(name).alias("check"), F.lit(column).alias("column_name"), F.col(f"c{i}").alias("failing"))
        )
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def enforce(df: DataFrame, contract: Contract) -> None:
    """Raises on any failing check; only the short report reaches the driver."""
    missing = missing_columns(df, contract.required)
    if missing:
        raise ContractError(f"{contract.name}: missing columns {missing}")
    failed = [r for r in check(df, contract).collect() if r["failing"]]
    if failed:
        detail = ", ".join(f"{r['check']}({r['column_name']})={r['failing']}" for r in failed)
        raise ContractError(f"{contract.name}: {detail}")


def offenders(df: DataFrame, column: str, values: tuple, limit: int | None = None) -> DataFrame:
    """Distinct values outside the list, with their counts."""
    bad = df.filter(not_allowed(column, values)).groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("rows")
    )
    return bad if limit is None else bad.orderBy(F.desc("rows"), "value").limit(limit)


_MATCH_COLUMNS = ("match_date", "home_team", "away_team", "home_goals", "away_goals", "tournament")

HISTORICAL_RAW = Contract(
    "historical_raw",
    required=("date", "home_team", "away_team", "home_score", "away_score", "tournament"),
    non_null=("date", "home_team", "away_team", "tournament"),
    dates=("date",),
    minimum={"home_score": 0, "away_score": 0},
)
STANDARD_MATCHES = Contract(
    "standardized_matches",
    required=_MATCH_COLUMNS,
    non_null=("match_date", "home_team", "away_team", "tournament"),
    dates=("match_date",),
    minimum={"home_goals": 0, "away_goals": 0},
)
# The columns that the stored tables must have.
FEATURE_DATASET = Contract(
    "feature_dataset",
    required=(*_MATCH_COLUMNS[:5], "elo_home", "elo_away", "elo_diff", "target_multiclass", "target"),
    non_null=(*_MATCH_COLUMNS[:5], "elo_home", "elo_away", "elo_diff", "target_multiclass", "target"),
    dates=("match_date",),
    minimum={"home_goals": 0, "away_goals": 0},
    allowed={"target_multiclass": (-1, 0, 1), "target": (0, 1)},
)
# Fixed values, as above.
_RUN_REQUIRED = (
    "artifact_path", "data_path", "training_rows", "test_rows", "feature_count", "accuracy",
    "macro_f1", "weighted_f1", "log_loss", "trained_at_utc", "persisted_at_utc",
)
TRAINING_RUNS = Contract(
    "training_run_frame",
    required=_RUN_REQUIRED,
    non_null=_RUN_REQUIRED,
    dates=("trained_at_utc", "persisted_at_utc"),
)
# Fixed values, as above.
TRAINING_SUMMARY = Contract(
    "training_summary",
    required=(
        "artifact_path", "data_path", "training_rows", "test_rows", "feature_count",
        "feature_columns_json", "train_date_start", "train_date_end", "test_date_start",
        "test_date_end", "class_distribution_train_json", "class_distribution_test_json",
        "accuracy", "macro_f1", "weighted_f1", "log_loss",
    ),
    minimum={"training_rows": 1, "test_rows": 1, "feature_count": 1, "accuracy": 0, "macro_f1": 0,
             "weighted_f1": 0, "log_loss": 0},
    maximum={"accuracy": 1, "macro_f1": 1, "weighted_f1": 1},
)

BY_TABLE = {
    ("bronze", "historical_matches"): STANDARD_MATCHES,
    ("bronze", "api_matches"): STANDARD_MATCHES,
    ("silver", "matches_cleaned"): STANDARD_MATCHES,
    ("gold", "features_dataset"): FEATURE_DATASET,
    ("gold", "training_runs"): TRAINING_RUNS,
}


def enforce_for_table(df: DataFrame, schema_name: str, table_name: str) -> None:
    """The contract registered for a table; tables without one pass."""
    contract = BY_TABLE.get((schema_name, table_name))
    if contract is not None:
        enforce(df, contract)


# The fields of a prediction result. The probabilities are named by the caller.
PREDICTION_REQUIRED = (
    "home_team", "away_team", "predicted_class", "predicted_outcome", "neutral",
    "feature_snapshot_dates", "feature_source", "model_artifact_path",
)


def prediction_violations(predictions: DataFrame, probabilities: str = "class_probabilities_json") -> DataFrame:
    """Rows whose probabilities are missing, empty or do not sum to 1 within 0.01.

    Missing columns and wrong optional types raise, as they concern every row.
    """
    missing = missing_columns(predictions, (*PREDICTION_REQUIRED, probabilities))
    if missing:
        raise ContractError(f"prediction_result: missing columns {missing}")
    types = {f.name: f.dataType.typeName() for f in predictions.schema.fields}
    for column, kind in (("match_segment", "string"), ("is_override_triggered", "boolean")):
        if types.get(column, kind) not in (kind, "void"):
            raise ContractError(f"prediction_result: {column} must be {kind}, is {types[column]}")
    return predictions.withColumn("probability_sum", _probability_sum(probabilities)).filter(
        F.col("probability_sum").isNull() | ~F.col("probability_sum").between(0.99, 1.01)
    )


def _probability_sum(probabilities: str):
    values = F.map_values(F.from_json(probabilities, "map<string,double>"))
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def split_predictions(predictions: DataFrame, probabilities: str = "class_probabilities_json") -> tuple[DataFrame, DataFrame]:
    """(rows that meet the contract, those of `prediction_violations`)."""
    broken = prediction_violations(predictions, probabilities)
    return predictions.filter(_probability_sum(probabilities).between(0.99, 1.01)), broken


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once (counted map-side first)."""
    return df.groupBy(*key).agg(F.count("*").alias("row_count")).filter(F.col("row_count") > 1)


def schema_tests(
    df: DataFrame, not_null: tuple[str, ...] = (), unique: tuple[str, ...] = (),
    accepted: dict[str, tuple] | None = None,
) -> DataFrame:
    """(test, column_name, failing) of declared column tests."""
    report = check(
        df, Contract("schema_tests", required=(), non_null=not_null, allowed=accepted or {})
    ).filter("check <> 'non_empty'").withColumnRenamed("check", "test")
    for column in unique:
        failing = duplicates(df.filter(F.col(column).isNotNull()), column).agg(F.count("*").alias("failing"))
        report = report.unionByName(
            failing.select(F.lit("unique").alias("test"), F.lit(column).alias("column_name"), "failing")
        )
    return report


def several_runs(snapshots: DataFrame) -> DataFrame:
    """A row when the table mixes pipeline runs, nothing otherwise."""
    return snapshots.agg(F.count_distinct("pipeline_run_id").alias("distinct_pipeline_runs")).filter(
        "distinct_pipeline_runs > 1"
    )


def metrics_out_of_range(runs: DataFrame) -> DataFrame:
    bad = F.col("log_loss") < 0
    for metric in ("accuracy", "macro_f1", "weighted_f1"):
        bad = bad | ~F.col(metric).between(0, 1)
    return runs.filter(bad)


def unaligned_lineage(latest_run: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Latest training runs that the serving table does not carry."""
    served = snapshots.select("pipeline_run_id").distinct()
    return latest_run.select("pipeline_run_id").join(served, "pipeline_run_id", "left_anti")
