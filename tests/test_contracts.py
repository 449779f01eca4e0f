import pytest
from pyspark.sql import functions as F

from formline.operators import quality

RAW = "date string, home_team string, away_team string, home_score string, away_score string, tournament string"


def test_valid_raw_frame_passes(spark):
    quality.enforce(spark.createDataFrame([("2024-01-01", "A", "B", "1", "0", "Friendly")], RAW), quality.HISTORICAL_RAW)


@pytest.mark.parametrize("row,word", [
    (("2024-01-01", "A", None, "1", "0", "F"), "non_null"), (("soon", "A", "B", "1", "0", "F"), "parseable_date"),
    (("2024-01-01", "A", "B", "-1", "0", "F"), "numeric_range"), (("2024-01-01", "A", "B", "x", "0", "F"), "numeric_range"),
])
def test_broken_raw_frames(spark, row, word):
    with pytest.raises(quality.ContractError, match=word):
        quality.enforce(spark.createDataFrame([row], RAW), quality.HISTORICAL_RAW)


def test_missing_column_and_empty_table(spark):
    df = spark.createDataFrame([("2024-01-01",)], "date string")
    with pytest.raises(quality.ContractError, match="missing columns"):
        quality.enforce(df, quality.HISTORICAL_RAW)
    with pytest.raises(quality.ContractError, match="non_empty"):
        quality.enforce(spark.createDataFrame([], RAW), quality.HISTORICAL_RAW)


def test_feature_contract(features):
    quality.enforce(features, quality.FEATURE_DATASET)
    with pytest.raises(quality.ContractError, match="allowed_values"):
        quality.enforce(features.withColumn("target", F.lit(3)), quality.FEATURE_DATASET)


def test_prediction_contract(spark):
    df = spark.createDataFrame(
        [(1, '{"a": 0.5, "b": 0.5}', None), (2, '{"a": 0.5}', "x"), (3, None, "x"), (4, "{}", None)],
        "id int, class_probabilities_json string, match_segment string")
    with pytest.raises(quality.ContractError, match="feature_snapshot_dates"):
        quality.prediction_violations(df)
    df = df.withColumns({c: F.lit("x") for c in quality.PREDICTION_REQUIRED})
    assert {r["id"] for r in quality.prediction_violations(df).collect()} == {2, 3, 4}
    with pytest.raises(quality.ContractError):
        quality.prediction_violations(df.withColumn("match_segment", F.lit(1)))


def test_lineage_and_runs(spark):
    served = spark.createDataFrame([("r1",), ("r2",)], "pipeline_run_id string")
    assert quality.several_runs(served).count() == 1
    assert quality.several_runs(served.limit(1)).isEmpty()
    assert quality.unaligned_lineage(spark.createDataFrame([("r9",)], "pipeline_run_id string"), served).count() == 1
