"""Statistics from hourly states equal those from the log."""

import pytest
from pyspark.sql import functions as F

from formline import views
from formline.operators import monitor, rollups
from tests.conftest import SMALL

AS_OF = "2024-01-31 00:00:00"


@pytest.fixture(scope="module")
def log(spark):
    rows = views.inference_log(spark, SMALL)
    kind = rows.schema["timestamp_utc"].dataType
    # Every seventh entry exactly on the hour, some without probabilities, source or segment.
    hour = F.date_trunc("hour", "timestamp_utc").cast(kind)
    return rows.withColumns({
        "timestamp_utc": F.when(F.col("match_id") % 7 == 0, hour).otherwise(F.col("timestamp_utc")),
        "class_probabilities_json": F.when(F.col("match_id") % 11 != 0, F.col("class_probabilities_json")),
        "feature_source": F.when(F.col("match_id") % 13 != 0, F.col("feature_source"))}).persist()


@pytest.fixture(scope="module")
def folder(spark, log, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rollups"))
    for run in (0, 1, 1):
        rollups.append(log.filter(F.col("match_id") % 2 == run), path, f"run-{run}")
    return path


def rows_of(df):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("as_of,hours", [(AS_OF, 1), (AS_OF, 24), (AS_OF, 720), ("2024-01-30 13:17:05", 5), ("2024-01-20 00:30:00", 720), ("2031-01-01 00:00:00", 3)])
def test_windows_equal_the_log(spark, log, folder, as_of, hours):
    states, values = rollups.window(spark, folder, as_of, hours, log)
    recent = monitor.look_back(log, as_of, hours=hours)
    assert rows_of(rollups.inference_statistics(states, values)) == rows_of(monitor.inference_statistics(recent))
    for name in ("segment_shadow_performance", "hourly_performance", "outcome_distribution", "shadow_matrix", "version_summary"):
        assert rows_of(getattr(rollups, name)(states)) == rows_of(getattr(monitor, name)(recent)), name


def test_a_window_on_the_hour_reads_states_only(spark, folder):
    states, _ = rollups.window(spark, folder, AS_OF, 48)
    assert all("/states/" in f for f in rollups.version_summary(states).inputFiles())
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-29" in plan
    assert states.select(F.min("day").cast("string")).first()[0] >= "2024-01-29"


def test_a_start_inside_an_hour_needs_the_log(spark, folder):
    with pytest.raises(ValueError, match="inside an hour"):
        rollups.window(spark, folder, "2024-01-30 13:17:05", 5)
    with pytest.raises(ValueError, match="within"):
        rollups.window(spark, folder, AS_OF, 721)
