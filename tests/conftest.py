import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # Call-site capture for error messages costs a stack walk per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", str(base / "checkpoint"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample(spark):
    from formline import views

    return views.matches(spark, SMALL).persist()


@pytest.fixture(scope="session")
def features(spark, sample):
    from formline.plans.build import feature_table

    return feature_table(sample, ["pool_id"]).persist()


@pytest.fixture
def make_matches(spark):
    def build(rows):
        """rows: (id, day, home, away, home goals, away goals[, tournament])"""
        full = [(*r, "Friendly") if len(r) == 6 else r for r in rows]
        df = spark.createDataFrame(
            full, "match_id long, day string, home_team string, away_team string, home_goals long, away_goals long, tournament string"
        )
        from pyspark.sql import functions as F

        return df.withColumns(
            {"match_date": F.col("day").cast("date"), "kickoff_ts": F.col("day").cast("timestamp_ntz")}
        ).drop("day")

    return build


def by_id(df, *columns):
    return {r["match_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}
