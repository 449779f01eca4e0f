"""Scans: match feeds, feature and report tables, training runs."""

from __future__ import annotations

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.operators import report, standard

# Columns of the historical feed.
HISTORICAL_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("home_team", T.StringType()),
        T.StructField("away_team", T.StringType()),
        T.StructField("home_score", T.LongType()),
        T.StructField("away_score", T.LongType()),
        T.StructField("tournament", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("neutral", T.BooleanType()),
    ]
)

_NAMED = T.StructType([T.StructField("name", T.StringType())])
MATCH_DOCUMENT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("utcDate", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("homeTeam", _NAMED),
        T.StructField("awayTeam", _NAMED),
        T.StructField(
            "score",
            T.StructType(
                [
                    T.StructField(
                        "fullTime",
                        T.StructType([T.StructField("home", T.LongType()), T.StructField("away", T.LongType())]),
                    )
                ]
            ),
        ),
        T.StructField(
            "competition",
            T.StructType([T.StructField("code", T.StringType()), T.StructField("name", T.StringType())]),
        ),
        T.StructField("area", _NAMED),
    ]
)
SNAPSHOT_SCHEMA = T.StructType(
    [T.StructField("matches", T.ArrayType(MATCH_DOCUMENT)), T.StructField("_corrupt_record", T.StringType())]
)


class SourceError(RuntimeError):
    """A source is missing, empty or malformed."""


def read_historical(spark: SparkSession, path: str, keep_unscored: bool = False) -> DataFrame:
    """Historical CSV with a header; `NA` is NULL; fixtures without a score are dropped.

    Columns are matched by name, so extra columns and any order are fine.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in HISTORICAL_SCHEMA.fields if f.name not in header]
    if missing:
        raise SourceError(f"historical feed lacks columns {missing}")
    known = {f.name: f for f in HISTORICAL_SCHEMA.fields}
    schema = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
    rows = spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(path)
    rows = rows.select(*HISTORICAL_SCHEMA.fieldNames())
    return rows if keep_unscored else standard.drop_unscored(rows, ("home_score", "away_score"))


def read_snapshots(spark: SparkSession, pattern: str, multi_line: bool = True) -> DataFrame:
    """Landed match documents; unreadable records keep their text in _corrupt_record.

    A landed download is one JSON object per file (`multi_line`); snapshots written by
    this package have one object per line, which also splits large files.
    """
    return spark.read.schema(SNAPSHOT_SCHEMA).option("multiLine", multi_line).json(pattern)


def match_documents(snapshots: DataFrame) -> DataFrame:
    """One row per document of the readable files."""
    return snapshots.select(F.explode("matches").alias("d")).select("d.*")


def read_api_matches(spark: SparkSession, pattern: str, multi_line: bool = True) -> DataFrame:
    """Flat matches of all landed files; an unreadable file contributes nothing."""
    return standard.standardize_documents(match_documents(read_snapshots(spark, pattern, multi_line)))


def unreadable_files(snapshots: DataFrame) -> DataFrame:
    """Readable and unreadable records (a scan may not ask for the corrupt column alone)."""
    return snapshots.agg(
        F.count_if(F.col("_corrupt_record").isNotNull()).alias("unreadable"),
        F.count_if(F.col("matches").isNotNull()).alias("readable"),
    )


def _checked(df: DataFrame, what: str) -> DataFrame:
    if df.limit(1).isEmpty():
        raise SourceError(f"{what} is empty")
    return df


def read_features(
    spark: SparkSession, path: str | None = None, table: str | None = None, source: str = "auto"
) -> tuple[DataFrame, str]:
    """Feature data set and where it came from: `table`, `file`, or `auto` (table, then file)."""
    if source not in ("auto", "table", "file"):
        raise ValueError(f"unknown feature source {source!r}")
    failure: Exception | None = None
    if source in ("auto", "table") and table is not None:
        try:
            return _checked(spark.table(table), table).withColumn("feature_source", F.lit("table")), "table"
        except (AnalysisException, SourceError) as error:
            if source == "table":
                raise
            failure = error
    if source in ("auto", "file") and path is not None:
        rows = _checked(spark.read.parquet(path), path)
        return rows.withColumn("feature_source", F.lit("file")), "file"
    raise SourceError(f"no feature source could be read ({failure})")


def read_relation(spark: SparkSession, query: str, jdbc: dict[str, str] | None = None) -> DataFrame:
    """Rows of a query, from the catalog or, with options, from a database."""
    if jdbc is None:
        return spark.sql(query)
    return spark.read.format("jdbc").options(**jdbc).option("query", query).load()


# Declared tables -> column that tells when a row was loaded.
DECLARED = {
    "bronze.historical_matches": "persisted_at_utc",
    "bronze.api_matches": "persisted_at_utc",
    "silver.matches_cleaned": "persisted_at_utc",
    "gold.features_dataset": "persisted_at_utc",
    "gold.training_runs": "persisted_at_utc",
}


def read_declared(spark: SparkSession, name: str) -> DataFrame:
    if name not in DECLARED:
        raise SourceError(f"{name} is not a declared source")
    return spark.table(name)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation report (JSON). Missing and malformed reports are different errors."""
    try:
        rows = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
        rows.limit(1).collect()
    except AnalysisException as error:
        raise SourceError(f"report {path} not found") from error
    except PySparkException as error:
        raise SourceError(f"report {path} is not valid JSON") from error
    except Exception as error:
        raise SourceError(f"report {path} could not be parsed") from error
    return rows


def read_latest_run(spark: SparkSession, curated: str, raw: str, source: str = "auto") -> tuple[DataFrame, str]:
    """Newest training run from the curated table, else from the raw one."""
    if source not in ("auto", "curated", "raw"):
        raise ValueError(f"unknown run source {source!r}")
    if source in ("auto", "curated"):
        try:
            rows = _checked(report.latest_run(spark.table(curated)), curated)
            return report.serialise_run(rows).withColumn("run_source", F.lit("curated")), "curated"
        except (AnalysisException, SourceError):
            if source == "curated":
                raise
    rows = _checked(report.latest_run(report.typed_runs(spark.table(raw))), raw)
    return report.serialise_run(rows).withColumn("run_source", F.lit("raw")), "raw"
