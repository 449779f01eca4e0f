"""Writes: layer files, tables with lineage, snapshots, logs, reports, models."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.operators import quality

IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
MODES = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}


def write_layer(df: DataFrame, path: str, day: str = "match_date") -> None:
    """Layer as Parquet, one folder per year, so that date filters skip files.

    Rows are spread inside a year as well: a year is split over several writers when
    it is large, and a small one ends in few files.
    """
    with_year = df.withColumn("year", F.year(day))
    with_year.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(path)


def checked_name(name: str) -> str:
    if not IDENTIFIER.match(name):
        raise ValueError(f"{name!r} is not a plain identifier")
    return name


def create_schema(spark: SparkSession, schema_name: str, location: str | None = None) -> None:
    where = f" location '{location}'" if location else ""
    spark.sql(f"create database if not exists {checked_name(schema_name)}{where}")


def with_lineage(df: DataFrame, pipeline_run_id: str | None) -> DataFrame:
    return df.withColumns(
        {"pipeline_run_id": F.lit(pipeline_run_id).cast("string"), "persisted_at_utc": F.current_timestamp()}
    )


def persist_table(
    df: DataFrame,
    schema_name: str,
    table_name: str,
    if_exists: str = "replace",
    pipeline_run_id: str | None = None,
    validate: bool = True,
    location: str | None = None,
) -> str:
    """Adds lineage columns, checks the table's contract, creates the schema, writes.

    `location` is where a schema that does not exist yet keeps its tables.
    """
    if if_exists not in MODES:
        raise ValueError(f"if_exists must be one of {sorted(MODES)}")
    name = f"{checked_name(schema_name)}.{checked_name(table_name)}"
    rows = with_lineage(df, pipeline_run_id)
    if validate:
        quality.enforce_for_table(rows, schema_name, table_name)
    create_schema(df.sparkSession, schema_name, location)
    rows.write.mode(MODES[if_exists]).saveAsTable(name)
    return name


def persist_jdbc(df: DataFrame, table: str, options: dict[str, str], if_exists: str = "append", writers: int = 8) -> None:
    """The same to a database: batches of 1000 rows over a bounded number of connections."""
    (
        df.write.format("jdbc").options(**options)
        .option("dbtable", table).option("batchsize", 1000).option("numPartitions", writers)
        .mode(MODES[if_exists]).save()
    )


def write_snapshot(documents: DataFrame, folder: str, at: datetime | None = None) -> str:
    """Documents kept as JSON under a time-stamped name, one `matches` array per line."""
    stamp = (at or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
    path = f"{folder}/api_international_matches_{stamp}"
    packed = documents.select(F.array(F.struct(*documents.columns)).alias("matches"))
    packed.write.mode("overwrite").json(path)
    return path


def training_run_row(spark: SparkSession, summary: dict, pipeline_run_id: str | None = None) -> DataFrame:
    """Nested training summary as one row; lists and maps become JSON text."""
    flat: dict[str, object] = {"pipeline_run_id": pipeline_run_id}
    for key, value in summary.items():
        if key.endswith("_date_range"):
            flat[key.replace("_range", "_start")] = value["start"]
            flat[key.replace("_range", "_end")] = value["end"]
        elif key == "metrics":
            for name, metric in value.items():
                if isinstance(metric, (dict, list)):
                    flat[f"{name}_json"] = json.dumps(metric)
                else:
                    flat[name] = float(metric)
        elif isinstance(value, (dict, list)):
            flat[f"{key}_json"] = json.dumps(value)
        else:
            flat[key] = value
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    flat.setdefault("trained_at_utc", now)
    flat["persisted_at_utc"] = now
    kinds = {bool: "boolean", int: "long", float: "double"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in flat.items())
    return spark.createDataFrame([tuple(flat.values())], schema)


def append_training_run(spark: SparkSession, summary: dict, table: str, pipeline_run_id: str | None = None) -> DataFrame:
    row = training_run_row(spark, summary, pipeline_run_id)
    quality.enforce(row, quality.TRAINING_RUNS)
    row.write.mode("append").option("mergeSchema", True).saveAsTable(table)
    return row


# Columns of the inference log.
LOG_COLUMNS = (
    "request_id", "timestamp_utc", "requested_match_date", "home_team", "away_team", "neutral",
    "tournament", "predicted_class", "predicted_outcome", "class_probabilities_json",
    "feature_snapshot_dates_json", "feature_source", "model_artifact_path", "model_version",
    "match_segment", "is_override_triggered", "shadow_predicted_outcome",
    "shadow_class_probabilities_json", "shadow_is_override_triggered", "shadow_model_name",
    "persisted_at_utc",
)


def log_rows(
    scored: DataFrame, artifact_path: str, at: datetime, model_version: str | None = None,
    requested_date: str | None = None,
) -> DataFrame:
    """Scored fixtures in the layout of the inference log."""
    moment = F.lit(at.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
    asked = F.col(requested_date) if requested_date else F.lit(None)
    dates = F.struct(
        F.col("home_snapshot_date").cast("string").alias("home_team"),
        F.col("away_snapshot_date").cast("string").alias("away_team"),
    )
    return scored.withColumns(
        {
            "request_id": F.concat_ws("_", "home_team", "away_team", F.lit(str(at.timestamp()))),
            "timestamp_utc": moment,
            "requested_match_date": asked.cast("date"),
            "feature_snapshot_dates_json": F.to_json(dates),
            "model_artifact_path": F.lit(artifact_path),
            "model_version": F.lit(model_version or "unknown"),
            "is_override_triggered": F.coalesce("is_override_triggered", F.lit(False)),
            "persisted_at_utc": F.current_timestamp(),
        }
    ).select(*LOG_COLUMNS)


def append_log(rows: DataFrame, path: str, run_id: str | None = None) -> str | None:
    """Appends to the log, partitioned by day. A failure is returned, never raised,
    because scoring must not fail over logging. New columns are read by schema merging.

    With a `run_id` the run's rows have folders of their own, staged and moved in when the write ends: a
    killed write shows nothing, and a repeated one replaces its own rows. A log has run ids for all or for no rows.
    """
    try:
        days = rows.withColumn("log_date", F.to_date("timestamp_utc"))
        if run_id is None:
            days.write.mode("append").partitionBy("log_date").parquet(path)
        else:
            (days.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("log_date", "run_id").parquet(path))
    except Exception as error:  # noqa: BLE001
        return f"{type(error).__name__}: {error}"
    return None


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A small report frame as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def load_csv_table(
    spark: SparkSession, csv_path: str, schema_name: str, table_name: str, schema: str | None = None,
    location: str | None = None,
) -> int:
    """Drops and reloads a table from CSV. The count comes from the stored file footers."""
    reader = spark.read.option("header", True)
    rows = (reader.schema(schema) if schema else reader).csv(csv_path)
    create_schema(spark, schema_name, location)
    name = f"{schema_name}.{checked_name(table_name)}"
    rows.write.mode("overwrite").saveAsTable(name)
    return spark.table(name).count()
