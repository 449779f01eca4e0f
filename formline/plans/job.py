"""The whole run: ingest, process, train, with stage skipping and one run id."""

from __future__ import annotations

import time
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.operators import ordered, quality, standard
from formline.plans import build, training
from formline.plans.models import Candidate
from formline.sources import readers, sinks

STAGES = ("ingest", "process", "train")


def identified(rows: DataFrame) -> DataFrame:
    """Adds what the feeds lack: `kickoff_ts` (midnight of the day) and `match_id`, the chronological position.

    Rows must be free of duplicates, so that the deduplication key orders them completely.
    """
    if "kickoff_ts" not in rows.columns:
        rows = rows.withColumn("kickoff_ts", F.col("match_date").cast("timestamp_ntz"))
    if "match_id" not in rows.columns:
        rows = ordered.with_row_index(rows, ["kickoff_ts", *standard.DEDUP_KEY], "match_id")
    return rows


def _ingest(historical: DataFrame, api: DataFrame | None, folder: str, era_start: date) -> None:
    """Both feeds as bronze layers; scored matches of the era, without duplicates, as the silver layer.

    Fixtures without a score are no fault of a feed, so contracts are checked after they are dropped.
    """
    feeds = {"historical": historical} | ({"api": api} if api is not None else {})
    scored = {}
    for name, feed in feeds.items():
        sinks.write_layer(feed, f"{folder}/bronze/{name}")
        stored = feed.sparkSession.read.parquet(f"{folder}/bronze/{name}").drop("year")
        scored[name] = standard.drop_unscored(stored)
        quality.enforce(scored[name], quality.STANDARD_MATCHES)
    if api is not None:
        rows = standard.union_feeds(scored["historical"], scored["api"])
    else:
        rows = scored["historical"].withColumn("source_priority", F.lit(1))
    tie = ("match_id",) if "match_id" in rows.columns else ("tournament", "city", "country")
    rows = standard.from_era(standard.deduplicate(rows, order=("source_priority", *tie)), era_start)
    sinks.write_layer(identified(rows), f"{folder}/silver")


def from_sources(spark: SparkSession, historical_path: str, snapshots: str | None, folder: str, multi_line: bool = True,
                 **options) -> DataFrame:
    """`run` from the feeds' files: the historical CSV and landed match documents of the service.

    Documents of national teams in international competitions are kept, and kept raw as a snapshot as well.
    """
    historical = standard.standardize_historical(readers.read_historical(spark, historical_path, keep_unscored=True))
    api = None
    if snapshots is not None:
        documents = readers.match_documents(readers.read_snapshots(spark, snapshots, multi_line)).withColumns({
            "competition_code": F.col("competition.code"), "home_team": F.col("homeTeam.name"),
            "away_team": F.col("awayTeam.name")})
        kept = standard.international_filter(documents).drop("competition_code", "home_team", "away_team")
        raw = sinks.write_snapshot(kept, f"{folder}/raw")
        stored = readers.match_documents(readers.read_snapshots(spark, raw, multi_line=False))
        api = standard.standardize_documents(stored)
    return run(spark, historical, api, folder, **options)


def run(
    spark: SparkSession,
    historical: DataFrame,
    api: DataFrame | None,
    folder: str,
    pool: list[str] | None = None,
    candidates: list[Candidate] | None = None,
    splits: int = 5,
    skip: tuple[str, ...] = (),
    era_start: date = date(1990, 1, 1),
    run_id: str | None = None,
    test_size: float = 0.2,
    calibration_size: float = 0.1,
) -> DataFrame:
    """Runs the stages and returns one row per stage (status, seconds, rows, detail).

    A skipped stage leaves the layer of an earlier run in place.
    """
    unknown = set(skip) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages {sorted(unknown)}")
    run_id = run_id or uuid.uuid4().hex
    report: list[tuple] = []

    def stage(name: str, work) -> None:
        if name in skip:
            report.append((run_id, name, "skipped", 0.0, None, None))
            return
        start = time.time()
        rows, detail = work()
        report.append((run_id, name, "done", time.time() - start, rows, detail))

    def ingest():
        _ingest(historical, api, folder, era_start)
        # Counted from the file footers, not by another pass over the rows.
        return spark.read.parquet(f"{folder}/silver").count(), None

    def process():
        silver = spark.read.parquet(f"{folder}/silver").drop("year")
        gold = sinks.with_lineage(build.feature_table(silver, pool, checkpoint_folder=f"{folder}/work"), run_id)
        sinks.write_layer(gold, f"{folder}/gold")
        stored = spark.read.parquet(f"{folder}/gold")
        quality.enforce(stored, quality.FEATURE_DATASET)
        return stored.count(), None

    def train():
        gold = spark.read.parquet(f"{folder}/gold").drop("year", "source_priority")
        out = training.train_and_select(
            gold, candidates, splits, test_size, calibration_size, model_folder=f"{folder}/models"
        )
        sinks.write_report(out["test_metrics"], f"{folder}/reports/test_metrics")
        sinks.write_report(out["ranking"], f"{folder}/reports/ranking")
        for name, table in training.report_tables(out).items():
            sinks.write_report(table, f"{folder}/reports/{name}")
        scored = out["test_metrics"].first()
        about = out["summary"]
        row = sinks.training_run_row(spark, {
            "artifact_path": f"{folder}/models/production", "data_path": f"{folder}/gold",
            "training_rows": gold.count() - scored["n"], "test_rows": scored["n"],
            "feature_count": len(about["feature_columns"]), **about,
            "metrics": {m: scored[m] for m in ("accuracy", "macro_f1", "weighted_f1", "log_loss")}}, run_id)
        quality.enforce(row, quality.TRAINING_RUNS)
        row.write.mode("append").parquet(f"{folder}/reports/training_runs")
        return scored["n"], f"{about['selected_model_name']} macro_f1={scored['macro_f1']:.4f}"

    for name, work in (("ingest", ingest), ("process", process), ("train", train)):
        stage(name, work)
    return spark.createDataFrame(
        report, "run_id string, stage string, status string, seconds double, rows long, detail string"
    )
