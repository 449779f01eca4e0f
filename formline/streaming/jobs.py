"""Streaming forms of batch operators: ingest with dedup, hourly view, ratings."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.operators import monitor, ratings, standard
from formline.sources.readers import MATCH_DOCUMENT


def stream_match_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Landed JSON files as a stream of flat matches, with the arrival-independent event time."""
    schema = T.StructType([T.StructField("matches", T.ArrayType(MATCH_DOCUMENT))])
    files = spark.readStream.schema(schema).json(folder)
    documents = files.select(F.explode("matches").alias("d")).select("d.*")
    flat = standard.standardize_documents(documents)
    return flat.withColumn("event_time", F.col("match_date").cast("timestamp"))


def dedup_matches(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """First arrival of every match key inside the watermark."""
    return stream.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(list(standard.DEDUP_KEY))


def run_to_parquet(rows: DataFrame, output: str, checkpoint: str) -> None:
    """Appends everything available now to Parquet."""
    query = (
        rows.writeStream.outputMode("append").format("parquet").option("path", output)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_ingest(spark: SparkSession, folder: str, output: str, checkpoint: str) -> None:
    """All files present so far, first arrival of every match, as Parquet. Restartable.

    A micro-batch is first deduplicated with a map-side combined minimum, so a match with
    very many copies does not meet in one state partition; then matches of earlier batches
    are left out. The output is the state: one folder per batch and day, a batch overwritten on a
    repeat, and only folders of the batch's days are read back.
    """
    flat = stream_match_documents(spark, folder).drop("event_time")
    key = list(standard.DEDUP_KEY)

    def apply(batch: DataFrame, batch_id: int) -> None:
        fresh = standard.deduplicate(batch, tuple(key), order=tuple(batch.columns))
        days = [r[0] for r in batch.select("match_date").distinct().collect()]
        if not days:
            return
        if batch_id > 0:
            layout = T.StructType([*batch.schema.fields, T.StructField("batch", T.IntegerType())])
            day = F.col("match_date")
            asked = day.isin([d for d in days if d is not None])
            known = spark.read.schema(layout).parquet(output).filter(
                (F.col("batch") < batch_id) & (asked | day.isNull() if None in days else asked))
            seen = known.select(*[F.col(c).alias(f"_{c}") for c in key])
            same = [fresh[c].eqNullSafe(seen[f"_{c}"]) for c in key]
            fresh = fresh.join(seen, reduce(and_, same), "left_anti")
        fresh.write.mode("overwrite").partitionBy("match_date").parquet(f"{output}/batch={batch_id}")

    query = (
        flat.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def hourly_performance(log_stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """The hourly ensemble view; rows later than the watermark are left out."""
    return (
        log_stream.withWatermark("timestamp_utc", delay)
        .groupBy(F.window("timestamp_utc", "1 hour"), "match_segment")
        .agg(*monitor.performance_aggregates())
        .select(F.col("window.start").alias("hour"), "match_segment", *_PERFORMANCE)
    )


_PERFORMANCE = (
    "total_predictions", "specialist_overrides", "override_rate_pct", "home_wins", "draws", "away_wins",
    "avg_home_win_prob", "avg_draw_prob", "avg_away_win_prob",
)


def run_hourly(spark: SparkSession, log_folder: str, schema: T.StructType, output: str, checkpoint: str) -> None:
    """Append mode: an hour is written once the watermark has passed it."""
    stream = spark.readStream.schema(schema).parquet(log_folder)
    run_to_parquet(hourly_performance(stream), output, checkpoint)


class RatingStream:
    """Ratings kept up to date by micro-batches.

    Every batch is cut into periods and applied with the period update. The state after
    batch n is the folder state/n, and the ratings of its matches rated/n; a repeated batch
    overwrites the same folders from the same input state, so a restart changes nothing. Late
    matches are rated from the state they meet; they cause no decay and leave the last match day.
    """

    def __init__(self, spark: SparkSession, folder: str, period: str = "match_date",
                 decay: bool = True):
        self.spark, self.folder, self.period, self.decay = spark, folder, period, decay

    def _state(self, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return self.spark.createDataFrame([], "team string, rating double, last_day int")
        return self.spark.read.parquet(f"{self.folder}/state/{batch_id - 1}")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        staged = f"{self.folder}/batch/{batch_id}"
        batch.write.mode("overwrite").parquet(staged)
        rows = self.spark.read.parquet(staged)
        state = self._state(batch_id)
        if rows.isEmpty():
            state.write.mode("overwrite").parquet(f"{self.folder}/state/{batch_id}")
            return
        prepared = ratings.prepared_periods(rows, F.col(self.period).cast("string"))
        values = sorted(r[0] for r in prepared.select("period").distinct().collect())
        for number, value in enumerate(values):
            part = prepared.filter(F.col("period") == value).drop("period")
            rated_path = f"{self.folder}/rated/{batch_id}/n={number}"
            ratings.rate_period(state, part, self.decay).write.mode("overwrite").parquet(rated_path)
            rated = self.spark.read.parquet(rated_path)
            target = f"{self.folder}/work/{batch_id}/{number}" if number + 1 < len(values) else f"{self.folder}/state/{batch_id}"
            ratings.next_state(state, rated, self.decay).write.mode("overwrite").parquet(target)
            state = self.spark.read.parquet(target)

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        query = (
            stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()

    def ratings(self) -> DataFrame:
        paths = f"{self.folder}/rated/*/n=*"
        return self.spark.read.parquet(paths).select("match_id", "elo_home", "elo_away")
