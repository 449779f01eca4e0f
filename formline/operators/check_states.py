"""Contract checks of a growing table, day by day.

Failing rows of every check are counted per day and written once; a report adds the days up. After an append or a rewrite
only the days it touched are counted again, and their filter reaches the scan. Rows without a day have a state of
their own (`NO_DAY`). A day that lost all its rows gets a state of zero rows, and an empty table fails `non_empty` as before.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.operators import quality

NO_DAY = "none"


def day_states(df: DataFrame, contract: quality.Contract, day: str, days: list[date | None] | None = None) -> DataFrame:
    """state_day, check, column_name, failing, rows for the given days, or for all."""
    if days is not None:
        known = [d for d in days if d is not None]
        wanted = F.col(day).isin(known) if known else F.lit(False)
        df = df.filter(wanted | F.col(day).isNull() if None in days else wanted)
    checks = quality._checks(df, contract)
    key = F.coalesce(F.col(day).cast("string"), F.lit(NO_DAY))
    sums = df.groupBy(key.alias("state_day")).agg(
        F.count("*").alias("rows"), *[F.count_if(bad).alias(f"c{i}") for i, bad in enumerate(checks.values())])
    asked = sorted({str(d) if d is not None else NO_DAY for d in days}) if days is not None else [NO_DAY]
    none = df.sparkSession.createDataFrame([(d,) for d in asked], "state_day string")
    sums = sums.unionByName(none.join(sums, "state_day", "left_anti"), allowMissingColumns=True).fillna(0)

    def row(name, column, failing):
        return F.struct(F.lit(name).alias("check"), F.lit(column).alias("column_name"), failing.cast("long").alias("failing"))

    each = [row("required_column", c, F.lit(int(c not in df.columns))) for c in contract.required]
    each += [row(name, column, F.col(f"c{i}")) for i, (name, column) in enumerate(checks)]
    each.append(row("non_empty", "*", F.lit(0)))
    return sums.select("state_day", "rows", F.inline(F.array(*each)))


def refresh(df: DataFrame, contract: quality.Contract, day: str, folder: str, days: list[date | None] | None = None) -> None:
    """Writes the states of the given days anew and leaves the others; repeating it changes nothing."""
    (day_states(df, contract, day, days).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("state_day").parquet(folder))


def report(spark: SparkSession, folder: str) -> DataFrame:
    """What `quality.check` reports on the whole table."""
    name = F.col("check")
    failing = F.when(name == "non_empty", (F.sum("rows") == 0).cast("long")).when(
        name == "required_column", F.max("failing")).otherwise(F.sum("failing"))
    return spark.read.parquet(folder).groupBy("check", "column_name").agg(failing.alias("failing"))
