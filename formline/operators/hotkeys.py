"""Windows over keys that may hold a large share of all rows.

A window partition is one task. When a key has more rows than one task should
sort, its rows are cut into consecutive time slices, and every slice gets a copy
of the few rows just before it (the halo), so that a frame of bounded width sees
exactly the rows it would see over the whole key. Keys below the limit stay in
one piece and cost nothing extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline.sources.folders import stored

SLICE = "_slice"
HALO = "_halo"
ROWS_PER_SLICE = 5_000_000
UNITS = ("day", "hour", "minute", "second", "millisecond", "microsecond")


def has_hot_keys(df: DataFrame, key: str, limit: int) -> bool:
    """One narrow, map-side combined count; only a yes or no reaches the driver."""
    return not df.groupBy(key).count().filter(F.col("count") > limit).limit(1).isEmpty()


def finest_unit(df: DataFrame, keys: list[str], time: str, limit: int) -> str:
    """Coarsest calendar unit in which no key has more than `limit` rows."""
    for unit in UNITS:
        start = F.date_trunc(unit, F.col(time)).alias("_unit")
        if df.groupBy(*keys, start).count().filter(F.col("count") > limit).limit(1).isEmpty():
            return unit
    return UNITS[-1]


def time_slices(df: DataFrame, key: str, time: str, limit: int) -> DataFrame | None:
    """(key, unit, unit start, slice) for the keys with more than `limit` rows, or None.

    A slice ends when it has reached `limit` rows at a unit boundary. The table has at
    most one row per hot key and calendar unit with rows.
    """
    if not has_hot_keys(df, key, limit):
        return None
    unit = finest_unit(df, [key], time, limit)
    hot = df.groupBy(key).count().filter(F.col("count") > limit).select(key)
    per_unit = df.groupBy(key, F.date_trunc(unit, F.col(time)).alias("_unit")).count()
    before = Window.partitionBy(key).orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    number = F.floor(F.coalesce(F.sum("count").over(before), F.lit(0)) / limit)
    slices = per_unit.join(hot, key, "left_semi").select(
        key, "_unit", number.alias(SLICE), F.lit(unit).alias("_unit_name")
    )
    # Small, but the outcome of a pass over everything, and used several times.
    return stored(slices)


def assign_slices(df: DataFrame, key: str, time: str, slices: DataFrame | None) -> DataFrame:
    """Adds the slice number; 0 for every key that is not hot."""
    if slices is None:
        return df.withColumn(SLICE, F.lit(0).cast("long"))
    unit = slices.select("_unit_name").first()[0]
    tagged = df.withColumn("_unit", F.date_trunc(unit, F.col(time)))
    return (
        tagged.join(slices.drop("_unit_name"), [key, "_unit"], "left")
        .withColumn(SLICE, F.coalesce(SLICE, F.lit(0).cast("long")))
        .drop("_unit")
    )


def _tail_per_slice(rows: DataFrame, group: list[str], order: list[str], width: int) -> DataFrame:
    """The last `width` rows of every (group, slice), packed in time order.

    The row-number filter is applied before the shuffle as well (window group
    limit), so at most `width` rows per slice leave each input partition.
    """
    latest = Window.partitionBy(*group, SLICE).orderBy(*[F.col(c).desc() for c in order])
    last = rows.withColumn("_n", F.row_number().over(latest)).filter(F.col("_n") <= width).drop("_n")
    ordered = F.struct(*order, F.struct(*rows.columns).alias("row"))
    return last.groupBy(*group, SLICE).agg(
        F.transform(F.sort_array(F.collect_list(ordered)), lambda x: x["row"]).alias("_tail")
    )


def with_halo(
    rows: DataFrame,
    key: str,
    groups: list[list[str]],
    order: list[str],
    width: int,
    slices: DataFrame | None,
) -> DataFrame:
    """Rows plus, per slice, copies of the `width` rows before it in every group.

    `rows` carries the slice column and a unique id as the last of `order`. Each
    group starts with `key`. Copies have the halo flag set.
    """
    flagged = rows.withColumn(HALO, F.lit(False))
    if slices is None:
        return flagged
    hot = rows.join(slices.select(key).distinct(), key, "left_semi")
    copies = None
    for group in groups:
        tails = _tail_per_slice(hot, group, order, width)
        # Every slice that has rows of the group contributes at least one, so the
        # last `width` rows lie within the `width` preceding slices.
        earlier = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(-width, -1)
        carried = tails.withColumn("_before", F.flatten(F.collect_list("_tail").over(earlier)))
        kept = F.greatest(F.least(F.size("_before"), F.lit(width)), F.lit(1))
        last = F.when(F.size("_before") > 0, F.slice("_before", -kept, kept))
        part = carried.select(F.col(SLICE).alias("_target"), F.explode(last).alias("row")).select(
            "row.*", "_target"
        )
        copies = part if copies is None else copies.unionByName(part)
    assert copies is not None
    copies = (
        copies.drop(SLICE)
        .withColumnRenamed("_target", SLICE)
        .dropDuplicates([key, SLICE, *order])
        .withColumn(HALO, F.lit(True))
    )
    return flagged.unionByName(copies)


def without_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(HALO)).drop(HALO, SLICE)
