"""Shards by a Feistel permutation of global row numbers, with DataFrame functions only.

Rows are numbered 0..n-1 in the order of (doc_id, checksum, size). A keyed permutation of 0..n-1
gives each row a place; shard = place mod shards, slot = place div shards. So shard sizes differ
by one row at most, slots have no gaps, and place, shard and slot of any row number can be
computed without the table.

The permutation is an additive Feistel network over pairs (l, r) with l < a, r < b. The radices
are chosen so that a*b exceeds n by little and neither is small, as each half is shifted by a hash of the
other and a half of one value would only rotate the rows; a place outside 0..n-1 walks on along its cycle. A walk
visits each of the a*b - n outside places once at most, which bounds it, and rows that are inside
at once carry an empty walk.

Defined cases: null text has no bytes; null ids sort first; rows equal in id, checksum and size are
numbered by where the scan met them; an empty table gives an empty result. Only doc_id and text are
read, so other columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.llm.common import id_and_text, partitions, store

ROUNDS = 6


def radices(n: int, tries: int | None = None) -> tuple[int, int]:
    """a <= b with the smallest a*b >= n among all a above a quarter of the square root of n (the last `tries` of them)."""
    root = math.isqrt(max(n, 1) - 1) + 1
    least = root // 4 + 1 if tries is None else max(1, root - tries)
    best = min(range(least, root + 1), key=lambda a: (-(-n // a) * a - n, -a))
    return best, max(1, -(-n // best))


def _network(x: Column, a: int, b: int, seed: int) -> Column:
    right = F.pmod(x, F.lit(b))
    left = ((x - right) / F.lit(b)).cast("long")
    for turn in range(ROUNDS):
        key = F.lit(seed * 1000 + turn)
        if turn % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(right, key), F.lit(a)), F.lit(a))
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(left, key), F.lit(b)), F.lit(b))
    return left * F.lit(b) + right


def permute(x: Column, n: int, seed: int) -> Column:
    """The place of row number x (0 <= x < n) in the permutation of 0..n-1 that `seed` names."""
    a, b = radices(n)
    outside = a * b - n
    once = _network(x, a, b, seed)
    if outside == 0:
        return once
    steps = F.when(once < n, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.lit(outside)))
    return F.aggregate(steps, once, lambda at, _: F.when(at < n, at).otherwise(_network(at, a, b, seed)))


def number_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `row_number` (long, from 0) in the order of the columns; one range shuffle, no global window."""
    spark = rows.sparkSession
    # The scan position breaks ties between equal rows, so that a hot value spreads over ranges.
    placed = rows.withColumn("_at", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in [*order, "_at"]]
    ranged = placed.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    kept = store(ranged.drop("_at").withColumn("_local", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_local", 33)
    # One row per shuffle partition: a count that the session sets, not the data.
    sizes = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).collect()
    start, starts = 0, {}
    for size in sorted(sizes, key=lambda r: r["_part"]):
        starts[size["_part"]] = start
        start += size["_n"]
    if not starts:
        return kept.withColumn("row_number", F.col("_local")).drop("_local")
    base = spark.createDataFrame(sorted(starts.items()), "_part long, _start long")
    return (
        kept.withColumn("_part", part).join(F.broadcast(base), "_part")
        .withColumn("row_number", F.col("_start") + F.col("_local").bitwiseAND(F.lit(2**33 - 1)))
        .drop("_part", "_local", "_start")
    )


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, row_number, place, shard, slot for every row of `docs`."""
    sized = id_and_text(docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    numbered = number_rows(sized, ["doc_id", "text_crc32", "size"])
    n = numbered.count()
    placed = numbered.withColumn("place", permute(F.col("row_number"), max(n, 1), seed))
    return placed.withColumns({
        "shard": F.pmod("place", F.lit(shards)).cast("int"),
        "slot": ((F.col("place") - F.pmod("place", F.lit(shards))) / shards).cast("long"),
    })
