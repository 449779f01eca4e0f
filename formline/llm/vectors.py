"""Helpers of the vector operators: rows that take part, batches as matrices, whole groups within tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.llm.common import partitions


def is_finite(vector: Column) -> Column:
    """Whether a vector is not null and holds neither null nor NaN nor infinite components."""
    x = vector.cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & whole, F.lit(False))


def id_and_vector(rows: DataFrame, vector_id: str, vector: str, *others: Column) -> DataFrame:
    """vec_id, v (float components stay float, all else becomes double) and `others`."""
    narrow = rows.schema[vector].dataType.simpleString() == "array<float>"
    v = F.col(vector).cast("array<float>" if narrow else "array<double>")
    return rows.select(F.col(vector_id).cast("long").alias("vec_id"), v.alias("v"), *others)


def longest(rows: DataFrame) -> int:
    """The largest number of components (0 for an empty table)."""
    return rows.agg(F.max(F.size("v"))).first()[0] or 0


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """List column as float64 rows, shorter vectors filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def scaled_integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64; values outside its range become its ends."""
    big = float(2**63)
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    out = np.where(np.abs(scaled) < big, scaled, 0).astype(np.int64)
    out[scaled >= big] = np.iinfo(np.int64).max
    out[scaled <= -big] = np.iinfo(np.int64).min
    return out


def groups_in_tasks(rows: DataFrame, by: list[str], look: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]],
                    schema: str, held_rows: int = 16_384) -> DataFrame:
    """`look` (rows, where each group starts) on whole groups, some groups at a time.

    A task holds at most its largest group and `held_rows` more, so callers bound their groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= held_rows:
                table = pa.Table.from_batches(held)
                starts = _starts(table, by)
                if starts[-1]:
                    yield from look(table.slice(0, starts[-1]), starts[:-1])
                held = table.slice(starts[-1]).to_batches()
                size = table.num_rows - starts[-1]
        if held:
            table = pa.Table.from_batches(held)
            yield from look(table, _starts(table, by))

    dealt = rows.repartition(partitions(rows.sparkSession), *by)
    return dealt.sortWithinPartitions(*by).mapInArrow(run, schema)


def _starts(table: pa.Table, by: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in by:
        values = table.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)
