"""Preparation of model inputs as a pipeline stage: exact median imputation and, for linear models, standardisation.

Medians are exact and interpolated, deviations are of the population, and all values live in the fitted stage,
which is saved and loaded inside a `PipelineModel` like any other. A transform is one array expression.
"""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.operators import ordered


class PreparedInputs(Model, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fills missing values with `medians` and maps x to (x - mean) / deviation."""

    medians = Param(Params._dummy(), "medians", "value for missing entries", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "subtracted values", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "divisors", TypeConverters.toListFloat)

    def filled(self) -> list[Column]:
        return [F.coalesce(F.col(c), F.lit(m)) for c, m in zip(self.getInputCols(), self.getOrDefault(self.medians))]

    def values(self) -> list[Column]:
        """The prepared inputs as columns."""
        limits = zip(self.filled(), self.getOrDefault(self.means), self.getOrDefault(self.deviations))
        return [value if (mean, deviation) == (0.0, 1.0) else (value - mean) / deviation for value, mean, deviation in limits]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), array_to_vector(F.array(*self.values())))


class InputPreparation(Estimator, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the medians of the non-NULL values of every input and, if `scaled`, mean and population
    deviation of the filled values; a constant input is only centred. Inputs have at least one value."""

    scaled = Param(Params._dummy(), "scaled", "whether inputs are standardised", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCol: str | None = None, scaled: bool = False):
        super().__init__()
        self._setDefault(scaled=False)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PreparedInputs:
        found = prepared_by(dataset, self.getInputCols(), F.lit(0), [[0]], self.getOrDefault(self.scaled))[0]
        if found is None or found.getInputCols() != self.getInputCols():
            raise ValueError("every input needs at least one value")
        return found._set(outputCol=self.getOutputCol())


def _merged(parts: list[tuple], median: float) -> tuple[float, float]:
    """Mean and population deviation of rows in parts of (rows, values, mean, deviation, least, largest), the missing filled in."""
    blocks = [(v, mean, deviation, least, largest) for _, v, mean, deviation, least, largest in parts if v]
    missing = sum(p[0] - p[1] for p in parts)
    if missing:
        blocks.append((missing, median, 0.0, median, median))
    least, largest = min(b[3] for b in blocks), max(b[4] for b in blocks)
    if least == largest:
        return least, 0.0
    total = sum(b[0] for b in blocks)
    mean = sum(b[0] / total * b[1] for b in blocks)
    return mean, math.sqrt(sum(b[0] / total * (b[2] ** 2 + (b[1] - mean) ** 2) for b in blocks))


def prepared_by(rows: DataFrame, columns: list[str], part: Column, groups: list[list[int]], scaled: bool) -> list[PreparedInputs | None]:
    """The preparation of every group of rows, all in the same passes. `part` numbers the rows' parts (from 0), a group is a list
    of parts. A group's inputs are the columns with values in it; None where there are none."""
    each = (F.count, F.avg, F.stddev_pop, F.min, F.max) if scaled else (F.count,)
    doubles = rows.select(part.cast("int").alias("_part"), *[F.col(c).cast("double").alias(c) for c in columns])
    found = doubles.groupBy("_part").agg(F.count("*"), *[f(F.col(c)) for c in columns for f in each]).collect()
    held = {r[0]: (r[1], [tuple(r[2 + i * len(each):2 + (i + 1) * len(each)]) for i in range(len(columns))]) for r in found}
    counts = [{c: sum(held[p][1][i][0] for p in own if p in held) for i, c in enumerate(columns)} for own in groups]
    medians = ordered.quantiles_by(doubles, columns, [0.5], F.col("_part"), groups, counts)
    out = []
    for own, count, middle in zip(groups, counts, medians):
        used = [c for c in columns if count[c]]
        if not used:
            out.append(None)
            continue
        filled = [float(middle[c][0]) for c in used]
        means, deviations = [0.0] * len(used), [1.0] * len(used)
        if scaled:
            at = [columns.index(c) for c in used]
            both = [_merged([(held[p][0], *held[p][1][i]) for p in own if p in held], m) for i, m in zip(at, filled)]
            means, deviations = [float(m) for m, _ in both], [d or 1.0 for _, d in both]
        out.append(PreparedInputs()._set(inputCols=used, outputCol="_features", medians=filled, means=means, deviations=deviations))
    return out
