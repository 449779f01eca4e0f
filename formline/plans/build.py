"""Feature build: ratings, form, flags and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from formline.operators import form, hotkeys, ratings, standard
from formline.sources.folders import stored


def feature_table(
    matches: DataFrame,
    pool: list[str] | None = None,
    window: int = 5,
    decay: bool = True,
    rows_per_slice: int = hotkeys.ROWS_PER_SLICE,
    checkpoint_folder: str | None = None,
) -> DataFrame:
    """Match rows with ratings, pair and form features, flags, segment and targets."""
    rated = ratings.exact_ratings(matches, pool, decay, checkpoint_folder=checkpoint_folder)
    # Used twice below (team rows and match rows), and its fold runs in Python.
    rated = stored(rated, checkpoint_folder)
    formed = form.with_form(form.with_pair_features(rated), window, rows_per_slice, counted=matches)
    return standard.with_targets(standard.with_segment(standard.with_training_flags(formed)))
