"""Outcome classes, probability rows and overrides as column expressions.

A class is -1 (away win), 0 (draw) or 1 (home win). A probability row is three
double columns in that order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = (-1, 0, 1)
LABELS = {-1: "away_win", 0: "draw", 1: "home_win"}
ENCODED = {-1: 0, 0: 1, 1: 2}


def outcome(home_goals: Column, away_goals: Column) -> Column:
    return F.signum((home_goals - away_goals).cast("double")).cast("int")


def home_win(home_goals: Column, away_goals: Column) -> Column:
    return (home_goals > away_goals).cast("int")


def outcome_label(cls: Column) -> Column:
    return F.when(cls == -1, LABELS[-1]).when(cls == 0, LABELS[0]).when(cls == 1, LABELS[1])


def encode(cls: Column) -> Column:
    return (cls + 1).cast("int")


def decode(index: Column) -> Column:
    return (index - 1).cast("int")


def result_points(goals_for: Column, goals_against: Column) -> Column:
    """1 for a win, 0.5 for a draw, 0 for a loss, seen from one side."""
    return (
        F.when(goals_for > goals_against, 1.0)
        .when(goals_for == goals_against, 0.5)
        .when(goals_for < goals_against, 0.0)
    )


def is_draw(home_goals: Column, away_goals: Column) -> Column:
    return (home_goals == away_goals).cast("double")


def argmax_class(p_away: Column, p_draw: Column, p_home: Column) -> Column:
    """Class of the largest probability, the first one on ties."""
    return (
        F.when((p_away >= p_draw) & (p_away >= p_home), -1).when(p_draw >= p_home, 0).otherwise(1)
    ).cast("int")


def normalise(p_away: Column, p_draw: Column, p_home: Column) -> tuple[Column, Column, Column]:
    """Rows scaled to sum 1; rows that sum to 0 are left as they are."""
    total = p_away + p_draw + p_home
    return tuple(F.when(total > 0, p / total).otherwise(p) for p in (p_away, p_draw, p_home))


def align(probabilities: dict[int, Column]) -> tuple[Column, Column, Column]:
    """Probability row in class order; a class the model never saw gets 0."""
    row = [F.coalesce(probabilities.get(cls, F.lit(0.0)), F.lit(0.0)) for cls in CLASSES]
    return normalise(*row)


def pick_probability(cls: Column, p_away: Column, p_draw: Column, p_home: Column) -> Column:
    return F.when(cls == -1, p_away).when(cls == 0, p_draw).when(cls == 1, p_home)


def override(generalist: tuple, specialist: tuple, uncertainty: Column, conviction: Column) -> Column:
    """True where the specialist's draw replaces an unsure generalist row."""
    return (
        (F.greatest(*generalist) < uncertainty)
        & (argmax_class(*specialist) == 0)
        & (specialist[1] >= conviction)
    )


def blend(generalist: tuple, specialist: tuple, use_specialist: Column) -> tuple[Column, ...]:
    row = [F.when(use_specialist, s).otherwise(g) for g, s in zip(generalist, specialist)]
    return normalise(*row)
