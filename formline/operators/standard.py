"""Standardisation: renames, typed projections, filters, keys, union and dedup."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions import outcomes
from formline.functions.names import fold_key, word_count
from formline.functions.tournaments import match_segment, serving_flags, training_flags

# Column names of the historical feed and their standard names.
HISTORICAL_NAMES = {
    "date": "match_date",
    "home_score": "home_goals",
    "away_score": "away_goals",
}

# Competition codes of national teams (kept) and clubs (dropped).
INTERNATIONAL_CODES = (
    "WC", "WCQ", "COPA", "COPAAQ", "EC", "ECQ", "ACN", "ANC", "ACNQ", "AFC", "AFCQ", "OFC", "OFCQ",
    "CONCACAF", "CNL", "UEFAQ", "CONMEBOLQ", "FR",
)
CLUB_CODES = (
    "PL", "BL1", "SA", "PD", "FL1", "PPL", "DED", "ELC", "BSA", "RFPL", "JPL", "MLS", "CL", "EL",
    "ECL", "CLI", "SUD",
)

DEDUP_KEY = ("match_date", "home_team", "away_team", "home_goals", "away_goals")


def standardize_historical(df: DataFrame) -> DataFrame:
    """Rename whichever historical columns are present."""
    return df.withColumnsRenamed(HISTORICAL_NAMES)


def standardize_documents(documents: DataFrame) -> DataFrame:
    """Nested match documents to the flat match layout (one row per document)."""
    return documents.select(
        F.to_date(F.split("utcDate", "T")[0]).alias("match_date"),
        F.coalesce("homeTeam.name", F.lit("Unknown")).alias("home_team"),
        F.coalesce("awayTeam.name", F.lit("Unknown")).alias("away_team"),
        F.col("score.fullTime.home").cast("long").alias("home_goals"),
        F.col("score.fullTime.away").cast("long").alias("away_goals"),
        F.coalesce("competition.name", F.lit("Unknown")).alias("tournament"),
        F.lit("Unknown").alias("city"),
        F.coalesce("area.name", F.lit("Unknown")).alias("country"),
        F.lit(False).alias("neutral"),
    )


def _blank_to_null(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def text_to_bool(text: Column) -> Column:
    word = F.lower(text)
    return F.when(word.isin("true", "t", "1", "yes"), True).when(
        word.isin("false", "f", "0", "no"), False
    )


def typed_bronze(df: DataFrame, source_stream: str) -> DataFrame:
    """All-text feed to typed columns; blanks and unreadable values become NULL."""
    return df.select(
        _blank_to_null("date").try_cast("date").alias("match_date"),
        _blank_to_null("home_team").alias("home_team"),
        _blank_to_null("away_team").alias("away_team"),
        _blank_to_null("home_goals").try_cast("bigint").alias("home_goals"),
        _blank_to_null("away_goals").try_cast("bigint").alias("away_goals"),
        _blank_to_null("tournament").alias("tournament"),
        _blank_to_null("city").alias("city"),
        _blank_to_null("country").alias("country"),
        text_to_bool(F.col("neutral")).alias("neutral"),
        F.lit(source_stream).alias("source_stream"),
    )


def align_to(df: DataFrame, other: DataFrame) -> DataFrame:
    """The columns of `other`, in its order."""
    return df.select(*other.columns)


def from_era(df: DataFrame, start: date = date(1990, 1, 1)) -> DataFrame:
    """Matches from `start` on."""
    return df.filter(F.col("match_date") >= F.lit(start))


def drop_unscored(
    df: DataFrame, score_columns: tuple[str, str] = ("home_goals", "away_goals")
) -> DataFrame:
    return df.dropna(subset=list(score_columns))


def removal_counts(df: DataFrame, start: date = date(1990, 1, 1)) -> DataFrame:
    """One row: all matches, those without a score, and scored ones before the era."""
    unscored = F.col("home_goals").isNull() | F.col("away_goals").isNull()
    early = F.coalesce(F.col("match_date") < F.lit(start), F.lit(False))
    return df.agg(
        F.count("*").alias("matches"),
        F.count_if(unscored).alias("unscored"),
        F.count_if(~unscored & early).alias("before_era"),
    )


def competition_reason(code: Column) -> Column:
    """`international`, `club` or `unknown`."""
    return (
        F.when(code.isin(*INTERNATIONAL_CODES), "international")
        .when(code.isin(*CLUB_CODES), "club")
        .otherwise("unknown")
    )


def is_national_name(name: Column, strict: bool = False) -> Column:
    """Heuristic for national teams.

    The strict form drops every name with a capital U or more than three words;
    the default drops age-group names only and keeps long names.
    """
    text = F.coalesce(name, F.lit(""))
    keep = ~text.contains("FC") & ~text.contains("Club")
    if strict:
        return keep & ~text.contains("U") & (word_count(text) <= 3)
    return keep & ~text.rlike(r"\bU\d{2}\b")


def international_filter(
    df: DataFrame, code: str = "competition_code", strict: bool = False
) -> DataFrame:
    return df.filter(
        (competition_reason(F.col(code)) == "international")
        & is_national_name(F.col("home_team"), strict)
        & is_national_name(F.col("away_team"), strict)
    )


def exclusion_counts(df: DataFrame, code: str = "competition_code", strict: bool = False) -> DataFrame:
    """Rows per reason: kept, club, unknown competition, not a national team."""
    national = is_national_name(F.col("home_team"), strict) & is_national_name(
        F.col("away_team"), strict
    )
    reason = competition_reason(F.col(code))
    label = F.when(reason != "international", reason).when(~national, "not_national").otherwise("kept")
    return df.groupBy(label.alias("reason")).agg(F.count("*").alias("matches"))


def with_training_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(training_flags(F.col("tournament")))


def with_serving_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(serving_flags(F.col("tournament")))


def with_segment(df: DataFrame, detector=match_segment) -> DataFrame:
    """Adds `match_segment`. `detector` maps the tournament column to a segment column."""
    return df.withColumn("match_segment", detector(F.col("tournament")))


def with_targets(df: DataFrame) -> DataFrame:
    goals = F.col("home_goals"), F.col("away_goals")
    return df.withColumns(
        {
            "goal_diff": goals[0] - goals[1],
            "target_multiclass": outcomes.outcome(*goals),
            "target": outcomes.home_win(*goals),
            "outcome_label": outcomes.outcome_label(outcomes.outcome(*goals)),
        }
    )


def match_key() -> Column:
    parts = [F.col("match_date").cast("string")] + [
        F.coalesce(F.col(c), F.lit(""))
        for c in ("home_team", "away_team", "tournament", "city", "country")
    ]
    return F.md5(F.concat_ws("||", *parts))


def same_team(home: Column, away: Column) -> Column:
    return fold_key(home) == fold_key(away)


def split_distinct_teams(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a team cannot play itself; missing names are rejected."""
    bad = F.coalesce(same_team(F.col("home_team"), F.col("away_team")), F.lit(True))
    return df.filter(~bad), df.filter(bad)


def union_feeds(historical: DataFrame, api: DataFrame) -> DataFrame:
    """All rows of both feeds; `source_priority` 1 is the historical feed."""
    return historical.withColumn("source_priority", F.lit(1)).unionByName(
        api.withColumn("source_priority", F.lit(2)), allowMissingColumns=True
    )


def deduplicate(
    df: DataFrame,
    key: tuple[str, ...] = DEDUP_KEY,
    order: tuple[str, ...] = ("source_priority", "match_id"),
) -> DataFrame:
    """First row per key. The minimum is combined map-side, so a key with very
    many copies shuffles one row per input partition."""
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("first_row")
    return df.groupBy(*key).agg(first).select("first_row.*")
