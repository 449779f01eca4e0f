"""Joins against the team dimensions: aliases, confederations, known teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.functions.names import alias_key, ascii_fold, fold_key

# Alias key -> canonical team name.
TEAM_ALIASES = {
    "usa": "United States", "us": "United States", "united_states": "United States",
    "usmnt": "United States",
    "england": "England", "uk": "England", "britain": "England",
    "czechoslovakia": "Czech Republic", "czech": "Czech Republic", "czechia": "Czech Republic",
    "holland": "Netherlands", "netherlands": "Netherlands",
    "korea": "South Korea", "south_korea": "South Korea", "southkorea": "South Korea",
    "sk": "South Korea",
    "ksa": "Saudi Arabia", "saudi": "Saudi Arabia", "saudi_arabia": "Saudi Arabia",
    "ivory_coast": "Côte d'Ivoire", "cote_d_ivoire": "Côte d'Ivoire",
    "coted_ivoire": "Côte d'Ivoire",
    "brasil": "Brazil", "br": "Brazil",
    "argentina": "Argentina", "arg": "Argentina",
    "chile": "Chile", "ch": "Chile",
    "colombia": "Colombia", "col": "Colombia",
    "urug": "Uruguay", "uruguay": "Uruguay",
    "paraguay": "Paraguay", "par": "Paraguay",
    "australia": "Australia", "aus": "Australia",
    "nz": "New Zealand", "new_zealand": "New Zealand",
}

UNKNOWN = "Unknown"
REGIONAL = "Regional/NonFIFA"
MIX = "Unknown/Regional Mix"
INTER = "Inter-confederation"


def default_aliases(spark: SparkSession) -> DataFrame:
    pairs = [F.lit(text) for pair in TEAM_ALIASES.items() for text in pair]
    return spark.range(1).select(F.explode(F.create_map(*pairs)).alias("alias", "canonical"))


def resolve_alias(df: DataFrame, column: str, aliases: DataFrame | None = None) -> DataFrame:
    """Canonical name where the alias is known, the trimmed name otherwise.

    The built-in table has a few dozen rows and is broadcast. A caller's own
    table is joined without a hint, so its measured size picks the strategy.
    """
    if aliases is None:
        dim = F.broadcast(default_aliases(df.sparkSession))
    else:
        dim = aliases.select("alias", "canonical").dropDuplicates(["alias"])
    dim = dim.withColumnsRenamed({"alias": "_alias", "canonical": "_canonical"})
    joined = df.join(dim, alias_key(F.col(column)) == F.col("_alias"), "left")
    name = F.coalesce("_canonical", F.trim(F.col(column)))
    return joined.withColumn(column, name).drop("_alias", "_canonical")


def confederation_key(name: Column) -> Column:
    return F.lower(ascii_fold(F.trim(name)))


def with_confederation(
    df: DataFrame, column: str, members: DataFrame, output: str, aliases: DataFrame | None = None
) -> DataFrame:
    """Adds the confederation of `column`, `Unknown` when the team is not listed.

    `members` has one row per (team, confederation). A team listed as regional
    stays regional whatever else it is listed under; further ties take the
    alphabetically first confederation.
    """
    rank = F.struct((F.col("confederation") != REGIONAL).alias("late"), F.col("confederation"))
    dim = (
        members.groupBy(confederation_key(F.col("team")).alias("_team_key"))
        .agg(F.min(rank)["confederation"].alias("_confederation"))
    )
    keyed = resolve_alias(df.withColumn("_name", F.col(column)), "_name", aliases)
    joined = keyed.join(dim, confederation_key(F.col("_name")) == F.col("_team_key"), "left")
    return joined.withColumn(output, F.coalesce("_confederation", F.lit(UNKNOWN))).drop(
        "_name", "_team_key", "_confederation"
    )


def matchup_segment(home: Column, away: Column) -> Column:
    """Same confederation wins, then any unknown side, then inter-confederation."""
    return (
        F.when(home == away, home)
        .when(home.isin(UNKNOWN, REGIONAL) | away.isin(UNKNOWN, REGIONAL), MIX)
        .otherwise(INTER)
    )


def known_confederations(df: DataFrame, column: str = "home_confederation") -> DataFrame:
    return df.filter(~F.col(column).isin(UNKNOWN, REGIONAL))


def distinct_teams(df: DataFrame) -> DataFrame:
    """Every non-NULL team of either role, from one scan."""
    return (
        df.select(F.explode(F.array("home_team", "away_team")).alias("team"))
        .filter(F.col("team").isNotNull())
        .distinct()
    )


def resolve_known_team(
    df: DataFrame, column: str, teams: DataFrame, output: str
) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved) by case-insensitive name."""
    known = teams.groupBy(fold_key(F.col("team")).alias("_key")).agg(
        F.max("team").alias("_resolved")
    )
    keyed = df.withColumn("_fold", fold_key(F.col(column)))
    hit = (
        keyed.join(known, F.col("_fold") == F.col("_key"))
        .withColumn(output, F.col("_resolved"))
        .drop("_fold", "_key", "_resolved")
    )
    miss = keyed.join(known, F.col("_fold") == F.col("_key"), "left_anti").drop("_fold")
    return hit, miss
