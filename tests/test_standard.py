from datetime import date

import pytest
from pyspark.sql import functions as F

from formline.functions.names import ascii_fold, word_count
from formline.functions.tournaments import match_segment, two_year_window
from formline.operators import dims, monitor, standard


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", build(F.col("v"))).orderBy("i").collect()]


ROUTES = {
    "FIFA World Cup": "worldcup", "World Cup": "worldcup", "FIFA World Cup qualification": "qualifiers",
    "Friendly": "friendlies", "International Friendly": "friendlies", "UEFA Euro": "continental",
    "UEFA Euro qualification": "qualifiers", "Copa América": "continental", "African Cup of Nations": "continental",
    "African Cup of Nations qualification": "qualifiers", "AFC Asian Cup": "continental", "Gold Cup": "continental",
    "UEFA Nations League": "continental", "Confederations Cup": "continental", "OFC playoff": "qualifiers",
    "World Cup repechage": "worldcup", "COSAFA Cup": None, "": None, None: None,
}


def test_router(spark):
    assert column(spark, list(ROUTES), match_segment) == list(ROUTES.values())


def test_windows_start_in_odd_years(spark):
    got = column(spark, [date(2025, 5, 1), date(2026, 1, 1), date(2024, 1, 1)], two_year_window, "date")
    assert got == ["2025-2026", "2025-2026", "2023-2024"]


def test_folding(spark):
    assert column(spark, ["Côte d'Ivoire", "Curaçao", "Frøya", "São Tomé", "Ĳssel"], ascii_fold) == [
        "Cote d'Ivoire", "Curacao", "Frya", "Sao Tome", "IJssel"]
    assert column(spark, ["", "  ", "a b  c"], word_count) == [0, 0, 3]


def test_aliases(spark):
    df = spark.createDataFrame([(n,) for n in ("USA", " brasil ", "South Korea", "Ivory Coast", "Malta ")], "team string")
    got = {r[0] for r in dims.resolve_alias(df, "team").collect()}
    assert got == {"United States", "Brazil", "South Korea", "Côte d'Ivoire", "Malta"}


def test_confederations(spark):
    members = spark.createDataFrame(
        [("Brazil", "CONMEBOL"), ("Cote d'Ivoire", "CAF"), ("Frøya", dims.REGIONAL), ("Froya", "UEFA")], "team string, confederation string")
    df = spark.createDataFrame([("brasil",), ("ivory coast",), ("Frøya",), ("Atlantis",)], "team string")
    got = {r["team"]: r["c"] for r in dims.with_confederation(df, "team", members, "c").collect()}
    assert got == {"brasil": "CONMEBOL", "ivory coast": "CAF", "Frøya": dims.REGIONAL, "Atlantis": dims.UNKNOWN}


def test_matchup(spark):
    pairs = [("UEFA", "UEFA"), ("UEFA", "CAF"), ("UEFA", "Unknown"), ("Unknown", "Unknown")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, h string, a string")
    got = [r[1] for r in df.select("i", dims.matchup_segment(F.col("h"), F.col("a"))).orderBy("i").collect()]
    assert got == ["UEFA", dims.INTER, dims.MIX, dims.UNKNOWN]


def test_competitions(spark):
    got = column(spark, ["WC", "EC", "PL", "CL", "ZZ", None], standard.competition_reason)
    assert got == ["international", "international", "club", "club", "unknown", "unknown"]


def test_national_names(spark):
    names = ["Uruguay", "Chelsea FC", "England U21", "Trinidad and Tobago Republic", "Club Brugge"]
    assert column(spark, names, standard.is_national_name) == [True, False, False, True, False]
    strict = column(spark, names, lambda c: standard.is_national_name(c, strict=True))
    assert strict == [False, False, False, False, False]


def test_first_feed_wins_and_copies_collapse(make_matches):
    m = make_matches([(i, "2024-01-01", "A", "B", 1, 0) for i in range(40)] + [(90, "2024-01-02", "A", "B", 1, 0)])
    both = standard.union_feeds(m, m.withColumn("match_id", F.col("match_id") - 1000))
    kept = {(r["match_id"], r["source_priority"]) for r in standard.deduplicate(both).collect()}
    assert kept == {(0, 1), (90, 1)}


def test_match_key_needs_only_the_date(spark):
    df = spark.createDataFrame([("2024-01-01", "A", "B", None, None, None)], "match_date string, home_team string, away_team string, tournament string, city string, country string")
    assert df.select(standard.match_key()).first()[0] is not None
    assert df.select(standard.match_key()).first()[0] == df.fillna("").select(standard.match_key()).first()[0]


@pytest.mark.parametrize("home,away,fresh", [("2024-01-20", "2024-01-25", True), ("2023-11-01", "2024-01-25", False)])
def test_freshness(spark, home, away, fresh):
    df = spark.createDataFrame([(home, away)], "home_snapshot_date string, away_snapshot_date string")
    row = monitor.feature_freshness(df, "2024-01-31").first()
    assert row["is_fresh"] == fresh and (row["warning"] is None) == fresh


def test_look_back_limits(spark):
    log = spark.createDataFrame([], "timestamp_utc timestamp")
    for hours in (0, 721):
        with pytest.raises(ValueError):
            monitor.look_back(log, "2024-01-31", hours=hours)
    with pytest.raises(ValueError):
        monitor.recent_inferences(log, 501)
