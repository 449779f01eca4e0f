"""Projections, filters, predicates, set operations, dimension joins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.common import Registry, day, with_views
from formline import views
from formline.functions import outcomes
from formline.functions.names import ascii_fold
from formline.functions.tournaments import two_year_window
from formline.operators import dims, standard

QUERIES = Registry()
add = QUERIES.add

BASIC = "match_id", "home_team", "away_team", "home_goals", "away_goals"


def _raw_feed(spark, sf_dir):
    """All-text feed with blanks, unreadable numbers and text booleans."""
    m = views.matches(spark, sf_dir)
    return m.select(
        "match_id",
        F.when(F.col("match_id") % 17 == 0, "").otherwise(F.col("match_date").cast("string")).alias("date"),
        "home_team",
        F.when(F.col("match_id") % 19 == 0, "").otherwise(F.col("away_team")).alias("away_team"),
        F.when(F.col("match_id") % 11 == 0, "")
        .when(F.col("match_id") % 13 == 0, "n/a")
        .otherwise(F.col("home_goals").cast("string")).alias("home_goals"),
        F.col("away_goals").cast("string").alias("away_goals"),
        "tournament",
        F.lit("").alias("city"),
        "country",
        F.when(F.col("match_id") % 5 == 0, "Yes").when(F.col("match_id") % 5 == 1, "F")
        .when(F.col("match_id") % 5 == 2, "maybe").otherwise(F.col("neutral").cast("string")).alias("neutral"),
    )


_RAW_FEED = """raw_feed as (select match_id,
 case when match_id%17=0 then '' else cast(match_date as varchar) end as date, home_team,
 case when match_id%19=0 then '' else away_team end as away_team,
 case when match_id%11=0 then '' when match_id%13=0 then 'n/a' else cast(home_goals as varchar) end as home_goals,
 cast(away_goals as varchar) as away_goals, tournament, '' as city, country,
 case match_id%5 when 0 then 'Yes' when 1 then 'F' when 2 then 'maybe' else cast(neutral as varchar) end as neutral
 from matches)"""


@add(
    "P1_rename_present_columns",
    with_views("matches", body="""select match_id, cast(match_date as varchar) as match_date,
 home_goals, away_goals, tournament from matches"""),
)
def p1(spark, sf_dir):
    feed = views.matches(spark, sf_dir).select(
        "match_id", F.col("match_date").alias("date"), F.col("home_goals").alias("home_score"),
        F.col("away_goals").alias("away_score"), "tournament",
    )
    return standard.standardize_historical(feed).withColumn("match_date", day("match_date"))


@add(
    "P2_typed_bronze",
    with_views("matches", ctes=_RAW_FEED, body="""select cast(try_cast(nullif(date,'') as date) as varchar) as match_date,
 home_team, nullif(away_team,'') as away_team, cast(try_cast(nullif(home_goals,'') as bigint) as varchar) as home_goals,
 try_cast(nullif(away_goals,'') as bigint) as away_goals, tournament, nullif(city,'') as city, country,
 case when lower(neutral) in ('true','t','1','yes') then 'yes' when lower(neutral) in ('false','f','0','no') then 'no' end as neutral,
 'historical' as source_stream from raw_feed"""),
)
def p2(spark, sf_dir):
    typed = standard.typed_bronze(_raw_feed(spark, sf_dir), "historical")
    return typed.withColumns({
        "match_date": day("match_date"),
        "home_goals": F.col("home_goals").cast("string"),
        "neutral": F.when(F.col("neutral"), "yes").when(~F.col("neutral"), "no"),
    })


@add(
    "P4_align_columns",
    with_views("matches", body="select away_team, home_team, match_id from matches"),
)
def p4(spark, sf_dir):
    m = views.matches(spark, sf_dir)
    api = m.select("match_id", "country", "home_team", "away_team")
    return standard.align_to(api, m.select("away_team", "home_team", "match_id"))


@add(
    "P5_era_filter",
    """select o_orderkey as match_id, cast(cast(o_orderdate as date) as varchar) as match_date from orders
 where cast(o_orderdate as date) >= date '1998-01-01'""",
)
def p5(spark, sf_dir):
    orders = views.read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").cast("date").alias("match_date")
    )
    return standard.from_era(orders, date(1998, 1, 1)).withColumn("match_date", day("match_date"))


@add(
    "P6_drop_unscored",
    with_views("matches", body="""select match_id, home_team, away_team, home_goals, away_goals
 from matches where match_id%6<>0 and match_id%9<>0"""),
)
def p6(spark, sf_dir):
    m = views.matches(spark, sf_dir).select(*BASIC).withColumns({
        "home_goals": F.when(F.col("match_id") % 6 != 0, F.col("home_goals")),
        "away_goals": F.when(F.col("match_id") % 9 != 0, F.col("away_goals")),
    })
    return standard.drop_unscored(m)


@add(
    "P6_removal_counts",
    """select count(*) as matches, count(*) filter (o_orderkey%6=0) as unscored,
 count(*) filter (o_orderkey%6<>0 and cast(o_orderdate as date)<date '1998-01-01') as before_era from orders""",
)
def p6_counts(spark, sf_dir):
    orders = views.read_table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("match_date"),
        F.when(F.col("o_orderkey") % 6 != 0, 1).alias("home_goals"), F.lit(0).alias("away_goals"))
    return standard.removal_counts(orders, date(1998, 1, 1))


def _api_feed(spark, sf_dir):
    m = views.matches(spark, sf_dir)
    code = (
        F.when(F.col("tournament") == "FIFA World Cup", "WC")
        .when(F.col("tournament") == "FIFA World Cup qualification", "WCQ")
        .when(F.col("tournament") == "UEFA Euro", "EC")
        .when(F.col("tournament") == "Friendly", "PL")
        .otherwise("XX")
    )
    home = (
        F.when(F.col("match_id") % 7 == 0, F.concat(F.col("home_team"), F.lit(" FC")))
        .when(F.col("match_id") % 7 == 1, F.concat(F.col("home_team"), F.lit(" U21")))
        .when(F.col("match_id") % 7 == 2, F.concat(F.col("home_team"), F.lit(" of the Isles")))
        .when(F.col("match_id") % 7 == 3, F.concat(F.lit("Unity "), F.col("home_team")))
        .otherwise(F.col("home_team"))
    )
    return m.select("match_id", code.alias("competition_code"), home.alias("home_team"), "away_team")


_API_FEED = """api as (select match_id, case tournament when 'FIFA World Cup' then 'WC'
 when 'FIFA World Cup qualification' then 'WCQ' when 'UEFA Euro' then 'EC' when 'Friendly' then 'PL' else 'XX' end as competition_code,
 case match_id%7 when 0 then home_team||' FC' when 1 then home_team||' U21' when 2 then home_team||' of the Isles'
  when 3 then 'Unity '||home_team else home_team end as home_team, away_team from matches)"""


@add(
    "P7_competition_filter",
    with_views("matches", ctes=_API_FEED, body="""select case when competition_code in ('WC','WCQ','EC') then 'international'
 when competition_code='PL' then 'club' else 'unknown' end as reason, count(*) as matches from api group by 1"""),
)
def p7(spark, sf_dir):
    api = _api_feed(spark, sf_dir)
    reason = standard.competition_reason(F.col("competition_code")).alias("reason")
    return api.groupBy(reason).agg(F.count("*").alias("matches"))


@add(
    "P8_national_team_names",
    with_views("matches", ctes=_API_FEED, body=r"""select match_id, home_team,
 not contains(home_team,'FC') and not contains(home_team,'Club') and not regexp_matches(home_team,'\bU[0-9]{2}\b') as national,
 not contains(home_team,'FC') and not contains(home_team,'Club') and not contains(home_team,'U')
   and len(string_split(home_team,' '))<=3 as national_strict from api"""),
)
def p8(spark, sf_dir):
    api = _api_feed(spark, sf_dir)
    return api.select(
        "match_id", "home_team",
        standard.is_national_name(F.col("home_team")).alias("national"),
        standard.is_national_name(F.col("home_team"), strict=True).alias("national_strict"),
    )


@add(
    "P9_international_filter",
    with_views("matches", ctes=_API_FEED, body=r"""select match_id, competition_code, home_team, away_team from api
 where competition_code in ('WC','WCQ','EC') and not contains(home_team,'FC') and not contains(home_team,'Club')
  and not regexp_matches(home_team,'\bU[0-9]{2}\b')"""),
)
def p9(spark, sf_dir):
    return standard.international_filter(_api_feed(spark, sf_dir))


@add(
    "P9_exclusion_counts",
    with_views("matches", ctes=_API_FEED, body=r"""select case when competition_code='PL' then 'club' when competition_code='XX' then 'unknown'
  when contains(home_team,'FC') or regexp_matches(home_team,'\bU[0-9]{2}\b') then 'not_national' else 'kept' end as reason,
  count(*) as matches from api group by 1"""),
)
def p9_counts(spark, sf_dir):
    return standard.exclusion_counts(_api_feed(spark, sf_dir))


def _flags_sql(regexes: dict[str, str], source: str) -> str:
    cases = ", ".join(
        f"cast(regexp_matches(lower(coalesce(tournament,'')),'{p}') as int) as {n}" for n, p in regexes.items()
    )
    return f"select match_id, tournament, {cases} from {source}"


_TOURNAMENTS = """named as (select match_id, case match_id%6 when 0 then 'AFC Asian Cup' when 1 then 'OFC Nations Cup'
 when 2 then null else tournament end as tournament from matches)"""


def _named(spark, sf_dir):
    m = views.matches(spark, sf_dir)
    name = (
        F.when(F.col("match_id") % 6 == 0, "AFC Asian Cup")
        .when(F.col("match_id") % 6 == 1, "OFC Nations Cup")
        .when(F.col("match_id") % 6 == 2, F.lit(None))
        .otherwise(F.col("tournament"))
    )
    return m.select("match_id", name.alias("tournament"))


@add(
    "P10_training_flags",
    with_views("matches", ctes=_TOURNAMENTS, body=_flags_sql({
        "is_friendly": "friendly", "is_world_cup": "world cup|wc|fifa",
        "is_qualifier": "qualification|qualifier|wcq|ecq|copaaq|acnq|afc|ofc|uefaq|conmebolq",
        "is_continental": "championship|euro|copa|africa|asian|confederation"}, "named")),
)
def p10(spark, sf_dir):
    return standard.with_training_flags(_named(spark, sf_dir))


@add(
    "P11_serving_flags",
    with_views("matches", ctes=_TOURNAMENTS, body=_flags_sql({
        "is_friendly": "friendly", "is_world_cup": "world cup|wc|fifa",
        "is_qualifier": "qualification|qualifier|wcq|ecq|copaaq|acnq|afcq|ofcq|uefaq|conmebolq",
        "is_continental": "championship|euro|copa|africa|asian|confederation"}, "named")),
)
def p11(spark, sf_dir):
    return standard.with_serving_flags(_named(spark, sf_dir))


@add(
    "P12_match_segment",
    with_views("matches", ctes=_TOURNAMENTS, body="""select match_id, case
 when contains(lower(tournament),'world cup') and not contains(lower(tournament),'qualification') then 'worldcup'
 when contains(lower(tournament),'friendly') then 'friendlies'
 when regexp_matches(lower(tournament),'qualification|qualifier|playoff|repechage') then 'qualifiers'
 when regexp_matches(lower(tournament),'copa am|euro|africa cup|african cup|asian cup|confederations|gold cup|nations league')
  then 'continental' end as match_segment from named"""),
)
def p12(spark, sf_dir):
    return standard.with_segment(_named(spark, sf_dir)).select("match_id", "match_segment")


@add(
    "P13_competition_segment",
    with_views("matches", ctes=_TOURNAMENTS, body="""select match_id, case
 when regexp_matches(lower(tournament),'world cup|wc|fifa') then 'World Cup'
 when regexp_matches(lower(tournament),'qualification|qualifier|afc|ofc') then 'Qualifier'
 when regexp_matches(lower(tournament),'championship|euro|copa|africa|asian|confederation') then 'Continental'
 when regexp_matches(lower(tournament),'friendly') then 'Friendly' else 'Other' end as competition_segment from named"""),
)
def p13(spark, sf_dir):
    from formline.functions.tournaments import competition_segment

    flagged = standard.with_training_flags(_named(spark, sf_dir))
    segment = competition_segment(*[F.col(c) for c in ("is_world_cup", "is_qualifier", "is_continental", "is_friendly")])
    return flagged.select("match_id", segment.alias("competition_segment"))


@add(
    "P14_two_year_window",
    """select cast(y-(1-y%2) as varchar)||'-'||cast(y-(1-y%2)+1 as varchar) as time_window, count(*) as matches
 from (select cast(year(o_orderdate) as int) as y from orders) group by 1""",
)
def p14(spark, sf_dir):
    orders = views.read_table(spark, sf_dir, "orders")
    return orders.groupBy(two_year_window(F.col("o_orderdate")).alias("time_window")).agg(
        F.count("*").alias("matches")
    )


@add(
    "P15_targets",
    with_views("matches", body="""select match_id, home_goals-away_goals as goal_diff,
 case when home_goals>away_goals then 1 when home_goals=away_goals then 0 else -1 end as target_multiclass,
 case when home_goals>away_goals then 1 else 0 end as target,
 case when home_goals>away_goals then 'home_win' when home_goals=away_goals then 'draw' else 'away_win' end as outcome_label
 from matches"""),
)
def p15(spark, sf_dir):
    m = standard.with_targets(views.matches(spark, sf_dir))
    return m.select("match_id", "goal_diff", "target_multiclass", "target", "outcome_label")


@add(
    "P16_match_key",
    with_views("matches", body="""select match_id, md5(concat_ws('||', cast(match_date as varchar), home_team, away_team,
 coalesce(tournament,''), '', coalesce(country,''))) as match_key from matches"""),
)
def p16(spark, sf_dir):
    m = views.matches(spark, sf_dir).withColumn("city", F.lit(None).cast("string"))
    return m.select("match_id", standard.match_key().alias("match_key"))


_P23 = """dirty as (select match_id, home_team, case when match_id%8=0 then ' '||lower(home_team)||' '
 when match_id%9=0 then null else away_team end as away_team from matches)"""


@add(
    "P23_distinct_teams_check",
    with_views("matches", ctes=_P23, body="""select match_id, home_team, coalesce(lower(trim(home_team))<>lower(trim(away_team)), false)
 as accepted from dirty"""),
)
def p23(spark, sf_dir):
    m = views.matches(spark, sf_dir)
    away = (
        F.when(F.col("match_id") % 8 == 0, F.concat(F.lit(" "), F.lower("home_team"), F.lit(" ")))
        .when(F.col("match_id") % 9 == 0, F.lit(None))
        .otherwise(F.col("away_team"))
    )
    accepted, rejected = standard.split_distinct_teams(m.select("match_id", "home_team", away.alias("away_team")))
    return accepted.select("match_id", "home_team", F.lit(True).alias("accepted")).unionByName(
        rejected.select("match_id", "home_team", F.lit(False).alias("accepted"))
    )


def _feeds(spark, sf_dir):
    m = views.matches(spark, sf_dir).drop("kickoff_ts")
    api = m.withColumn("match_id", F.col("match_id") + 1_000_000_000)
    return m, api


_FEEDS = """both_feeds as (select match_id, match_date, home_team, away_team, home_goals, away_goals, tournament, 1 as source_priority from matches
 union all select match_id+1000000000, match_date, home_team, away_team, home_goals, away_goals, tournament, 2 from matches)"""


@add(
    "U1_union_feeds",
    with_views("matches", ctes=_FEEDS, body="""select source_priority, count(*) as matches, cast(sum(home_goals) as bigint) as home_goals
 from both_feeds group by 1"""),
)
def u1(spark, sf_dir):
    return standard.union_feeds(*_feeds(spark, sf_dir)).groupBy("source_priority").agg(
        F.count("*").alias("matches"), F.sum("home_goals").alias("home_goals")
    )


@add(
    "U4_deduplicate",
    with_views("matches", ctes=_FEEDS, body="""select match_id, cast(match_date as varchar) as match_date, home_team, away_team, home_goals, away_goals,
 tournament, source_priority from (select *, row_number() over (partition by match_date, home_team, away_team, home_goals, away_goals
  order by source_priority, match_id) as rn from both_feeds) where rn=1"""),
)
def u4(spark, sf_dir):
    kept = standard.deduplicate(standard.union_feeds(*_feeds(spark, sf_dir)))
    return kept.select(
        "match_id", day("match_date").alias("match_date"), "home_team", "away_team", "home_goals",
        "away_goals", "tournament", "source_priority",
    )


@add(
    "J1_alias_resolution",
    with_views("matches", ctes="""raw_names as (select match_id, case match_id%5 when 0 then ' USA ' when 1 then 'South Korea'
 when 2 then 'brasil' when 3 then 'Ivory Coast' else ' '||home_team||' ' end as home_team from matches)""",
        body="""select match_id, case match_id%5 when 0 then 'United States' when 1 then 'South Korea' when 2 then 'Brazil'
 when 3 then 'Côte d''Ivoire' else trim(home_team) end as home_team from raw_names"""),
)
def j1(spark, sf_dir):
    m = views.matches(spark, sf_dir)
    raw = (
        F.when(F.col("match_id") % 5 == 0, " USA ").when(F.col("match_id") % 5 == 1, "South Korea")
        .when(F.col("match_id") % 5 == 2, "brasil").when(F.col("match_id") % 5 == 3, "Ivory Coast")
        .otherwise(F.concat(F.lit(" "), F.col("home_team"), F.lit(" ")))
    )
    return dims.resolve_alias(m.select("match_id", raw.alias("home_team")), "home_team")


def members(spark, sf_dir):
    """(team, confederation) from nation and region; nations 20 up play under no name of their own."""
    nation = views.read_table(spark, sf_dir, "nation")
    region = views.read_table(spark, sf_dir, "region")
    listed = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.when(F.col("n_nationkey") < 20, F.col("n_name")).otherwise(F.concat(F.lit("FORMER "), "n_name")).alias("team"),
        F.when(F.col("n_nationkey") == 7, dims.REGIONAL).otherwise(F.col("r_name")).alias("confederation"),
    )
    return listed


MEMBERS_SQL = """members as (select case when n_nationkey<20 then n_name else 'FORMER '||n_name end as team, case when n_nationkey=7 then 'Regional/NonFIFA' else r_name end as confederation
 from nation join region on n_regionkey=r_regionkey),
sides as (select m.*, 'NATION_'||cast((match_id*7)%25 as varchar) as away_country from matches m),
confed as (select s.*, coalesce(h.confederation,'Unknown') as home_confederation, coalesce(a.confederation,'Unknown') as away_confederation
 from sides s left join members h on h.team=s.country left join members a on a.team=s.away_country)"""


def with_confederations(spark, sf_dir, df):
    df = df.withColumn("away_country", F.concat(F.lit("NATION_"), ((F.col("match_id") * 7) % 25).cast("string")))
    listed = members(spark, sf_dir)
    df = dims.with_confederation(df, "country", listed, "home_confederation")
    return dims.with_confederation(df, "away_country", listed, "away_confederation")


@add(
    "J2_confederation_lookup",
    with_views("matches", ctes=MEMBERS_SQL, body="select match_id, home_confederation, away_confederation from confed"),
)
def j2(spark, sf_dir):
    accented = F.concat(F.lit(" "), F.replace("country", F.lit("A"), F.lit("Á")))
    m = views.matches(spark, sf_dir).withColumn("country", accented)
    return with_confederations(spark, sf_dir, m).select("match_id", "home_confederation", "away_confederation")


@add(
    "J3_known_team_resolution",
    with_views("matches", body="""select match_id, case when match_id%50=0 then null else home_team end as resolved from matches"""),
)
def j3(spark, sf_dir):
    m = views.matches(spark, sf_dir)
    asked = m.select("match_id", F.when(F.col("match_id") % 50 == 0, "Nowhere").otherwise(
        F.concat(F.lit(" "), F.lower("home_team"), F.lit(" "))).alias("asked"))
    hit, miss = dims.resolve_known_team(asked, "asked", dims.distinct_teams(m), "resolved")
    return hit.select("match_id", "resolved").unionByName(
        miss.select("match_id", F.lit(None).cast("string").alias("resolved"))
    )


@add(
    "J11_confederation_matchup",
    with_views("matches", ctes=MEMBERS_SQL, body="""select match_id, case when home_confederation=away_confederation then home_confederation
 when home_confederation in ('Unknown','Regional/NonFIFA') or away_confederation in ('Unknown','Regional/NonFIFA') then 'Unknown/Regional Mix'
 else 'Inter-confederation' end as confederation_segment from confed"""),
)
def j11(spark, sf_dir):
    df = with_confederations(spark, sf_dir, views.matches(spark, sf_dir))
    segment = dims.matchup_segment(F.col("home_confederation"), F.col("away_confederation"))
    return df.select("match_id", segment.alias("confederation_segment"))


@add(
    "J12_known_confederations",
    with_views("matches", ctes=MEMBERS_SQL, body="""select match_id, home_confederation from confed
 where home_confederation not in ('Unknown','Regional/NonFIFA')"""),
)
def j12(spark, sf_dir):
    df = with_confederations(spark, sf_dir, views.matches(spark, sf_dir))
    return dims.known_confederations(df).select("match_id", "home_confederation")


@add(
    "A30_distinct_teams",
    with_views("matches", body="select home_team as team from matches union select away_team from matches"),
)
def a30(spark, sf_dir):
    return dims.distinct_teams(views.matches(spark, sf_dir))


@add(
    "A31_confederation_coverage",
    with_views("matches", ctes=MEMBERS_SQL, body="""select round(avg(case when home_confederation<>'Unknown' then 1.0 else 0.0 end),6) as known_home_confederation_ratio,
 round(avg(case when home_confederation in ('Unknown','Regional/NonFIFA') then 1.0 else 0.0 end),6) as regional_or_unknown_ratio from confed"""),
)
def a31(spark, sf_dir):
    from formline.operators.metrics import confederation_coverage

    return confederation_coverage(with_confederations(spark, sf_dir, views.matches(spark, sf_dir)))


@add(
    "F8_scalar_functions",
    with_views("matches", body="""select match_id, strip_accents('Côte '||replace(home_team,'A','Å')) as folded,
 greatest(home_goals, away_goals) as top_goals, round(ln(1+home_goals),6) as log_goals,
 round(1/(1+pow(10,(away_goals-home_goals)/4.0)),6) as logistic, cast(year(match_date) as int) as year,
 strftime(date_trunc('hour', kickoff_ts),'%Y-%m-%d %H') as hour,
 case when home_goals>away_goals then 2 when home_goals=away_goals then 1 else 0 end as encoded from matches"""),
)
def f8(spark, sf_dir):
    m = views.matches(spark, sf_dir)
    goals = F.col("home_goals"), F.col("away_goals")
    return m.select(
        "match_id",
        ascii_fold(F.concat(F.lit("Côte "), F.replace("home_team", F.lit("A"), F.lit("Å")))).alias("folded"),
        F.greatest(*goals).alias("top_goals"),
        F.round(F.log(1.0 + goals[0]), 6).alias("log_goals"),
        F.round(1 / (1 + F.pow(F.lit(10.0), (goals[1] - goals[0]) / 4.0)), 6).alias("logistic"),
        F.year("match_date").alias("year"),
        F.date_format(F.date_trunc("hour", "kickoff_ts"), "yyyy-MM-dd HH").alias("hour"),
        outcomes.encode(outcomes.outcome(*goals)).alias("encoded"),
    )


@add(
    "F1_pluggable_segment_detector",
    with_views("matches", body="""select case when tournament like '%Cup%' then 'cup' when tournament='Friendly' then 'friendly' else 'none' end as match_segment,
 count(*) as matches from matches group by 1"""),
)
def f1(spark, sf_dir):
    def cups(tournament):
        return F.when(tournament.contains("Cup"), "cup").when(tournament == "Friendly", "friendly")

    routed = standard.with_segment(views.matches(spark, sf_dir), detector=cups)
    return routed.groupBy(F.coalesce("match_segment", F.lit("none")).alias("match_segment")).agg(F.count("*").alias("matches"))
