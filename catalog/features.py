"""Form windows, ratings, snapshots, fixture features."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import Registry, day, r6, with_views
from formline import views
from formline.operators import form, ratings, snapshots, standard
from formline.plans.build import feature_table
from formline.sources.folders import stored

QUERIES = Registry()
add = QUERIES.add

FRAME = "rows between 5 preceding and 1 preceding"

LONG_SQL = """long_rows as (select match_id, match_date, kickoff_ts, 'home' as role, home_team as team, away_team as opponent,
  home_goals as goals_for, away_goals as goals_against from matches
 union all select match_id, match_date, kickoff_ts, 'away', away_team, home_team, away_goals, home_goals from matches)"""

RATED_SQL = """m as materialized (select match_id, pool_id, match_date, home_goals, away_goals,
 cast(replace(home_team,'TEAM_','') as int)%12+1 as h, cast(replace(away_team,'TEAM_','') as int)%12+1 as a,
 row_number() over (partition by pool_id order by kickoff_ts, match_id) as seq from matches),
fold as (
 select pool_id, cast(0 as bigint) as seq, list_transform(range(12), lambda x: 1500.0::double) as rt, list_transform(range(12), lambda x: null::date) as ld, null::bigint as match_id, null::double as eh, null::double as ea
   from (select distinct pool_id from m) p
 union all
 select pool_id, seq,
  list_transform(rt,lambda v,i: case when i=h then eh+20*(sc-ex) when i=a then ea-20*(sc-ex) else v end),
  list_transform(ld,lambda v,i: case when i=h or i=a then match_date else v end), match_id, eh, ea
 from (select *, 1/(1+pow(10,(ea-eh)/400)) as ex from (
  select m.pool_id,m.seq,r.rt,r.ld,m.h,m.a,m.match_date,m.match_id,
   case when home_goals>away_goals then 1.0 when home_goals<away_goals then 0.0 else 0.5 end::double as sc,
   {home} as eh, {away} as ea
  from fold r join m on m.pool_id=r.pool_id and m.seq=r.seq+1) x) y),
rated as materialized (select match_id, eh as elo_home, ea as elo_away from fold where seq>0)"""
_DECAYED = ("case when r.ld[{s}] is not null and m.match_date>r.ld[{s}] then "
            "1500+(r.rt[{s}]-1500)*pow(0.97,(m.match_date-r.ld[{s}])/90.0) else r.rt[{s}] end")
RATED_DECAY_SQL = RATED_SQL.format(home=_DECAYED.format(s="h"), away=_DECAYED.format(s="a"))
RATED_PLAIN_SQL = RATED_SQL.format(home="r.rt[h]", away="r.rt[a]")

# Every form column, long form first, then back on the match row.
FEATURES_SQL = RATED_DECAY_SQL + """,
base as materialized (select m2.*, elo_home, elo_away from matches m2 join rated using (match_id)),
side as (select match_id, match_date, kickoff_ts, 'home' as role, home_team as team, away_team as opponent, home_goals as gf, away_goals as ga,
  elo_home as elo, elo_away as opp from base
 union all select match_id, match_date, kickoff_ts, 'away', away_team, home_team, away_goals, home_goals, elo_away, elo_home from base),
scored as (select *, case when gf>ga then 1.0 when gf=ga then 0.5 else 0.0 end::double as pts, case when gf=ga then 1.0 else 0.0 end::double as drawn from side),
formed as materialized (select match_id, role,
  avg(gf) over r as avg_goals_last5, avg(ga) over r as avg_goals_conceded_last5, avg(pts) over r as win_rate_last5, avg(drawn) over r as draw_rate_last5,
  avg(gf) over t as global_avg_goals_last5, avg(ga) over t as global_avg_conceded_last5, avg(pts) over t as global_win_rate_last5,
  avg(opp) over r as avg_opponent_elo_last5, avg(pts*opp/1500) over r as weighted_win_rate_last5, avg(elo) over r as elo_form
 from scored window r as (partition by team, role order by kickoff_ts, match_id rows between 5 preceding and 1 preceding),
  t as (partition by team order by kickoff_ts, match_id rows between 5 preceding and 1 preceding)),
features as materialized (select b.*, h.avg_goals_last5 as home_avg_goals_last5, h.avg_goals_conceded_last5 as home_avg_goals_conceded_last5,
  h.win_rate_last5 as home_win_rate_last5, h.draw_rate_last5 as home_draw_rate_last5, h.global_avg_goals_last5 as home_global_avg_goals_last5,
  h.global_avg_conceded_last5 as home_global_avg_conceded_last5, h.global_win_rate_last5 as home_global_win_rate_last5,
  h.avg_opponent_elo_last5 as home_avg_opponent_elo_last5, h.weighted_win_rate_last5 as home_weighted_win_rate_last5, h.elo_form as home_elo_form,
  h.avg_opponent_elo_last5 as home_opponent_elo_form,
  a.avg_goals_last5 as away_avg_goals_last5, a.avg_goals_conceded_last5 as away_avg_goals_conceded_last5,
  a.win_rate_last5 as away_win_rate_last5, a.draw_rate_last5 as away_draw_rate_last5, a.global_avg_goals_last5 as away_global_avg_goals_last5,
  a.global_avg_conceded_last5 as away_global_avg_conceded_last5, a.global_win_rate_last5 as away_global_win_rate_last5,
  a.avg_opponent_elo_last5 as away_avg_opponent_elo_last5, a.weighted_win_rate_last5 as away_weighted_win_rate_last5, a.elo_form as away_elo_form,
  a.avg_opponent_elo_last5 as away_opponent_elo_form,
  h.win_rate_last5-a.win_rate_last5 as home_advantage_effect
 from base b join formed h on h.match_id=b.match_id and h.role='home' join formed a on a.match_id=b.match_id and a.role='away')"""


def rated(spark, sf_dir, decay=True):
    return ratings.exact_ratings(views.matches(spark, sf_dir), ["pool_id"], decay)


def featured(spark, sf_dir):
    return form.with_form(stored(rated(spark, sf_dir)), counted=views.matches(spark, sf_dir))


def _window_sql(columns: dict[str, tuple[str, str]]) -> str:
    """name -> (value, partition) over the match table."""
    picks = ", ".join(
        f"round(avg({value}) over (partition by {key} order by kickoff_ts, match_id {FRAME}),6) as {name}"
        for name, (value, key) in columns.items()
    )
    return with_views("matches", body=f"select match_id, {picks} from matches")


def _form_query(*names):
    def query(spark, sf_dir):
        wide = form.with_form(views.matches(spark, sf_dir))
        return wide.select("match_id", *[r6(n).alias(n) for n in names])

    return query


def _rated_form_query(*names):
    def query(spark, sf_dir):
        return featured(spark, sf_dir).select("match_id", *[r6(n).alias(n) for n in names])

    return query


_POINTS_HOME = "case when home_goals>away_goals then 1.0 when home_goals=away_goals then 0.5 else 0.0 end::double"
_POINTS_AWAY = "case when away_goals>home_goals then 1.0 when home_goals=away_goals then 0.5 else 0.0 end::double"
_DRAWN = "case when home_goals=away_goals then 1.0 else 0.0 end::double"

for _name, _columns in {
    "L1_home_avg_goals": {"home_avg_goals_last5": ("home_goals", "home_team")},
    "L2_home_avg_goals_conceded": {"home_avg_goals_conceded_last5": ("away_goals", "home_team")},
    "L3_away_avg_goals": {"away_avg_goals_last5": ("away_goals", "away_team")},
    "L4_away_avg_goals_conceded": {"away_avg_goals_conceded_last5": ("home_goals", "away_team")},
    "L6_role_win_rate": {"home_win_rate_last5": (_POINTS_HOME, "home_team"),
                         "away_win_rate_last5": (_POINTS_AWAY, "away_team")},
    "L8_role_draw_rate": {"home_draw_rate_last5": (_DRAWN, "home_team"),
                          "away_draw_rate_last5": (_DRAWN, "away_team")},
}.items():
    add(_name, _window_sql(_columns))(_form_query(*_columns))


def _global_sql(columns: dict[str, str]) -> str:
    picks = ", ".join(
        f"round(max(case when role='{side}' then {name} end),6) as {side}_{name}"
        for side in ("home", "away") for name in columns
    )
    inner = ", ".join(
        f"avg({value}) over (partition by team order by kickoff_ts, match_id {FRAME}) as {name}"
        for name, value in columns.items()
    )
    return with_views("matches", ctes=LONG_SQL, body=f"select match_id, {picks} from (select match_id, role, {inner} from long_rows) group by match_id")


_POINTS = "case when goals_for>goals_against then 1.0 when goals_for=goals_against then 0.5 else 0.0 end::double"
for _name, _columns in {
    "L5_global_goals": {"global_avg_goals_last5": "goals_for", "global_avg_conceded_last5": "goals_against"},
    "L7_global_win_rate": {"global_win_rate_last5": _POINTS},
}.items():
    add(_name, _global_sql(_columns))(_form_query(*[f"{s}_{n}" for s in ("home", "away") for n in _columns]))

for _name, _columns in {
    "L9_opponent_strength": ("home_avg_opponent_elo_last5", "away_avg_opponent_elo_last5"),
    "L10_weighted_win_rate": ("home_weighted_win_rate_last5", "away_weighted_win_rate_last5"),
    "L11_opponent_form": ("home_opponent_elo_form", "away_opponent_elo_form"),
    "L12_rating_form": ("home_elo_form", "away_elo_form"),
}.items():
    add(_name, with_views("matches", recursive=True, ctes=FEATURES_SQL, body="select match_id, " + ", ".join(
        f"round({c},6) as {c}" for c in _columns) + " from features"))(_rated_form_query(*_columns))


@add(
    "U2_team_rows",
    with_views("matches", ctes=LONG_SQL, body="select match_id, role, team, opponent, goals_for, goals_against from long_rows"),
)
def u2(spark, sf_dir):
    rows = form.team_rows(views.matches(spark, sf_dir))
    return rows.select("match_id", "role", "team", "opponent", "goals_for", "goals_against")


@add(
    "P19_role_results",
    with_views("matches", ctes=LONG_SQL, body=f"select match_id, role, {_POINTS} as points, "
               "case when goals_for=goals_against then 1.0 else 0.0 end::double as drawn from long_rows"),
)
def p19(spark, sf_dir):
    rows = form.with_role_results(form.team_rows(views.matches(spark, sf_dir)))
    return rows.select("match_id", "role", "points", "drawn")


@add(
    "J10_reattach_by_match_and_role",
    with_views("matches", ctes=LONG_SQL + f""",
formed as (select match_id, role, avg(goals_for) over (partition by team order by kickoff_ts, match_id {FRAME}) as g from long_rows)""",
        body="""select m.match_id, m.home_team, m.away_team, round(h.g,6) as home_global_avg_goals_last5, round(a.g,6) as away_global_avg_goals_last5
 from matches m join formed h on h.match_id=m.match_id and h.role='home' join formed a on a.match_id=m.match_id and a.role='away'"""),
)
def j10(spark, sf_dir):
    m = views.matches(spark, sf_dir)
    wide = form.reattach(m, form.team_form(m))
    return wide.select("match_id", "home_team", "away_team", *[
        r6(f"{s}_global_avg_goals_last5").alias(f"{s}_global_avg_goals_last5") for s in ("home", "away")])


@add(
    "W5_sequential_ratings",
    with_views("matches", recursive=True, ctes=RATED_PLAIN_SQL,
               body="select match_id, round(elo_home,6) as elo_home, round(elo_away,6) as elo_away from rated"),
)
def w5(spark, sf_dir):
    out = rated(spark, sf_dir, decay=False)
    return out.select("match_id", r6("elo_home").alias("elo_home"), r6("elo_away").alias("elo_away"))


@add(
    "W6_ratings_with_decay",
    with_views("matches", recursive=True, ctes=RATED_DECAY_SQL,
               body="select match_id, round(elo_home,6) as elo_home, round(elo_away,6) as elo_away from rated"),
)
def w6(spark, sf_dir):
    out = rated(spark, sf_dir)
    return out.select("match_id", r6("elo_home").alias("elo_home"), r6("elo_away").alias("elo_away"))


# One team graph: the away side of every match comes from the next pool, so all teams are connected.
_ONE_GRAPH_SQL = """g as materialized (select match_id, kickoff_ts, match_date, home_goals, away_goals, home_team,
 concat('TEAM_', cast((cast(replace(away_team,'TEAM_','') as int)+12)%96 as varchar)) as away_team from matches),
m as materialized (select match_id, match_date, home_goals, away_goals,
 cast(replace(home_team,'TEAM_','') as int)+1 as h, cast(replace(away_team,'TEAM_','') as int)+1 as a,
 row_number() over (order by kickoff_ts, match_id) as seq from g),
fold as (
 select cast(0 as bigint) as seq, list_transform(range(96), lambda x: 1500.0::double) as rt, list_transform(range(96), lambda x: null::date) as ld,
  null::bigint as match_id, null::double as eh, null::double as ea
 union all
 select seq,
  list_transform(rt,lambda v,i: case when i=h then eh+20*(sc-ex) when i=a then ea-20*(sc-ex) else v end),
  list_transform(ld,lambda v,i: case when i=h or i=a then match_date else v end), match_id, eh, ea
 from (select *, 1/(1+pow(10,(ea-eh)/400)) as ex from (
  select m.seq,r.rt,r.ld,m.h,m.a,m.match_date,m.match_id,
   case when home_goals>away_goals then 1.0 when home_goals<away_goals then 0.0 else 0.5 end::double as sc,
   """ + _DECAYED.format(s="h") + " as eh, " + _DECAYED.format(s="a") + """ as ea
  from fold r join m on m.seq=r.seq+1) x) y)"""


@add(
    "W6_ratings_by_levels",
    with_views("matches", recursive=True, ctes=_ONE_GRAPH_SQL,
               body="select match_id, round(eh,6) as elo_home, round(ea,6) as elo_away from fold where seq>0"),
)
def w6_levels(spark, sf_dir):
    away = F.concat(F.lit("TEAM_"), ((F.substring_index("away_team", "_", -1).cast("int") + 12) % 96).cast("string"))
    graph = views.matches(spark, sf_dir).withColumn("away_team", away)
    out = ratings.exact_ratings(graph, rows_per_step=2000)
    return out.select("match_id", r6("elo_home").alias("elo_home"), r6("elo_away").alias("elo_away"))


@add(
    "P17_pair_features",
    with_views("matches", recursive=True, ctes=RATED_DECAY_SQL, body="""select match_id, round(elo_home-elo_away,6) as elo_diff, round(elo_away,6) as home_opponent_elo,
 round(elo_home,6) as away_opponent_elo, round(elo_home/greatest(elo_away,1e-6),6) as elo_ratio_home, round(elo_home+elo_away,6) as combined_elo_strength from rated"""),
)
def p17(spark, sf_dir):
    out = form.with_pair_features(rated(spark, sf_dir))
    names = "elo_diff", "home_opponent_elo", "away_opponent_elo", "elo_ratio_home", "combined_elo_strength"
    return out.select("match_id", *[r6(n).alias(n) for n in names])


@add(
    "P18_home_advantage",
    with_views("matches", body=f"""select match_id, round(avg({_POINTS_HOME}) over (partition by home_team order by kickoff_ts, match_id {FRAME})
 - avg({_POINTS_AWAY}) over (partition by away_team order by kickoff_ts, match_id {FRAME}),6) as home_advantage_effect from matches"""),
)
def p18(spark, sf_dir):
    return form.with_form(views.matches(spark, sf_dir)).select(
        "match_id", r6("home_advantage_effect").alias("home_advantage_effect"))


CURATED = (
    "elo_home", "elo_away", "elo_diff",
    *[f"{s}_{v}" for s in ("home", "away") for v in snapshots.SIDE_VALUES],
    "home_advantage_effect",
)


@add(
    "P3_curated_feature_table",
    with_views("matches", recursive=True, ctes=FEATURES_SQL, body="select match_id, cast(match_date as varchar) as match_date, home_team, away_team, tournament, "
               + ", ".join(f"round({'elo_home-elo_away' if c == 'elo_diff' else c},6) as {c}" for c in CURATED)
               + """, case when tournament='Friendly' then 1 else 0 end as is_friendly,
 case when tournament like 'FIFA%' then 1 else 0 end as is_world_cup,
 case when tournament like '%qualification' then 1 else 0 end as is_qualifier,
 case when tournament='UEFA Euro' then 1 else 0 end as is_continental,
 cast(sign(home_goals-away_goals) as int) as target_multiclass, case when home_goals>away_goals then 1 else 0 end as target from features"""),
)
def p3(spark, sf_dir):
    table = feature_table(views.matches(spark, sf_dir), pool=["pool_id"])
    return table.select(
        "match_id", day("match_date").alias("match_date"), "home_team", "away_team", "tournament",
        *[r6(c).alias(c) for c in CURATED],
        "is_friendly", "is_world_cup", "is_qualifier", "is_continental", "target_multiclass", "target",
    )


SNAPSHOT_COLUMNS = ["elo", "opponent_elo", *snapshots.SIDE_VALUES]

HISTORY_SQL = FEATURES_SQL + ",\nhistory as (" + " union all ".join(
    f"select match_date as snapshot_date, match_id, kickoff_ts, {own}_team as team, {other}_team as opponent, '{own}' as team_role, "
    f"elo_{own} as elo, elo_{other} as opponent_elo, "
    + ", ".join(f"{own}_{v} as {v}" for v in snapshots.SIDE_VALUES) + " from features"
    for own, other in (("home", "away"), ("away", "home"))) + ")"


def history(spark, sf_dir):
    return snapshots.team_snapshots(featured(spark, sf_dir))


def _snapshot_view(df):
    return df.select(day("snapshot_date").alias("snapshot_date"), "match_id", "team", "opponent", "team_role",
                     *[r6(c).alias(c) for c in SNAPSHOT_COLUMNS])


_SNAPSHOT_PICK = ("select cast(snapshot_date as varchar) as snapshot_date, match_id, team, opponent, team_role, "
                  + ", ".join(f"round({c},6) as {c}" for c in SNAPSHOT_COLUMNS))


def _latest_cte(keys: str, role: str) -> str:
    return (f"select * replace ({role} as team_role) from (select *, row_number() over (partition by {keys} "
            "order by snapshot_date desc, kickoff_ts desc, match_id desc) as rn from history) where rn=1")


@add(
    "W1_latest_by_role",
    with_views("matches", recursive=True, ctes=HISTORY_SQL, body=f"{_SNAPSHOT_PICK} from ({_latest_cte('team, team_role', 'team_role')})"),
)
def w1(spark, sf_dir):
    return _snapshot_view(snapshots.latest_by_role(history(spark, sf_dir)))


@add(
    "W2_latest_overall",
    with_views("matches", recursive=True, ctes=HISTORY_SQL, body=f"{_SNAPSHOT_PICK} from ({_latest_cte('team', chr(39) + 'overall' + chr(39))})"),
)
def w2(spark, sf_dir):
    return _snapshot_view(snapshots.latest_overall(history(spark, sf_dir)))


LATEST_SQL = f"latest as ({_latest_cte('team, team_role', 'team_role')} union all {_latest_cte('team', chr(39) + 'overall' + chr(39))})"


@add(
    "U3_latest_snapshots",
    with_views("matches", recursive=True, ctes=HISTORY_SQL + ",\n" + LATEST_SQL, body=f"{_SNAPSHOT_PICK} from latest"),
)
def u3(spark, sf_dir):
    return _snapshot_view(snapshots.latest_snapshots(history(spark, sf_dir)))


@add(
    "P21_snapshots_up_to_a_day",
    with_views("matches", ctes=LONG_SQL, body="""select team, role, cast(max(match_date) as varchar) as snapshot_date, max_by(match_id, (kickoff_ts, match_id)) as match_id
 from long_rows where match_date <= date '2024-01-10' group by 1,2"""),
)
def p21(spark, sf_dir):
    rows = snapshots.team_snapshots(views.matches(spark, sf_dir))
    latest = snapshots.latest_by_role(snapshots.on_or_before(rows, "2024-01-10"))
    return latest.select("team", F.col("team_role").alias("role"), day("snapshot_date").alias("snapshot_date"), "match_id")


FIXTURE_COLUMNS = (
    "elo_home", "elo_away", "elo_diff", "elo_ratio_home", "combined_elo_strength", "home_advantage_effect",
    *[f"{s}_{v}" for s in ("home", "away") for v in snapshots.SIDE_VALUES],
)


def fixtures(spark, sf_dir):
    """Every match again as a request, teams swapped, on its own date."""
    m = views.matches(spark, sf_dir)
    return m.select("match_id", "match_date", F.col("away_team").alias("home_team"),
                    F.col("home_team").alias("away_team"), "tournament", "neutral")


def _fixture_view(df):
    return df.select("match_id", "home_team", "away_team", *[r6(c).alias(c) for c in FIXTURE_COLUMNS],
                     "is_world_cup", "is_qualifier", day("home_snapshot_date").alias("home_snapshot_date"),
                     day("away_snapshot_date").alias("away_snapshot_date"))


def _fixture_pick() -> str:
    parts = ["round(ho.elo,6) as elo_home", "round(ao.elo,6) as elo_away", "round(ho.elo-ao.elo,6) as elo_diff",
             "round(ho.elo/greatest(ao.elo,1e-6),6) as elo_ratio_home", "round(ho.elo+ao.elo,6) as combined_elo_strength",
             "round(case when f.neutral then 0.0 else coalesce(hr.win_rate_last5, ho.global_win_rate_last5)-coalesce(ar.win_rate_last5, ao.global_win_rate_last5) end,6) as home_advantage_effect"]
    for side in ("home", "away"):
        for v in snapshots.SIDE_VALUES:
            source = f"{side[0]}o" if v.startswith("global_") else f"{side[0]}r"
            parts.append(f"round({source}.{v},6) as {side}_{v}")
    return ("select f.match_id, f.home_team, f.away_team, " + ", ".join(parts)
            + ", case when f.tournament like 'FIFA%' then 1 else 0 end as is_world_cup, case when f.tournament like '%qualification' then 1 else 0 end as is_qualifier"
            + ", cast(ho.snapshot_date as varchar) as home_snapshot_date, cast(ao.snapshot_date as varchar) as away_snapshot_date")


_FIXTURES_SQL = """fixtures as (select match_id, match_date, away_team as home_team, home_team as away_team, tournament, neutral
 from matches)"""


@add(
    "J4_fixture_features_latest",
    with_views("matches", recursive=True, ctes=HISTORY_SQL + ",\n" + LATEST_SQL + ",\n" + _FIXTURES_SQL, body=_fixture_pick() + """ from fixtures f
 join latest ho on ho.team=f.home_team and ho.team_role='overall' join latest ao on ao.team=f.away_team and ao.team_role='overall'
 left join latest hr on hr.team=f.home_team and hr.team_role='home' left join latest ar on ar.team=f.away_team and ar.team_role='away'"""),
)
def j4(spark, sf_dir):
    latest = snapshots.latest_snapshots(history(spark, sf_dir))
    good, _ = snapshots.fixture_features_latest(fixtures(spark, sf_dir), latest)
    return _fixture_view(good)


@add(
    "J4_unresolved_fixtures",
    with_views("matches", ctes=_FIXTURES_SQL, body="select match_id, tournament from fixtures where home_team='TEAM_1' or away_team='TEAM_1'"),
)
def j4_missing(spark, sf_dir):
    latest = snapshots.latest_snapshots(history(spark, sf_dir)).filter("team <> 'TEAM_1'")
    asked = fixtures(spark, sf_dir).withColumn("home_team", F.lower("home_team"))
    _, missing = snapshots.fixture_features_latest(asked, latest)
    return missing.select("match_id", "tournament")


def _as_of_cte(name: str, side: str, role: str | None) -> str:
    condition = f" and h.team_role='{role}'" if role else ""
    return (f"{name} as (select f.match_id as fixture_id, h.* from fixtures f join history h on h.team=f.{side}_team{condition} and h.snapshot_date<=f.match_date"
            " qualify row_number() over (partition by f.match_id order by h.snapshot_date desc, h.kickoff_ts desc, h.match_id desc)=1)")


@add(
    "J5_fixture_features_as_of",
    with_views("matches", recursive=True, ctes=",\n".join([HISTORY_SQL, _FIXTURES_SQL, _as_of_cte("ho", "home", None), _as_of_cte("ao", "away", None),
               _as_of_cte("hr", "home", "home"), _as_of_cte("ar", "away", "away")]), body=_fixture_pick() + """ from fixtures f
 join ho on ho.fixture_id=f.match_id join ao on ao.fixture_id=f.match_id
 left join hr on hr.fixture_id=f.match_id left join ar on ar.fixture_id=f.match_id"""),
)
def j5(spark, sf_dir):
    good, _ = snapshots.fixture_features_as_of(
        fixtures(spark, sf_dir), history(spark, sf_dir), counted=snapshots.team_snapshots(views.matches(spark, sf_dir)))
    return _fixture_view(good)
