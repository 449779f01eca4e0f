"""Metrics, segment reports, global order, thresholds, ranking, promotion."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import Registry, day, r6, with_views
from catalog.standard import MEMBERS_SQL, with_confederations
from formline import views
from formline.functions import outcomes
from formline.functions.tournaments import rank_in_order
from formline.operators import metrics, ordered, report, standard, thresholds

QUERIES = Registry()
add = QUERIES.add


def frame(spark, sf_dir):
    """Generalist rows as an evaluation frame."""
    p = views.predictions(spark, sf_dir)
    row = [F.col(c) for c in thresholds.GENERALIST]
    return p.withColumns({
        "p_away": row[0], "p_draw": row[1], "p_home": row[2], "predicted": outcomes.argmax_class(*row),
    })


def specialist_frame(spark, sf_dir):
    p = views.predictions(spark, sf_dir)
    row = [F.col(c) for c in thresholds.SPECIALIST]
    return p.withColumns({
        "p_away": row[0], "p_draw": row[1], "p_home": row[2], "predicted": outcomes.argmax_class(*row),
    })


def _frame_cte(name: str = "frame", prefix: str = "g") -> str:
    a, d, h = f"{prefix}_away", f"{prefix}_draw", f"{prefix}_home"
    return f"""{name} as (select *, {a} as p_away, {d} as p_draw, {h} as p_home, greatest({a},{d},{h}) as conf,
 case when {a}>={d} and {a}>={h} then -1 when {d}>={h} then 0 else 1 end as predicted,
 case when actual=-1 then {a} when actual=0 then {d} else {h} end as p_true from predictions)"""


FRAME_SQL = _frame_cte()


def suite_sql(source: str, group: str | None, extra: str = "") -> str:
    """Metric suite over `source` as a SELECT, built from class counts and bins."""
    g = f"{group} as grp" if group else "0 as grp"
    return f"""(with src as (select *, {g} from {source}),
 agg as (select grp, count(*) as n, {extra}
  sum(case when actual=predicted then 1 else 0 end)::double as hits,
  avg(-ln(least(greatest(p_true/(p_away+p_draw+p_home), 2.220446049250313e-16), 1-2.220446049250313e-16))) as log_loss,
  avg(pow(p_away-(case when actual=-1 then 1 else 0 end),2)+pow(p_draw-(case when actual=0 then 1 else 0 end),2)+pow(p_home-(case when actual=1 then 1 else 0 end),2)) as brier
  from src group by grp),
 cls as (select grp, k, sum(case when actual=k then 1 else 0 end)::double as t, sum(case when predicted=k then 1 else 0 end)::double as p,
   sum(case when actual=k and predicted=k then 1 else 0 end)::double as tp from src, (values (-1),(0),(1)) v(k) group by grp, k),
 per as (select grp, k, t, p, tp, case when p=0 then 0 else tp/p end as prec, case when t=0 then 0 else tp/t end as rec,
   case when t+p=0 then 0 else 2*tp/(t+p) end as f1 from cls),
 roll as (select grp, avg(case when t+p>0 then f1 end) as macro_f1, sum(f1*t)/sum(t) as weighted_f1, avg(case when t>0 then rec end) as balanced,
   sum(t*p) as tpsum, sum(t*t) as t2, sum(p*p) as p2, max(case when k=0 then f1 end) as draw_f1, max(case when k=0 then rec end) as draw_recall from per group by grp),
 bins as (select grp, case when conf>=1.0 then 9 else
   (select count(*) from range(1,10) e(i) where i*0.1::double<=conf) end as b, count(*) as c, avg(case when actual=predicted then 1.0 else 0.0 end) as acc, avg(conf) as cf
   from src group by 1,2),
 ece as (select grp, sum(c*abs(acc-cf))/sum(c) as ece from bins group by grp)
 select agg.*, macro_f1, weighted_f1, balanced, draw_f1, draw_recall, ece, hits/n as accuracy,
  case when (n*n-p2)*(n*n-t2)=0 then 0 else (hits*n-tpsum)/sqrt((n*n-p2)*(n*n-t2)) end as mcc,
  (hits/n-tpsum/(n*n))/(1-tpsum/(n*n)) as kappa
 from agg join roll using (grp) join ece using (grp))"""


SUITE_PICK = """n, round(accuracy,6) as accuracy, round(macro_f1,6) as macro_f1, round(weighted_f1,6) as weighted_f1, round(balanced,6) as balanced_accuracy,
 round(mcc,6) as matthews_corrcoef, round(kappa,6) as cohen_kappa, round(log_loss,6) as log_loss, round(brier,6) as multiclass_brier_score,
 round(ece,6) as expected_calibration_error, round(draw_f1,6) as draw_f1, round(draw_recall,6) as draw_recall"""
SUITE_SQL = suite_sql("frame", None)


def rounded_suite(df, *keep):
    return df.select(*keep, "n", *[r6(m).alias(m) for m in metrics.SUITE])


def _one(name, *columns, sql_names=None):
    pairs = dict(zip(columns, sql_names or columns))
    picks = ", ".join(f"round({source},6) as {c}" for c, source in pairs.items())

    @add(name, with_views("predictions", ctes=FRAME_SQL, body=f"select {picks} from {SUITE_SQL}"))
    def query(spark, sf_dir):
        return metrics.evaluate(frame(spark, sf_dir)).select(*[r6(c).alias(c) for c in columns])


_one("A4_accuracy", "accuracy")
_one("A6_balanced_accuracy", "balanced_accuracy", sql_names=("balanced",))
_one("A7_matthews_correlation", "matthews_corrcoef", sql_names=("mcc",))
_one("A8_cohen_kappa", "cohen_kappa", sql_names=("kappa",))
_one("A9_log_loss", "log_loss")
_one("A10_brier", "multiclass_brier_score", sql_names=("brier",))
_one("A12_draw_scores", "draw_f1", "draw_recall")


@add(
    "A1_class_distribution",
    with_views("predictions", body="""select actual, count(*) as rows, round(100.0*count(*)/sum(count(*)) over (),6) as percent
 from predictions group by actual"""),
)
def a1(spark, sf_dir):
    return metrics.class_distribution(views.predictions(spark, sf_dir), "actual").withColumn("percent", r6("percent"))


@add(
    "A2_imbalance",
    with_views("predictions", body="""select round(max(c)/min(c)::double,6) as ratio,
 case when max(c)/min(c)::double<1.5 then 'balanced' when max(c)/min(c)::double<3 then 'moderate' else 'severe' end as verdict
 from (select count(*) as c from predictions group by actual)"""),
)
def a2(spark, sf_dir):
    return metrics.imbalance(views.predictions(spark, sf_dir), "actual").withColumn("ratio", r6("ratio"))


@add(
    "A3_confusion_matrix",
    with_views("predictions", ctes=FRAME_SQL, body="""select actual, a as predicted_away, d as predicted_draw, h as predicted_home,
 round(a/(a+d+h)::double,6) as share_away, round(d/(a+d+h)::double,6) as share_draw, round(h/(a+d+h)::double,6) as share_home
 from (select actual, count(*) filter (predicted=-1) as a, count(*) filter (predicted=0) as d, count(*) filter (predicted=1) as h from frame group by actual)"""),
)
def a3(spark, sf_dir):
    m = metrics.confusion_matrix(frame(spark, sf_dir))
    return m.withColumns({f"share_{c}": r6(f"share_{c}") for c in ("away", "draw", "home")})


@add(
    "A5_class_report",
    with_views("predictions", ctes=FRAME_SQL + """,
cls as (select k, sum(case when actual=k then 1 else 0 end)::bigint as t, sum(case when predicted=k then 1 else 0 end)::bigint as p,
  sum(case when actual=k and predicted=k then 1 else 0 end)::bigint as tp from frame, (values (-1),(0),(1)) v(k) group by k),
per as (select case k when -1 then 'away_win' when 0 then 'draw' else 'home_win' end as label, tp/p::double as pr, tp/t::double as rc, 2.0*tp/(t+p) as f1, t from cls)""",
        body="""select label, round(pr,6) as precision, round(rc,6) as recall, round(f1,6) as f1_score, t as support from per
 union all select 'macro avg', round(avg(pr),6), round(avg(rc),6), round(avg(f1),6), cast(sum(t) as bigint) from per
 union all select 'weighted avg', round(sum(pr*t)/sum(t),6), round(sum(rc*t)/sum(t),6), round(sum(f1*t)/sum(t),6), cast(sum(t) as bigint) from per"""),
)
def a5(spark, sf_dir):
    return metrics.class_report(frame(spark, sf_dir)).withColumns(
        {c: r6(c) for c in ("precision", "recall", "f1_score")})


@add(
    "A11_calibration_error",
    with_views("predictions", ctes=FRAME_SQL, body="""select cast((select count(*) from range(1,10) e(i) where i*0.1::double<=conf) as int) as bin,
 count(*) as rows, round(avg(conf),6) as confidence, round(avg(case when actual=predicted then 1.0 else 0.0 end),6) as accuracy from frame group by 1"""),
)
def a11(spark, sf_dir):
    bins = metrics.calibration_bins(frame(spark, sf_dir))
    return bins.withColumns({"confidence": r6("confidence"), "accuracy": r6("accuracy")})


@add(
    "A13_metric_suite",
    with_views("predictions", ctes=FRAME_SQL, body=f"select {SUITE_PICK} from {SUITE_SQL}"),
)
def a13(spark, sf_dir):
    return rounded_suite(metrics.evaluate(frame(spark, sf_dir)))


# ---- segments -------------------------------------------------------------

REPORT_SQL = MEMBERS_SQL + ",\n" + FRAME_SQL + """,
report_frame as (select f.*, case actual when -1 then 'away_win' when 0 then 'draw' else 'home_win' end as actual_label,
  case predicted when -1 then 'away_win' when 0 then 'draw' else 'home_win' end as predicted_label,
  case when f.tournament like 'FIFA%' then 'World Cup' when f.tournament='UEFA Euro' then 'Continental' when f.tournament='Friendly' then 'Friendly' else 'Other' end as competition_segment,
  cast(year(f.match_date)-(1-year(f.match_date)%2) as varchar)||'-'||cast(year(f.match_date)-(1-year(f.match_date)%2)+1 as varchar) as time_window,
  home_confederation, away_confederation,
  case when home_confederation=away_confederation then home_confederation
   when home_confederation in ('Unknown','Regional/NonFIFA') or away_confederation in ('Unknown','Regional/NonFIFA') then 'Unknown/Regional Mix'
   else 'Inter-confederation' end as confederation_segment
 from frame f join confed c using (match_id))"""


def report_frame(spark, sf_dir):
    flagged = standard.with_training_flags(frame(spark, sf_dir))
    return metrics.prediction_frame(with_confederations(spark, sf_dir, flagged))


@add(
    "P28_prediction_frame",
    with_views("predictions", ctes=REPORT_SQL, body="""select match_id, actual_label, predicted_label, round(conf,6) as max_probability, competition_segment, time_window,
 home_confederation, away_confederation, confederation_segment from report_frame"""),
)
def p28(spark, sf_dir):
    return report_frame(spark, sf_dir).select(
        "match_id", "actual_label", "predicted_label", r6("max_probability").alias("max_probability"), "competition_segment",
        "time_window", "home_confederation", "away_confederation", "confederation_segment")


_DATES = "cast(min(match_date) as varchar) as date_start, cast(max(match_date) as varchar) as date_end, "


@add(
    "A14_segment_analysis",
    with_views("predictions", ctes=REPORT_SQL, body="select 'competition_segment' as segment_type, grp as segment_value, date_start, date_end, "
               + SUITE_PICK + f" from {suite_sql('report_frame', 'competition_segment', _DATES)} where n>=60"),
)
def a14(spark, sf_dir):
    out = metrics.segment_analysis(report_frame(spark, sf_dir), "competition_segment", 60)
    return rounded_suite(out, "segment_type", "segment_value", day("date_start").alias("date_start"), day("date_end").alias("date_end"))


@add(
    "A14_all_segments_one_pass",
    with_views("predictions", ctes=REPORT_SQL, body=" union all ".join(
        f"select '{c}' as segment_type, grp as segment_value, date_start, date_end, {SUITE_PICK} from {suite_sql('report_frame', c, _DATES)} where n>={m}"
        + (" and grp not in ('Unknown','Regional/NonFIFA')" if c == "home_confederation" else "")
        for c, m in metrics.SEGMENT_MIN_ROWS.items())),
)
def a14_all(spark, sf_dir):
    out = metrics.all_segments(report_frame(spark, sf_dir))
    return rounded_suite(out, "segment_type", "segment_value", day("date_start").alias("date_start"), day("date_end").alias("date_end"))


@add(
    "T8_category_order",
    with_views("predictions", ctes=REPORT_SQL, body="""select competition_segment, count(*) as matches,
 case competition_segment when 'World Cup' then 1 when 'Qualifier' then 2 when 'Continental' then 3 when 'Friendly' then 4 when 'Other' then 5 else 6 end as position
 from report_frame group by competition_segment"""),
)
def t8(spark, sf_dir):
    from formline.functions.tournaments import COMPETITION_SEGMENTS

    counts = report_frame(spark, sf_dir).groupBy("competition_segment").agg(F.count("*").alias("matches"))
    position = rank_in_order(F.col("competition_segment"), COMPETITION_SEGMENTS).cast("int")
    return counts.withColumn("position", position).orderBy("position")


@add(
    "T2_confident_errors",
    with_views("predictions", ctes=REPORT_SQL, body="""select match_id, actual_label, predicted_label, round(conf,4) as confidence, competition_segment, time_window
 from report_frame where actual<>predicted order by conf desc, match_id limit 15"""),
)
def t2(spark, sf_dir):
    return report.confident_errors(report_frame(spark, sf_dir)).select(
        "match_id", "actual_label", "predicted_label", "confidence", "competition_segment", "time_window")


# ---- overrides and thresholds ---------------------------------------------

HAND_TUNED = {"friendlies": (0.40, 0.60), "worldcup": (0.55, 0.50), "continental": (0.48, 0.60), "qualifiers": (0.50, 0.62)}
_HAND_SQL = "configured(match_segment, u, c) as (values " + ", ".join(
    f"('{s}', {u}::double, {c}::double)" for s, (u, c) in HAND_TUNED.items()) + ")"
SEGMENTED_SQL = """segmented as (select *, case tournament when 'FIFA World Cup' then 'worldcup' when 'Friendly' then 'friendlies'
 when 'FIFA World Cup qualification' then 'qualifiers' when 'UEFA Euro' then 'continental' end as match_segment from predictions)"""
OVERRIDE_SQL = SEGMENTED_SQL + ",\n" + _HAND_SQL + """,
limits as (select s.*, coalesce(u,0.48) as uncertainty, coalesce(c,0.58) as conviction from segmented s left join configured using (match_segment)),
fired as (select *, greatest(g_away,g_draw,g_home)<uncertainty and s_draw>s_away and s_draw>=s_home and s_draw>=conviction as is_override from limits),
blended as (select *, case when is_override then 0 when g_away>=g_draw and g_away>=g_home then -1 when g_draw>=g_home then 0 else 1 end as predicted from fired)"""


def _segmented(spark, sf_dir):
    return standard.with_segment(views.predictions(spark, sf_dir))


def _overridden(spark, sf_dir):
    table = thresholds.threshold_table(spark, HAND_TUNED)
    return thresholds.with_override(thresholds.with_thresholds(_segmented(spark, sf_dir), table, (0.48, 0.58)))


@add(
    "J8_segment_thresholds",
    with_views("predictions", ctes=OVERRIDE_SQL, body="select match_id, coalesce(match_segment,'none') as match_segment, uncertainty, conviction from limits"),
)
def j8(spark, sf_dir):
    table = thresholds.threshold_table(spark, HAND_TUNED)
    out = thresholds.with_thresholds(_segmented(spark, sf_dir), table, (0.48, 0.58))
    return out.select("match_id", F.coalesce("match_segment", F.lit("none")).alias("match_segment"), "uncertainty", "conviction")


@add(
    "M9_segment_aware_override",
    with_views("predictions", ctes=OVERRIDE_SQL, body="""select match_id, is_override, predicted, round(case when is_override then s_draw else g_draw end,6) as p_draw from blended"""),
)
def m9(spark, sf_dir):
    return _overridden(spark, sf_dir).select("match_id", "is_override", "predicted", r6("p_draw").alias("p_draw"))


@add(
    "M8_global_override",
    with_views("predictions", body="""select match_id, greatest(g_away,g_draw,g_home)<0.45 and s_draw>s_away and s_draw>=s_home and s_draw>=0.55 as is_override from predictions"""),
)
def m8(spark, sf_dir):
    p = views.predictions(spark, sf_dir)
    limits = p.withColumns({"uncertainty": F.lit(0.45), "conviction": F.lit(0.55)})
    return thresholds.with_override(limits).select("match_id", "is_override")


@add(
    "M12_probability_alignment",
    with_views("predictions", body="""select match_id, round(g_away/(g_away+g_home),6) as p_away, 0.0::double as p_draw, round(g_home/(g_away+g_home),6) as p_home from predictions"""),
)
def m12(spark, sf_dir):
    row = outcomes.align({-1: F.col("g_away"), 1: F.col("g_home")})
    names = ("p_away", "p_draw", "p_home")
    return views.predictions(spark, sf_dir).select("match_id", *[r6(p).alias(n) for n, p in zip(names, row)])


@add(
    "A16_segment_statistics",
    with_views("predictions", ctes=OVERRIDE_SQL, body="""select match_segment, count(*) as n_samples, round(avg(is_override::int),6) as override_rate,
 round(avg((actual=predicted)::int),6) as accuracy,
 round(case when count(*) filter (actual=0)=0 then 0 else count(*) filter (actual=0 and predicted=0)/(count(*) filter (actual=0))::double end,6) as draw_accuracy,
 round(case when count(*) filter (predicted=0)=0 then 0 else count(*) filter (actual=0 and predicted=0)/(count(*) filter (predicted=0))::double end,6) as draw_precision
 from blended where match_segment is not null group by match_segment"""),
)
def a16(spark, sf_dir):
    out = metrics.segment_statistics(_overridden(spark, sf_dir))
    return out.withColumns({c: r6(c) for c in ("override_rate", "accuracy", "draw_accuracy", "draw_precision")})


@add(
    "A17_segment_coverage",
    with_views("predictions", ctes=SEGMENTED_SQL, body="select match_segment, count(*) as rows from segmented where match_segment in ('friendlies','worldcup') group by 1"),
)
def a17(spark, sf_dir):
    return metrics.segment_coverage(_segmented(spark, sf_dir), ["friendlies", "worldcup"])


GRID_SQL = SEGMENTED_SQL + """,
u_grid as (select i::int as i, 0.30::double+0.02::double*i as u from range(18) r(i)), c_grid as (select j::int as j, 0.40::double+0.02::double*j as c from range(13) r(j)),
losses as (select *, case when g_away>=g_draw and g_away>=g_home then -1 when g_draw>=g_home then 0 else 1 end as base,
  -ln(case actual when -1 then g_away when 0 then g_draw else g_home end) as base_loss, -ln(case actual when -1 then s_away when 0 then s_draw else s_home end) as spec_loss
  from segmented where match_segment is not null),
cells as (select match_segment, i, j, u, c, count(*) as n,
  count(*) filter (greatest(g_away,g_draw,g_home)<u and s_draw>s_away and s_draw>=s_home and s_draw>=c) as overrides,
  count(*) filter (actual=0) as draws, count(*) filter (base=0) as base_p, count(*) filter (base=0 and actual=0) as base_h, avg(base_loss) as base_log_loss,
  count(*) filter (base=0 or (greatest(g_away,g_draw,g_home)<u and s_draw>s_away and s_draw>=s_home and s_draw>=c)) as p,
  count(*) filter (actual=0 and (base=0 or (greatest(g_away,g_draw,g_home)<u and s_draw>s_away and s_draw>=s_home and s_draw>=c))) as h,
  avg(case when greatest(g_away,g_draw,g_home)<u and s_draw>s_away and s_draw>=s_home and s_draw>=c then spec_loss else base_loss end) as log_loss
  from losses, u_grid, c_grid group by all),
scored_cells as (select *, case when p+draws=0 then 0 else 2.0::double*h/(p+draws) end as draw_f1, case when base_p+draws=0 then 0 else 2.0::double*base_h/(base_p+draws) end as base_draw_f1 from cells)"""


@add(
    "J9_threshold_grid",
    with_views("predictions", ctes=GRID_SQL, body="""select match_segment, i, j, n, overrides, round(draw_f1,6) as draw_f1, round(log_loss,6) as log_loss,
 round(base_draw_f1,6) as base_draw_f1, round(base_log_loss,6) as base_log_loss from scored_cells"""),
)
def j9(spark, sf_dir):
    grid = thresholds.grid_statistics(_segmented(spark, sf_dir))
    return grid.select("match_segment", "i", "j", "n", "overrides", *[
        r6(c).alias(c) for c in ("draw_f1", "log_loss", "base_draw_f1", "base_log_loss")])


@add(
    "M15_threshold_tuning",
    with_views("predictions", ctes=GRID_SQL + """,
allowed as (select *, row_number() over (partition by match_segment order by draw_f1 desc, i, j) as rn from scored_cells
  where overrides>0 and draw_f1>base_draw_f1 and log_loss<=base_log_loss+0.2)""", body="""select s.match_segment, round(coalesce(a.u,0.01),6) as uncertainty,
 round(coalesce(a.c,0.99),6) as conviction, round(coalesce(a.draw_f1, s.base_draw_f1),6) as draw_f1
 from (select distinct match_segment, base_draw_f1 from scored_cells) s left join (select * from allowed where rn=1) a using (match_segment)"""),
)
def m15(spark, sf_dir):
    # The synthetic specialist costs more log loss than a real one, hence the wide budget.
    best = thresholds.tune_thresholds(_segmented(spark, sf_dir), budget=0.2)
    return best.select("match_segment", *[r6(c).alias(c) for c in ("uncertainty", "conviction", "draw_f1")])


@add(
    "Q17_threshold_table",
    with_views("predictions", ctes=SEGMENTED_SQL, body="""select match_segment, uncertainty, conviction from (
 select match_segment, round(2.4*avg(g_home),6) as uncertainty, round(avg(s_draw)-0.52,6) as conviction, count(*) as n from segmented where match_segment is not null group by 1)
 where uncertainty not between 0 and 1 or conviction not between 0 and 1"""),
)
def q17(spark, sf_dir):
    table = _segmented(spark, sf_dir).filter("match_segment is not null").groupBy("match_segment").agg(
        r6(2.4 * F.avg("g_home")).alias("uncertainty"), r6(F.avg("s_draw") - 0.52).alias("conviction"),
        F.count("*").alias("min_samples"))
    return thresholds.invalid_thresholds(table).drop("min_samples")


# ---- ranking, deployment, promotion ---------------------------------------

_MODELS_SQL = FRAME_SQL + ",\n" + _frame_cte("spec", "s") + ",\n" + """mixed as (select * replace ((p_away+s_away)/2 as p_away, (p_draw+s_draw)/2 as p_draw, (p_home+s_home)/2 as p_home) from frame),
mix as (select * replace (greatest(p_away,p_draw,p_home) as conf, case when p_away>=p_draw and p_away>=p_home then -1 when p_draw>=p_home then 0 else 1 end as predicted,
  case when actual=-1 then p_away when actual=0 then p_draw else p_home end as p_true) from mixed)"""
CANDIDATES_SQL = _MODELS_SQL + ",\ncandidates as (" + " union all ".join(
    f"select '{m}' as model_name, round(macro_f1,9) as macro_f1, round(draw_f1,9) as draw_f1, round(draw_recall,9) as draw_recall, round(balanced,9) as balanced_accuracy, round(mcc,9) as matthews_corrcoef, "
    f"round(log_loss,9) as log_loss, round(brier,9) as multiclass_brier_score, round(ece,9) as expected_calibration_error, round(accuracy,9) as accuracy, round(weighted_f1,9) as weighted_f1, round(kappa,9) as cohen_kappa from {suite_sql(s, None)}"
    for m, s in (("generalist", "frame"), ("specialist", "spec"), ("mixture", "mix"))) + ")"


def mixture_frame(spark, sf_dir):
    f = frame(spark, sf_dir)
    mixed = f.withColumns({p: (F.col(p) + F.col(s)) / 2 for p, s in zip(metrics.PROBABILITIES, thresholds.SPECIALIST)})
    return mixed.withColumn("predicted", outcomes.argmax_class(*[F.col(p) for p in metrics.PROBABILITIES]))


def candidates(spark, sf_dir):
    stacked = None
    for name, build in (("generalist", frame), ("specialist", specialist_frame), ("mixture", mixture_frame)):
        part = build(spark, sf_dir).select("match_id", "actual", "predicted", *metrics.PROBABILITIES).withColumn("model_name", F.lit(name))
        stacked = part if stacked is None else stacked.unionByName(part)
    return metrics.evaluate(stacked, "model_name").withColumns({m: F.round(m, 9) for m in metrics.SUITE})


_RANK_SQL = """ranked as (select *, dense_rank() over (order by macro_f1 desc) as r1, dense_rank() over (order by draw_f1 desc) as r2,
 dense_rank() over (order by draw_recall desc) as r3, dense_rank() over (order by balanced_accuracy desc) as r4, dense_rank() over (order by matthews_corrcoef desc) as r5,
 dense_rank() over (order by log_loss) as r6, dense_rank() over (order by multiclass_brier_score) as r7, dense_rank() over (order by expected_calibration_error) as r8 from candidates),
placed as (select *, cast(r1+r2+r3+r4+r5+r6+r7+r8 as int) as selection_score, cast(row_number() over (order by r1+r2+r3+r4+r5+r6+r7+r8, macro_f1 desc, draw_f1 desc, draw_recall desc, log_loss) as int) as selection_rank from ranked)"""


@add(
    "W4_candidate_ranking",
    with_views("predictions", ctes=CANDIDATES_SQL + ",\n" + _RANK_SQL, body="select model_name, selection_score, selection_rank, cast(r1 as int) as rank_macro_f1, cast(r6 as int) as rank_log_loss from placed"),
)
def w4(spark, sf_dir):
    ranked = report.rank_candidates(candidates(spark, sf_dir))
    return ranked.select("model_name", "selection_score", "selection_rank", "rank_macro_f1", "rank_log_loss")


@add(
    "T6_top_candidates",
    with_views("predictions", ctes=CANDIDATES_SQL + ",\n" + _RANK_SQL, body="select model_name, selection_rank from placed order by selection_rank limit 2"),
)
def t6(spark, sf_dir):
    return report.top_candidates(report.rank_candidates(candidates(spark, sf_dir)), 2).select("model_name", "selection_rank")


@add(
    "T10_models_by_macro_f1",
    with_views("predictions", ctes=CANDIDATES_SQL, body="select model_name, round(macro_f1,6) as macro_f1, cast(row_number() over (order by macro_f1 desc, model_name) as int) as position from candidates"),
)
def t10(spark, sf_dir):
    out = report.best_by_metric(candidates(spark, sf_dir))
    return out.select("model_name", r6("macro_f1").alias("macro_f1"), "position")


@add(
    "P27_flatten_candidates",
    with_views("predictions", ctes=CANDIDATES_SQL + ",\n" + _RANK_SQL, body="""select model_name, 'sample' as model_family, selection_rank, selection_score, round(macro_f1,6) as macro_f1,
 round(draw_f1,6) as draw_f1, round(log_loss,6) as log_loss from placed"""),
)
def p27(spark, sf_dir):
    ranked = report.rank_candidates(candidates(spark, sf_dir))
    nested = ranked.select("model_name", F.lit("sample").alias("model_family"), "selection_rank", "selection_score",
                           F.struct(*[r6(c).alias(c) for c in ("macro_f1", "draw_f1", "log_loss")]).alias("mean_metrics"))
    return report.flatten_candidates(nested)


@add(
    "A27_fold_summary",
    with_views("predictions", ctes=FRAME_SQL, body=f"""select round(avg(macro_f1),6) as mean_macro_f1, round(stddev_pop(macro_f1),6) as std_macro_f1,
 round(avg(log_loss),6) as mean_log_loss, round(stddev_pop(log_loss),6) as std_log_loss, round(avg(draw_recall),6) as mean_draw_recall, round(stddev_pop(ece),6) as std_expected_calibration_error
 from {suite_sql('frame', "date_trunc('week', match_date)")}"""),
)
def a27(spark, sf_dir):
    weekly = metrics.evaluate(frame(spark, sf_dir).withColumn("fold", F.date_trunc("week", "match_date")), "fold")
    names = "mean_macro_f1", "std_macro_f1", "mean_log_loss", "std_log_loss", "mean_draw_recall", "std_expected_calibration_error"
    return metrics.fold_summary(weekly).select(*[r6(n).alias(n) for n in names])


_VARIANTS_SQL = CANDIDATES_SQL + """,
variants as (select case model_name when 'generalist' then 'uncalibrated' else model_name end as variant, * from candidates),
deltas as (select v.*, v.macro_f1-b.macro_f1 as d1, v.weighted_f1-b.weighted_f1 as d2, b.log_loss-v.log_loss as g1, b.expected_calibration_error-v.expected_calibration_error as g2,
  v.draw_recall-b.draw_recall as d3 from variants v, (select * from variants where variant='uncalibrated') b),
judged as (select *, d1>=-0.015 and d2>=-0.02 and d3>=-0.05 as keeps, g1>=0.005 or g2>=0.005 as gains from deltas)"""


@add(
    "M14_deployment_variant",
    with_views("predictions", ctes=_VARIANTS_SQL, body="""select variant, keeps as preserves_class_balance, gains as improves_probability_quality, variant='uncalibrated' or (keeps and gains) as is_viable,
 row_number() over (order by (keeps and gains and variant<>'uncalibrated') desc, (variant='uncalibrated') desc, log_loss, expected_calibration_error, macro_f1 desc)=1 as is_chosen from judged"""),
)
def m14(spark, sf_dir):
    c = candidates(spark, sf_dir)
    variants = c.withColumn("variant", F.when(F.col("model_name") == "generalist", "uncalibrated").otherwise(F.col("model_name")))
    out = report.deployment_decisions(variants)
    return out.select("variant", "preserves_class_balance", "improves_probability_quality", "is_viable", "is_chosen")


_PAIR_SQL = "v1 as (select * from candidates where model_name='generalist'), v2 as (select * from candidates where model_name='mixture')"


@add(
    "M19_promotion_gate",
    with_views("predictions", ctes=CANDIDATES_SQL + ",\n" + _PAIR_SQL, body="""select round(v2.log_loss-v1.log_loss,6) as delta_log_loss, round(v2.macro_f1-v1.macro_f1,6) as delta_macro_f1,
 case when abs(v2.log_loss-v1.log_loss)<=0.002 and abs(v2.macro_f1-v1.macro_f1)<=0.002 then 'EQUIVALENT_PROMOTE_V2' when v2.log_loss<=v1.log_loss and v2.macro_f1>=v1.macro_f1 then 'PROMOTE_V2' else 'KEEP_V1' end as decision
 from v1, v2"""),
)
def m19(spark, sf_dir):
    c = candidates(spark, sf_dir)
    gate = report.promotion_gate(c.filter("model_name = 'generalist'"), c.filter("model_name = 'mixture'"))
    return gate.select(r6("delta_log_loss").alias("delta_log_loss"), r6("delta_macro_f1").alias("delta_macro_f1"), "decision")


@add(
    "M20_metric_directions",
    with_views("predictions", ctes=CANDIDATES_SQL + ",\n" + _PAIR_SQL + ",\n" + "long_metrics as (" + " union all ".join(
        f"select '{m}' as metric, v1.{m} as a, v2.{m} as b, {str(up).lower()} as up from v1, v2" for m, up in report.HIGHER_IS_BETTER.items()) + ")",
        body="""select metric, round(a,6) as v1, round(b,6) as v2, round(b-a,6) as delta,
 case when abs(b-a)<0.002 then 'flat' when (up and b>a) or (not up and b<a) then 'up' else 'down' end as direction from long_metrics"""),
)
def m20(spark, sf_dir):
    c = candidates(spark, sf_dir)
    out = report.metric_directions(c.filter("model_name = 'generalist'"), c.filter("model_name = 'mixture'"))
    return out.select("metric", *[r6(x).alias(x) for x in ("v1", "v2", "delta")], "direction")


@add(
    "J7_segment_comparison",
    with_views("predictions", ctes=REPORT_SQL + f""",
rep1 as (select grp as segment_value, n, macro_f1, log_loss from {suite_sql("(select * replace (case when competition_segment='Friendly' then 'First only' else competition_segment end as competition_segment) from report_frame)", 'competition_segment')}),
spec as (select * replace (s_away as p_away, s_draw as p_draw, s_home as p_home, greatest(s_away,s_draw,s_home) as conf,
  case when s_away>=s_draw and s_away>=s_home then -1 when s_draw>=s_home then 0 else 1 end as predicted,
  case when actual=-1 then s_away when actual=0 then s_draw else s_home end as p_true) from report_frame),
rep2 as (select grp as segment_value, n, macro_f1, log_loss from {suite_sql("(select * replace (case when competition_segment='Other' then 'Second only' else competition_segment end as competition_segment) from spec)", 'competition_segment')})""",
        body="""select segment_value, coalesce(a.n,0) as rows_v1, coalesce(b.n,0) as rows_v2, round(a.macro_f1,6) as macro_f1_v1, round(b.macro_f1,6) as macro_f1_v2,
 round(b.macro_f1-a.macro_f1,6) as delta_macro_f1, round(b.log_loss-a.log_loss,6) as delta_log_loss from rep1 a full join rep2 b using (segment_value)"""),
)
def j7(spark, sf_dir):
    # One segment of each report has a name that the other lacks.
    named = F.col("competition_segment")
    first = report_frame(spark, sf_dir).withColumn("competition_segment", F.when(named == "Friendly", "First only").otherwise(named))
    second = report_frame(spark, sf_dir).withColumn("competition_segment", F.when(named == "Other", "Second only").otherwise(named))
    row = [F.col(c) for c in thresholds.SPECIALIST]
    second = second.withColumns({"p_away": row[0], "p_draw": row[1], "p_home": row[2], "predicted": outcomes.argmax_class(*row)})
    out = report.compare_segments(
        metrics.segment_analysis(first, "competition_segment", 1), metrics.segment_analysis(second, "competition_segment", 1))
    return out.select("segment_value", "rows_v1", "rows_v2", *[
        r6(c).alias(c) for c in ("macro_f1_v1", "macro_f1_v2", "delta_macro_f1", "delta_log_loss")])


# ---- global order ----------------------------------------------------------

ORDER = ["kickoff_ts", "match_id"]
_INDEXED = "idx as (select *, row_number() over (order by kickoff_ts, match_id)-1 as i, count(*) over () as n from matches)"


@add(
    "W7_temporal_split",
    with_views("matches", ctes=_INDEXED, body="""select case when i < n-cast(floor(n*0.2) as bigint)-cast(floor(n*0.1) as bigint) then 'train' when i < n-cast(floor(n*0.2) as bigint) then 'calibration' else 'test' end as part,
 count(*) as rows, min(match_id) as low_id, cast(sum(match_id) as bigint) as id_sum from idx group by 1"""),
)
def w7(spark, sf_dir):
    parts = ordered.temporal_split(views.matches(spark, sf_dir), ORDER, test_size=0.2, calibration_size=0.1)
    out = None
    for name, part in zip(("train", "calibration", "test"), parts):
        row = part.groupBy(F.lit(name).alias("part")).agg(
            F.count("*").alias("rows"), F.min("match_id").alias("low_id"), F.sum("match_id").alias("id_sum"))
        out = row if out is None else out.unionByName(row)
    return out


_FOLDS = """folds as (select k, n, n-5*(n//6)+k*(n//6) as start, n-5*(n//6)+(k+1)*(n//6) as stop from (select max(n) as n from idx), range(5) r(k))"""


@add(
    "W8_expanding_folds",
    with_views("matches", ctes=_INDEXED + ",\n" + _FOLDS, body="""select cast(k+1 as int) as fold, count(*) filter (i<start) as train_rows, count(*) filter (i>=start and i<stop) as validation_rows,
 cast(coalesce(sum(match_id) filter (i>=start and i<stop),0) as bigint) as validation_ids from idx, folds group by k"""),
)
def w8(spark, sf_dir):
    m = views.matches(spark, sf_dir)
    out = None
    for k, (train, valid) in enumerate(ordered.expanding_folds(m, ORDER, 5), start=1):
        both = train.select("match_id", F.lit(True).alias("t")).unionByName(valid.select("match_id", F.lit(False).alias("t")))
        row = both.groupBy(F.lit(k).alias("fold")).agg(
            F.count_if("t").alias("train_rows"), F.count_if(~F.col("t")).alias("validation_rows"),
            F.coalesce(F.sum(F.when(~F.col("t"), F.col("match_id"))), F.lit(0)).alias("validation_ids"))
        out = row if out is None else out.unionByName(row)
    return out


@add(
    "W9_calibration_selection_split",
    with_views("matches", ctes=_INDEXED, body="select case when i < n//2 then 'fit' else 'selection' end as part, count(*) as rows, cast(sum(match_id) as bigint) as id_sum from idx group by 1"),
)
def w9(spark, sf_dir):
    fit, selection = ordered.calibration_selection_split(views.matches(spark, sf_dir), ORDER)
    both = fit.select(F.lit("fit").alias("part"), "match_id").unionByName(selection.select(F.lit("selection").alias("part"), "match_id"))
    return both.groupBy("part").agg(F.count("*").alias("rows"), F.sum("match_id").alias("id_sum"))


@add(
    "U5_train_and_calibration",
    with_views("matches", ctes=_INDEXED, body="""select count(*) as rows, cast(sum(match_id) as bigint) as id_sum from idx
 where i < n-cast(floor(n*0.2) as bigint)"""),
)
def u5(spark, sf_dir):
    """Both windows together are one filter on the order columns."""
    m = views.matches(spark, sf_dir)
    total = m.count()
    both = ordered.Cuts(m, ORDER, [total - int(total * 0.2)]).slice(0, total - int(total * 0.2))
    return both.agg(F.count("*").alias("rows"), F.sum("match_id").alias("id_sum"))


@add(
    "T1_chronological_row_index",
    with_views("matches", ctes=_INDEXED, body="select match_id, i as row_index from idx"),
)
def t1(spark, sf_dir):
    return ordered.with_row_index(views.matches(spark, sf_dir), ORDER).select("match_id", "row_index")


@add(
    "M22_stratified_split",
    with_views("predictions", body="""select match_id, case when row_number() over (partition by actual order by md5('42:' || match_id), match_id)
  <= floor(count(*) over (partition by actual) * 0.2 + 0.5) then 'test' else 'train' end as part from predictions"""),
)
def m22(spark, sf_dir):
    train, test = ordered.stratified_split(views.predictions(spark, sf_dir), "match_id", "actual")
    return train.select("match_id", F.lit("train").alias("part")).union(test.select("match_id", F.lit("test").alias("part")))


# Class and the column of its probability.
CLASSES = {1: "g_home", 0: "g_draw", -1: "g_away"}


def _per_class(body: str) -> str:
    """The text once per class, with {c} and {p} filled in."""
    return "\nunion all\n".join(f"({body.replace('{c}', str(c)).replace('{p}', p)})" for c, p in CLASSES.items())


def _each_class(make):
    parts = [make(cls, score).withColumn("class", F.lit(cls)) for cls, score in CLASSES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@add(
    "A15_calibration_curve",
    # DuckDB wants constant quantile shares, so the edges are one list-valued aggregate.
    with_views("predictions", body=_per_class("""with edges as (select quantile_cont({p}, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) as e from predictions),
binned as (select {p} as score, actual, len(list_filter(e, lambda x: x<{p})) as bin from predictions, edges)
select cast({c} as int) as class, cast(bin as int) as bin, count(*) as rows, round(avg(score),6) as mean_predicted,
 round(avg((actual={c})::int),6) as observed from binned group by bin""")),
)
def a15(spark, sf_dir):
    p = views.predictions(spark, sf_dir)
    curve = _each_class(lambda cls, score: ordered.calibration_curve(p, cls, score))
    return curve.withColumns({"mean_predicted": r6("mean_predicted"), "observed": r6("observed")})


@add(
    "A29_exact_median",
    with_views("predictions", body="select round(median(g_home),6) as g_home, round(median(g_draw),6) as g_draw, round(median(s_draw),6) as s_draw, cast(count(*) as bigint) as rows from predictions"),
)
def a29(spark, sf_dir):
    p = views.predictions(spark, sf_dir)
    found = ordered.exact_quantiles(p, ["g_home", "g_draw", "s_draw"], [0.5])
    return p.agg(F.count("*").alias("rows")).select(*[F.round(F.lit(v[0]), 6).alias(c) for c, v in found.items()], "rows")


_ROC = """with points as (select {p} as threshold, sum((actual={c})::int) as p, sum((actual<>{c})::int) as q from predictions group by 1),
curve as (select threshold, sum(p) over (order by threshold desc) as tp, sum(q) over (order by threshold desc) as fp, sum(p) over () as pp, sum(q) over () as qq from points)"""


@add(
    "W11_roc_curve",
    with_views("predictions", body=_per_class(_ROC + " select cast({c} as int) as class, round(threshold,9) as threshold, cast(tp as bigint) as true_positives, cast(fp as bigint) as false_positives, round(tp/pp,6) as true_positive_rate, round(fp/qq,6) as false_positive_rate from curve")),
)
def w11(spark, sf_dir):
    p = views.predictions(spark, sf_dir)
    curve = _each_class(lambda cls, score: ordered.roc_curve(p, cls, score))
    return curve.withColumns({"threshold": F.round("threshold", 9), "true_positive_rate": r6("true_positive_rate"),
                              "false_positive_rate": r6("false_positive_rate")})


@add(
    "W11_roc_auc",
    with_views("predictions", body=_per_class(_ROC + ",\nsteps as (select fp-coalesce(lag(fp) over (order by threshold desc),0) as w, (tp+coalesce(lag(tp) over (order by threshold desc),0))/2.0 as h, pp, qq from curve)"
               " select cast({c} as int) as class, round(sum(w*h)/max(pp)/max(qq),6) as auc from steps")),
)
def w11_auc(spark, sf_dir):
    p = views.predictions(spark, sf_dir)
    return _each_class(lambda cls, score: ordered.roc_auc(p, cls, score)).withColumn("auc", r6("auc"))


# ---- small aggregates -------------------------------------------------------


@add(
    "A24_date_range",
    with_views("matches", body="select cast(min(match_date) as varchar) as date_start, cast(max(match_date) as varchar) as date_end, count(*) as rows from matches"),
)
def a24(spark, sf_dir):
    return metrics.date_range(views.matches(spark, sf_dir), "match_date").withColumns(
        {"date_start": day("date_start"), "date_end": day("date_end")})


_HOLES = "holes as (select match_id, case when match_id%3=0 then null else home_goals end as home_goals, case when match_id%7=0 then null else tournament end as tournament from matches)"


@add(
    "A25_null_counts",
    with_views("matches", ctes=_HOLES, body="""select 'match_id' as column_name, count(*)-count(match_id) as nulls from holes union all select 'home_goals', count(*)-count(home_goals) from holes
 union all select 'tournament', count(*)-count(tournament) from holes"""),
)
def a25(spark, sf_dir):
    m = views.matches(spark, sf_dir).select(
        "match_id", F.when(F.col("match_id") % 3 != 0, F.col("home_goals")).alias("home_goals"),
        F.when(F.col("match_id") % 7 != 0, F.col("tournament")).alias("tournament"))
    return metrics.null_counts(m)


@add(
    "A26_numeric_ranges",
    with_views("matches", body=" union all ".join(
        f"select '{c}' as column_name, min({c})::double as low, max({c})::double as high, max({c})>100 or min({c})<-100 as wide from matches"
        for c in ("match_id", "pool_id", "home_goals", "away_goals"))),
)
def a26(spark, sf_dir):
    return metrics.numeric_ranges(views.matches(spark, sf_dir))


@add(
    "A28_class_weights",
    with_views("predictions", ctes="""cc as (select actual, count(*)::double as c, sum(count(*)) over ()::double as n, count(*) over () as k from predictions group by actual),
raw_w as (select *, n/(k*c)*case when actual=0 then 1.2 else 1 end as w from cc)""", body="select actual, round(w*n/sum(w*c) over (),6) as weight from raw_w"),
)
def a28(spark, sf_dir):
    return metrics.class_weights(views.predictions(spark, sf_dir), "actual", 1.2).withColumn("weight", r6("weight"))


@add(
    "F2_row_weights",
    with_views("predictions", ctes="""cc as (select actual, count(*)::double as c, sum(count(*)) over ()::double as n, count(*) over () as k from predictions group by actual),
raw_w as (select *, n/(k*c)*case when actual=0 then 1.2 else 1 end as w from cc), scaled as (select actual, c, n, w*n/sum(w*c) over () as w from raw_w),
raised as (select actual, c, n, w*case when actual=0 then 4.0/3 else 1 end as w from scaled)""",
        body="select p.match_id, round(r.w*r.n/(select sum(w*c) from raised),6) as weight from predictions p join raised r using (actual)"),
)
def f2(spark, sf_dir):
    weighted = metrics.with_class_weights(views.predictions(spark, sf_dir), "actual", 1.2)
    return metrics.specialist_weights(weighted, "actual", "weight").select("match_id", r6("weight").alias("weight"))


@add(
    "P20_feature_columns",
    with_views("matches", body="""select 0::int as position, 'neutral' as column_name, count(neutral) as filled, count(*) filter (neutral) as total from matches
 union all select 1::int, 'base_strength', count(*), sum(match_id%11) from matches"""),
)
def p20(spark, sf_dir):
    m = standard.with_targets(views.matches(spark, sf_dir)).withColumn("base_strength", F.col("match_id") % 11)
    listed = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.col(c).cast("long").alias("value"))
        for i, c in enumerate(metrics.feature_columns(m))])
    return m.select(F.inline(listed)).groupBy("position", "column_name").agg(
        F.count("value").alias("filled"), F.sum("value").alias("total"))


@add(
    "P25_tournament_edition",
    with_views("matches", body="select match_id from matches where tournament='FIFA World Cup' and year(match_date)=2024"),
)
def p25(spark, sf_dir):
    from formline.plans.scoring import edition_slice

    return edition_slice(views.matches(spark, sf_dir), "FIFA World Cup", 2024).select("match_id")


@add(
    "P25_fallback_last_matches",
    with_views("matches", body="select match_id from matches order by match_date desc, kickoff_ts desc, match_id desc limit 64"),
)
def p25_fallback(spark, sf_dir):
    from formline.plans.scoring import edition_slice

    return edition_slice(views.matches(spark, sf_dir), "FIFA World Cup", 1930).select("match_id")
