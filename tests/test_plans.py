"""Query plans: what must and must not be in them."""

from formline.operators import form, metrics, snapshots
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_form_costs_two_long_exchanges_and_one_wide(spark, sample):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(form.with_form(sample))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning(team") == 1
    assert text.count("Exchange hashpartitioning(match_id") == 2
    assert "SinglePartition" not in text and "CartesianProduct" not in text


def test_suite_reads_once_and_combines_first(spark):
    from catalog.evaluation import frame

    text = plan(metrics.evaluate(frame(spark, SMALL), "tournament"))
    assert text.count("FileScan parquet") == 1
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_count" in text


def test_latest_is_one_shuffle(spark, sample):
    text = plan(snapshots.latest_snapshots(snapshots.team_snapshots(sample)))
    assert text.count("Exchange hashpartitioning") == 1


def test_scan_reads_only_what_is_needed(spark):
    from formline import views

    text = plan(views.matches(spark, SMALL).groupBy("home_team").count())
    assert "ReadSchema: struct<user_id:bigint>" in text
