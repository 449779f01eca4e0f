"""Day states add up to the check of the whole table."""

from datetime import date

from pyspark.sql import functions as F

from formline.operators import check_states, quality

CONTRACT = quality.Contract("c", required=("d", "x", "missing"), non_null=("t",), minimum={"x": 0.0}, allowed={"t": ("a", "b")})


def rows(df):
    return sorted((r["check"], r["column_name"], r["failing"]) for r in df.collect())


def table(spark, values):
    return spark.createDataFrame(values, "d date, x double, t string")


FIRST = [(date(2024, 1, 1), 1.0, "a"), (date(2024, 1, 1), -1.0, None), (date(2024, 1, 2), None, "c"), (None, 2.0, "b")]


def test_appends_and_rewrites_equal_a_full_check(spark, tmp_path):
    folder = str(tmp_path / "states")
    check_states.refresh(table(spark, FIRST), CONTRACT, "d", folder)
    assert rows(check_states.report(spark, folder)) == rows(quality.check(table(spark, FIRST), CONTRACT))
    # A new day, a rewritten one, another without a day, and a day that loses its rows; each refresh is repeated.
    steps = [
        (FIRST + [(date(2024, 1, 3), -5.0, "z")], [date(2024, 1, 3)]),
        ([(date(2024, 1, 1), 3.0, "a"), *FIRST[2:], (date(2024, 1, 3), -5.0, "z")], [date(2024, 1, 1)]),
        ([*FIRST[2:], (None, -1.0, "q")], [date(2024, 1, 1), date(2024, 1, 3), None])]
    for values, days in steps:
        for _ in range(2):
            check_states.refresh(table(spark, values), CONTRACT, "d", folder, days)
        assert rows(check_states.report(spark, folder)) == rows(quality.check(table(spark, values), CONTRACT))


def test_an_empty_table_fails_non_empty(spark, tmp_path):
    folder = str(tmp_path / "states")
    check_states.refresh(table(spark, []), CONTRACT, "d", folder)
    assert rows(check_states.report(spark, folder)) == rows(quality.check(table(spark, []), CONTRACT))


def test_only_the_days_asked_for_are_scanned(spark, tmp_path):
    table(spark, FIRST).write.parquet(str(tmp_path / "t"))
    made = check_states.day_states(spark.read.parquet(str(tmp_path / "t")), CONTRACT, "d", [date(2024, 1, 2)])
    assert {r["state_day"] for r in made.collect()} == {"2024-01-02"}
    assert "PushedFilters: [In(d, [2024-01-02])" in made._jdf.queryExecution().executedPlan().toString().replace("IsNotNull(d), EqualTo(d,2024-01-02)", "In(d, [2024-01-02])")
