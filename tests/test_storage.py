import pytest
from pyspark.sql import functions as F

from formline.operators import report
from formline.sources import readers, sinks
from formline.sources.folders import shared_folder
from formline.streaming import jobs


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


HEADER = "date,home_team,away_team,home_score,away_score,tournament,city,country,neutral\n"


def test_historical_scan(spark, tmp_path):
    path = write(tmp_path / "a.csv", HEADER + "2024-01-01,A,B,1,0,Friendly,X,Y,FALSE\n2030-01-01,A,B,NA,NA,Friendly,X,Y,TRUE\n")
    rows = readers.read_historical(spark, path).collect()
    assert len(rows) == 1 and rows[0]["home_score"] == 1 and rows[0]["neutral"] is False
    assert readers.read_historical(spark, path, keep_unscored=True).count() == 2


def test_historical_scan_without_a_column(spark, tmp_path):
    path = write(tmp_path / "b.csv", "date,home_team\n2024-01-01,A\n")
    with pytest.raises(readers.SourceError, match="away_team"):
        readers.read_historical(spark, path)


DOCUMENT = """{"matches": [{"utcDate": "2024-03-02T18:00:00Z", "homeTeam": {"name": "A"}, "awayTeam": {"name": null},
 "score": {"fullTime": {"home": 2, "away": 1}}, "competition": {"code": "WC", "name": "World Cup"}, "area": {"name": "World"}}]}"""


def test_unreadable_snapshot_files_are_skipped(spark, tmp_path):
    write(tmp_path / "api_international_matches_1.json", DOCUMENT)
    write(tmp_path / "api_international_matches_2.json", "{ not json")
    pattern = str(tmp_path / "api_international_matches_*.json")
    rows = readers.read_api_matches(spark, pattern).collect()
    assert len(rows) == 1
    assert (rows[0]["away_team"], rows[0]["tournament"], rows[0]["neutral"]) == ("Unknown", "World Cup", False)
    assert readers.unreadable_files(readers.read_snapshots(spark, pattern)).first()[0] == 1


def test_report_errors_differ(spark, tmp_path):
    with pytest.raises(readers.SourceError, match="not found"):
        readers.read_report(spark, str(tmp_path / "none.json"))
    bad = write(tmp_path / "bad.json", "{ oops")
    with pytest.raises(readers.SourceError, match="pars|valid"):
        readers.read_report(spark, bad)


def test_feature_sources(spark, sample, tmp_path):
    path = str(tmp_path / "gold")
    sample.write.parquet(path)
    assert readers.read_features(spark, path, "no.such_table")[1] == "file"
    with pytest.raises(Exception):
        readers.read_features(spark, path, "no.such_table", source="table")
    with pytest.raises(ValueError):
        readers.read_features(spark, path, source="ftp")
    empty = str(tmp_path / "empty")
    sample.limit(0).write.parquet(empty)
    with pytest.raises(readers.SourceError, match="empty"):
        readers.read_features(spark, empty, source="file")


def test_table_sink(spark, sample, tmp_path):
    rows = sample.drop("kickoff_ts")
    name = sinks.persist_table(rows, "silver_test", "matches", "fail", "r1", location=str(tmp_path / "db"))
    assert spark.table(name).filter("pipeline_run_id = 'r1' and persisted_at_utc is not null").count() == sample.count()
    sinks.persist_table(rows, "silver_test", "matches", "append", "r2")
    assert spark.table(name).count() == 2 * sample.count()
    with pytest.raises(Exception):
        sinks.persist_table(rows, "silver_test", "matches", "fail")
    with pytest.raises(ValueError):
        sinks.persist_table(rows, "bad-name", "matches")


def test_year_folders_prune(spark, sample, tmp_path):
    path = str(tmp_path / "layer")
    sinks.write_layer(sample, path)
    plan = spark.read.parquet(path).filter("year = 2024")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_training_runs(spark, tmp_path):
    summary = {
        "artifact_path": "m", "data_path": "d", "training_rows": 5, "test_rows": 2, "feature_count": 1, "feature_columns": ["x"],
        "class_distribution_train": {"0": 3}, "train_date_range": {"start": "2020-01-01", "end": "2021-01-01"},
        "metrics": {"accuracy": 0.5, "macro_f1": 0.4, "weighted_f1": 0.4, "log_loss": 1.0, "classification_report": {"draw": {}}},
    }
    row = sinks.training_run_row(spark, summary, "r1")
    typed = report.typed_runs(row).first()
    assert typed["feature_columns_json"] == ["x"] and typed["class_distribution_train_json"] == {"0": 3}
    assert str(typed["train_date_end"]) == "2021-01-01"


def test_log_failure_is_returned(sample):
    assert sinks.append_log(sample, "/nowhere") is not None


def test_log_schema_grows(spark, tmp_path):
    path = str(tmp_path / "log")
    first = spark.sql("select timestamp '2024-01-01 00:00:00' as timestamp_utc, 1 as a")
    assert sinks.append_log(first, path) is None
    assert sinks.append_log(first.withColumn("shadow", F.lit("x")), path) is None
    assert set(sinks.read_log(spark, path).columns) >= {"a", "shadow"}
    assert sinks.read_log(spark, path).count() == 2


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_rating_stream_restarts(spark, tmp_path, make_matches):
    from formline.operators import ratings

    m = make_matches([(i, f"2024-01-{i + 1:02d}", "AB"[i % 2], "BA"[i % 2], i % 3, 1) for i in range(9)])
    source = str(tmp_path / "in")
    job = jobs.RatingStream(spark, str(tmp_path / "ratings"))
    for part in ("match_id < 4", "match_id >= 4"):
        m.filter(part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(m.schema).parquet(source)
        job.run(stream, str(tmp_path / "checkpoint"))
    job.apply(m.filter("match_id >= 4"), 1)
    exact = {r["match_id"]: r["elo_home"] for r in ratings.exact_ratings(m).collect()}
    got = {r["match_id"]: r["elo_home"] for r in job.ratings().collect()}
    assert got.keys() == exact.keys()
    assert all(got[k] == pytest.approx(exact[k]) for k in exact)


def test_ingest_drops_copies_within_and_across_batches(spark, tmp_path):
    source, output = str(tmp_path / "landed"), str(tmp_path / "out")

    def land(days):
        docs = [
            '{"matches": [{"utcDate": "2024-01-%02dT10:00:00Z", "homeTeam": {"name": "A"}, "awayTeam": {"name": "B"}, '
            '"score": {"fullTime": {"home": 1, "away": 0}}}]}' % d
            for d in days
        ]
        spark.createDataFrame([(d,) for d in docs], "value string").coalesce(1).write.mode("append").text(source)
        jobs.run_ingest(spark, source, output, str(tmp_path / "checkpoint"))
        return spark.read.parquet(output)

    assert land([1, 2, 2, 2]).count() == 2
    both = land([2, 3, 3])
    assert both.count() == 3
    assert both.filter("match_date = date '2024-01-02' and batch = 0").count() == 1


def test_late_hours_are_left_out(spark, tmp_path):
    rows = spark.sql("""select timestamp '2024-01-01 00:10:00' as timestamp_utc, 'friendlies' as match_segment, true as is_override_triggered,
        'draw' as predicted_outcome, '{"home_win": 0.2, "draw": 0.5, "away_win": 0.3}' as class_probabilities_json""")
    log, out, check = (str(tmp_path / n) for n in ("log", "out", "check"))
    for moment in ("2024-01-01 00:10:00", "2024-01-01 06:00:00", "2024-01-01 00:20:00", "2024-01-01 12:00:00"):
        rows.withColumn("timestamp_utc", F.lit(moment).cast("timestamp")).write.mode("append").parquet(log)
        jobs.run_hourly(spark, log, rows.schema, out, check)
    got = {str(r["hour"]): r["total_predictions"] for r in spark.read.parquet(out).collect()}
    assert got["2024-01-01 00:00:00"] == 1
