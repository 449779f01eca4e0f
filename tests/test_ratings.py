import random

import pytest
from pyspark.sql import functions as F

from formline.operators import ratings
from tests.conftest import by_id


def sequential(rows, decay=True):
    """Plain fold of the documented formulas."""
    from datetime import date

    state, out = {}, {}
    for match, day, home, away, hg, ag in rows:
        day = date.fromisoformat(day)
        now = []
        for team in (home, away):
            r, last = state.get(team, (1500.0, None))
            if decay and last and (day - last).days > 0:
                r = 1500 + (r - 1500) * 0.97 ** ((day - last).days / 90)
            now.append(r)
        score = 1.0 if hg > ag else 0.5 if hg == ag else 0.0
        gain = 20 * (score - 1 / (1 + 10 ** ((now[1] - now[0]) / 400)))
        out[match] = tuple(now)
        state[home], state[away] = (now[0] + gain, day), (now[1] - gain, day)
    return out


ROWS = [
    (1, "2020-01-01", "A", "B", 2, 0), (2, "2020-01-05", "C", "D", 1, 1), (3, "2020-03-01", "B", "C", 0, 3),
    (4, "2022-06-15", "A", "C", 0, 1), (5, "2022-06-16", "D", "A", 2, 2),
]


def test_first_match_starts_level_and_order_is_kept(make_matches):
    got = by_id(ratings.exact_ratings(make_matches(ROWS)), "elo_home", "elo_away")
    assert got[1] == (1500.0, 1500.0)
    for match, pair in sequential(ROWS).items():
        assert got[match] == pytest.approx(pair)


def test_decay_changes_the_second_match(make_matches):
    m = make_matches([(1, "2020-01-01", "A", "B", 1, 0), (2, "2022-06-15", "A", "B", 1, 0)])
    on, off = (by_id(ratings.exact_ratings(m, decay=d), "elo_home")[2] for d in (True, False))
    assert off == pytest.approx(1510.0) and 1500 < on < off


def test_rating_sum_is_kept_without_decay(sample):
    rated = ratings.exact_ratings(sample, ["pool_id"], decay=False)
    first = rated.agg(F.max(F.abs(F.col("elo_home") + F.col("elo_away") - 3000))).first()[0]
    assert first < 1000
    last = rated.groupBy("pool_id").agg(F.max_by(F.col("elo_home"), F.col("match_id"))).count()
    assert last == sample.select("pool_id").distinct().count()


@pytest.mark.parametrize("limit", [15, 60])
def test_steps_equal_one_pass(sample, limit):
    whole = by_id(ratings.exact_ratings(sample, ["pool_id"]), "elo_home", "elo_away")
    stepped = by_id(ratings.exact_ratings(sample, ["pool_id"], rows_per_step=limit), "elo_home", "elo_away")
    assert whole.keys() == stepped.keys()
    assert all(whole[k] == pytest.approx(stepped[k], abs=1e-9) for k in whole)


def test_pools_are_components_of_the_team_graph(sample, make_matches):
    rows = ratings._prepared(sample, [])
    found = ratings.with_components(rows).select("pool", "home_team", "away_team").distinct().collect()
    assert len({r["pool"] for r in found}) > 1
    by_team = {r["home_team"]: r["pool"] for r in found}
    assert all(by_team[r["away_team"]] == r["pool"] for r in found if r["away_team"] in by_team)
    pooled = by_id(ratings.exact_ratings(sample, ["pool_id"]), "elo_home")
    own = by_id(ratings.exact_ratings(sample, rows_per_step=250), "elo_home")
    assert all(pooled[k] == pytest.approx(own[k], abs=1e-9) for k in pooled)


def test_steps_may_end_inside_an_instant(make_matches):
    m = make_matches([(i, "2020-01-01", "AB"[i % 2], "BC"[i % 2], i % 3, 1) for i in range(9)])
    whole = by_id(ratings.exact_ratings(m), "elo_home", "elo_away")
    stepped = by_id(ratings.exact_ratings(m, rows_per_step=2), "elo_home", "elo_away")
    assert all(whole[k] == pytest.approx(stepped[k]) for k in whole)


def test_unscored_matches_move_no_rating(make_matches):
    rows = [(0, "2020-01-01", "A", "B", 2, 0), (1, "2020-01-02", "A", "B", None, None), (2, "2020-01-02", "A", "B", 1, 1)]
    got = by_id(ratings.exact_ratings(make_matches(rows)), "elo_home")
    assert got[1] is None and got[2] == pytest.approx(by_id(ratings.exact_ratings(make_matches(rows[::2])), "elo_home")[2])


def test_pool_keys_do_not_merge(make_matches):
    m = make_matches([(0, "2020-01-01", "A", "B", 1, 0), (1, "2020-01-02", "A", "B", 1, 0)])
    pair = F.when(F.col("match_id") == 0, F.struct(F.lit("a|b").alias("p"), F.lit("c").alias("q"))).otherwise(
        F.struct(F.lit("a").alias("p"), F.lit("b|c").alias("q")))
    split = m.withColumn("pair", pair).select("*", "pair.p", "pair.q").drop("pair")
    assert by_id(ratings.exact_ratings(split, ["p", "q"]), "elo_home")[1] == 1500


def test_late_batch_keeps_the_last_day(spark):
    state = spark.createDataFrame([("A", 1600.0, 18300), ("B", 1500.0, 18300)], "team string, rating double, last_day int")
    late = spark.createDataFrame([(1, "A", "B", 18000, 1.0)], "match_id long, home_team string, away_team string, day int, points double")
    after = ratings.next_state(state, ratings.rate_period(state, late)).collect()
    assert {r["last_day"] for r in after} == {18300}


def test_period_equals_exact_when_no_team_plays_twice(make_matches):
    m = make_matches(ROWS)
    exact = by_id(ratings.exact_ratings(m), "elo_home", "elo_away")
    period = by_id(ratings.period_ratings(m, F.col("match_date").cast("string")), "elo_home", "elo_away")
    assert all(exact[k] == pytest.approx(period[k]) for k in exact)


def one_graph(rnd, teams, days, per_day):
    """Matches of one connected graph; a team may play several times a day."""
    rows = []
    for day in range(days):
        for _ in range(per_day):
            home, away = rnd.sample(range(teams), 2)
            rows.append((len(rows), f"2020-{1 + day // 28:02d}-{1 + day % 28:02d}", f"T{home}", f"T{away}", rnd.randrange(3), rnd.randrange(3)))
    return rows


@pytest.mark.parametrize("limit", [7, 25])
def test_levels_equal_one_pass(make_matches, limit):
    rows = one_graph(random.Random(limit), teams=24, days=2, per_day=24)
    matches = make_matches(rows)
    got = by_id(ratings.exact_ratings(matches, rows_per_step=limit), "elo_home", "elo_away")
    want = sequential(rows)
    assert set(got) == set(want)
    for match, pair in want.items():
        assert got[match] == pytest.approx(pair, abs=1e-9)


def test_levels_are_the_longest_chains(make_matches):
    rows = one_graph(random.Random(1), teams=10, days=3, per_day=25)
    prepared = ratings._prepared(make_matches(rows), [])
    got = {r["match_id"]: r["level"] for r in ratings.dependency_levels(prepared).collect()}
    last, want = {}, {}
    for match, day, home, away, *_ in rows:
        want[match] = 1 + max(last.get((day, home), 0), last.get((day, away), 0))
        last[day, home] = last[day, away] = want[match]
    assert got == want


def test_idle_pools_keep_their_ratings_between_levels(make_matches):
    rows = [(0, "2020-01-01", "X", "Y", 1, 0)]
    rows += [(1 + i, "2020-01-02", *pair, 2, 1) for i, pair in enumerate([("A", "B"), ("B", "C"), ("C", "A"), ("A", "C")] * 2)]
    rows += [(40, "2020-02-01", "Y", "X", 0, 0)]
    got = by_id(ratings.exact_ratings(make_matches(rows), rows_per_step=3), "elo_home", "elo_away")
    for match, pair in sequential(rows).items():
        assert got[match] == pytest.approx(pair, abs=1e-9)


def test_a_fold_reads_a_pool_by_batches(spark):
    import pyarrow as pa

    def batch(at):
        return pa.RecordBatch.from_pydict({
            "pool": ["p"] * 3, "played": [True] * 3, "match_id": [at, at + 1, at + 2], "home_team": ["A", "B", "C"],
            "away_team": ["B", "C", "A"], "day": pa.array([at] * 3, pa.int32()), "points": [1.0, 0.5, 0.0]})

    read = []

    def batches():
        for at in (0, 3, 6):
            read.append(at)
            yield batch(at)

    out = ratings._fold(True)(batches())
    first = next(out)
    assert read == [0] and first.column("match_id").to_pylist() == [0, 1, 2]
    kinds = [kind for part in out for kind in part.column("kind").to_pylist()]
    assert kinds == ["match"] * 6 + ["team"] * 3


def test_a_pool_without_a_match_in_a_step_keeps_its_ratings(spark):
    state = spark.createDataFrame([("p", "A", 1600.0, 18300), ("q", "C", 1550.0, -1)], "pool string, team string, rating double, last_day int")
    rows = spark.createDataFrame([("p", 1, "A", "B", 18300, 1.0)], "pool string, match_id long, home_team string, away_team string, day int, points double")
    out = ratings._folded(rows.withColumn("kickoff_ts", F.lit("2020-02-08").cast("timestamp_ntz")), state, True)
    teams = {(r["pool"], r["team"]): (r["rating"], r["last_day"]) for r in out.filter("kind = 'team'").collect()}
    assert teams["q", "C"] == (1550.0, -1) and teams["p", "A"][0] > 1600 and teams["p", "B"][1] == 18300


@pytest.mark.parametrize("fold", [10, 40, 1000])
def test_short_levels_run_together(make_matches, tmp_path, fold):
    rows = one_graph(random.Random(fold), teams=24, days=3, per_day=30)
    prepared = ratings.with_components(ratings._prepared(make_matches(rows), []))
    levelled = ratings.dependency_levels(prepared)
    numbers, steps = ratings._level_steps(levelled, 20, fold)
    sizes = [r["count"] for r in levelled.join(numbers, ["day", "level"]).groupBy("step").count().orderBy("step").collect()]
    assert sum(sizes) == len(rows) and len(sizes) == len(steps) and not any(steps)
    assert len(steps) <= len(rows) // fold + 1 and max(sizes) <= fold + 20
    in_order = [r["step"] for r in numbers.orderBy("day", "level").collect()]
    assert in_order == sorted(in_order)
    got = by_id(ratings.exact_ratings(make_matches(rows), rows_per_step=8, rows_per_fold=fold), "elo_home", "elo_away")
    for match, pair in sequential(rows).items():
        assert got[match] == pytest.approx(pair, abs=1e-9)


def test_repeated_matches_take_levels_of_their_own(make_matches):
    rows = [(1, "2020-01-01", "A", "B", 2, 0), (1, "2020-01-01", "A", "B", 2, 0), (2, "2020-01-01", "B", "C", 1, 1)]
    found = ratings.dependency_levels(ratings._prepared(make_matches(rows), [])).collect()
    assert sorted((r["match_id"], r["level"]) for r in found) == [(1, 1), (1, 2), (2, 3)]
