import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathlume.operators.sessions import SessionTable, local_sessions

PAUSE = 100


def brute(rows, pause=PAUSE):
    out = set()
    for g in {r[0] for r in rows if r[0] is not None}:
        times = sorted(t for h, t in rows if h == g and t is not None and t >= 1)
        run = times[:1]
        for t in times[1:]:
            if t - run[-1] > pause:
                out.add((g, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        if run:
            out.add((g, run[0], run[-1], len(run)))
    return out


def local(spark, rows, pause=PAUSE):
    df = spark.createDataFrame(rows, "g string, t long").withColumn("start_ms", F.lit("clash")).withColumn("n_events", F.lit(0))
    return local_sessions(df, "d", F.col("g"), F.col("t"), pause)


def taken(df):
    return {(r["group_id"], r["start_ms"], r["end_ms"], r["n_events"]) for r in df.collect()}


def test_a_pause_of_exactly_the_limit_does_not_part(spark):
    rows = [("a", 1), ("a", 101), ("a", 202), ("b", 5), ("b", 5), ("", 3), (None, 4), ("a", None), ("a", 0), ("a", -7), ("hot", 1)]
    assert taken(local(spark, rows)) == {("a", 1, 101, 2), ("a", 202, 202, 1), ("b", 5, 5, 2), ("", 3, 3, 1), ("hot", 1, 1, 1)}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_one_batch_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.choice([None, 0, -1, rng.randrange(1, 3000), rng.randrange(1, 400)])) for _ in range(150)]
    assert taken(local(spark, rows)) == brute(rows)


@pytest.mark.parametrize("slice_ms", [50, 1000, 10**9])
def test_batches_in_any_order_equal_one_batch(spark, tmp_path, slice_ms):
    rng = random.Random(slice_ms)
    rows = [(rng.choice(["hot", "hot", "b", "c"]), rng.randrange(1, 6000)) for _ in range(240)]
    table = SessionTable(spark, f"file://{tmp_path}/t", PAUSE, slice_ms)
    assert table.read().count() == 0
    shuffled = rng.sample(rows, len(rows))
    for i in range(0, len(rows), 60):
        table.apply(local(spark, shuffled[i : i + 60]))
    assert taken(table.read()) == brute(rows)
    table.apply(local(spark, []))
    assert taken(SessionTable(spark, f"file://{tmp_path}/t", PAUSE, slice_ms).read()) == brute(rows)


def test_a_batch_bridges_stored_sessions_and_leaves_other_slices_alone(spark, tmp_path):
    table = SessionTable(spark, f"file://{tmp_path}/t", PAUSE, 1000)
    table.apply(local(spark, [("a", 10), ("a", 200), ("a", 50_000), ("b", 10)]))
    before = table._manifest()["slices"]
    table.apply(local(spark, [("a", 105)]))
    after = table._manifest()["slices"]
    assert taken(table.read()) == {("a", 10, 200, 3), ("a", 50_000, 50_000, 1), ("b", 10, 10, 1)}
    assert before["50"] == after["50"] and before["0"] != after["0"]


def test_a_failed_batch_leaves_the_table_as_it_was(spark, tmp_path):
    table = SessionTable(spark, f"file://{tmp_path}/t", PAUSE)
    table.apply(local(spark, [("a", 10)]))
    broken = local(spark, [("a", 20)]).withColumn("n_events", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        table.apply(broken)
    assert taken(table.read()) == {("a", 10, 10, 1)}


def test_settings_of_a_stored_table_must_agree(spark, tmp_path):
    SessionTable(spark, f"file://{tmp_path}/t", PAUSE).apply(local(spark, [("a", 10)]))
    with pytest.raises(ValueError):
        SessionTable(spark, f"file://{tmp_path}/t", PAUSE + 1)


def test_an_old_reader_still_reads_after_more_batches(spark, tmp_path):
    table = SessionTable(spark, f"file://{tmp_path}/t", PAUSE, keep_versions=3)
    table.apply(local(spark, [("a", 10)]))
    old = table.read()
    table.apply(local(spark, [("a", 60)]))
    table.apply(local(spark, [("a", 120)]))
    assert taken(old) == {("a", 10, 10, 1)} and taken(table.read(2)) == {("a", 10, 60, 2)} and taken(table.read()) == {("a", 10, 120, 3)}
    table.apply(local(spark, [("a", 900)]))
    assert table.versions() == [2, 3, 4] and taken(table.read()) == {("a", 10, 120, 3), ("a", 900, 900, 1)}


def test_a_batch_sent_again_is_taken_once(spark, tmp_path):
    table = SessionTable(spark, f"file://{tmp_path}/t", PAUSE)
    assert table.apply(local(spark, [("a", 10)]), "s", 0) and table.apply(local(spark, [("a", 20)]), "s", 1)
    assert not table.apply(local(spark, [("a", 20)]), "s", 1) and not table.apply(local(spark, [("a", 10)]), "s", 0)
    assert table.apply(local(spark, [("a", 30)]), "other", 0)
    assert taken(table.read()) == {("a", 10, 30, 3)}


def test_two_writers_lose_no_batch(spark, tmp_path, monkeypatch):
    one, two = (SessionTable(spark, f"file://{tmp_path}/t", PAUSE) for _ in range(2))
    one.apply(local(spark, [("a", 10)]))
    merged, hurried = one._merged, []

    def late(stored, batch):
        found = merged(stored, batch)
        if not hurried:  # the other writer commits between reading and committing
            hurried.append(two.apply(local(spark, [("a", 60)])))
        return found

    monkeypatch.setattr(one, "_merged", late)
    one.apply(local(spark, [("a", 110)]))
    assert taken(one.read()) == {("a", 10, 110, 3)} and one.versions() == [1, 2, 3]
