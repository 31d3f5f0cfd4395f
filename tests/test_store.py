"""The store of answers: pruned without a sort, read while it changes."""

import random
import threading
from datetime import datetime, timedelta

import pytest

from quotelens.operators.reuse import prune_store
from quotelens.operators.store import ANSWERS, AnswerStore

START = datetime(2024, 1, 1)


def rows_of(n, seed=3):
    rng = random.Random(seed)
    keys = ["", "a", "ab", "abc", "b", "añ", "😀", None] + [f"{rng.randrange(16**6):06x}" for _ in range(40)]
    times = [None, START, START, START + timedelta(microseconds=1), START + timedelta(days=4000), datetime(1901, 1, 1)] + [START + timedelta(seconds=rng.randrange(10**7)) for _ in range(20)]
    return [(rng.choice(keys), str(k), rng.choice(times)) for k in range(n)]


@pytest.mark.parametrize("most", [-1, 0, 1, 2, 17, 150, 199, 200, 999])
def test_newest_rows(spark, most):
    rows = rows_of(200)
    df = spark.createDataFrame(rows, ANSWERS).repartition(5)
    order = lambda r: (r[2] is None, -((r[2] or START) - START).total_seconds(), (r[0] or "").encode())
    want = sorted(rows, key=order)[: max(0, most)]
    got = prune_store(df, most).collect()
    assert sorted(map(order, map(tuple, got))) == sorted(map(order, want)) and len({r["report"] for r in got}) == len(want)


def test_newest_rows_of_one_time_and_key(spark):
    df = spark.createDataFrame([("k", str(k), START) for k in range(9)], ANSWERS)
    assert prune_store(df, 4).count() == 4
    df = spark.createDataFrame([(f"{k:03x}", "r", START) for k in range(600)], ANSWERS).repartition(7)
    assert sorted(r["key"] for r in prune_store(df, 301).collect()) == [f"{k:03x}" for k in range(301)]
    df = spark.createDataFrame([(f"{k:03x}", "r", None) for k in range(60)], ANSWERS)
    assert sorted(r["key"] for r in prune_store(df, 7).collect()) == [f"{k:03x}" for k in range(7)]


def test_no_row_is_sorted_or_moved(spark):
    plan = prune_store(spark.createDataFrame(rows_of(300), ANSWERS), 100)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "TakeOrdered" not in plan and plan.count("Exchange") <= 1  # that of the rows of one key and time


def test_readers_have_one_version_or_the_next(spark, tmp_path):
    store = AnswerStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0
    store.prune(3)
    store.clear_old()
    frame = lambda rows: spark.createDataFrame(rows, ANSWERS)
    store.append(frame([(f"k{k}", "r", START + timedelta(days=k)) for k in range(5)]))
    old = store.read()
    store.append(frame([("new", "r", START + timedelta(days=99))]))
    store.prune(2)
    assert sorted(r["key"] for r in old.collect()) == [f"k{k}" for k in range(5)]
    assert sorted(r["key"] for r in store.read().collect()) == ["k4", "new"]
    store.prune(0)
    assert store.read().count() == 0
    store.append(frame([("again", "r", START)]))
    store.clear_old()
    assert [r["key"] for r in store.read().collect()] == ["again"] and store.version()[0] == 5
    assert len(list((tmp_path / "store" / "versions").glob("[0-9]*"))) == 1


def test_what_is_added_during_a_prune_stays(spark, tmp_path, monkeypatch):
    store = AnswerStore(spark, str(tmp_path / "store"))
    frame = lambda *keys: spark.createDataFrame([(k, "r", START) for k in keys], ANSWERS)
    store.append(frame("a", "b", "c"))
    write = store._write

    def late(rows):
        name = write(rows)
        AnswerStore(spark, store.path).append(frame("meanwhile"))
        return name

    monkeypatch.setattr(store, "_write", late)
    store.prune(1)
    assert sorted(r["key"] for r in store.read().collect()) == ["a", "meanwhile"]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    lock, commit = threading.Lock(), AnswerStore._commit

    def add(k):
        store = AnswerStore(spark, path)
        new = store._write(spark.createDataFrame([(f"k{k}", "r", START)], ANSWERS))
        with lock:  # renaming on a local disk replaces what is there, unlike on a shared file system
            commit(store, lambda folders: [*folders, new])

    threads = [threading.Thread(target=add, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r["key"] for r in AnswerStore(spark, path).read().collect()) == [f"k{k}" for k in range(6)]
