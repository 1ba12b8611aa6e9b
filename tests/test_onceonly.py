import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.functions.text import identifier
from ledgerloom.operators import onceonly
from ledgerloom.operators.onceonly import IdentifierIndex, Runs

SCHEMA = "delivery_id bigint, run_id string, sequence bigint, op_id string, received_at timestamp, kind int, slot string"
T = dt.datetime(2025, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(i, r, s, o, None if t is None else T + dt.timedelta(seconds=t), 0, "") for i, r, s, o, t in rows], SCHEMA)


def surplus(spark, rows):
    return sorted(r.delivery_id for r in onceonly.surplus_deliveries(frame(spark, rows)).collect())


def test_earliest_then_smallest_stays(spark):
    assert surplus(spark, [(1, "R", 1, "a", 5), (2, "r ", 1, " A", 3), (3, "r", 1, "a", 3), (4, "r", 2, "a", 1), (5, "q", 1, "a", 1)]) == [1, 3]


def test_null_parts_are_never_copies(spark):
    assert surplus(spark, [(1, None, 1, "a", 1), (2, None, 1, "a", 1), (3, "r", None, "a", 1), (4, "r", None, "a", 1), (5, "r", 1, " ", 1), (6, "r", 1, " ", 1), (7, "x", 1, "a", None), (8, "x", 1, "a", 9)]) == [7]


def test_empty(spark):
    assert surplus(spark, []) == []


def test_hot_group_against_brute_force(spark):
    n = 30_000
    df = spark.range(n).select(F.col("id").alias("delivery_id"), F.lit("r").alias("run_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7001).alias("sequence"), F.lit("o").alias("op_id"), F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(1000))).alias("received_at"))
    best, want = {}, set()
    for r in sorted(df.collect(), key=lambda r: (r.received_at, r.delivery_id)):
        want.add(r.delivery_id) if r.sequence in best else best.setdefault(r.sequence, r.delivery_id)
    assert {r.delivery_id for r in onceonly.surplus_deliveries(df).collect()} == want


def test_index_over_batches_and_merges(spark):
    parts = [identifier("run_id"), F.col("sequence"), identifier("op_id")]
    index = IdentifierIndex(spark)
    seen, want, got = set(), [], []
    for b in range(onceonly.MAX_RUNS + 3):
        rows = [(100 * b + i, "r", (i * 7 + b * 5) % 60, "o", b * 100 + i) for i in range(20)]
        for i, _, s, _, _ in rows:
            want += [i] if s in seen else []
            seen.add(s)
        got += [r.delivery_id for r in index.admit(frame(spark, rows), parts, "received_at", "delivery_id").collect()]
    assert sorted(got) == want
    assert len(index.runs) <= onceonly.MAX_RUNS
    again = IdentifierIndex(spark, index.root)
    assert [r.delivery_id for r in again.admit(frame(spark, [(1, "r", 1, "o", 1), (2, "z", 1, "o", 1)]), parts, "received_at", "delivery_id").collect()] == [1]


def test_colliding_first_halves():
    runs = Runs()
    run = np.array([(5, 1), (5, 2), (5, 9), (8, 1)], dtype=[("a", "<u8"), ("b", "<u8")])
    runs.add(run)
    h1, h2 = np.array([5, 5, 5, 8, 9], "u8"), np.array([2, 9, 3, 1, 1], "u8")
    assert runs.known(h1, h2).tolist() == [True, True, False, True, False]


def test_a_batch_that_comes_again_gives_what_it_gave(spark):
    parts = [identifier("run_id"), F.col("sequence"), identifier("op_id")]
    index = IdentifierIndex(spark)
    got = lambda ix, rows, name: sorted(r.delivery_id for r in ix.admit(frame(spark, rows), parts, "received_at", "delivery_id", name).collect())
    a, b = [(1, "r", 1, "o", 1), (2, "r", 1, "o", 2), (3, "r", 2, "o", 3)], [(4, "r", 1, "o", 4), (5, "r", 9, "o", 5)]
    assert got(index, a, "a") == [2] == got(index, a, "a")
    assert got(index, b, "b") == [4] == got(IdentifierIndex(spark, index.root), b, "b")
    index.merge()
    later = IdentifierIndex(spark, index.root)
    assert got(later, a, "a") == [2] and got(later, [(6, "r", 9, "o", 6)], "c") == [6] and len(later.runs) == 2


def test_an_unfinished_run_is_written_over(spark):
    from ledgerloom.session import _hadoop

    parts = [identifier("run_id"), F.col("sequence"), identifier("op_id")]
    index = IdentifierIndex(spark)
    rows = frame(spark, [(1, "r", 1, "o", 1), (2, "r", 1, "o", 2)])
    index.admit(rows, parts, "received_at", "delivery_id", "a")
    p, fs = _hadoop(spark, f"{index.runs[0]}/_SUCCESS")
    fs.delete(p, False)
    again = IdentifierIndex(spark, index.root)
    assert again.runs == [] and [r.delivery_id for r in again.admit(rows, parts, "received_at", "delivery_id", "a").collect()] == [2]


def test_stored_runs_are_searched_by_later_splits(spark, monkeypatch):
    rows = [(i, "r", i % 7, "o", i if i % 5 else None) for i in range(60)]
    want = set()
    best = {}
    for i, _, s, _, t in sorted(rows, key=lambda r: (r[4] is None, r[4] or 0, r[0])):
        want.add(i) if s in best else best.setdefault(s, i)
    for splits in (1, 2, 5):
        assert {r.delivery_id for r in onceonly.surplus_deliveries(frame(spark, rows), splits=splits).collect()} == want


def test_prefixes_of_other_lengths_meet(spark, monkeypatch):
    parts = [identifier("run_id"), F.col("sequence"), identifier("op_id")]
    index = IdentifierIndex(spark)
    index.admit(frame(spark, [(i, "r", i, "o", i) for i in range(50)]), parts, "received_at", "delivery_id")
    monkeypatch.setattr(onceonly, "MORE_BITS", 9)
    assert sorted(r.delivery_id for r in index.admit(frame(spark, [(100 + i, "r", i, "o", i) for i in range(40, 60)]), parts, "received_at", "delivery_id").collect()) == list(range(140, 150))
