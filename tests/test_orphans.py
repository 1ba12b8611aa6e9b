import datetime as dt

import numpy as np
import pytest

from ledgerloom.operators import orphans

R = "ref_table string, row_id bigint, target string, need int, at timestamp, revision int, node_id string"
N = "node_id string, revision int, valid_from timestamp, valid_to timestamp, target string, id int"


def day(m, d):
    return dt.datetime(2025, m, d)


def found(spark, refs, nodes):
    r = spark.createDataFrame([(t, i, x, n, a, 0, "") for t, i, x, n, a in refs], R)
    n = spark.createDataFrame([(i, v, a, b, "", 0) for i, v, a, b in nodes], N)
    return {tuple(x) for x in orphans.orphan_references(r, n).collect()}


def test_reasons(spark):
    nodes = [("a", 3, day(1, 10), day(3, 20)), ("a", 3, day(1, 10), day(3, 20)), ("a", 4, day(5, 5), None), ("b", 1, day(6, 1), None), ("c", 2, day(1, 1), None), ("d", 1, None, None)]
    refs = [
        ("t", 1, "a", None, day(1, 5)), ("t", 2, "a", None, day(1, 10)), ("t", 3, "a", None, day(3, 20)), ("t", 4, "a", None, day(4, 1)), ("t", 5, "a", None, day(5, 5)), ("t", 6, "b", None, day(5, 31)),
        ("t", 7, "zzz", None, day(2, 2)), ("t", 7, "zzz", None, day(2, 2)), ("t", 8, "c", 2, day(2, 2)), ("t", 9, "c", 3, day(2, 2)), ("t", 10, None, None, day(2, 2)), ("t", 11, "c", None, None), ("t", 12, "a", 4, day(2, 2)),
        ("t", 13, "d", None, day(2, 2)),
    ]
    assert found(spark, refs, nodes) == {
        ("t", 1, "a", "late", "2025-01"), ("t", 3, "a", "deleted", "2025-03"), ("t", 4, "a", "deleted", "2025-04"), ("t", 6, "b", "late", "2025-05"), ("t", 7, "zzz", "missing", "2025-02"),
        ("t", 9, "c", "missing_revision", "2025-02"), ("t", 12, "a", "missing_revision", "2025-02"), ("t", 13, "d", "late", "2025-02"),
    }


def test_empty(spark):
    assert found(spark, [], []) == set()
    assert found(spark, [("t", 1, "a", None, day(1, 1))], []) == {("t", 1, "a", "missing", "2025-01")}
    assert found(spark, [], [("a", 1, day(1, 1), None)]) == set()


def test_hot_target_and_many_keys(spark):
    refs = [("t", i, "hot" if i % 3 == 0 else f"k{i}", None, day(1 + i % 12, 15)) for i in range(3000)]
    nodes = [("hot", 1, day(1, 1), day(7, 1))] + [(f"k{i}", 1, day(1, 1), None) for i in range(0, 3000, 2)]
    want = {("t", i, "hot", "deleted", f"2025-{1 + i % 12:02d}") for i in range(0, 3000, 3) if i % 12 >= 6} | {("t", i, f"k{i}", "missing", f"2025-{1 + i % 12:02d}") for i in range(1, 3000, 2) if i % 3}
    assert found(spark, refs, nodes) == want


def test_collected_references(spark):
    links = spark.createDataFrame([(1, " ./a ", day(1, 1)), (2, "  ", day(1, 1)), (3, None, day(1, 1))], "link_id bigint, target string, seen_at timestamp")
    docs = spark.createDataFrame([(5, ["x", None, ""], {"./y": 2, "z": None}, day(2, 1)), (6, None, None, day(2, 1))], "row_id bigint, doc_requires array<string>, doc_reviewed_as_of map<string,int>, published_at timestamp")
    got = {(r.ref_table, r.row_id, r.target, r.need) for r in orphans.collect_references(links, docs).where("target is not null").collect()}
    assert got == {("impact_links", 1, "a", None), ("doc_requires", 5, "x", None), ("doc_reviewed_as_of", 5, "y", 2), ("doc_reviewed_as_of", 5, "z", None)}


def test_a_bare_prefix_names_nothing_and_is_an_orphan(spark):
    links = spark.createDataFrame([(1, "./  ", day(1, 1)), (2, " ", day(1, 1))], "link_id bigint, target string, seen_at timestamp")
    docs = spark.createDataFrame([], "row_id bigint, doc_requires array<string>, doc_reviewed_as_of map<string,int>, published_at timestamp")
    nodes = spark.createDataFrame([], "node_id string, revision int, valid_from timestamp, valid_to timestamp")
    assert {tuple(r) for r in orphans.orphan_references(orphans.collect_references(links, docs), nodes).collect()} == {("impact_links", 1, "", "missing", "2025-01")}


@pytest.mark.parametrize(("share", "form"), [(0.001, "list"), (0.3, "bits"), (1.0, "runs"), (0.0, "list")])
def test_bitmaps_of_every_density(share, form):
    rng = np.random.default_rng(1)
    n = orphans.RANGE
    p = np.flatnonzero(rng.random(n) < share)
    q = np.flatnonzero(rng.random(n) < 0.5)
    a = orphans.Bitmap.of(p, n)
    assert a.form == form and a.nbytes <= n // 8
    assert (a.positions() == p).all() and a.has(np.arange(n)).nonzero()[0].tolist() == p.tolist()
    for other in (q, p[: len(p) // 2], np.arange(100, 9000), p[:0]):
        assert a.and_not(orphans.Bitmap.of(other, n)).positions().tolist() == sorted(set(p.tolist()) - set(other.tolist()))


def test_lifetimes_that_touch_gaps_and_long_ones(spark):
    import random

    rng = random.Random(5)
    t0 = dt.datetime(2024, 11, 1)
    at = lambda: t0 + dt.timedelta(hours=rng.choice([0, 24 * 30, 24 * 61, rng.randrange(9000)]))
    nodes = [(f"n{rng.randrange(12)}", rng.randrange(5), a, None if rng.random() < 0.3 else a + dt.timedelta(hours=rng.randrange(3000))) for a in (at() for _ in range(60))]
    refs = [("t", i, f"n{rng.randrange(14)}", rng.choice([None, 1, 3, 6]), at()) for i in range(800)]
    want = set()
    for _, i, x, need, a in refs:
        own = [(v, s, e) for n, v, s, e in nodes if n == x]
        alive = [v for v, s, e in own if s <= a and (e is None or a < e)]
        why = ("missing_revision" if need is not None and need > max(alive) else None) if alive else "deleted" if any(e and e <= a for *_, e in own) else "late" if own else "missing"
        if why:
            want.add(("t", i, x, why, a.strftime("%Y-%m")))
    assert found(spark, refs, nodes) == want and {w[3] for w in want} == {"missing_revision", "deleted", "late", "missing"}
