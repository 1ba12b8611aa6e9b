from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import packing as P

DOCS = "doc_id bigint, text string, tokens int, capacity string, container_id string"
BINS = "bin_kind string, capacity_tokens int, doc_id bigint"


def pack(spark, texts, bins):
    d = spark.createDataFrame([(i, t, 0, "", "") for i, t in texts], DOCS)
    b = spark.createDataFrame([(k, c, 0) for k, c in bins], BINS)
    return P.pack(d, b).collect()


def check(got, texts, path=P.TOKENIZER_DIR + "/" + P.VOCABULARY):
    """Every token of every text once, in order; no container too full; texts cut only if they must be."""
    want = Counter()
    for _, t in texts:
        want[P.token_count(t, path)] += 1
    by_kind = {}
    for r in got:
        by_kind.setdefault(r.bin_kind, []).append(r)
    for rs in by_kind.values():
        cap = rs[0].capacity_tokens
        load = Counter()
        docs = {}
        for r in rs:
            load[r.container_id] += r.tokens
            docs.setdefault(r.doc_id, []).append(r)
        assert max(load.values()) <= cap
        total = Counter()
        for ps in docs.values():
            ps.sort(key=lambda r: r.piece_no)
            at = 0
            for i, r in enumerate(ps):
                assert (r.piece_no, r.start_token) == (i, at)
                at += r.tokens
                assert i == len(ps) - 1 or r.tokens == cap
            assert len(ps) == 1 or at > cap
            total[at] += 1
        assert total == want
    return by_kind


def test_whole_tables(spark, sf_dir):
    from ledgerloom.session import table

    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    bins = [(r.bin_kind, r.capacity_tokens) for r in table(spark, sf_dir, "pack_bins").collect()]
    by_kind = check(pack(spark, docs, bins), docs)
    for rs in by_kind.values():
        n = len({r.container_id for r in rs} - {"none"})
        used, cap = sum(r.tokens for r in rs), rs[0].capacity_tokens
        assert n <= used / cap / 0.93 + 3


def test_null_empty_long_and_odd_bins(spark):
    texts = [(1, None), (2, ""), (3, "word " * 3000), (4, "a b c"), (5, "x" * 5000)]
    got = pack(spark, [*texts, (None, "lost")], [("k", 512), ("k", 512), ("same", 512), ("no", None), ("bad", 0)])
    by_kind = check(got, texts)
    assert by_kind.keys() == {"k", "same"}
    assert {r.container_id for r in got if r.tokens == 0} == {"none"}


def test_empty_tables(spark):
    assert pack(spark, [], [("k", 512)]) == []
    assert pack(spark, [(1, "a")], []) == []


def test_nonnegative_least_squares_finds_an_exact_fit():
    rng = np.random.default_rng(1)
    a = rng.random((12, 30))
    x = np.zeros(30)
    x[[3, 8, 20]] = [1.5, 2.0, 0.25]
    got = P.nonnegative_least_squares(a, a @ x)
    assert got.min() >= 0 and np.abs(a @ got - a @ x).max() < 1e-6
    assert np.abs(P.nonnegative_least_squares(a, -np.ones(12))).max() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_never_use_more_texts_than_there_are(seed):
    h = np.zeros(P.CLASSES + 1, "i8")
    h[1:] = np.random.default_rng(seed).integers(0, 500, P.CLASSES)
    a, n = P.plan(h)
    assert ((a @ n) <= h).all() and (n > 0).all()
    assert (a @ n).sum() > 0.8 * h[P.CLASSES // 2 :].sum()


def test_best_fit():
    assert P.best_fit([3, 9, 4], [5, 4], 10) == [0, 2, 1]
    assert P.best_fit([], [5], 10) == []


def test_levels_follow_the_mean_length():
    assert [P.depth_of(c, 311) for c in (512, 2048, 8192)] == [0, 1, 2] and P.depth_of(512, 0.0) == 0
    assert [P._length(8192, j) for j in range(3)] == [8192, int(2048 * P.BUNDLE), int(512 * P.BUNDLE)]


def test_patterns_carry_containers_of_many_short_texts(spark):
    rng = np.random.default_rng(3)
    texts = [(i, "word " * int(n)) for i, n in enumerate(rng.integers(30, 200, 3000))]
    got = pack(spark, texts, [("long", 4096)])
    check(got, texts)
    [r] = P.fill_report(spark.createDataFrame(got)).collect()
    assert r.containers <= -(-r.tokens // 4096) + 1 and r.in_pattern_containers > 0.5
