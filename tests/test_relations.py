"""Set, join, delta, graph, fingerprint, series, ledger and taint operators on small cases and against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import deltas, fingerprints, graphs, joins, ledger, series, sets, taint


def members(spark, d):
    return spark.createDataFrame([(o, e) for o, es in d.items() for e in (es or [None])], "owner string, element string")


def got(df):
    return {tuple(r) for r in df.collect()}


def test_dominance_and_classes(spark):
    m = members(spark, {"a": ["x"], "b": ["x", "y"], "c": ["y", "x", "x"], "d": ["z"], "e": []})
    everyone = spark.createDataFrame([(x,) for x in "abcdef"], "owner string")
    assert got(sets.obsolescence(m, everyone)) == {("a", "redundant_by_evidence"), ("b", "active_candidate"), ("c", "equivalent_witness"), ("d", "active_candidate"), ("e", "unmapped"), ("f", "unmapped")}
    assert {o for o, *_ in got(sets.dominators(m))} == {"a"}
    assert got(sets.held_once(m)) == {("z", "d")}
    assert sets.dominators(m.limit(0)).count() == 0


@pytest.mark.parametrize("least", [0.5, 0.75])
def test_set_joins_against_brute_force(spark, least):
    rng = random.Random(7)
    d = {f"o{i:03d}": sorted(rng.sample("abcdefgh", rng.randrange(1, 6))) for i in range(150)}
    first = {}
    for o, s in d.items():
        first.setdefault(tuple(s), o)
    want = {(min(a, b), max(a, b)) for s, a in first.items() for t, b in first.items() if a != b and len(set(s) & set(t)) / len(set(s) | set(t)) >= least}
    assert {(a, b) for a, b, _ in got(sets.likeness_join(members(spark, d), least))} == want
    classes = {frozenset(s) for s in first}
    ups = {o: [t for t in classes if t > set(s)] for o, s in d.items()}
    assert {(o, len([t for t in u if len(t) == min(map(len, u))])) for o, u in ups.items() if u} == got(sets.dominators(members(spark, d)).groupBy("owner").agg(F.count("*")))


def test_greedy_merge():
    assert sets.merge_greedily([["a", "b"], ["a", "b", "c"]], 0.66) == [["a", "b", "c"]]
    assert sets.merge_greedily([["a", "b"], ["c", "d"]], 0.5) == [["a", "b"], ["c", "d"]]
    assert sets.merge_greedily([], 0.5) == []


def test_winners(spark):
    df = spark.createDataFrame([("g", "a", 1), ("g", "b", 2), ("h", "c", None)], "g string, id string, v int")
    assert got(sets.winners(df, ["g"], [-F.coalesce("v", F.lit(0)), F.col("id")])) == {("g", "b", 2), ("h", "c", None)}


def test_interval_and_point_joins(spark):
    rng = random.Random(1)
    iv = [(i, s := rng.randrange(300), s + rng.randrange(40)) for i in range(80)]
    df = spark.createDataFrame([("k", *x) for x in iv] + [("k", 999, 10, 5), ("other", 1000, 0, 500)], "k string, id int, s int, e int")
    side = lambda p: df.select("k", F.col("id").alias(f"{p}_id"), F.col("s").alias(f"{p}_start"), F.col("e").alias(f"{p}_end"))
    out = [(r.a_id, r.b_id) for r in joins.interval_join(side("a"), side("b"), ["k"], 16).where("a_id < b_id and k = 'k'").collect()]
    assert len(out) == len(set(out))
    assert set(out) == {(a, b) for a, s, e in iv for b, t, f in iv if a < b and s <= f and t <= e}
    spans = spark.createDataFrame([("k", 5, 0), ("k", 100, 130)], "k string, start int, end int")
    points = spark.createDataFrame([("k", x) for x in (-1, 0, 5, 6, 115, 131)], "k string, at int")
    assert {r["at"] for r in joins.point_join(points, spans, ["k"], 7).collect()} == {0, 5, 115}


def test_fall_through_ambiguity_and_as_of(spark):
    left = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    one, two = (spark.createDataFrame(x, "k string, v string") for x in ([("a", "1"), ("a", "2")], [("a", "9"), ("b", "3"), (None, "0")]))
    assert got(joins.first_match(left, [one, two], "k", "v")) == {("a", "1", 0, 2), ("b", "3", 1, 1), ("c", None, None, None), (None, None, None, None)}
    amb = {(r.k, r.n, round(r.confidence, 3), r.inferred) for r in joins.ambiguity(spark.createDataFrame([("u",)] + [("m",)] * 20, "k string"), "k").collect()}
    assert amb == {("u", 1, 1.0, False), ("m", 20, 0.1, True)}
    t = lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(days=n)
    rng = random.Random(2)
    l = [("k", t(rng.randrange(400)), i) for i in range(60)] + [("z", t(1), 99)]
    r = sorted({t(rng.randrange(400)) for _ in range(25)})
    right = spark.createDataFrame([("k", x, i) for i, x in enumerate(r)], "k string, t timestamp, v int")
    res = {x.id: x.asof_v for x in joins.as_of(spark.createDataFrame(l, "k string, t timestamp, id int"), right, ["k"], "t", "v", F.date_trunc("month", "t")).collect()}
    assert res == {i: (max((j for j, y in enumerate(r) if y <= x), default=None) if k == "k" else None) for k, x, i in l}


def test_deltas(spark):
    a, b = (spark.createDataFrame(x, "k string, count bigint, v string") for x in ([("x", 2, "1"), ("y", 1, None)], [("x", 5, "1"), ("z", 1, "q"), ("y", 1, "")]))
    assert got(deltas.count_delta(a, b, ["k"])) == {("x", 2, 5, 3), ("y", 1, 1, 0), ("z", 0, 1, 1)}
    assert got(deltas.entity_delta(a, b, ["k"], ["v"])) == {("z", "added"), ("y", "changed")}
    new, known = deltas.ratchet(b, a, ["k"])
    assert [r.k for r in new.collect()] == ["z"] and known.count() == 2
    g = spark.createDataFrame([(None,), (0,), (1,), (20,)], "d int").select(deltas.gate(F.col("d"), 1, 20))
    assert [r[0] for r in g.collect()] == ["unreadable", "pass", "warn", "block"]
    diff = deltas.multiset_diff(*(spark.createDataFrame([(x,) for x in s], "b string") for s in (["ab", "c"], ["ab", "ab", "d"])), ["b"])
    assert {(r.b, r.change_kind) for r in diff.collect()} == {("ab", "changed"), ("c", "removed"), ("d", "added")}


def edges(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "src string, dst string")


def components_of(pairs, nodes=()):
    up = {x: x for x in [*nodes, *(x for p in pairs for x in p)]}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in up}


def test_components(spark):
    rng = random.Random(9)
    pairs = [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}") for _ in range(80)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)] + [("hub", f"h{i}") for i in range(50)]
    assert got(graphs.components(edges(spark, pairs), spark.createDataFrame([("alone",)], "node string"))) == components_of(pairs, ["alone"])
    assert graphs.components(edges(spark, [])).count() == 0
    u = graphs.union_sets(spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "b"), ("3", "d")], "owner string, element string"))
    assert got(u) == {("1", "1"), ("2", "1"), ("3", "3")}


def test_components_of_links_against_brute_force(spark, sf_dir):
    from ledgerloom.plans.catalogue import QUERIES
    from tests.brute import links

    whole = [p for p in links(sf_dir) if None not in p]
    assert got(QUERIES["graph_components"](spark, sf_dir)) == components_of(whole)


def test_reach_and_strongest_paths(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")])
    seed = spark.createDataFrame([("a",)], "node string")
    assert got(graphs.reach(e, seed, 2)) == {("a", 0), ("b", 1), ("c", 2)}
    assert {r.node for r in graphs.downstream(e, seed).collect()} == {"b", "c", "d", "e"}
    w = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 1.0), ("c", "b", 0.9), ("b", "d", 1.0)], "src string, dst string, confidence double")
    assert got(graphs.strongest_paths(w, seed, 5)) == {("a", 1.0), ("b", 0.9), ("c", 1.0), ("d", 0.9)}
    assert dict(got(graphs.strongest_paths(w, seed, 1)))["b"] == 0.5


def test_refinement_ignores_order_and_tells_degrees_apart(spark):
    nodes = spark.createDataFrame([(x, "s") for x in "abcde"], "node string, seed string")
    e = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")]
    x = dict(got(graphs.refine(nodes, edges(spark, e), 2)))
    assert x == dict(got(graphs.refine(nodes.orderBy(F.desc("node")), edges(spark, e[::-1]), 2)))
    assert x["a"] == x["e"] and x["b"] == x["d"] and len(set(x.values())) == 3


def test_levels_components_and_schedule(spark):
    dag = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x"), ("y", "z")]
    assert got(graphs.levels(edges(spark, dag))) == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("x", None), ("y", None), ("z", None)}
    rng = random.Random(11)
    pairs = [(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}") for _ in range(60)]
    names = {x for p in pairs for x in p}
    reach = {n: {n} for n in names}
    for _ in names:
        for a, b in pairs:
            reach[a] |= reach[b]
    want = {(n, min(m for m in names if m in reach[n] and n in reach[m])) for n in names}
    assert got(graphs.strong_components(edges(spark, pairs))) == want
    assert graphs.strong_components(edges(spark, [])).count() == 0
    assert graphs.schedule([("a", "b")]) == (["b", "a"], [])
    assert graphs.schedule([("a", "b"), ("b", "a")]) == ([], ["a", "b"])
    assert graphs.schedule([("root", "a"), ("root", "b"), ("a", "c"), ("b", "c")]) == (["c", "a", "b", "root"], [])
    assert graphs.schedule([("a", "a")]) == ([], ["a"])


def test_interning(spark):
    n = spark.createDataFrame([("F", ["a"], "first", 1), ("F", ["a"], "second", 2), ("F", ["b"], "x", 3)], "kind string, key array<string>, meta string, seq int")
    assert {(r.key[0], r.meta) for r in graphs.intern_nodes(n).collect()} == {("a", "first"), ("b", "x")}


def test_fingerprints(spark):
    m = lambda d: spark.createDataFrame(list(d.items()), "key string, exponent bigint")
    a, b = m({"x": 2, "y": 1}), m({"x": 1, "z": 1})
    assert got(fingerprints.algebra(a, b)) == {("x", 1, 2, 1), ("y", 0, 1, 1), ("z", 0, 1, 1)}
    assert fingerprints.contains(a, m({"x": 2})).first()[0] and not fingerprints.contains(a, b).first()[0] and not fingerprints.contains(a, a.limit(0)).first()[0]
    assert fingerprints.primes(6) == [2, 3, 5, 7, 11, 13]
    assert fingerprints.factor(2 * 2 * 3 * 17, [2, 3, 5]) == ({2: 2, 3: 1}, 17)


def test_series(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([1, 0, 0, 2, 0])], "k string, i int, v int")
    assert [(r.rate, r.trend) for r in series.recurrence(df, ["k"], "i", "v", 1).orderBy("i").collect()] == [(1.0, None), (0.5, -1), (0.0, 0), (0.5, 2), (0.5, -2)]
    assert [r.since for r in series.runs_since(df, ["k"], "i", "v").orderBy("i").collect()] == [0, 1, 2, 0, 1]
    assert [(r.i, r.previous) for r in series.violations(df, ["k"], "i", "v").orderBy("i").collect()] == [(1, 1), (4, 2)]


def test_ledger(spark):
    df = spark.createDataFrame([("a", 1, "set", "x"), ("a", 3, "delete", None), ("a", 2, "set", "y"), ("b", 1, "set", None), ("c", 1, "noop", "z")], "k string, seq int, op string, v string")
    s = ledger.fold(df, ["k"], "seq", F.col("op"), F.col("v"))
    assert got(s) == {("b", 1, None)}
    assert ledger.same_state(s, s).count() == 0
    d = lambda x: ledger.state_digest(x, ["k"], "value").first()[0]
    assert d(s) == d(s.repartition(3)) != d(s.limit(0))


def test_taint(spark):
    m = spark.createDataFrame([("e", "unknown", True, None, None, True), ("o", "x", False, None, None, True), ("o", "unknown", False, None, None, True), ("s", "x", False, None, None, True), ("s", "x", False, True, False, True), ("s", "x", False, True, True, None), ("s", "unknown", False, True, True, True), ("s", "x", False, True, True, True)], "p string, kind string, expired boolean, known boolean, allows boolean, witness boolean")
    p = F.when(F.col("p") == "o", "observe").otherwise("enforce")
    out = m.select(taint.status(p, F.col("kind"), F.col("expired"), F.col("known"), F.col("allows"), F.col("witness")))
    assert [r[0] for r in out.collect()] == ["expired_exemption", "resolved", "unresolved", "illegal_locus", "illegal_locus", "missing_witness", "unresolved", "resolved"]
    g = spark.createDataFrame([("a", True, False), ("a", True, None), ("b", True, True), ("c", None, False)], "profile string, ready boolean, regressed boolean")
    assert got(taint.lifecycle(g)) == {("a", "promote"), ("b", "demote"), ("c", "hold")}


def test_scalars(spark):
    df = spark.createDataFrame([("1m30s", ["b ", "a", "", None, "a"], '{"b":1,"a":[2.5,null]}'), ("750ms", [], "{"), ("soon", None, None), ("1.5s", ["x"], "[]")], "d string, p array<string>, j string")
    r = df.select(scalars.duration_ns("d").alias("d"), scalars.paramset("p").alias("p"), scalars.canonical_text("j").alias("j")).collect()
    assert [x.d for x in r] == [90_000_000_000, 750_000_000, None, 1_500_000_000]
    assert [x.p for x in r] == [["a", "b"], [], None, ["x"]]
    assert [x.j for x in r] == ['{"a":[2.5,null],"b":1}', None, None, "[]"]
    j = spark.createDataFrame([(["a"], ["a", "b"]), ([], [])], "a array<string>, b array<string>").select(scalars.jaccard("a", "b"))
    assert [x[0] for x in j.collect()] == [0.5, 1.0]
    assert scalars.type_key("Optional[int]") == scalars.type_key("int | None") == "Union[None, int]"
    assert scalars.type_key("typing.Dict[str, Union[int, str]]") == "dict[str, Union[int, str]]"
    assert scalars.canonical_multiset([("a", 1), ("b", 2), ("a", 3)]) == [["a", 4], ["b", 2]]
    with pytest.raises(ValueError):
        scalars.canonical_multiset([("a", 0)])
    assert scalars.bundle_name(["user_id", "ctx"], {"user_id": 3, "ctx": 3}) == "UserIdBundle"


def test_numbers_are_dense_and_in_order(spark):
    from ledgerloom.functions.ordering import numbered

    df = spark.range(1000).selectExpr("concat('n', lpad(cast(pmod(xxhash64(id), 100000) as string), 6, '0'), '-', id) name", "1 x").repartition(7)
    rows = numbered(df, ["name"], "no").orderBy("name").collect()
    assert [r.no for r in rows] == list(range(1000))
    assert numbered(df.limit(0), ["name"], "no").count() == 0


def test_an_unfinished_fixpoint_is_an_error(spark, monkeypatch):
    from ledgerloom.operators import program

    chain = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)], "src string, dst string")
    monkeypatch.setattr(graphs, "LOCAL_EDGES", 0)
    monkeypatch.setattr(graphs, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        graphs.components(chain)
    monkeypatch.setattr(program, "MAX_ROUNDS", 0)
    groups = spark.createDataFrame([("f", ["a", "b"])], "fn string, bundle array<string>")
    bound = spark.createDataFrame([("g", "x", "f", "a"), ("g", "y", "f", "b")], "caller string, caller_param string, callee string, callee_param string")
    with pytest.raises(RuntimeError):
        program.propagate_bundles(groups, bound)


def test_mask_bits_that_do_not_fit_are_an_error(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "owner int, key string")
    bits = spark.createDataFrame([("a", 0), ("b", 64)], "key string, bit bigint")
    with pytest.raises(Exception, match="bit beyond 62"):
        fingerprints.masks(items, bits).collect()
    got = {(r.owner, r.word, r["mask"]) for r in fingerprints.wide_masks(items, bits).collect()}
    assert got == {(1, 0, 1), (1, 1, 4), (2, 0, 1)}


@pytest.mark.parametrize("few", [0, 12, 10**6])
def test_rounds_and_one_task_agree(spark, monkeypatch, few):
    rng = random.Random(few)
    monkeypatch.setattr(graphs, "LOCAL_EDGES", few)
    names = [f"n{i:02d}" for i in range(24)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(18)} | {(f"c{i:02d}", f"c{i + 1:02d}") for i in range(12)}
    e = spark.createDataFrame(sorted(pairs), "src string, dst string")
    nodes = spark.createDataFrame([("alone",)], "node string")
    down = {}
    for a, b in pairs:
        down.setdefault(a, set()).add(b)

    def below(a):
        seen, todo = set(), [a]
        while todo:
            for x in down.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    every = {x for p in pairs for x in p} | {"alone"}
    reach = {a: below(a) for a in every}
    strong = {a: min([a, *(b for b in reach[a] if a in reach[b])]) for a in every}
    assert {r.node: r.component for r in graphs.strong_components(e, nodes).collect()} == strong
    bad = {b for a in every if a in reach[a] for b in reach[a]}
    level = {}

    def depth(n):
        if n not in level:
            level[n] = max((depth(a) + 1 for a, b in pairs if b == n), default=0)
        return level[n]

    assert {r.node: r.level for r in graphs.levels(e, nodes).collect()} == {n: None if n in bad else depth(n) for n in every}
    seeds = ["c00", "n03", "alone"]
    dist, todo = {x: 0 for x in seeds}, list(seeds)
    for n in todo:
        for x in sorted(down.get(n, ())):
            if x not in dist and dist[n] < 4:
                dist[x] = dist[n] + 1
                todo.append(x)
    assert {r.node: r.depth for r in graphs.reach(e, spark.createDataFrame([(x,) for x in [*seeds, "n03"]], "node string"), 4).collect()} == dist
    near = {n: {n} for n in every}
    for _ in every:
        for a, b in pairs:
            near[a] |= near[b]
            near[b] |= near[a]
    assert {r.node: r.component for r in graphs.components(e, nodes).collect()} == {n: min(near[n]) for n in every}
