import random

import pytest

from ledgerloom.operators import hierarchy as H


def brute(edges, nodes):
    up = {}
    for c, p in edges:
        up[c] = min(p, up.get(c, p))
    names = {x for e in edges for x in e} | set(nodes)
    kids = {}
    for c, p in up.items():
        kids.setdefault(p, set()).add(c)
    out = {}
    for n in names:
        seen, x = [], n
        while x is not None and x not in seen:
            seen.append(x)
            x = up.get(x)
        if x is None:
            cls, root, depth, path = "tree", seen[-1], len(seen) - 1, seen[::-1]
        else:
            k = seen.index(x)
            cls, root, depth, path = ("below_cycle" if k else "cycle"), min(seen[k:]), k, seen[: k + 1][::-1]
        below, todo = set(), [n]
        while todo:
            for c in kids.get(todo.pop(), ()):
                if c not in below:
                    below.add(c)
                    todo.append(c)
        out[n] = (cls, root, depth, len(below - {n}), path)
    return out


def solve(spark, edges, nodes=(), paths=True):
    e = spark.createDataFrame([("h", c, p, "x") for c, p in edges], "hierarchy string, child string, parent string, id string")
    n = spark.createDataFrame([("h", x) for x in nodes], "hierarchy string, name string")
    return {r.node_name: (r.node_class, r.root_node, r.node_depth, r.descendants, list(r.path) if paths else None) for r in H.hierarchies(e, n, paths).collect()}


def test_shapes(spark):
    edges = [("b", "a"), ("c", "b"), ("d", "b"), ("e", "e"), ("f", "e"), ("x", "z"), ("y", "x"), ("z", "y"), ("w", "y"), ("v", "w"), ("b", "a")]
    assert solve(spark, edges, ["lone", "a"]) == brute(edges, ["lone", "a"])


def test_random_forests_and_cycles(spark):
    rng = random.Random(3)
    n = 300
    edges = [(f"n{i:03d}", f"n{rng.randrange(n) if rng.random() < 0.03 else rng.randrange(max(i, 1)):03d}") for i in range(n) if rng.random() < 0.9]
    assert solve(spark, edges) == brute(edges, [])


def test_long_chain_and_long_cycle(spark):
    rng = random.Random(4)
    names = [f"n{i:03d}" for i in range(120)]
    rng.shuffle(names)
    edges = list(zip(names[1:60], names[:59])) + list(zip(names[60:], names[61:] + names[60:61]))
    assert solve(spark, edges) == brute(edges, [])


def test_star(spark):
    edges = [(f"c{i}", "hub") for i in range(500)] + [("hub", "top")]
    assert solve(spark, edges) == brute(edges, [])


def test_nulls_empty_and_two_parents(spark):
    assert solve(spark, []) == {}
    assert solve(spark, [], ["a"]) == {"a": ("tree", "a", 0, 0, ["a"])}
    got = solve(spark, [("a", None), (None, "b"), ("c", "q"), ("c", "p")], paths=False)
    assert {k: v[:3] for k, v in got.items()} == {"a": ("tree", "a", 0), "b": ("tree", "b", 0), "c": ("tree", "p", 1), "p": ("tree", "p", 0), "q": ("tree", "q", 0)}


def test_descendant_pairs(spark):
    e = spark.createDataFrame([("h", "b", "a"), ("h", "c", "b"), ("h", "d", "a")], "hierarchy string, child string, parent string")
    got = {tuple(r) for r in H.descendant_pairs(H.hierarchies(e, paths=True)).collect()}
    assert got == {("h", "a", "b", 1), ("h", "a", "c", 2), ("h", "b", "c", 1), ("h", "a", "d", 1)}


def test_descendants_of_cycles_too(spark):
    edges = [("b", "a"), ("c", "b"), ("e", "e"), ("f", "e"), ("x", "z"), ("y", "x"), ("z", "y"), ("w", "y"), ("v", "w")]
    e = spark.createDataFrame([("h", c, p) for c, p in edges], "hierarchy string, child string, parent string")
    got = sorted((r.node_name, r.descendant) for r in H.descendants(H.hierarchies(e, paths=True)).collect())
    cycle = [(a, b) for a in "xyz" for b in "vwxyz" if a != b]
    assert got == sorted([("a", "b"), ("a", "c"), ("b", "c"), ("e", "f"), ("w", "v"), *cycle])


def test_edges_of_documents(spark):
    docs = spark.createDataFrame([("./a.md", 1, ["x.md#s"], 1), ("a.md", 2, [" ", None, "./b.md#t", "c.md"], 2), ("b.md", 1, None, 3), (None, 5, ["a.md"], 4), ("c.md", 1, ["#only"], 5)], "doc_path string, doc_revision int, doc_requires array<string>, row_id bigint")
    docs = docs.selectExpr("*", "cast(null as timestamp) published_at")
    assert {(r.child, r.parent) for r in H.required_edges(docs).collect()} == {("a.md", "b.md"), ("b.md", None), ("c.md", None)}


@pytest.mark.parametrize("few", [0, 40])
def test_rounds_to_the_end_and_a_core_in_one_task(spark, monkeypatch, few):
    monkeypatch.setattr(H, "LOCAL_NODES", few)
    rng = random.Random(6)
    edges = [(f"n{i:03d}", f"n{rng.randrange(150) if rng.random() < 0.05 else rng.randrange(max(i, 1)):03d}") for i in range(150) if rng.random() < 0.9]
    names = [f"k{i:02d}" for i in range(60)]
    edges += list(zip(names[1:30], names[:29])) + list(zip(names[30:], names[31:] + names[30:31]))
    assert solve(spark, edges, ["lone"]) == brute(edges, ["lone"])
