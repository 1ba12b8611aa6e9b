from ledgerloom.operators import program as P
from ledgerloom.sources import python_code

LIB = """
def low(a, b, c):
    return sink(a, b)
def sink(x, y):
    return x + y
def mid(p, q, r):
    low(p, q, r)
def top(u, v):
    if u:
        mid(u, q=v, r=1)
def twin():
    pass
"""
OTHER = """
def twin():
    return mid(1, 2, 3)
def uses():
    twin()
"""
TEST = """
def test_mid():
    mid(1, 2, 3)
def test_uses():
    uses()
"""


def facts(spark):
    return python_code.scan(spark.createDataFrame([("lib.py", LIB), ("other.py", OTHER), ("tests/test_x.py", TEST)], "path string, source string"))


def test_edges_and_ambiguities(spark):
    e = {(r.caller.split("::")[1], r.callee, r.confidence) for r in P.call_edges(facts(spark)).collect()}
    assert ("top", "lib.py::mid", 1.0) in e and {("uses", "lib.py::twin", 0.5), ("uses", "other.py::twin", 0.5)} <= e
    assert {tuple(r) for r in P.call_ambiguities(facts(spark)).collect()} == {("other.py::uses", "twin", 2)}


def test_bundles_reach_callers(spark):
    f = facts(spark)
    groups = P.signature_groups(f)
    assert {(r.fn, tuple(r.bundle)) for r in groups.collect()} >= {("lib.py::low", ("a", "b"))}
    start = groups.where("fn = 'lib.py::low'")
    got = {}
    for r in P.propagate_bundles(start, P.bindings(f)).collect():
        got.setdefault((r.fn, r.bundle_id), set()).add(r.param)
    assert {(fn, tuple(sorted(ps))) for (fn, _), ps in got.items()} == {("lib.py::low", ("a", "b")), ("lib.py::mid", ("p", "q")), ("lib.py::top", ("u", "v"))}
    assert {r.fn for r in P.propagate_bundles(start, P.bindings(f), ("lib.py::low",)).collect()} == {"lib.py::low"}


def test_decisions_and_impact(spark):
    f = facts(spark)
    assert {(r.fn, tuple(r.params), r.tier) for r in P.decision_surfaces(f).collect()} == {("lib.py::top", ("u",), "boundary")}
    changes = spark.createDataFrame([("lib.py", 4, 5)], "path string, start int, end int")
    assert {(r.fn.split("::")[1], r.confidence, r.kind) for r in P.impact(f, changes).collect()} == {("test_mid", 1.0, "must"), ("test_uses", 0.5, "likely")}


def test_clusters_tags_structure(spark):
    t = spark.createDataFrame([("t1", "a"), ("t1", "b"), ("t2", "b"), ("t2", "a"), ("t3", "a")], "test string, target string")
    assert [tuple(r) for r in P.call_clusters(t).collect()] == [("t1", 2, 2)]
    tags = spark.createDataFrame([("t", x) for x in ("id1", "shown", "both", "none")], "test string, tag string")
    uni = spark.createDataFrame([("shown", "id1"), ("both", "id2"), ("both", "id3")], "display string, identity string")
    assert {(r.tag, r.status) for r in P.annotation_drift(tags, uni).collect()} == {("id1", "ok"), ("shown", "legacy_tag"), ("both", "legacy_ambiguous"), ("none", "orphaned")}
    b = spark.createDataFrame([("x", "f", ["a", "b"]), ("x", "g", ["b", "a"]), ("y", "h", ["c"]), ("y", "h", [])], "path string, fn string, bundle array<string>")
    assert tuple(P.structure_metrics(b).first()) == (2, 3, 3, 5 / 3, 2)
    assert {(r.kind, r.uses) for r in P.structure_reuse(b.where("fn <> 'h'")).collect()} == {("bundle", 2), ("function", 2)}


def test_steps_mappings_and_drift(spark):
    a = spark.createDataFrame([("s", "m", ["p", "q"])], "source string, target string, basis array<string>")
    b = spark.createDataFrame([("m", "t", ["q", "r"]), ("m", "u", [])], "source string, target string, basis array<string>")
    assert {(r.target, tuple(r.basis)) for r in P.compose(a, b).collect()} == {("t", ("p", "q", "r")), ("u", ("p", "q"))}
    m = spark.createDataFrame([("a", "x"), ("b", "x")], "domain string, image string")
    assert tuple(P.faithful(m).first()) == (False, True)
    one = spark.createDataFrame([("s1", "r"), ("s2", "r"), ("s3", "r"), ("s4", "r")], "surface string, representative string")
    two = spark.createDataFrame([("s1", "r"), ("s2", "q"), ("s3", "z")], "surface string, representative string")
    w = spark.createDataFrame([("q", "r")], "left string, right string")
    assert {tuple(r) for r in P.drift(one, two, w).collect()} == {("s1", "non_drift"), ("s2", "linked"), ("s3", "drift"), ("s4", "missing")}
