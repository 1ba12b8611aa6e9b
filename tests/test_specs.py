import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.plans import spec as S
from ledgerloom.plans.compile import apply_spec
from ledgerloom.plans.registry import PREDICATES, SPECS

NAMES = st.sampled_from(["a", " b", "c ", "", "d"])
OPS = st.one_of(
    st.builds(lambda p: {"op": "select", "params": {"predicates": p}}, st.lists(NAMES)),
    st.builds(lambda p: {"op": "select", "params": {"predicate": p}}, NAMES),
    st.builds(lambda p: {"op": "project", "params": {"fields": p}}, st.lists(NAMES)),
    st.builds(lambda p: {"op": "count_by", "params": {"fields": p}}, st.lists(NAMES)),
    st.builds(lambda p, o: {"op": "sort", "params": {"by": [*p, {"key": "z", "order": o}]}}, st.lists(NAMES), st.sampled_from(["asc", "DESC", "up"])),
    st.builds(lambda n: {"op": "limit", "params": {"count": n}}, st.one_of(st.integers(-2, 5), st.sampled_from(["3", "x", None, True]))),
    st.just({"op": "other", "params": {"b": 1, "a": [{"z": 1, "y": 2}]}}),
)
SPEC = st.builds(lambda ops: {"name": "n", "domain": "d", "pipeline": ops}, st.lists(OPS, max_size=6))


@given(SPEC)
@settings(max_examples=200, deadline=None)
def test_normal_form_is_stable(d):
    once = S.normalize(S.from_dict(d))
    assert S.normalize(S.from_dict(once)) == once
    assert S.from_dict(S.to_dict(S.from_dict(d))) == S.from_dict(d)


@given(st.permutations(["a", "b", "c"]), st.permutations(["x", "y"]))
@settings(max_examples=20, deadline=None)
def test_order_of_names_does_not_matter(p, q):
    spec = lambda p, q: S.from_dict({"name": "n", "pipeline": [{"op": "select", "params": {"predicates": p}}, {"op": "count_by", "params": {"fields": q}}]})
    assert S.identity(spec(p, q)) == S.identity(spec(["a", "b", "c"], ["x", "y"]))


def test_fusion_and_no_ops():
    parts = [{"op": "select", "params": {"predicates": ["b"]}}, {"op": "select", "params": {"predicate": " a "}}, {"op": "project", "params": {"fields": []}}, {"op": "limit", "params": {"count": -1}}, {"op": "sort", "params": {"by": {"field": "x"}}}, 5, {"op": ""}]
    assert S.normalize(S.from_dict({"name": "n", "pipeline": parts}))["pipeline"] == [{"op": "select", "params": {"predicates": ["a", "b"]}}]
    assert S.from_dict({"spec_version": "x"}).spec_version == 1
    assert json.loads(S.identity(SPECS["lint_findings"]))["name"] == "lint_findings"


def run(spark, df, *ops, registry=None, params=None, **own):
    return [r.asDict() for r in apply_spec(S.Spec("t", tuple(S.Op(o, p) for o, p in ops), "", own), df, registry, params).collect()]


def test_traverse(spark):
    df = spark.createDataFrame([("s1", [("a",), ("b",)]), ("s2", None), ("s3", [])], "suite string, candidates array<struct<qual:string>>")
    assert run(spark, df, ("traverse", {"field": "candidates", "prefix": "candidate_", "index": "candidate_index"})) == [{"suite": "s1", "candidate_index": 0, "candidate_qual": "a"}, {"suite": "s1", "candidate_index": 1, "candidate_qual": "b"}]
    kept = run(spark, df, ("traverse", {"field": "candidates", "merge": False, "keep": True, "as": "one"}))
    assert [(r["one"].qual, len(r["candidates"])) for r in kept] == [("a", 2), ("b", 2)]
    assert run(spark, df, ("traverse", {"field": "suite"})) == [] == run(spark, df, ("traverse", {"field": "absent"}))


def test_sort_nulls_and_stability(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "id int, k string")
    asc = run(spark, df, ("sort", {"by": [{"field": "id", "order": "desc"}]}), ("sort", {"by": ["k"]}))
    assert [r["id"] for r in asc] == [3, 4, 1, 2]
    assert [r["id"] for r in run(spark, df, ("sort", {"by": [{"field": "k", "order": "desc"}, "id"]}), ("limit", {"count": 2}))] == [2, 1]
    assert [r["id"] for r in run(spark, df, ("sort", {"by": ["k", "id"]}), ("project", {"fields": ["id"]}))] == [3, 1, 4, 2]


def test_count_by_and_predicates(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), ("a", 2), (None, None)], "g string, v int")
    got = run(spark, df, ("count_by", {"fields": ["g"]}), ("select", {"predicates": ["count_gt_1", "unknown"]}), registry=PREDICATES)
    assert got == [{"g": "a", "count": 2}, {"g": None, "count": 2}]
    least = {"least": lambda d, p: F.col("v") >= p["n"]}
    assert len(run(spark, df, ("select", {"predicates": ["least"]}), registry=least, n=1)) == 3
    assert len(run(spark, df, ("select", {"predicates": ["least"]}), registry=least, params={"n": 2}, n=1)) == 1
    assert run(spark, df.limit(0), ("count_by", {"fields": ["g"]})) == []


def test_registered_specs_run_on_relations_without_their_columns(spark):
    df = spark.createDataFrame([("x",)], "anything string")
    for spec in SPECS.values():
        assert apply_spec(spec, df, PREDICATES).count() <= 1
