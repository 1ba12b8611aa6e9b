import json

from ledgerloom.operators import nested
from ledgerloom.operators.nested import NodeType
from tests.conftest import rows

ENVELOPE = "delivery_id bigint, payload_json string, value string, record_id bigint"
ARTIFACT = "record_id bigint, artifact_json string, kind string, idx int"


def items(spark, artifacts=(), envelopes=()):
    a = spark.createDataFrame([(i, t, "x", 1) for i, t in artifacts], ARTIFACT)
    e = spark.createDataFrame([(i, t, "x", -1) for i, t in envelopes], ENVELOPE)
    return {tuple(r[c] for c in ("record_id", "entity", "parent_key", "item_index", "item")) for r in nested.child_items(a, e).collect()}


def test_shapes_of_artifacts(spark):
    one = {"boundary_asymmetry_scenario": {"left": {"basis_path": ["a", {"key": "b", "prime": 2}, None]}, "right": {"basis_path": "c"}}}
    two = {"boundary_asymmetry_scenario": [{"left": None}, {"left": {"basis_path": []}, "right": {"basis_path": ["d", "d"]}}]}
    three = {"cases": [{"case_id": "k", "dimensions": {"x": {"mask": 5}, "y": {"mask": None}, "z": None}}, {"case_id": "m", "dimensions": [{"name": "x", "mask": "19270180645233"}, 7, {"mask": 12345678901234567890}]}]}
    got = items(spark, [(1, json.dumps(one)), (2, json.dumps(json.dumps(two))), (3, json.dumps(three, indent=1)), (4, None), (5, '{"cases": '), (6, "[1]"), (7, "")])
    assert got == {
        (1, "basis_step", "0/left", 0, "a"), (1, "basis_step", "0/left", 1, "b"), (1, "basis_step", "0/right", 0, "c"),
        (2, "basis_step", "1/right", 0, "d"), (2, "basis_step", "1/right", 1, "d"),
        (3, "mask", "k/x", 0, "5"), (3, "mask", "m/x", 1, "19270180645233"), (3, "mask", "m/", 1, "12345678901234567890"),
    }


def test_shapes_of_payloads(spark):
    e = [
        (1, {"key": "a", "value": {"sites": [{"path": "p", "params": ["x", None]}, "s", {"path": None, "params": "y"}]}}),
        (2, {"value": [{"path": "q"}, 3, [{"path": "inner"}]]}),
        (3, {"key": "c", "value": {"sites": {"path": "lone", "params": None}}}),
        (4, {"key": None, "value": {"sites": [{"path": "r"}]}}),
        (5, {"key": "e", "value": "text"}),
    ]
    got = items(spark, (), [(i, json.dumps(o)) for i, o in e])
    assert got == {
        (1, "site", "a", 0, "p"), (1, "site_param", "0", 0, "x"), (1, "site_param", "0", 1, None), (1, "site", "a", 2, None), (1, "site_param", "2", 0, "y"),
        (2, "site", "", 0, "q"), (3, "site", "c", 0, "lone"), (4, "site", "", 0, "r"),
    }


def test_empty_tables(spark):
    assert items(spark) == set()


def test_labels_are_intervals(spark):
    record = {"a": [{"b": 1}, {"b": [2, {"c": {}}]}], "d": {"e": None}}
    out = nested.Labeller([NodeType("b", "a[]/b")], all_nodes=True).rows(record)
    assert [r[1] for r in out] == list(range(len(out)))
    assert sorted(r[2] for r in out) == list(range(len(out)))
    inside = lambda x, y: x[1] < y[1] and x[2] > y[2]
    for x in out:
        assert sum(inside(y, x) for y in out) == x[3]


def test_a_very_deep_and_a_very_long_record(spark):
    deep = {"key": "k"}
    for _ in range(400):
        deep = {"value": deep}
    long = {"key": "k", "value": {"sites": [{"path": str(i)} for i in range(20_000)]}}
    got = items(spark, (), [(1, json.dumps(deep)), (2, json.dumps(long))])
    assert len(got) == 20_000


def test_nodes_of_all_types(spark):
    df = spark.createDataFrame([(1, '{"x": {"y": [1, 2]}}')], "record_id bigint, json string")
    got = nested.label_nodes(df, "record_id", "json", [NodeType("y", "x/y[]")], all_nodes=True)
    assert [r[5] for r in rows(got.select("record_id", "node_type", "pre", "post", "depth", "kind", "value"))].count("y") == 0
    assert {(r.node_type, r.kind, r.value) for r in got.collect()} == {("", "object", None), ("", "array", None), ("y", "integer", "1"), ("y", "integer", "2")}


def test_a_table_per_node_type_with_parents(spark):
    import json

    record = {"cases": [{"case_id": "c1", "dimensions": {"base": {"mask": 5}, "ctor": {"mask": None}}}], "boundary_asymmetry_scenario": {"left": {"basis_path": ["a", {"key": "b"}]}}}
    df = spark.createDataFrame([(1, json.dumps(record), "x"), (2, None, ""), (3, "{broken", "")], "record_id bigint, artifact_json string, label string")
    tables = nested.node_tables(nested.label_nodes(df, "record_id", "artifact_json", nested.ARTIFACT_TYPES), nested.ARTIFACT_TYPES)
    assert tables.keys() == {"scenario", "side", "step", "case", "dimension", "mask"}
    parents = {n: {r.parent_type for r in t.collect()} for n, t in tables.items()}
    assert parents == {"scenario": {None}, "side": {"scenario"}, "step": {"side"}, "case": {None}, "dimension": {"case"}, "mask": {"dimension"}}
    sides = {(r.record_id, r.pre) for r in tables["side"].collect()}
    steps = tables["step"].orderBy("idx").collect()
    assert [r.value for r in steps] == ["a", "b"] and {(r.record_id, r.parent_pre) for r in steps} == sides


def test_tables_of_artifacts_and_payloads(spark):
    artifacts = [(1, json.dumps({"boundary_asymmetry_scenario": {"left": {"basis_path": ["a", None]}, "right": {"basis_path": []}}})), (2, json.dumps({"cases": [{"case_id": "c"}]})), (3, "{broken")]
    envelopes = [(1, json.dumps({"key": "k", "value": {"sites": [{"path": "p", "params": ["x", "y"]}, "s", {"path": "q", "params": None}]}})), (2, json.dumps({"value": [7, {"params": "z"}]})), (3, json.dumps({"key": "k", "value": 5})), (4, None)]
    a, e = spark.createDataFrame([(i, t, "x", 1) for i, t in artifacts], ARTIFACT), spark.createDataFrame([(i, t, "x", -1) for i, t in envelopes], ENVELOPE)
    got = nested.all_tables(a, e).collect()
    node = {(r.source, r.record_id, r.pre, r.node_type): r for r in got}
    assert len(node) == len(got)
    place = lambda r: (r.record_id, r.node_type, r.label, r.idx, r.value)
    parent = lambda r: None if r.parent_type is None else place(node[r.source, r.record_id, r.parent_pre, r.parent_type])
    s, left = (1, "scenario", "boundary_asymmetry_scenario", 0, None), (1, "side", "left", 0, None)
    one, two, three = (1, "payload", "", 0, "k"), (2, "payload", "", 0, None), (3, "payload", "", 0, "k")
    p, z = (1, "site", "sites", 0, "p"), (2, "site", "value", 1, None)
    want = {
        "aspf_artifacts": {(s, None), (left, s), ((1, "side", "right", 0, None), s), ((1, "step", "basis_path", 0, "a"), left), ((1, "step", "basis_path", 1, None), left), ((2, "case", "cases", 0, "c"), None)},
        "event_envelopes": {(one, None), (p, one), ((1, "param", "params", 0, "x"), p), ((1, "param", "params", 1, "y"), p), ((1, "site", "sites", 2, "q"), one), (two, None), (z, two), ((2, "param", "params", 0, "z"), z), (three, None)},
    }
    assert {source: {(place(r), parent(r)) for r in got if r.source == source} for source in want} == want
    assert len(got) == sum(map(len, want.values()))
