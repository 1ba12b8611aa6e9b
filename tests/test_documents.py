"""Document formats, the wire format, and operators of the evidence catalogue on small cases."""

import json
import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.operators import evidence, graphs, resolution, traces
from ledgerloom.sources import documents, wire


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.one_of(st.none(), st.text()), st.one_of(st.none(), st.text(max_size=400)))
def test_wire_round_trip(sequence, run_id, record):
    row = {"sequence": sequence, "run_id": run_id, "record": record}
    assert wire.decode("event", wire.encode("event", row)) == row


def test_wire_skips_unknown_fields_and_refuses_broken_ones():
    known = wire.encode("commit", {"run_id": "r", "last_durable_sequence": 300})
    extra = wire.varint(9 << 3 | 2) + wire.varint(2) + b"xy" + wire.varint(8 << 3 | 5) + b"1234"
    assert wire.decode("commit", extra + known) == {"run_id": "r", "last_durable_sequence": 300}
    for broken in (known[:-1] + b"\xff", b"\x0a\x05ab", b"\x0a\x02\xff\xfe", b"\x0b", b"\x80" * 12):
        assert wire.decode("commit", broken) is None
    assert wire.decode("commit", b"") == {"run_id": None, "last_durable_sequence": None}


def test_nested_front_matter(spark):
    text = """---
doc_id: readme  # kept as text
revision: 3
tags: [a, "b c", 4]
requires:
  - one.md
  - path: two.md
    min: 2
reviewed:
  one.md: 2
  deep:
    x: true
none:
same_level:
- p
- q
---
# Title
"""
    df = spark.createDataFrame([(1, text), (2, "no front"), (3, None), (4, "---\nopen: 1"), (5, "")], "doc_id int, text string")
    got = {r.doc_id: json.loads(r.j) if r.j else None for r in df.select("doc_id", documents.front_matter_json("text").alias("j")).collect()}
    assert got.pop(1) == {"doc_id": "readme  # kept as text", "revision": 3, "tags": ["a", "b c", 4], "requires": ["one.md", {"path": "two.md", "min": 2}], "reviewed": {"one.md": 2, "deep": {"x": True}}, "none": None, "same_level": ["p", "q"]}
    assert set(got.values()) == {None}


def test_toml_and_json(spark):
    rows = {tuple(r) for r in documents.toml_config(spark, 'top = 1\n[a]\nx = [1, 2]\n[a.b]\ny = "z"\n').collect()}
    assert rows == {("", "top", "1"), ("a", "x", "[1, 2]"), ("a.b", "y", '"z"')}
    assert documents.toml_config(spark, "= broken").count() == 0
    assert documents.pretty_json({"b": 1, "a": [2]}) == '{\n  "a": [\n    2\n  ],\n  "b": 1\n}\n'


def test_git_diff(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "f.txt").write_text("a\nb\n")
    git("add", ".")
    git("commit", "-qm", "c")
    (tmp_path / "f.txt").write_text("a\nc\n")
    assert [r.line for r in documents.git_diff(spark, str(tmp_path)).orderBy("line_no").collect()][-2:] == ["-b", "+c"]
    assert documents.git_diff(spark, str(tmp_path / "none")).count() == 0


def test_resolution_falls_through_and_marks_ambiguity(spark):
    f = spark.createDataFrame([("m.f", "m", [], "f"), ("m.g.f", "m", ["g"], "f"), ("n.h", "n", [], "h"), ("n.C.k", "n", ["C"], "k"), ("o.C.k", "o", ["C"], "k")], "fn string, path string, scope array<string>, name string")
    calls = spark.createDataFrame([(1, "m", ["g", "x"], "f"), (2, "m", [], "f"), (3, "m", [], "h2"), (4, "m", [], "n.h"), (5, "m", [], "D.k"), (6, "m", [], "nothing"), (7, "m", [], "E.k")], "call_id int, path string, scope array<string>, name string")
    imports = spark.createDataFrame([("m", "h2", "n", "h")], "path string, alias string, module string, target string")
    methods = spark.createDataFrame([("C", "k", "n.C.k"), ("B", "k", "o.C.k")], "class string, method string, fn string")
    bases = spark.createDataFrame([("D", "C"), ("C", "B"), ("E", "C2"), ("E", "B"), ("C2", "E")], "class string, base string")
    rules = {"lexical": resolution.lexical(calls, f), "import": resolution.imported(calls, f, imports), "exact": resolution.exact(calls, f), "class": resolution.by_class(calls, methods, bases)}
    got = {r.call_id: (r.level, r.fn, r.ambiguous) for r in resolution.resolve(calls, rules).collect()}
    assert got == {1: ("lexical", "m.g.f", False), 2: ("lexical", "m.f", False), 3: ("import", "n.h", False), 4: ("exact", "n.h", False), 5: ("class", "n.C.k", False), 6: (None, None, False), 7: ("class", "o.C.k", False)}
    twice = spark.createDataFrame([("C", "k", "a"), ("C", "k", "b")], "class string, method string, fn string")
    one = resolution.resolve(calls.where("call_id = 5"), {"class": resolution.by_class(calls, twice, bases)}).first()
    assert (one.level, one.fn, one.ambiguous) == (None, None, True)


def test_types_flow_up_until_they_disagree(spark):
    params = [("a", "x", None), ("b", "y", "Any"), ("c", "z", "int"), ("d", "w", "str"), ("e", "v", "object"), ("f", "u", "bool")]
    bound = [("a", "x", "b", "y"), ("b", "y", "c", "z"), ("e", "v", "c", "z"), ("e", "v", "d", "w"), ("f", "u", "c", "z")]
    got = {(r.fn, r.param, r.annotation, r.kind) for r in resolution.type_flow(spark.createDataFrame(params, "fn string, param string, annotation string"), spark.createDataFrame(bound, "caller string, caller_param string, callee string, callee_param string")).collect()}
    assert got == {("a", "x", "int", "adopted"), ("b", "y", "int", "adopted"), ("e", "v", None, "ambiguous")}


def test_duplicate_ids_and_suites_without_place_are_errors(spark):
    with pytest.raises(Exception, match="duplicate test: a"):
        evidence.unique(spark.createDataFrame([("a",), ("b",), ("a",)], "test string"), "test").collect()
    assert evidence.unique(spark.createDataFrame([("a",), (None,), (None,)], "test string"), "test").count() == 3
    schema = "suite string, path string, qual string, line int, col int, end_line int, end_col int"
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    good = [("a", "p", "q", 1, 1, 9, 1), ("b", "p", "q.b", 2, 1, 3, 1)]
    assert {r.suite: r.depth for r in graphs.suite_order(spark.createDataFrame(good, schema), e).collect()} == {"a": 0, "b": 1}
    with pytest.raises(Exception, match="suite without place"):
        graphs.suite_order(spark.createDataFrame([*good, ("c", "p", None, 1, 1, 1, 1)], schema), e).collect()


def test_first_rows_of_a_hot_group(spark):
    df = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(600)], "k int, v int")
    got = {(r.k, r.v) for r in traces.tail(df, ["k"], "v", 2).collect()}
    want = {}
    for r in df.collect():
        want.setdefault(r.k, []).append(r.v)
    assert got == {(k, v) for k, vs in want.items() for v in sorted(vs)[-2:]}


@pytest.mark.parametrize(("guard", "env", "want"), [
    ("a and b", {"a": False}, False), ("a and b", {"a": True}, None), ("a or b", {"a": True}, True), ("a or b", {"a": False}, None), ("not a", {"a": 0}, True), ("-x < -1", {"x": 2}, True),
    ("1 < x <= 3", {"x": 3}, True), ("1 < x < y", {"x": 0}, False), ("1 < x < y", {"x": 2}, None), ("x == 'a'", {"x": "a"}, True), ("x < 'a'", {"x": 1}, None), ("f(x)", {"x": 1}, None),
    ("b'x'", {}, None), ("x.y", {"x": 1}, None), ("x in (1, 2)", {"x": 1}, None), ("broken (", {}, None), ("None", {}, False), ("x", {"x": None}, False),
])
def test_guards_in_three_values(guard, env, want):
    from ledgerloom.operators import guards

    assert guards.holds(guard, json.dumps(env)) is want
    assert guards.holds(None, None) is None
