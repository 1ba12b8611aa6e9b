import json

from pyspark.sql import functions as F

from ledgerloom.plans.registry import SPECS
from ledgerloom.session import new_path
from ledgerloom.sources import artifacts, python_code, text
from ledgerloom.streaming.ledger import LedgerState, file_stream, run_once, sessions

DIFF = """diff --git a/src/x.py b/src/x.py
--- a/src/x.py
+++ b/src/x.py
@@ -4,0 +5,2 @@
+a
+b
@@ -9 +12 @@ def f
+c
@@ -20,2 +22,0 @@
--- a/gone.py
+++ /dev/null
@@ -1,2 +0,0 @@
"""


def test_diffs(spark):
    lines = text.numbered_lines(spark.createDataFrame([(1, DIFF), (2, None)], "d int, t string"), "d", "t")
    assert {tuple(r) for r in text.diff_ranges(lines, "d").collect()} == {(1, "src/x.py", 5, 6), (1, "src/x.py", 12, 12)}
    assert {r.line for r in text.diff_lines(lines, "d").collect()} == {5, 6, 12}


def test_markdown(spark):
    md = "---\nrole: guide\nrequires: a b\n---\nintro\n# One\nx\n## Two\ny"
    df = spark.createDataFrame([(1, md)], "d int, t string")
    assert {tuple(r) for r in text.front_matter(df, "d", "t").collect()} == {(1, "role", "guide"), (1, "requires", "a b")}
    h = {r.line: (r.level, r.heading) for r in text.headings(text.numbered_lines(df, "d", "t"), "d").collect()}
    assert h["intro"] == (None, None) and h["x"] == (1, "One") and h["y"] == (2, "Two")


def test_lines(spark):
    df = spark.createDataFrame([("pkg/module.py:9:2: DF001 ambiguous bundle",), ("no lint",), (None,), ("a.py:pkg.fn decision surface params: a, b (boundary)",)], "t string")
    assert [(r.path, r.line, r.col, r.code, r.message) for r in text.lint_lines(df, "t").collect()] == [("pkg/module.py", 9, 2, "DF001", "ambiguous bundle")]
    assert [(r.qual, r.params, r.meta) for r in text.decision_lines(df, "t").collect()] == [("pkg.fn", ["a", "b"], "boundary")]
    s = spark.createDataFrame([(["a", "b"], 3), (["a", "b"], 0), ([], 5), (None, 5)], "frames array<string>, weight int")
    assert [tuple(r) for r in text.perf_samples(s).collect()] == [("a;b", 4)]


def test_json_files(spark, tmp_path):
    (tmp_path / "x.delta.jsonl").write_text('{"a": 1}\n\nnot json\n[1]\n{"a": 2, "b": 3}\n')
    assert [r.a for r in text.json_lines(spark, str(tmp_path / "x.delta.jsonl"), "a int").collect()] == [1, 2]
    embedded = spark.createDataFrame([(9,)], "a int")
    assert text.state_or_ledger(spark, str(tmp_path), "a int", embedded).count() == 2
    (tmp_path / "empty").mkdir()
    assert text.state_or_ledger(spark, str(tmp_path / "empty"), "a int", embedded).first().a == 9
    (tmp_path / "o.json").write_text("[1]")
    assert text.json_object(spark, str(tmp_path / "o.json")) == {}


SOURCE = '''
import os as o
def callee(a, b=1, *rest):
    if b:
        raise ValueError(b)
    return b
def caller(foo):
    callee(foo, 2)
    callee(foo, b=2)
# evidence: ev.one ev.two
def test_it():
    callee(5, 7)
'''


def test_python_sources(spark, tmp_path):
    files = spark.createDataFrame([("pkg/x.py", SOURCE), ("pkg/bad.py", "def ("), ("pkg/none.py", None)], "path string, source string")
    facts = python_code.scan(files)
    by = {}
    for r in facts.collect():
        by.setdefault(r.kind, []).append(r)
    assert {r.name for r in by["function"]} == {"callee", "caller", "test_it"} and len(by["parse_failure"]) == 1
    assert json.loads(by["test"][0].detail) == {"evidence": ["ev.one", "ev.two"]}
    assert [json.loads(r.detail)["params"] for r in by["decision"]] == [["b"]]
    assert by["raise"][0].name == "ValueError"
    assert {tuple(r) for r in python_code.constant_flow(facts.where("qual <> 'test_it'")).select("callee", "param", "value", "calls").collect()} == {("callee", "b", "2", 2)}
    assert {tuple(r) for r in python_code.unused_arguments(facts).select("qual", "callee", "param").collect()} == {("caller", "callee", "a")}
    (tmp_path / "skip").mkdir()
    (tmp_path / "a.py").write_text(SOURCE)
    (tmp_path / "skip" / "b.py").write_text(SOURCE)
    assert python_code.read_tree(spark, str(tmp_path), ("skip",)).count() == 1
    spark.dataSource.register(python_code.adapter_for(path="x.py"))
    assert spark.read.format("python_facts").option("exclude", "skip").load(str(tmp_path)).where("kind = 'function'").count() == 3
    assert python_code.adapter_for("cobol") is None


def test_artifacts(spark):
    df = spark.createDataFrame([("k", 1)], "key string, count int")
    root = new_path(spark, "baseline")
    artifacts.write_baseline(df, root, SPECS["ambiguity_baseline"])
    artifacts.write_baseline(df.withColumn("count", F.col("count") + 1), root, SPECS["ambiguity_baseline"])
    got = artifacts.read_baseline(spark, root).first()
    assert got["count"] == 2 and json.loads(got.generated_by_spec_id)["name"] == "ambiguity_baseline"
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert artifacts.dot(e).count("->") == 2 and artifacts.mermaid(e).count("-->") == 2
    assert "... 1 more edges" in artifacts.dot(e, 1) and "... 1 more edges" in artifacts.mermaid(e, 1) and "more" not in artifacts.dot(e)
    assert artifacts.report([("S", ["x"])], "T").endswith("## S\nx\n")
    archive = new_path(spark, "archive")
    artifacts.write_archive({"events": df}, archive)
    assert artifacts.read_archive(spark, archive, ["events"])["events"].count() == 1


def test_streams(spark, tmp_path):
    schema = "state_key string, seq bigint, dead boolean, val string"
    for i, rows in enumerate([[("a", 5, False, "x"), ("b", 1, False, "y")], [("a", 3, True, ""), ("b", 2, True, "")], [("b", 1, False, "z"), ("c", 1, False, None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{i}"))
    state = LedgerState(spark, ["state_key"])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
    state.follow(stream).awaitTermination()
    assert {tuple(r) for r in state.current().collect()} == {("a", 5, "x"), ("c", 1, "")}
    spark.sql("select timestamp_seconds(id * 600) ts, 'u' k from range(100) union all select timestamp_seconds(1000000), 'u'").coalesce(1).write.parquet(str(tmp_path / "ts"))
    s = file_stream(spark, str(tmp_path / "ts" / "*.parquet"), "ts timestamp, k string")
    assert [r.n for r in run_once(sessions(s, "ts", "1 hour", "1 day", ["k"]), "sessions").collect()] == [100]
