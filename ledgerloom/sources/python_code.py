"""Python source trees as fact tables: functions, calls, parameter uses, decision surfaces, raises and tests.

Files are read whole by the binary file source and parsed with ast in Arrow batches; a file that doesn't parse gives one
parse_failure row. Facts come as one narrow relation and are split by kind.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FACT = "path string, kind string, qual string, name string, line int, end_line int, detail string"
#: Calls that mark evidence in a comment.
EVIDENCE_MARK = "evidence:"


class _Facts(ast.NodeVisitor):
    def __init__(self, path: str, source: str) -> None:
        self.path, self.rows, self.scope = path, [], []
        self.params: list[dict[str, list]] = []
        self.lines = source.splitlines()

    def add(self, kind: str, name: str, node: ast.AST, detail=None) -> None:
        self.rows.append((self.path, kind, ".".join(self.scope), name, getattr(node, "lineno", 0), getattr(node, "end_lineno", 0) or 0, None if detail is None else json.dumps(detail, sort_keys=True)))

    def _function(self, node) -> None:
        a = node.args
        names = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)]
        hints = {x.arg: ast.unparse(x.annotation) for x in (*a.posonlyargs, *a.args, *a.kwonlyargs) if x.annotation}
        self.add("function", node.name, node, {"params": names, "hints": hints, "star": bool(a.vararg), "star_kw": bool(a.kwarg)})
        if node.name.startswith("test"):
            above = self.lines[node.lineno - 2].strip() if node.lineno >= 2 else ""
            mark = above.partition(EVIDENCE_MARK)[2].strip() if above.startswith("#") else ""
            self.add("test", node.name, node, {"evidence": mark.split() if mark else []})
        for d in node.decorator_list:
            self.visit(d)
        self.scope.append(node.name)
        self.params.append({p: [] for p in names})
        for x in node.body:
            self.visit(x)
        used = self.params.pop()
        for p, uses in used.items():
            forwarded = sorted({u for u in uses if u})
            self.add("param_use", p, node, {"forward": forwarded, "non_forward": "" in uses, "unused": not uses})
        self.scope.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.add("class", node.name, node, {"bases": [ast.unparse(b) for b in node.bases], "fields": [x.target.id for x in node.body if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name)]})
        self.scope.append(node.name)
        self.generic_visit(node)
        self.scope.pop()

    def _import(self, node) -> None:
        module = getattr(node, "module", None) or ""
        for a in node.names:
            self.add("import", a.asname or a.name, node, {"module": module, "name": a.name})

    visit_Import = visit_ImportFrom = _import

    def visit_Call(self, node: ast.Call) -> None:
        callee = ast.unparse(node.func)
        const = lambda v: ast.unparse(v) if isinstance(v, ast.Constant) else None
        self.add("call", callee, node, {
            "pos": [[i, a.id if isinstance(a, ast.Name) else None, const(a)] for i, a in enumerate(node.args) if not isinstance(a, ast.Starred)],
            "kw": [[k.arg, k.value.id if isinstance(k.value, ast.Name) else None, const(k.value)] for k in node.keywords if k.arg],
            "star": any(isinstance(a, ast.Starred) for a in node.args), "star_kw": any(k.arg is None for k in node.keywords),
        })
        self.visit(node.func)
        for slot, value in [(f"arg[{i}]", a) for i, a in enumerate(node.args)] + [(f"kw[{k.arg}]", k.value) for k in node.keywords]:
            if isinstance(value, ast.Name) and self.params and value.id in self.params[-1]:
                self.params[-1][value.id].append(f"{callee}:{slot}")
            else:
                self.visit(value)

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load) and self.params and node.id in self.params[-1]:
            self.params[-1][node.id].append("")

    def _decision(self, node) -> None:
        names = sorted({n.id for n in ast.walk(node.test) if isinstance(n, ast.Name) and self.params and n.id in self.params[-1]})
        if names:
            self.add("decision", type(node).__name__.lower(), node, {"params": names})
        self.generic_visit(node)

    visit_If = visit_While = visit_Assert = visit_IfExp = _decision

    def visit_Raise(self, node: ast.Raise) -> None:
        self.add("raise", ast.unparse(node.exc.func if isinstance(node.exc, ast.Call) else node.exc) if node.exc else "", node)
        self.generic_visit(node)


def facts_of(path: str, source: str) -> list[tuple]:
    """All facts of one file, or one parse_failure."""
    try:
        v = _Facts(path, source)
        v.visit(ast.parse(source))
        return v.rows
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [(path, "parse_failure", "", type(e).__name__, 0, 0, None)]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
    for b in batches:
        rows = [r for p, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in facts_of(p, s or "")]
        cols = list(zip(*rows)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in FACT.split(", ")])


def scan(files: DataFrame) -> DataFrame:
    """Facts of (path, source) rows."""
    return files.select("path", "source").mapInArrow(_batches, FACT)


def read_tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, source) of the *.py files below root, without those in folders of the excluded names."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.py").option("recursiveFileLookup", "true").load(root)
    files = raw.select("path", F.col("content").cast("string").alias("source"))
    for name in exclude:
        files = files.where(~F.contains("path", F.lit(f"/{name}/")))
    return files


def constant_flow(facts: DataFrame) -> DataFrame:
    """callee, param, value, calls: parameters that every non-test call gives the same constant.

    Calls are resolved by name to functions whose name is unique; positions beyond the parameters and unknown keywords
    are left out, and a variable or starred argument rules a parameter out.
    """
    fn = facts.where("kind = 'function'").select("path", "name", F.from_json("detail", "params array<string>").alias("d"))
    unique = fn.groupBy("name").agg(F.count("*").alias("n"), F.first("d.params").alias("params"), F.first("path").alias("fpath")).where("n = 1")
    schema = "pos array<array<string>>, kw array<array<string>>, star boolean, star_kw boolean"
    calls = facts.where("kind = 'call'").where(~F.regexp_like("path", F.lit(r"(^|/)tests?/|(^|/)test_[^/]*\.py$"))).select(F.element_at(F.split("name", r"\."), -1).alias("name"), F.from_json("detail", schema).alias("d"))
    bound = calls.join(unique, "name")
    pos = bound.select("fpath", "name", "params", F.explode("d.pos").alias("a")).select("fpath", "name", F.get("params", F.col("a")[0].cast("int")).alias("param"), F.col("a")[1].alias("var"), F.col("a")[2].alias("const"))
    kw = bound.select("fpath", "name", "params", F.explode("d.kw").alias("a")).where(F.array_contains("params", F.col("a")[0])).select("fpath", "name", F.col("a")[0].alias("param"), F.col("a")[1].alias("var"), F.col("a")[2].alias("const"))
    g = pos.unionByName(kw).where("param is not null").groupBy(F.col("fpath").alias("path"), "name", "param").agg(F.min("const").alias("value"), F.max("const").alias("high"), F.max(F.col("const").isNull()).alias("varies"), F.count("*").alias("calls"))
    return g.where("not varies and value = high").select("path", F.col("name").alias("callee"), "param", "value", "calls")


def unused_arguments(facts: DataFrame) -> DataFrame:
    """caller path and qual, callee, param: variables passed to a parameter that its function never uses."""
    uses = facts.where("kind = 'param_use'").select("qual", "name", F.from_json("detail", "unused boolean").alias("d")).where("d.unused").select(F.element_at(F.split("qual", r"\."), -1).alias("callee"), F.col("name").alias("param"))
    fn = facts.where("kind = 'function'").select("name", F.from_json("detail", "params array<string>").alias("d")).groupBy("name").agg(F.count("*").alias("n"), F.first("d.params").alias("params")).where("n = 1")
    calls = facts.where("kind = 'call'").where(~F.regexp_like("path", F.lit(r"(^|/)tests?/|(^|/)test_[^/]*\.py$"))).select("path", "qual", F.element_at(F.split("name", r"\."), -1).alias("callee"), F.from_json("detail", "pos array<array<string>>, kw array<array<string>>").alias("d"))
    b = calls.join(fn.select(F.col("name").alias("callee"), "params"), "callee")
    pos = b.select("path", "qual", "callee", "params", F.explode("d.pos").alias("a")).where(F.col("a")[1].isNotNull()).select("path", "qual", "callee", F.get("params", F.col("a")[0].cast("int")).alias("param"))
    kw = b.select("path", "qual", "callee", F.explode("d.kw").alias("a")).where(F.col("a")[1].isNotNull()).select("path", "qual", "callee", F.col("a")[0].alias("param"))
    return pos.unionByName(kw).dropna(subset=["param"]).join(uses.distinct(), ["callee", "param"], "left_semi").distinct()


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _FactReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options.get("path", "")
        self.skip = {x for x in options.get("exclude", "").split(",") if x}

    def partitions(self):
        import os

        found = []
        for at, dirs, names in os.walk(self.root):
            dirs[:] = sorted(d for d in dirs if d not in self.skip)
            found += [os.path.join(at, n) for n in sorted(names) if n.endswith(".py")]
        return [_File(p) for p in found] or [_File("")]

    def read(self, partition: _File):
        if partition.path:
            with open(partition.path, encoding="utf-8", errors="replace") as f:
                yield from facts_of(partition.path, f.read())


class PythonFacts(DataSource):
    """spark.dataSource.register(PythonFacts); spark.read.format("python_facts").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "python_facts"

    def schema(self) -> str:
        return FACT

    def reader(self, schema) -> DataSourceReader:
        return _FactReader(dict(self.options))


#: Sources of facts by language and by file extension.
ADAPTERS = {"python": PythonFacts}
EXTENSIONS = {".py": "python"}


def adapter_for(language: str | None = None, path: str | None = None):
    """The data source of a language, or of a file's extension; None where there is none."""
    if language is None and path is not None:
        language = EXTENSIONS.get("." + path.rpartition(".")[2])
    return ADAPTERS.get((language or "").lower())
