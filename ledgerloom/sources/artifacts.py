"""Artifacts as files: baselines tagged with the spec that made them, ledgers' archives, reports and diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.spec import Spec, identity
from ledgerloom.session import publish, published


def write_baseline(df: DataFrame, root: str, spec: Spec) -> str:
    """A new version of a baseline, tagged with its spec's identity, made current in one step."""
    return publish(df.withColumn("generated_by_spec_id", F.lit(identity(spec))), root)


def read_baseline(spark: SparkSession, root: str) -> DataFrame:
    return published(spark, root)


def write_archive(tables: dict[str, DataFrame], root: str) -> None:
    """Event, snapshot and commit tables of a ledger, each below its own name."""
    for name, df in tables.items():
        publish(df, f"{root}/{name}")


def read_archive(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: published(spark, f"{root}/{n}") for n in names}


def event_sink(events: DataFrame, root: str) -> DataFrame:
    """Events partitioned by kind as JSON, and their manifest: kind, n."""
    events.write.partitionBy("kind").mode("append").json(root)
    return events.groupBy("kind").agg(F.count("*").alias("n"))


def report(sections: list[tuple[str, list[str]]], title: str, spec: Spec | None = None) -> str:
    """Markdown text of ordered sections, with the spec's identity in front."""
    out = [f"<!-- spec: {identity(spec)} -->"] if spec else []
    out.append(f"# {title}")
    for name, lines in sections:
        out += ["", f"## {name}", *lines]
    return "\n".join(out) + "\n"


def _edges(edges: DataFrame, limit: int) -> tuple[list, int]:
    """The first edges by name, and how many more there are."""
    every = edges.select("src", "dst").dropna().distinct()
    return every.orderBy("src", "dst").limit(limit).collect(), max(0, every.count() - limit)


def dot(edges: DataFrame, limit: int = 2000) -> str:
    """Graphviz text of the first edges by name; a comment says how many are left out of the picture."""
    rows, more = _edges(edges, limit)
    rest = [f"  // ... {more} more edges\n"] if more else []
    return "digraph {\n" + "".join([*(f'  "{r.src}" -> "{r.dst}";\n' for r in rows), *rest]) + "}\n"


def mermaid(edges: DataFrame, limit: int = 2000) -> str:
    """Mermaid text of the first edges by name; a comment says how many are left out of the picture."""
    rows, more = _edges(edges, limit)
    names = {n: f"n{i}" for i, n in enumerate(sorted({x for r in rows for x in (r.src, r.dst)}))}
    rest = f"  %% ... {more} more edges\n" if more else ""
    return "graph TD\n" + "".join(f'  {i}["{n}"]\n' for n, i in names.items()) + "".join(f"  {names[r.src]} --> {names[r.dst]}\n" for r in rows) + rest
