"""Schemas that drift between files: matched by similarity flooding, reported, and read into one table.

Each file's schema becomes a graph: nodes for the record, its objects, its fields and the value types; edges for
nesting and typing. Flooding starts from the likeness of names and of the values in records that both files hold, and
lets the score of two nodes flow to the pairs reached over edges of the same kind, until it settles. Lost and new
fields are then matched one to one in order of score; a match counts as a rename only if the values agree in all
shared records, which is checked for every pair, so no rename depends on a threshold. Where the values of several
fields agree, flooding says which is which, and its scores say which renames name the columns of the one table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.ordering import previous_in_group
from ledgerloom.operators.graphs import components
from ledgerloom.session import join_measured, stored

#: Flooding ends when no score changes by more than this. A pair keeps its own score besides what flows in, so rounds
#: converge; beyond so many something is wrong, and an error says so.
SETTLED, MAX_ROUNDS = 1e-3, 10_000
_ABSENT = object()


def read_records(body: str | None) -> list[dict]:
    """The objects in body: a JSON array of them, or one per line; unreadable lines and other values are left out."""
    if not body or not body.strip():
        return []
    try:
        whole = json.loads(body)
        return [r for r in (whole if isinstance(whole, list) else [whole]) if isinstance(r, dict)]
    except (ValueError, RecursionError):
        out = []
        for line in body.splitlines():
            try:
                r = json.loads(line)
            except (ValueError, RecursionError):
                continue
            if isinstance(r, dict):
                out.append(r)
        return out


def flatten(record: dict, prefix: str = "") -> dict:
    """Dotted paths to values that aren't objects."""
    out, todo = {}, [(prefix, record)]
    while todo:
        p, r = todo.pop()
        for k, v in r.items():
            if isinstance(v, dict):
                todo.append((f"{p}{k}.", v))
            else:
                out[p + k] = v
    return out


def type_of(v) -> str | None:
    return None if v is None else {bool: "boolean", int: "integer", float: "decimal number", str: "string", list: "array"}[type(v)]


def _text(v) -> str | None:
    return None if v is _ABSENT else json.dumps(v, sort_keys=True)


class Profile:
    """Fields, their types and the records by key of one file."""

    def __init__(self, body: str | None) -> None:
        self.fields: dict[str, set[str]] = {}
        self.records: dict[str, dict] = {}
        for r in map(flatten, read_records(body)):
            for f, v in r.items():
                t = type_of(v)
                self.fields.setdefault(f, set()).update({t} if t else ())
            if r.get("record_key") is not None:
                self.records.setdefault(_text(r["record_key"]), r)


def _grams(name: str) -> set[str]:
    s = f"^{''.join(x for x in name.lower() if x.isalnum())}$"
    return {s[i : i + 2] for i in range(len(s) - 1)}


def _graph(p: Profile) -> tuple[list[str], dict[str, np.ndarray]]:
    paths = sorted({".".join(f.split(".")[:i]) for f in p.fields for i in range(f.count(".") + 2)})
    types = sorted({t for ts in p.fields.values() for t in ts})
    names = paths + [f"<{t}>" for t in types]
    at = {n: i for i, n in enumerate(names)}
    child, typed = np.zeros((len(names), len(names))), np.zeros((len(names), len(names)))
    for n in paths:
        if n:
            child[at[n.rpartition(".")[0]], at[n]] = 1
        for t in p.fields.get(n, ()):
            typed[at[n], at[f"<{t}>"]] = 1
    return names, {"child": child, "typed": typed}


def flood(a: Profile, b: Profile, start: dict[tuple[str, str], float]) -> dict[tuple[str, str], float]:
    """Settled scores of all pairs of fields of a and b; start: evidence from values, added to that from names."""
    na, ga = _graph(a)
    nb, gb = _graph(b)
    grams = {n: _grams(n.rpartition(".")[2]) for n in {*na, *nb}}
    s0 = np.array([[float(x == y) if "<" in (x[:1], y[:1]) else 0.05 + len(grams[x] & grams[y]) / len(grams[x] | grams[y]) + start.get((x, y), 0.0) for y in nb] for x in na])
    share = lambda m, axis: m / np.maximum(m.sum(axis=axis, keepdims=True), 1)
    ways = []
    for kind in ga:
        ways.append((share(ga[kind], 1).T, share(gb[kind], 1)))
        ways.append((share(ga[kind].T, 1).T, share(gb[kind].T, 1)))
    s = s0 / s0.max()
    for _ in range(MAX_ROUNDS):
        base = s0 + s
        new = base + sum(x @ base @ y for x, y in ways)
        new /= new.max()
        done = np.abs(new - s).max() < SETTLED
        s = new
        if done:
            break
    else:
        raise RuntimeError("flooding did not settle")
    return {(x, y): s[i, j] for i, x in enumerate(na) if x in a.fields for j, y in enumerate(nb) if y in b.fields}


def _agreement(a: Profile, b: Profile, old: str, new: str, shared: list[str]) -> tuple[float, bool]:
    """Share of the shared records in which the values agree; whether all do, at least once not null."""
    same = [(x := _text(a.records[k].get(old, _ABSENT))) == _text(b.records[k].get(new, _ABSENT)) and (x not in (None, "null") or None) for k in shared]
    return sum(x is True for x in same) / max(len(shared), 1), any(x is True for x in same) and not any(x is False for x in same)


def changes_between(a: Profile, b: Profile) -> list[tuple[str, str]]:
    """(old field, new field) of every change from a to b; '' stands for none, equal names for a change of type."""
    return [(x, y) for x, y, _ in scored_changes(a, b)]


def scored_changes(a: Profile, b: Profile) -> list[tuple[str, str, float]]:
    """As changes_between, with the flooded score of renames (0 for other changes)."""
    lost, new = sorted(a.fields.keys() - b.fields.keys()), sorted(b.fields.keys() - a.fields.keys())
    out = [(f, f, 0.0) for f in sorted(a.fields.keys() & b.fields.keys()) if a.fields[f] and b.fields[f] and a.fields[f] != b.fields[f]]
    if lost and new:
        shared = sorted(a.records.keys() & b.records.keys())
        agree = {(x, y): _agreement(a, b, x, y, shared) for x in lost for y in new}
        may = [p for p, (_, whole) in agree.items() if whole]
        score = flood(a, b, {p: v for p, (v, _) in agree.items()}) if may else {}
        for x, y in sorted(may, key=lambda p: (-score[p], p)):
            if x in lost and y in new:
                out.append((x, y, float(score[x, y])))
                lost.remove(x)
                new.remove(y)
    return out + [(f, "", 0.0) for f in lost] + [("", f, 0.0) for f in new]


def _diff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, old, new, scores = [], [], [], []
        for fid, before, after in zip(*(c.to_pylist() for c in batch.columns)):
            for x, y, s in scored_changes(Profile(before), Profile(after)):
                ids.append(fid)
                old.append(x)
                new.append(y)
                scores.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(old, pa.string()), pa.array(new, pa.string()), pa.array(scores, pa.float64())], names=["file_id", "old_field", "new_field", "score"])


def _once(files: DataFrame) -> DataFrame:
    """family, producer, written_at, file_id of each file once, under its smallest id."""
    thin = files.select("family", "producer", "written_at", "file_id").dropna(subset=["written_at", "file_id"])
    return thin.groupBy("family", "producer", "written_at").agg(F.min("file_id").alias("file_id"))


def file_changes(files: DataFrame) -> DataFrame:
    """One row (file_id, old_field, new_field) per change between a file and the one before it of its family and producer.

    Files of one family, producer and written_at are one file, under the smallest id. Files without written_at or id
    have no place in the order and are left out; null families and producers are groups of their own; a body without
    records has no fields. Bodies are fetched by file id, so a producer with a third of all files isn't one group.
    """
    return scored_file_changes(files).drop("score")


def scored_file_changes(files: DataFrame) -> DataFrame:
    """As file_changes, with the flooded score of renames."""
    pairs = previous_in_group(_once(files), ["family", "producer"], "written_at", "file_id", F.to_date("written_at"), "before_id").where("before_id is not null")
    pairs = stored(pairs.select("file_id", "before_id"), "pairs")
    bodies = files.select(F.col("file_id").alias("id"), "body").dropna(subset=["id"])
    got = pairs.join(bodies.withColumnsRenamed({"id": "before_id", "body": "before"}), "before_id").join(bodies.withColumnsRenamed({"id": "file_id", "body": "after"}), "file_id")
    return got.select("file_id", "before", "after").mapInArrow(_diff, "file_id bigint, old_field string, new_field string, score double")


def _merge_names(table: pd.DataFrame) -> pd.DataFrame:
    """Names of one component of renames (kind e: x renamed y, weight; c: x and y in one file; u: x in weight files),
    each with the name that stands for it."""
    kinds = dict(list(table.groupby("kind")))
    pairs = lambda k: list(zip(kinds[k]["x"], kinds[k]["y"])) if k in kinds else []
    together = {p for x, y in pairs("c") for p in ((x, y), (y, x))}
    use = dict(zip(kinds["u"]["x"], kinds["u"]["weight"])) if "u" in kinds else {}
    group = {n: {n} for p in pairs("e") for n in p}
    for _, x, y in sorted((-w, x, y) for x, y, w in kinds["e"][["x", "y", "weight"]].itertuples(index=False)):
        a, b = group[x], group[y]
        if a is not b and not any((p, q) in together for p in a for q in b):
            a |= b
            for n in b:
                group[n] = a
    rows = [(n, min(g, key=lambda m: (-use.get(m, 0), m))) for n, g in group.items()]
    return pd.DataFrame({"family": table["family"].iloc[0], "field": [n for n, _ in rows], "canonical": [c for _, c in rows]})


def canonical_names(records: DataFrame, changes: DataFrame) -> DataFrame:
    """family, field, canonical of all fields that renames connect: the name of its group in most files, then the first.

    records: family, file_id, field. changes: family, old_field, new_field, score. Renames join names into groups, those
    of the greatest sum of flooded scores first, unless two names of the group occur in one file, for then they are
    different fields. Names that no chain of renames connects are never compared: each component is decided alone, and
    what comes together there is names, never records.
    """
    key = lambda c: F.concat_ws("\u0001", "family", c)
    renames = changes.where("old_field <> '' and new_field <> '' and old_field <> new_field and family is not null")
    edges = stored(renames.groupBy("family", F.col("old_field").alias("x"), F.col("new_field").alias("y")).agg(F.sum("score").alias("weight")), "renames")
    parts = components(edges.select(key("x").alias("src"), key("y").alias("dst")))
    parts = stored(parts.select(F.substring_index("node", "\u0001", 1).alias("family"), F.expr("substring(node, instr(node, '\u0001') + 1)").alias("field"), "component"), "components")
    held = stored(join_measured(records.select("family", "file_id", "field").distinct(), parts, ["family", "field"]), "held")
    a, b = held.select("component", "family", "file_id", F.col("field").alias("x")), held.select("component", "file_id", F.col("field").alias("y"))
    both = a.join(b, ["component", "file_id"]).where("x < y").select("component", "family", "x", "y").distinct()  # names of one file in one component
    none = F.lit(None).cast("string")
    rows = edges.join(parts.withColumnRenamed("field", "x"), ["family", "x"]).select("component", "family", F.lit("e").alias("kind"), "x", "y", "weight")
    rows = rows.unionByName(both.select("component", "family", F.lit("c").alias("kind"), "x", "y", F.lit(0.0).alias("weight")))
    rows = rows.unionByName(held.groupBy("component", "family", F.col("field").alias("x")).agg(F.count("*").cast("double").alias("weight")).select("component", "family", F.lit("u").alias("kind"), "x", none.alias("y"), "weight"))
    return rows.groupBy("component").applyInPandas(lambda t: _merge_names(t), "family string, field string, canonical string")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(family, file_id, body) to one row per record and field."""
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        for family, fid, body in zip(*(c.to_pylist() for c in batch.columns)):
            for no, r in enumerate(map(flatten, read_records(body))):
                for f, v in r.items():
                    for c, x in zip(cols, (family, fid, no, f, type_of(v), v if isinstance(v, str) or v is None else json.dumps(v))):
                        c.append(x)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["family", "file_id", "record_no", "field", "value_type", "value"])


def unified(files: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """All records of all files in one shape: family, file_id, record_no, field (canonical), value_type, value (text).

    Each file counts once, whatever its deliveries; files without written_at or id are left out, as in file_changes. The
    type of a field is the narrowest that holds all its values in the family: integers and decimal numbers join to
    decimal number, other mixtures and integers beyond 64 bits to string; arrays stay JSON text. changes: the rows of
    scored_file_changes, made here if None; without scores every rename weighs the same.
    """
    once = stored(_once(files).select("file_id", F.col("family").alias("f")), "files")
    bodies = files.select("family", "file_id", "body").join(once, "file_id").where("family <=> f").dropDuplicates(["file_id"])
    long = stored(bodies.select("family", "file_id", "body").mapInArrow(_rows, "family string, file_id bigint, record_no bigint, field string, value_type string, value string"), "records")
    changes = scored_file_changes(files) if changes is None else changes
    if "score" not in changes.columns:
        changes = changes.withColumn("score", F.lit(1.0))
    names = canonical_names(long, changes.join(once, "file_id").withColumnRenamed("f", "family"))
    long = join_measured(long, names, ["family", "field"], "left").withColumn("field", F.coalesce("canonical", "field"))
    wide = F.when(F.size("t") == 0, "string").when(F.size("t") == 1, F.when((F.col("t")[0] == "integer") & ~F.col("fits"), "string").otherwise(F.col("t")[0])).when(F.size(F.array_except("t", F.array(F.lit("integer"), F.lit("decimal number")))) == 0, "decimal number").otherwise("string")
    fits = F.bool_and((F.col("value_type") != "integer") | F.col("value").try_cast("bigint").isNotNull())
    kinds = long.groupBy("family", "field").agg(F.collect_set("value_type").alias("t"), F.coalesce(fits, F.lit(True)).alias("fits")).select("family", "field", wide.alias("value_type"))
    a, b = long.alias("a"), kinds.alias("b")
    return a.join(b, F.col("a.family").eqNullSafe(F.col("b.family")) & (F.col("a.field") == F.col("b.field"))).select("a.family", "file_id", "record_no", "a.field", "b.value_type", "value")


def wide_table(long: DataFrame, family: str) -> DataFrame:
    """One row per record of a family, one typed column per canonical field (dots become underscores)."""
    of = long.where(F.col("family") == family)
    sql = {"integer": "bigint", "decimal number": "double", "boolean": "boolean"}
    fields = {r.field: sql.get(r.value_type, "string") for r in of.select("field", "value_type").distinct().collect()}
    packed = of.groupBy("file_id", "record_no").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("m"))
    return packed.select("file_id", "record_no", *(F.col("m")[f].try_cast(t).alias(f.replace(".", "_")) for f, t in sorted(fields.items())))
