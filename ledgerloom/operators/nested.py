"""Nested records to flat node tables linked by depth-first interval labels.

Every JSON node of a record gets a pre-order and a post-order number from one depth-first traversal. A node contains
another exactly if its pre is smaller and its post larger, so tables of nodes need no foreign keys: a child finds its
ancestor of any type by interval containment within the record.

Paths of node types are written as segments joined by '/':
  name        the member of that name            a|b       either member; the node's label tells which
  name[]      each entry of the list: an array as it is, null as empty, a lone value as an array of one
  name[!]     each entry, arrays only            name{key} a collection by name: an object's members, or an array of
                                                          objects that hold their name in `key`
The empty path is the record itself. All paths have a fixed number of segments, hence nodes of one type never contain
each other, and the nearest node of a type before a child in pre-order is the only one that can contain it: links need
one window over each record in pre-order, no pairs.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import read_object, scalar_text
from ledgerloom.session import stored

NODE_SCHEMA = "record_id bigint, node_type string, pre bigint, post bigint, depth int, kind string, label string, idx bigint, value string"
#: Rows of an output batch.
BATCH = 20_000


@dataclass(frozen=True)
class NodeType:
    """name: of the type. path: where its nodes are. field: the member that is an object node's value, empty for none.
    carrier: emitted only if a node of a type that isn't a carrier lies within it."""

    name: str
    path: str
    field: str = ""
    carrier: bool = False


class _State:
    __slots__ = ("members", "entries", "arrays", "named", "types")

    def __init__(self) -> None:
        self.members: dict[str, _State] = {}
        self.entries: _State | None = None
        self.arrays: _State | None = None
        self.named: dict[str, _State] = {}
        self.types: list[int] = []


def _compile(types: list[NodeType]) -> _State:
    root = _State()
    for n, t in enumerate(types):
        at = [root]
        for segment in filter(None, t.path.split("/")):
            names, mark = re.fullmatch(r"([^\[\]{}]+)(\[\]|\[!\]|\{[^}]+\})?", segment).groups()
            at = [s.members.setdefault(x, _State()) for s in at for x in names.split("|")]
            if mark == "[]":
                for s in at:
                    s.entries = s.entries or _State()
                at = [s.entries for s in at]
            elif mark == "[!]":
                for s in at:
                    s.arrays = s.arrays or _State()
                at = [s.arrays for s in at]
            elif mark:
                at = [s.named.setdefault(mark[1:-1], _State()) for s in at]
        for s in at:
            s.types.append(n)
    return root


class Labeller:
    """Depth-first traversal of one record at a time; rows of its typed nodes come in pre-order."""

    def __init__(self, types: list[NodeType], all_nodes: bool = False, bare: bool = False) -> None:
        self.types, self.root, self.all, self.bare = types, _compile(types), all_nodes, bare
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 60_000))

    def rows(self, record: dict) -> list[list]:
        self.pre = self.post = 0
        self.out: list[list] = []
        self._visit(record, [(self.root, "", 0)], 0, "", 0)
        if self.bare:
            return self.out
        types = self.types
        keep, reach = [False] * len(self.out), []
        for i, row in enumerate(self.out):
            while reach and self.out[reach[-1]][2] < row[2]:
                reach.pop()
            if row[0] < 0 or not types[row[0]].carrier:
                keep[i] = True
                while reach and not keep[reach[-1]]:
                    keep[reach.pop()] = True
            else:
                reach.append(i)
        return [r for r, k in zip(self.out, keep) if k]

    def _visit(self, node, states: list, depth: int, label: str, idx: int) -> None:
        pre = self.pre
        self.pre += 1
        mine = []
        i = 0
        while i < len(states):  # a lone value also is the only entry of its own list
            s, name, at = states[i]
            if s.entries is not None and not isinstance(node, list) and node is not None:
                states.append((s.entries, name, 0))
            for n in s.types:
                f = self.types[n].field
                is_object = isinstance(node, dict)
                value = scalar_text(node.get(f)) if is_object and f else None if is_object or isinstance(node, list) else scalar_text(node)
                row = [n, pre, 0, depth, _kind(node), name, at, value]
                mine.append(row)
                self.out.append(row)
            i += 1
        if self.all and not mine:
            row = [-1, pre, 0, depth, _kind(node), label, idx, None if isinstance(node, (dict, list)) else scalar_text(node)]
            mine.append(row)
            self.out.append(row)
        if isinstance(node, dict):
            for k, v in node.items():
                below = [(s.members[k], k, 0) for s, _, _ in states if k in s.members]
                below += [(s, k, 0) for t, _, _ in states for s in t.named.values()]
                if below or self.all:
                    self._visit(v, below, depth + 1, k, 0)
                else:
                    self._skip(v)
        elif isinstance(node, list):
            for at, v in enumerate(node):
                below = []
                for s, name, _ in states:
                    below += [(x, name, at) for x in (s.entries, s.arrays) if x is not None]
                    if s.named and isinstance(v, dict):
                        below += [(x, scalar_text(v.get(f)), at) for f, x in s.named.items()]
                if below or self.all:
                    self._visit(v, below, depth + 1, label, at)
                else:
                    self._skip(v)
        for row in mine:
            row[2] = self.post
        self.post += 1

    def _skip(self, node) -> None:
        """Numbers a subtree without typed nodes."""
        self.pre += 1
        if isinstance(node, dict):
            for v in node.values():
                self._skip(v)
        elif isinstance(node, list):
            for v in node:
                self._skip(v)
        self.post += 1


def _kind(node) -> str:
    return {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}[type(node)]


def label_nodes(df: DataFrame, record_id: str, json_col: str, types: list[NodeType], all_nodes: bool = False, bare: bool = False) -> DataFrame:
    """One row per typed node of every readable record, with interval labels (NODE_SCHEMA).

    Unreadable and null records yield no rows; equal record ids are the caller's to avoid. all_nodes also emits the
    nodes of no type, under the type ''; bare also emits the carriers that nothing lies within. Other columns of df are
    ignored. No shuffle.
    """
    names = [t.name for t in types] + [""]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(types, all_nodes, bare)
        schema = pa.schema([("record_id", pa.int64()), ("node_type", pa.string()), ("pre", pa.int64()), ("post", pa.int64()), ("depth", pa.int32()), ("kind", pa.string()), ("label", pa.string()), ("idx", pa.int64()), ("value", pa.string())])
        out: list[list] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            columns[1] = [names[n] for n in columns[1]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                record = read_object(text)
                if record is not None:
                    out.extend([rid, *row] for row in labeller.rows(record))
                if len(out) >= BATCH:
                    yield flush()
                    out = []
        if out:
            yield flush()

    picked = df.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(json_col).alias("json"))
    return picked.where("json is not null and record_id is not null").mapInArrow(run, NODE_SCHEMA)


def link(nodes: DataFrame, ancestors: list[str]) -> DataFrame:
    """nodes with a column for each ancestor type: the node of that type that contains it, as a struct, or null.

    One shuffle by record and one window in pre-order: the last node of the type seen so far contains the node if its
    post-order number is larger; nodes of one type never nest (see the module's notes).
    """
    w = Window.partitionBy("record_id").orderBy("pre", F.col("post").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = nodes
    for a in ancestors:
        seen = F.last(F.when(F.col("node_type") == a, F.struct("pre", "post", "label", "idx", "value")), ignorenulls=True).over(w)
        out = out.withColumn(f"in_{a}", seen)
    for a in ancestors:
        c = F.col(f"in_{a}")
        out = out.withColumn(f"in_{a}", F.when((c["pre"] <= F.col("pre")) & (c["post"] >= F.col("post")), c))
    return out


#: Node types of artifact documents and of message payloads.
ARTIFACT_TYPES = [
    NodeType("scenario", "boundary_asymmetry_scenario[]", carrier=True),
    NodeType("side", "boundary_asymmetry_scenario[]/left|right", carrier=True),
    NodeType("step", "boundary_asymmetry_scenario[]/left|right/basis_path[]", field="key"),
    NodeType("case", "cases[]", field="case_id", carrier=True),
    NodeType("dimension", "cases[]/dimensions{name}", carrier=True),
    NodeType("mask", "cases[]/dimensions{name}/mask"),
]
PAYLOAD_TYPES = [
    NodeType("payload", "", field="key", carrier=True),
    NodeType("site", "value/sites[]", field="path"),
    NodeType("site", "value[!]", field="path"),
    NodeType("param", "value/sites[]/params[]"),
    NodeType("param", "value[!]/params[]"),
]


def child_items(artifacts: DataFrame, envelopes: DataFrame) -> DataFrame:
    """Child items of artifacts and payloads: record_id, entity, parent_key, item_index, item.

    Steps and masks that are null give no row; sites must be objects; a null param gives a row with a null item; a
    missing case id, dimension name or key reads as ''.
    """
    a = link(label_nodes(artifacts, "record_id", "artifact_json", ARTIFACT_TYPES), ["scenario", "side", "case", "dimension"])
    text = lambda c: F.coalesce(c, F.lit(""))
    a = a.where("node_type in ('step', 'mask') and value is not null").select(
        "record_id",
        F.when(F.col("node_type") == "step", "basis_step").otherwise("mask").alias("entity"),
        F.when(F.col("node_type") == "step", F.concat_ws("/", F.col("in_scenario.idx").cast("string"), F.col("in_side.label")))
        .otherwise(F.concat_ws("/", text(F.col("in_case.value")), text(F.col("in_dimension.label")))).alias("parent_key"),
        F.when(F.col("node_type") == "step", F.col("idx")).otherwise(F.col("in_case.idx")).alias("item_index"),
        F.col("value").alias("item"),
    )
    p = link(label_nodes(envelopes, "delivery_id", "payload_json", PAYLOAD_TYPES), ["payload", "site"])
    p = p.where("(node_type = 'site' and kind = 'object') or (node_type = 'param' and in_site is not null)").select(
        "record_id",
        F.when(F.col("node_type") == "site", "site").otherwise("site_param").alias("entity"),
        F.when(F.col("node_type") == "site", text(F.col("in_payload.value"))).otherwise(F.col("in_site.idx").cast("string")).alias("parent_key"),
        F.col("idx").alias("item_index"),
        F.col("value").alias("item"),
    )
    return a.unionByName(p)


def node_tables(nodes: DataFrame, types: list[NodeType]) -> dict[str, DataFrame]:
    """A table per node type, with its parent's type and label: record_id, pre, post, depth, kind, label, idx, value,
    parent_type, parent_pre.

    The parent is the innermost node of another type that contains the node, carrier or not; of several types that one
    node has, each is within those before it in types. Nodes are written once, a folder per type, so a type's table
    reads its own rows only.
    """
    names = list(dict.fromkeys(t.name for t in types))
    linked = link(nodes, names)
    around = []
    for n, c in enumerate(names):
        pre = F.col(f"in_{c}.pre")
        within = (pre < F.col("pre")) | ((pre == F.col("pre")) & F.col("node_type").isin(names[n + 1 :]))
        around.append(F.when(within, F.struct(pre.alias("pre"), F.lit(n).alias("n"), F.lit(c).alias("t"))))
    flat = linked.select("node_type", "record_id", "pre", "post", "depth", "kind", "label", "idx", "value", F.array_max(F.array(*around)).alias("p"))
    kept = stored(flat.select("node_type", "record_id", "pre", "post", "depth", "kind", "label", "idx", "value", F.col("p.t").alias("parent_type"), F.col("p.pre").alias("parent_pre")), "nodes", ("node_type",))
    return {n: kept.where(F.col("node_type") == n).drop("node_type") for n in names}


def all_tables(artifacts: DataFrame, envelopes: DataFrame) -> DataFrame:
    """The node tables of artifacts and of payloads, one after the other: source, node_type and node_tables' columns.

    source names the input, as ids of artifacts and of deliveries are apart. Every node of a type has a row, also one
    with nothing in it or with the value null; sites must be objects. A payload's value is its key, and null without one.
    """
    out = []
    for source, df, key, text, types in (("aspf_artifacts", artifacts, "record_id", "artifact_json", ARTIFACT_TYPES), ("event_envelopes", envelopes, "delivery_id", "payload_json", PAYLOAD_TYPES)):
        nodes = label_nodes(df, key, text, types, bare=True).where("node_type <> 'site' or kind = 'object'")
        out += [t.select(F.lit(source).alias("source"), F.lit(n).alias("node_type"), *t.columns) for n, t in node_tables(nodes, types).items()]
    return reduce(DataFrame.unionByName, out)
