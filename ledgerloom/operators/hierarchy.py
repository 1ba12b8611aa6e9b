"""Parent-child links to full hierarchies by tree contraction.

Every round rakes all leaves into their parents and splices out an independent set of unary chain nodes (those whose
hash of the round exceeds that of parent and child), so long chains and wide trees both shrink by a constant factor and
the rounds grow with the logarithm of the size. Removed nodes are kept with what is needed to put them back; undoing the
rounds in reverse gives root, depth, path and number of descendants. A cycle never loses its last node: it contracts to
a node that is its own parent, which is how cycles show. Every round is one written table in the shared folder; when few
nodes are left linked, one task rakes them leaf by leaf and undoes that in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import reference, tidy
from ledgerloom.session import stored, stored_with

#: Far beyond what any input needs; the rounds grow as the logarithm of the number of nodes.
MAX_ROUNDS = 400
#: Nodes still linked that one task may finish; counted in every round. Beyond it all rounds are distributed.
LOCAL_NODES = 20_000
_RESOLVED = ["h", "id", "cls", "root", "depth", "total"]


def _rake_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of a contraction, raked leaf by leaf and undone in reverse: h, id, cls, root, depth, total, path.

    Rows are those of _contract's live. Nodes that no raking reaches are on cycles.
    """
    rows = {(r["h"], r["id"]): r for b in batches for r in b.to_pylist()}
    kids = dict.fromkeys(rows, 0)
    total = {k: r["own"] for k, r in rows.items()}
    up = {k: (k[0], r["parent"]) if r["parent"] is not None else None for k, r in rows.items()}
    for k, p in up.items():
        if p is not None:
            kids[p] += 1
    raked = [k for k in rows if not kids[k]]
    for k in raked:  # grows while it is read
        p = up[k]
        if p is not None:
            total[p] += total[k] + rows[k]["extra"]
            kids[p] -= 1
            if not kids[p]:
                raked.append(p)
    known: dict[tuple, tuple] = {}
    for k in rows:
        if kids[k] and k not in known:
            ring, at = [], k
            while not ring or at != k:
                ring.append(at)
                at = up[at]
            names = [x for m in ring for x in (m[1], rows[m]["low"]) if x is not None]
            size = sum(total[m] + rows[m]["extra"] for m in ring)
            for m in ring:
                known[m] = ("cycle", min(names), 0, size, [m[1]])
    for k in reversed(raked):
        p = up[k]
        if p is None:
            known[k] = ("tree", k[1], 0, total[k], [k[1]])
        else:
            cls, root, depth, _, path = known[p]
            known[k] = ("tree" if cls == "tree" else "below_cycle", root, depth + rows[k]["w"], total[k], [*path, *rows[k].get("seg", ()), k[1]])
    out = [(*k, *v) for k, v in known.items()]
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()))
    for i in range(0, len(out), 5000):
        cols = list(zip(*out[i : i + 5000]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[*_RESOLVED, "path"])


def _contract(live: DataFrame, paths: bool) -> tuple[list[tuple[DataFrame, dict]], DataFrame]:
    """Each round's table and how many of its nodes are leaves, spliced, and still linked to another; and what resolves
    the nodes that the last round left.

    live: h, id, parent, kids (children left), w (links to the parent), own (nodes raked into it, itself included), extra
    and low (number and smallest name of the nodes spliced out of its link), seg (their names) if paths.
    """
    rounds = []
    for r in range(MAX_ROUNDS):
        a = live.withColumn("leaf", (F.col("kids") == 0) & F.col("parent").isNotNull()).drop("kids")
        under = a.where("parent is not null").groupBy("h", F.col("parent").alias("id")).agg(
            F.sum(F.when(F.col("leaf"), F.col("own") + F.col("extra"))).alias("gain"),
            F.count(F.when(~F.col("leaf"), 1)).alias("kids"),
            F.min(F.when(~F.col("leaf"), F.col("id"))).alias("child"),
            F.sum(F.when(~F.col("leaf"), F.col("extra"))).alias("child_extra"),
        )
        rank = lambda c: F.xxhash64(F.lit(r), F.col("h"), F.col(c))  # noqa: B023, E731
        chain = (F.col("kids") == 1) & (F.col("parent") != F.col("id")) & (rank("id") > rank("parent")) & (rank("id") > rank("child"))
        b = a.join(under, ["h", "id"], "left").withColumn("own", F.col("own") + F.coalesce("gain", F.lit(0)))
        b = b.withColumn("spliced", F.coalesce(chain, F.lit(False)) & ~F.col("leaf")).drop("gain").withColumn("kids", F.coalesce("kids", F.lit(0)))
        yes = lambda c: F.count(F.when(c, 1))
        b, n = stored_with(b, f"round{r}", leaf=yes(F.col("leaf")), spliced=yes(F.col("spliced")), linked=yes(~F.col("leaf") & ~F.col("spliced") & (F.col("parent") != F.col("id"))))
        rounds.append((b, n))
        looped = F.col("parent").isNotNull()
        if not n["linked"]:
            last = b.where("not leaf and not spliced")
            root = F.when(looped, F.least("id", "low")).otherwise(F.col("id"))
            return rounds, last.select("h", "id", F.when(looped, "cycle").otherwise("tree").alias("cls"), root.alias("root"), F.lit(0).cast("bigint").alias("depth"), (F.col("own") + F.col("extra")).alias("total"), *([F.array("id").alias("path")] if paths else []))
        stay = b.where("not leaf and not spliced")
        over = b.where("spliced").select("h", F.col("child").alias("id"), F.col("id").alias("via"), F.col("parent").alias("up"), F.col("w").alias("up_w"), (F.col("own") + F.col("extra")).alias("up_extra"), F.col("low").alias("up_low"), *([F.col("seg").alias("up_seg")] if paths else []))
        joined = stay.join(over, ["h", "id"], "left")
        hit = F.col("via").isNotNull()
        live = joined.select(
            "h", "id", "kids", F.coalesce("up", "parent").alias("parent"), (F.col("w") + F.coalesce("up_w", F.lit(0))).alias("w"), "own", (F.col("extra") + F.coalesce("up_extra", F.lit(0))).alias("extra"),
            F.least("low", "via", "up_low").alias("low"), *([F.when(hit, F.concat("up_seg", F.array("via"), "seg")).otherwise(F.col("seg")).alias("seg")] if paths else []),
        )
        if n["linked"] <= LOCAL_NODES:
            linked = F.col("parent").isNotNull() | (F.col("kids") > 0)
            kept = stored(live, "core")
            core = kept.where(linked).repartition(1).mapInArrow(_rake_alone, "h string, id string, cls string, root string, depth bigint, total bigint, path array<string>")
            alone = kept.where(~linked).select("h", "id", F.lit("tree").alias("cls"), F.col("id").alias("root"), F.lit(0).cast("bigint").alias("depth"), F.col("own").alias("total"), F.array("id").alias("path"))
            both = core.unionByName(alone)
            return rounds, both if paths else both.drop("path")
    raise RuntimeError("contraction did not end")


def hierarchies(edges: DataFrame, nodes: DataFrame | None = None, paths: bool = False) -> DataFrame:
    """hierarchy, node_name, node_class, root_node, node_depth, descendants, and path (array of names) if paths.

    edges: hierarchy, child, parent. nodes: hierarchy, name of further nodes. node_class is 'tree', 'cycle' (root_node
    the smallest name on it, depth 0) or 'below_cycle' (root_node that of the cycle reached upwards, depth and path from
    its first node on the cycle). Of several parents of a node the smallest name counts, repeated links count once, an
    edge with a null end only names its other end. A table without edges gives its nodes as roots.
    """
    e = edges.select(F.col("hierarchy").alias("h"), F.col("child"), F.col("parent"))
    names = e.select("h", F.explode(F.array("child", "parent")).alias("id"))
    if nodes is not None:
        names = names.unionByName(nodes.select(F.col("hierarchy").alias("h"), F.col("name").alias("id")))
    up = e.dropna().select("h", F.col("child").alias("id"), "parent")
    start = names.select("h", "id", F.lit(None).cast("string").alias("parent")).unionByName(up).dropna(subset=["h", "id"])
    start = stored(start.groupBy("h", "id").agg(F.min("parent").alias("parent")), "start")
    kids = start.where("parent is not null").groupBy("h", F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    live = start.join(kids, ["h", "id"], "left").select("h", "id", "parent", F.coalesce("kids", F.lit(0)).alias("kids"), F.lit(1).cast("bigint").alias("w"), F.lit(1).cast("bigint").alias("own"), F.lit(0).cast("bigint").alias("extra"), F.lit(None).cast("string").alias("low"), *([F.array().cast("array<string>").alias("seg")] if paths else []))
    rounds, core = _contract(stored(live, "live"), paths)
    done = stored(core, "resolved")
    for b, n in reversed(rounds):
        at = lambda df, key, mark, cols: df.select("h", F.col("id").alias(key), *(F.col(c).alias(mark + c) for c in cols))
        known = ["cls", "root", "depth", *(["path"] if paths else [])]
        full = lambda: [F.concat("p_path", "seg", F.array("id")).alias("path")] if paths else []  # noqa: B023, E731
        off_cycle = F.when(F.col("p_cls") == "tree", "tree").otherwise("below_cycle")
        s = b.where("spliced").join(at(done, "parent", "p_", known), ["h", "parent"]).join(at(done, "child", "c_", ["cls", "total"]), ["h", "child"])
        on = F.col("c_cls") == "cycle"
        s = s.select(
            "h", "id", F.when(on, "cycle").otherwise(off_cycle).alias("cls"), F.col("p_root").alias("root"), F.when(on, 0).otherwise(F.col("p_depth") + F.col("w")).cast("bigint").alias("depth"),
            F.when(on, F.col("c_total")).otherwise(F.col("own") + F.col("child_extra") + F.col("c_total")).alias("total"), *([F.when(on, F.array("id")).otherwise(full()[0]).alias("path")] if paths else []),
        )
        above = done.unionByName(s) if n["spliced"] else done
        k = b.where("leaf").join(at(above, "parent", "p_", known), ["h", "parent"])
        k = k.select("h", "id", off_cycle.alias("cls"), F.col("p_root").alias("root"), (F.col("p_depth") + F.col("w")).alias("depth"), F.col("own").alias("total"), *full())
        done = stored(above.unionByName(k), "resolved") if n["leaf"] else stored(above, "resolved") if n["spliced"] else done
    return done.select(F.col("h").alias("hierarchy"), F.col("id").alias("node_name"), F.col("cls").alias("node_class"), F.col("root").alias("root_node"), F.col("depth").alias("node_depth"), (F.col("total") - 1).alias("descendants"), *(["path"] if paths else []))


def descendant_pairs(resolved: DataFrame) -> DataFrame:
    """hierarchy, node_name, descendant, distance for every node of a tree or below a cycle; resolved must have paths."""
    e = resolved.where("node_class <> 'cycle'").select("hierarchy", F.col("node_name").alias("descendant"), F.size("path").alias("n"), F.posexplode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("pos", "node_name"))
    return e.select("hierarchy", "node_name", "descendant", (F.col("n") - 1 - F.col("pos")).cast("bigint").alias("distance"))


def descendants(resolved: DataFrame) -> DataFrame:
    """hierarchy, node_name, descendant: every node with each of its other nodes downwards; resolved must have paths.

    A node on a cycle is above all others on it and all nodes below it; the join is as large as what comes out.
    """
    first = F.when(F.col("node_class") == "below_cycle", 2).otherwise(1)  # the path's node on the cycle is among those of the join
    above = F.slice("path", first, F.greatest(F.size("path") - first, F.lit(0)))
    pairs = resolved.where("node_class <> 'cycle'").select("hierarchy", F.explode(above).alias("name"), F.col("node_name").alias("descendant"))
    on = resolved.where("node_class = 'cycle'").select("hierarchy", "root_node", F.col("node_name").alias("name"))
    under = resolved.where("node_class <> 'tree'").select("hierarchy", "root_node", F.col("node_name").alias("descendant"))
    rounds = on.join(under, ["hierarchy", "root_node"]).where("name <> descendant").select("hierarchy", "name", "descendant")
    return pairs.unionByName(rounds).withColumnRenamed("name", "node_name")


def link_edges(links: DataFrame) -> DataFrame:
    """Explicit doc links as edges, the source above the target."""
    of = links.where((F.lower(tidy("source_kind")) == "doc") & (F.lower(tidy("confidence")) == "explicit"))
    return of.select(F.lit("impact_links").alias("hierarchy"), reference("target").alias("child"), reference("source").alias("parent"))


def required_edges(frontmatter: DataFrame) -> DataFrame:
    """Each document's highest revision as an edge below its first requirement (parent null if it has none)."""
    first = F.get(F.filter(F.transform("doc_requires", reference), lambda x: x.isNotNull()), F.lit(0))
    doc = frontmatter.select(reference("doc_path").alias("child"), F.struct(F.coalesce("doc_revision", F.lit(-(2**31))).alias("r"), "published_at", "row_id", F.nullif(F.substring_index(first, "#", 1), F.lit("")).alias("parent")).alias("s")).dropna(subset=["child"])
    best = doc.groupBy("child").agg(F.max("s").alias("s"))
    return best.select(F.lit("doc_requires").alias("hierarchy"), "child", F.col("s.parent").alias("parent"))


def all_edges(links: DataFrame, frontmatter: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [link_edges(links), required_edges(frontmatter)])
