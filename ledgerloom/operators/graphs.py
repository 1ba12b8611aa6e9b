"""A property graph as two relations, and iterative operators over its edges.

Edges are (src, dst). Every round of an iteration is one written table in the shared folder, so plans stay short and a
lost executor costs one round; rounds end when a frontier or a change count is empty, or when so few edges are left that
one task finishes them.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.ordering import numbered
from ledgerloom.session import stored, stored_with

MAX_ROUNDS = 200
#: A graph, or what rounds have left of one, is finished in one task if it has no more edges than this (some tens of MB);
#: the edges are counted while they are written. Beyond it every round is distributed.
LOCAL_EDGES = 250_000


def intern_nodes(rows: DataFrame) -> DataFrame:
    """node_id, kind, key, meta: one row per (kind, key array); the meta that comes first by column seq wins."""
    node_id = F.sha2(F.to_json(F.struct("kind", "key")), 256)
    return rows.withColumn("node_id", node_id).groupBy("node_id", "kind", "key").agg(F.min_by("meta", "seq").alias("meta"))


def intern_alts(rows: DataFrame) -> DataFrame:
    """Hyperedges once per kind, inputs and canonical evidence."""
    return rows.select("kind", "inputs", "evidence").dropDuplicates(["kind", "inputs", "evidence"])


def graph_signature(edges: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with dense numbers from 0 by (kind, name), and edges between numbers."""
    nodes = numbered(kinds.select("kind", "name").distinct(), ["kind", "name"], "node_no")
    n = nodes.select("name", "node_no")
    e = edges.join(n.toDF("src", "src_no"), "src").join(n.toDF("dst", "dst_no"), "dst").select("src_no", "dst_no").distinct()
    return nodes, e


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """node, depth: nodes within max_depth links of the seeds (node), each at its least depth."""
    seen = stored(seeds.select("node", F.lit(0).alias("depth")).dropna().distinct(), "seen")
    e, size = stored_with(edges.select("src", "dst").dropna().distinct(), "edges", n=F.count(F.lit(1)))
    if size["n"] <= LOCAL_EDGES:
        starts = seen.select(F.col("node").alias("dst")).join(e.select(F.col("src").alias("dst")), "dst", "left_semi")
        few = _in_one_task(e.unionByName(starts.select(F.lit(None).cast(e.schema["src"].dataType).alias("src"), "dst")), lambda rows: _walked(rows, max_depth), "level")
        few = few.join(seen.select("node"), "node", "left_anti").select("node", F.col("level").cast("int").alias("depth"))
        return seen.unionByName(few)
    front = seen
    for d in range(1, max_depth + 1):
        step = front.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front, n = stored_with(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("depth")), "front", n=F.count(F.lit(1)))
        if not n["n"]:
            break
        seen = seen.unionByName(front) if d % 8 else stored(seen.unionByName(front), "seen")
    return seen


def strongest_paths(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """node, confidence: the best of all paths of at most max_depth links, a path being worth its weakest edge.

    edges: src, dst, confidence; seeds are worth 1. Level-synchronous: a node is passed on again when its worth grows.
    """
    best = stored(seeds.select("node", F.lit(1.0).alias("confidence")).distinct(), "best")
    front, e = best, stored(edges.groupBy("src", "dst").agg(F.max("confidence").alias("c")), "edges")
    for _ in range(max_depth):
        step = front.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.max(F.least("confidence", "c")).alias("confidence"))
        better = step.alias("s").join(best.alias("b"), "node", "left").where("b.confidence is null or s.confidence > b.confidence").select("node", "s.confidence")
        front, n = stored_with(better, "front", n=F.count(F.lit(1)))
        if not n["n"]:
            break
        best = stored(best.unionByName(front).groupBy("node").agg(F.max("confidence").alias("confidence")), "best")
    return best


def _in_one_task(edges: DataFrame, solve: Callable[[list[tuple]], dict], value: str) -> DataFrame:
    """node and value as solve gives them for the edges (src, dst), which must be few."""
    kind = edges.schema["src"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        got = solve(rows)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(got.keys()), pa.array(got.values(), pa.int64() if value == "level" else None)], names=["node", value])

    return edges.select("src", "dst").repartition(1).mapInArrow(run, f"node {kind.simpleString()}, {value} {'bigint' if value == 'level' else kind.simpleString()}")


def _joined(rows: list[tuple]) -> dict:
    """Smallest node of each node's component, by union and find."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in rows:
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {n: top(n) for n in list(up)}


def _walked(rows: list[tuple], max_depth: int) -> dict:
    """Least number of links to each node from the seeds, which are the ends of rows without a source."""
    down: dict = {}
    for a, b in rows:
        if a is not None:
            down.setdefault(a, []).append(b)
    depth = {b: 0 for a, b in rows if a is None}
    todo = list(depth)
    for n in todo:  # grows while it is read
        if depth[n] < max_depth:
            for x in down.get(n, ()):
                if x not in depth:
                    depth[x] = depth[n] + 1
                    todo.append(x)
    return depth


def _peeled(rows: list[tuple]) -> dict:
    """Longest chain into each node, None on and below cycles."""
    down: dict = {}
    k: dict = {}
    for a, b in rows:
        down.setdefault(a, []).append(b)
        k[b] = k.get(b, 0) + 1
        k.setdefault(a, 0)
    level = dict.fromkeys(k)
    ready = [n for n, x in k.items() if not x]
    for n in ready:
        level[n] = 0
    for n in ready:  # grows while it is read
        for x in down.get(n, ()):
            k[x] -= 1
            if not k[x]:
                ready.append(x)
                level[x] = level[n] + 1  # the last one to be taken away lies deepest
    return level


def _strong(rows: list[tuple]) -> dict:
    """Smallest node of each node's strong component: finishing order along the edges, then groups against them."""
    down: dict = {}
    up: dict = {}
    for a, b in rows:
        down.setdefault(a, []).append(b)
        up.setdefault(b, []).append(a)
    order, seen = [], set()
    for root in [*down, *up]:
        todo = [(root, iter(down.get(root, ())))] if root not in seen else []
        seen.add(root)
        while todo:
            n, rest = todo[-1]
            x = next((y for y in rest if y not in seen), None)
            if x is None:
                order.append(n)
                todo.pop()
            else:
                seen.add(x)
                todo.append((x, iter(down.get(x, ()))))
    out: dict = {}
    for root in reversed(order):
        if root in out:
            continue
        group, todo = [], [root]
        out[root] = root
        while todo:
            n = todo.pop()
            group.append(n)
            for x in up.get(n, ()):
                if x not in out:
                    out[x] = root
                    todo.append(x)
        first = min(group)
        out.update(dict.fromkeys(group, first))
    return out


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component (its smallest node) of an undirected graph, by alternating large-star and small-star steps.

    Each step links neighbours to the smallest neighbour; a star is added up by partial aggregation and its edges are
    rewritten by a join, so a node that touches a third of all edges is never one task's list.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).dropna()
    names = e.select(F.explode(F.array("u", "v")).alias("node"))
    if nodes is not None:
        names = names.unionByName(nodes.select("node"))
    names = stored(names.dropna().distinct(), "nodes")
    e, size = stored_with(e.where("u <> v").distinct(), "edges", n=F.count(F.lit(1)))
    if size["n"] <= LOCAL_EDGES:
        few = _in_one_task(e.select(F.col("u").alias("src"), F.col("v").alias("dst")), _joined, "component")
        return names.join(few, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    state = None
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        links = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e, now = stored_with(links, "small", n=F.count(F.lit(1)), h=F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")))
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return names.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def union_sets(members: DataFrame) -> DataFrame:
    """owner, group: sets (owner, element) that share elements directly or over others form one group."""
    tag = lambda c, t: F.concat(F.lit(t), F.col(c).cast("string"))
    c = components(members.select(tag("owner", "o:").alias("src"), tag("element", "x:").alias("dst")))
    owned = c.where("node like 'o:%'").select(F.substring("node", 3, 1 << 30).alias("owner"), "component")
    first = owned.groupBy("component").agg(F.min("owner").alias("group"))
    return owned.join(first, "component").select("owner", "group")


def refine(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """node, label after rounds of colour refinement; nodes: node, seed. Edges count in both directions.

    A node's next label is the digest of its own and of the multiset of its neighbours' labels. The multiset is a sum of
    hashes over (label, count), so a node of any degree is a partial aggregate; labels are those of classes, not text.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).dropna()
    e = stored(both, "edges")
    labels = stored(nodes.select("node", F.sha2(F.concat(F.lit("seed|"), F.coalesce(F.col("seed").cast("string"), F.lit(""))), 256).alias("label")), "labels")
    for r in range(rounds):
        near = e.join(labels.select(F.col("node").alias("dst"), F.col("label").alias("l")), "dst").groupBy("src", "l").agg(F.count("*").alias("n"))
        h = lambda s: F.sum(F.xxhash64(F.lit(s), "l", "n").cast("decimal(20,0)")).cast("string")
        bag = near.groupBy(F.col("src").alias("node")).agg(F.concat_ws("|", h(0), h(1), F.sum("n").cast("string")).alias("bag"))
        labels = stored(labels.join(bag, "node", "left").select("node", F.sha2(F.concat_ws("#", F.lit(str(r)), "label", F.coalesce("bag", F.lit(""))), 256).alias("label")), "labels")
    return labels


def levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, level: the longest chain of edges into the node; null for nodes on a cycle or below one.

    Every round takes the nodes without a remaining edge into them and lowers the counts of those they lead to.
    """
    e, size = stored_with(edges.select("src", "dst").dropna().distinct(), "edges", n=F.count(F.lit(1)))
    others = nodes.select("node").dropna().distinct() if nodes is not None else None
    if size["n"] <= LOCAL_EDGES:
        got = _in_one_task(e, _peeled, "level")
        if others is None:
            return got
        got = stored(got, "levels")
        return got.unionByName(others.join(got, "node", "left_anti").withColumn("level", F.lit(0).cast("bigint")))
    names = e.select(F.col("src").alias("node"), F.lit(0).alias("k")).unionByName(e.select(F.col("dst").alias("node"), F.lit(1).alias("k")))
    if others is not None:
        names = names.unionByName(others.select("node", F.lit(0).alias("k")))
    free = {"free": F.count(F.when(F.col("k") == 0, 1))}
    state, n = stored_with(names.groupBy("node").agg(F.sum("k").alias("k")), "state", **free)
    done = state.limit(0).select("node", F.lit(None).cast("bigint").alias("level"))
    for level in range(1 << 30):
        ready = state.where("k = 0").select("node", F.lit(level).cast("bigint").alias("level"))
        if not n["free"]:
            return done.unionByName(state.select("node", F.lit(None).cast("bigint").alias("level")))
        if level and not level % 8:  # what is left, on its own: a chain begins at this level
            e, size = stored_with(e.join(state.select(F.col("node").alias("src")), "src", "left_semi"), "edges", n=F.count(F.lit(1)))
            if size["n"] <= LOCAL_EDGES:
                rest = stored(_in_one_task(e, _peeled, "level"), "levels")
                alone = state.select("node").join(rest, "node", "left_anti").withColumn("level", F.lit(0).cast("bigint"))
                return done.unionByName(rest.unionByName(alone).select("node", (F.col("level") + level).alias("level")))
        done = ready if level == 0 else done.unionByName(ready)
        less = e.join(ready, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("less"))
        state, n = stored_with(state.where("k > 0").join(less, "node", "left").select("node", (F.col("k") - F.coalesce("less", F.lit(0))).alias("k")), "state", **free)
    raise RuntimeError("peeling did not end")


def strong_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component (its smallest node) of strongly connected components, by colouring.

    Nodes that peel off from either end of the graph are components alone. In the core that is left, the smallest name
    that reaches each node becomes its colour, and the nodes of a colour that reach the colour's own node are one
    component; the others go on.
    """
    e, size = stored_with(edges.select("src", "dst").dropna().distinct(), "edges", n=F.count(F.lit(1)))
    if size["n"] <= LOCAL_EDGES:
        got = _in_one_task(e, _strong, "component")
        if nodes is None:
            return got
        got = stored(got, "strong")
        return got.unionByName(nodes.select("node").dropna().distinct().join(got, "node", "left_anti").withColumn("component", F.col("node")))
    down = stored(levels(e, nodes), "down")
    core = down.where("level is null").select("node")
    within = lambda e, keep: e.join(keep.toDF("src"), "src").join(keep.toDF("dst"), "dst").select("src", "dst")
    e = stored(within(e, core), "core")
    up = stored(levels(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "up")
    left, n = stored_with(up.where("level is null").select("node"), "left", n=F.count(F.lit(1)))
    alone = down.where("level is not null").select("node").unionByName(up.where("level is not null").select("node"))
    done = alone.select("node", F.col("node").alias("component"))
    for _ in range(1 << 20):
        if not n["n"]:
            return done
        e, size = stored_with(within(e, left), "core", n=F.count(F.lit(1)))
        if size["n"] <= LOCAL_EDGES:
            few = stored(_in_one_task(e, _strong, "component"), "strong")
            return done.unionByName(few).unionByName(left.join(few, "node", "left_anti").withColumn("component", F.col("node")))
        color = stored(left.select("node", F.col("node").alias("color")), "color")
        while True:
            got = e.join(color.toDF("src", "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("c"))
            moved = color.join(got, "node", "left").select("node", F.least("color", "c").alias("color"), (F.col("c") < F.col("color")).alias("moved"))
            new, moves = stored_with(moved, "color", moved=F.count(F.when(F.col("moved"), 1)))
            color = new.select("node", "color")
            if not moves["moved"]:
                break
        same = e.join(color.toDF("src", "a"), "src").join(color.toDF("dst", "b"), "dst").where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        back = reach(same, color.where("node = color").select("node"), 1 << 30)
        found = stored(back.select("node").join(color, "node").select("node", F.col("color").alias("component")), "found")
        done = done.unionByName(found)
        left, n = stored_with(left.join(found.select("node"), "node", "left_anti"), "left", n=F.count(F.lit(1)))
    raise RuntimeError("colouring did not end")


def downstream(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """node: everything derived, directly or not, from the changed nodes."""
    return reach(edges, changed, 1 << 30).where("depth > 0").select("node")


def schedule(edges: Iterable[tuple[str, str]], nodes: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """Exact order of a small dependency graph (node, needs): always the smallest ready name; and the names left over.

    Inherently one step after another, for graphs that fit in memory; levels() is the distributed partial order.
    """
    needs: dict[str, set[str]] = {n: set() for n in nodes}
    for node, dep in edges:
        needs.setdefault(node, set()).add(dep)
        needs.setdefault(dep, set())
    users: dict[str, list[str]] = {n: [] for n in needs}
    for n, ds in needs.items():
        for d in ds:
            users[d].append(n)
    open_ = {n: len(d) for n, d in needs.items()}
    ready = [n for n, k in open_.items() if not k]
    heapq.heapify(ready)
    order = []
    while ready:
        n = heapq.heappop(ready)
        order.append(n)
        for u in users[n]:
            open_[u] -= 1
            if not open_[u]:
                heapq.heappush(ready, u)
    return order, sorted(n for n, k in open_.items() if k)


def recursive(edges: DataFrame) -> DataFrame:
    """node: nodes on a cycle of edges, a link to itself included."""
    c = strong_components(edges)
    many = c.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    return c.join(many, "component", "left_semi").select("node").union(edges.where("src = dst").select("src")).distinct()


def carried(seeds: DataFrame, bound: DataFrame) -> DataFrame:
    """fn, param: seeds (fn, param) and all parameters handed on to one, directly or over others.

    bound: caller, caller_param, callee, callee_param. The fixpoint is reach over pairs, against the calls.
    """
    pair = lambda a, b: F.to_json(F.array(F.col(a), F.col(b)))
    e = bound.dropna().select(pair("callee", "callee_param").alias("src"), pair("caller", "caller_param").alias("dst"))
    hit = reach(e, seeds.dropna().select(pair("fn", "param").alias("node")), 1 << 30)
    at = F.from_json("node", "array<string>")
    return hit.select(at[0].alias("fn"), at[1].alias("param"))


def neighbours(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """node, dependents, dependencies: for each of the nodes (node), how many nodes depend on it, and it on others (src to dst)."""
    e = edges.select("src", "dst").dropna().distinct()
    out = e.select(F.col("src").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    n = out.join(changed.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.sum("up").alias("dependents"), F.sum("down").alias("dependencies"))
    return changed.select("node").distinct().join(n, "node", "left").select("node", F.coalesce("dependents", F.lit(0)).cast("bigint").alias("dependents"), F.coalesce("dependencies", F.lit(0)).cast("bigint").alias("dependencies"))


def fiber_rank(df: DataFrame, keys: list[str], weight: str, name: str) -> DataFrame:
    """df with fiber_rank: place from 0 in its group by falling weight, then name."""
    from pyspark.sql import Window

    return df.withColumn("fiber_rank", (F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(weight), name)) - 1).cast("bigint"))


def refine_classes(nodes: DataFrame, edges: DataFrame, rounds: int, directed: bool = False) -> DataFrame:
    """node, label, degree, class_size, class_rank after refinement; it stops early once a round splits no class.

    As refine(); directed refinement looks along edges only, and an isolated node's degree is 0. class_rank numbers
    the labels from 0 in their order.
    """
    e = edges.select("src", "dst").dropna()
    both = e if directed else e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = stored(both, "edges")
    labels = stored(nodes.select("node", F.sha2(F.concat(F.lit("seed|"), F.coalesce(F.col("seed").cast("string"), F.lit(""))), 256).alias("label")), "labels")
    classes = labels.select("label").distinct().count()
    for _ in range(rounds):
        near = e.join(labels.select(F.col("node").alias("dst"), F.col("label").alias("l")), "dst").groupBy("src", "l").agg(F.count("*").alias("n"))
        h = lambda s: F.sum(F.xxhash64(F.lit(s), "l", "n").cast("decimal(20,0)")).cast("string")
        bag = near.groupBy(F.col("src").alias("node")).agg(F.concat_ws("|", h(0), h(1), F.sum("n").cast("string")).alias("bag"))
        new = stored(labels.join(bag, "node", "left").select("node", F.sha2(F.concat_ws("#", "label", F.coalesce("bag", F.lit(""))), 256).alias("label")), "labels")
        now = new.select("label").distinct().count()
        if now == classes:  # labels hold those before, so classes only ever split
            break
        labels, classes = new, now
    degree = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    ranks = numbered(labels.groupBy("label").agg(F.count("*").alias("class_size")), ["label"], "class_rank")
    return labels.join(degree, "node", "left").join(ranks, "label").select("node", "label", F.coalesce("degree", F.lit(0)).alias("degree"), "class_size", "class_rank")


def suite_order(suites: DataFrame, contains: DataFrame) -> DataFrame:
    """suite, depth, order_key of suites (suite, path, qual, line, col, end_line, end_col), below links (src, dst).

    A suite without path, qual or one of the four numbers is an error when the result is read. depth is the number of
    links from a suite that nothing contains; null on and below cycles. order_key sorts by path, depth and place.
    """
    whole = F.lit(True)
    for c in ("path", "qual", "line", "col", "end_line", "end_col"):
        whole = whole & F.col(c).isNotNull()
    ok = F.when(whole & (F.col("path") != ""), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("suite without place: "), F.coalesce(F.col("suite").cast("string"), F.lit("null")))).cast("boolean"))
    s = suites.where(ok).dropDuplicates(["suite"])
    depth = levels(contains, s.select(F.col("suite").alias("node"))).withColumnRenamed("node", "suite")
    pad = lambda c: F.lpad(F.col(c).cast("string"), 10, "0")
    return s.join(depth, "suite").select("suite", F.col("level").alias("depth"), F.concat_ws("|", "path", F.lpad(F.coalesce("level", F.lit(0)).cast("string"), 10, "0"), pad("line"), pad("col"), pad("end_line"), pad("end_col"), "qual").alias("order_key"))


def trusted(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node: the roots (node) and all that their edges lead to, to the fixpoint."""
    return reach(edges, roots, 1 << 30).select("node")


def blockers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node) and distinct edges (src blocks dst) of rows (node, blockers array); blank blockers are none."""
    e = rows.select(F.explode("blockers").alias("src"), F.col("node").alias("dst")).where("trim(src) <> ''").dropna().distinct()
    return rows.select("node").dropna().union(e.select("src")).distinct(), e
