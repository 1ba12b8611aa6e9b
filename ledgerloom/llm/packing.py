"""Texts into containers of fixed capacity, by patterns fitted to the histogram of lengths.

Texts are measured in tokens once. For each capacity, texts longer than it give full pieces, each a container of its
own, and a remainder. Lengths fall into classes of 1/64 of the capacity; all patterns of few lengths that fill a
container nearly are enumerated, and non-negative least squares finds how often to repeat each so that the histogram is
met. Counts are rounded down; which text takes which place of which copy follows from its number within its class, so
patterns need neither a join nor a shuffle of texts.

Where a container holds many more texts than a pattern, patterns go by levels: short texts are first fitted into bundles
of about a quarter of the container, those of shorter texts again into quarters, until few texts of mean length fill
one; a bundle then takes a place in the patterns of the level above, by its true length. What is left over at a level, a
reserve of the shortest level, and the texts of bundles that found no place fill the room left in pattern containers and
then new ones, best fit and longest first, in groups of bounded size.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import join_measured, partitions_for, stored

TOKENIZER_DIR = os.environ.get("LEDGERLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's tokenizer cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Length classes of a container, the shortest class in patterns, the most texts of a pattern, and the classes that a
#: pattern may leave empty.
CLASSES, SHORTEST, MOST, SLACK = 64, 4, 4, 2
#: Leftover texts and open containers of a group that is packed together.
GROUP = 20_000
#: A bundle may be as long as this share of a quarter of the level above; and one of so many texts of the lowest level
#: is kept to fill room.
BUNDLE, RESERVE = 1.025, 10
_ITEM = "capacity int, doc_id bigint, piece_no int, start_token bigint, tokens int"
_UNIT = f"{_ITEM}, bundle string"


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str | None, path: str) -> int:
    return len(_encoding(path).encode_ordinary(text)) if text else 0


@cache
def patterns() -> np.ndarray:
    """All multisets of up to MOST classes that leave at most SLACK classes empty, as counts per class."""
    out = []

    def extend(parts: tuple[int, ...], total: int) -> None:
        if total >= CLASSES - SLACK:
            out.append(parts)
        if len(parts) < MOST:
            for c in range(parts[-1] if parts else SHORTEST, CLASSES - total + 1):
                extend((*parts, c), total + c)

    extend((), 0)
    table = np.zeros((CLASSES + 1, len(out)))
    for j, parts in enumerate(out):
        for c in parts:
            table[c, j] += 1
    return table


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    floor = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(6 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= floor:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if s.min() > floor:
                x[:] = 0
                x[at] = s
                break
            low = s <= floor
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            drop = at[(x[at] <= floor) & low]
            x[drop] = 0
            active[drop] = False
            if not active.any():
                break
    return x


def plan(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts per class of the patterns used, and how often each is used."""
    table = patterns()
    fitted = np.floor(nonnegative_least_squares(table[SHORTEST:], histogram[SHORTEST:].astype(float)) + 1e-6).astype("i8")
    used = np.flatnonzero(fitted)
    a, n = table[:, used].astype("i8"), fitted[used]
    for j in np.argsort(-n, kind="stable"):  # rounding must not use more texts than there are
        over = a @ n - histogram
        bad = (over > 0) & (a[:, j] > 0)
        if bad.any():
            n[j] = max(0, n[j] - int(np.ceil((over[bad] / a[bad, j]).max())))
    return a[:, n > 0], n[n > 0]


def _layout(histogram: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per class: where each pattern's texts begin in the class's numbering, the pattern, and its texts a container."""
    a, n = plan(histogram)
    out = {}
    for c in range(SHORTEST, CLASSES + 1):
        use = np.flatnonzero(a[c])
        if len(use):
            out[c] = (np.append(0, np.cumsum(a[c, use] * n[use])), use, a[c, use])
    return out


def _measure(capacities: list[int], path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = token_count(text, path)
                for cap in capacities:
                    full, rest = divmod(n, cap)
                    for p in range(full + (rest > 0 or n == 0)):
                        for c, x in zip(cols, (cap, doc, p, p * cap, cap if p < full else rest)):
                            c.append(x)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _ITEM.split(", ")])

    return run


def _columns(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in names]


def _numbered(lengths: dict[int, int]):
    """Units with their class under their capacity's length at this level, task, and number within class and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        seen = {c: np.zeros(CLASSES + 1, "i8") for c in lengths}
        for b in batches:
            cap, tokens = _columns(b, "capacity", "tokens")
            cls, seq = np.zeros(b.num_rows, "i4"), np.zeros(b.num_rows, "i8")
            for c, length in lengths.items():
                at = np.flatnonzero(cap == c)
                k = -(-tokens[at].astype("i8") * CLASSES // length)
                o = np.argsort(k, kind="stable")
                n = np.bincount(k, minlength=CLASSES + 1)
                cls[at] = k
                seq[at[o]] = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + seen[c][k[o]]
                seen[c] += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cls), pa.array(np.full(b.num_rows, part, "i4")), pa.array(seq)], names=[*b.schema.names, "cls", "part", "seq"])

    return run


def _placed(layouts: dict[int, dict], mark: str):
    """Container of each unit by its number within its class; null where it is left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _UNIT.split(", ")]
        for b in batches:
            cap, cls, rank = _columns(b, "capacity", "cls", "rank")
            where = np.full(b.num_rows, None, object)
            for c, layout in layouts.items():
                for k, (starts, use, per) in layout.items():
                    at = np.flatnonzero((cap == c) & (cls == k) & (rank < starts[-1]))
                    j = np.searchsorted(starts, rank[at], "right") - 1
                    copy = (rank[at] - starts[j]) // per[j]
                    where[at] = [f"{mark}{p}-{x}" for p, x in zip(use[j], copy)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(x)) for x in names), pa.array(where, pa.string())], names=[*names, "container_id"])

    return run


def _fit(units: DataFrame, lengths: dict[int, int], mark: str) -> DataFrame:
    """Units of one level with the container that the patterns give them, or null."""
    numbered = stored(units.mapInArrow(_numbered(lengths), f"{_UNIT}, cls int, part int, seq bigint"), "units")
    counts = numbered.where(F.col("cls") >= SHORTEST).groupBy("capacity", "cls", "part").agg(F.count("*").alias("n"))
    counts = stored(counts.withColumn("before", F.sum("n").over(Window.partitionBy("capacity", "cls").orderBy("part")) - F.col("n")), "counts")
    hist = {c: np.zeros(CLASSES + 1, "i8") for c in lengths}
    for r in counts.groupBy("capacity", "cls").agg(F.sum("n").alias("n")).collect():  # a row per class
        hist[r.capacity][r.cls] = r.n
    layouts = {c: _layout(h) for c, h in hist.items()}
    ranked = join_measured(numbered, counts.select("capacity", "cls", "part", "before"), ["capacity", "cls", "part"], "left")
    ranked = ranked.withColumn("rank", F.col("seq") + F.coalesce("before", F.lit(2**62)))
    return stored(ranked.mapInArrow(_placed(layouts, mark), f"{_UNIT}, container_id string"), "placed")


def depth_of(capacity: int, mean: float) -> int:
    """Levels below the container: as many quarterings as it takes until MOST texts of mean length fill one."""
    depth = 0
    while mean > 0 and capacity / 4**depth / mean > MOST:
        depth += 1
    return depth


def _length(capacity: int, level: int) -> int:
    return capacity if level == 0 else max(1, int(capacity / 4**level * BUNDLE))


def best_fit(sizes: list[int], rooms: list[int], capacity: int) -> list[int]:
    """Container of each size, the sizes taken longest first: an open one with the least room that holds it, or a new
    one; rooms are the open ones', new ones are numbered after them."""
    room = sorted((r, i) for i, r in enumerate(rooms))
    out, new = [0] * len(sizes), len(rooms)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = bisect_left(room, (sizes[k], -1))
        if at < len(room):
            r, i = room.pop(at)
        else:
            r, i = capacity, new
            new += 1
        out[k] = i
        if r > sizes[k]:
            insort(room, (r - sizes[k], i))
    return out


def _fill(table: pa.Table) -> pa.Table:
    """One group's open containers (doc_id null, tokens = their room) and leftover items, to places of the items."""
    table = table.combine_chunks()
    capacity, grp = table["capacity"][0].as_py(), table["grp"][0].as_py()
    is_open = table["doc_id"].is_null().to_numpy()
    open_, items = table.filter(pa.array(is_open)).sort_by([("tokens", "ascending"), ("container_id", "ascending")]), table.filter(pa.array(~is_open)).sort_by([("tokens", "descending"), ("doc_id", "ascending"), ("piece_no", "ascending")])
    got = np.array(best_fit(items["tokens"].to_pylist(), open_["tokens"].to_pylist(), capacity), "i8")
    names = np.array([*open_["container_id"].to_pylist(), *(f"r{grp}-{i}" for i in range(int(got.max(initial=-1)) + 1 - len(open_)))], object)
    return items.set_column(table.schema.get_field_index("container_id"), "container_id", pa.array(names[got] if len(got) else [], pa.string()))


def pack(documents: DataFrame, bins: DataFrame, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """bin_kind, capacity_tokens, container_id, doc_id, piece_no, start_token, tokens: every text or piece once per kind.

    A text is cut only if it alone exceeds the capacity. Null and empty texts have no tokens and share container 'none';
    rows without a doc_id can't be assigned and are left out; repeated rows of a document are texts of their own.
    Capacities that are null or not positive are left out; kinds of one capacity are packed alike.
    """
    spark = documents.sparkSession
    kinds = bins.select("bin_kind", F.col("capacity_tokens").cast("int").alias("capacity")).where("capacity > 0").distinct()
    capacities = [r.capacity for r in kinds.select("capacity").distinct().orderBy("capacity").collect()]  # container sizes, not rows
    path = os.path.join(tokenizer_dir, VOCABULARY)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    items = stored(docs.mapInArrow(_measure(capacities, path), _ITEM), "items")
    part = (F.col("tokens") > 0) & (F.col("tokens") < F.col("capacity"))
    means = {r.capacity: r.mean for r in items.where(part).groupBy("capacity").agg(F.avg("tokens").alias("mean")).collect()}  # a row per capacity
    depth = {c: depth_of(c, means.get(c, 0.0)) for c in capacities}
    level = F.lit(0)
    for c, d in depth.items():
        for j in range(1, d + 1):
            level = F.when((F.col("capacity") == c) & (F.col("tokens") <= _length(c, j)), j).otherwise(level)
    lowest = F.coalesce(*(F.when(F.col("capacity") == c, F.lit(d)) for c, d in depth.items()), F.lit(0))
    kept = (level == lowest) & (level > 0) & (F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(RESERVE)) == 0)
    cols = ["capacity", "doc_id", "piece_no", "start_token", "tokens"]
    leveled = items.where(part).withColumn("level", F.when(kept, -1).otherwise(level))
    unplaced = [leveled.where("level = -1").select(*cols)]
    fitted, bundles = None, None
    for j in range(max(depth.values(), default=0), -1, -1):
        units = leveled.where(F.col("level") == j).select(*cols, F.lit(None).cast("string").alias("bundle"))
        if bundles is not None:
            units = units.unionByName(bundles)
        placed = _fit(units, {c: _length(c, j) for c in capacities if depth[c] >= j}, f"{j}p" if j else "p")
        own = placed.where("bundle is null")
        unplaced.append(own.where("container_id is null").select(*cols))
        now = own.where("container_id is not null").select(*cols, "container_id")
        if fitted is not None:
            up = placed.where("bundle is not null").select("capacity", F.col("bundle").alias("container_id"), F.col("container_id").alias("up"))
            moved = stored(fitted.join(up, ["capacity", "container_id"]), "moved")
            unplaced.append(moved.where("up is null").select(*cols))
            now = now.unionByName(moved.where("up is not null").select(*cols, F.col("up").alias("container_id")))
        fitted = now
        whole_bundles = fitted.groupBy("capacity", F.col("container_id").alias("bundle")).agg(F.sum("tokens").cast("int").alias("tokens"))
        bundles = whole_bundles.select("capacity", *(F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("piece_no", "int"), ("start_token", "bigint"))), "tokens", "bundle")
    left = reduce(DataFrame.unionByName, unplaced)
    whole = items.where(~part).withColumn("container_id", F.when(F.col("tokens") == 0, "none").otherwise(F.concat(F.lit("w"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece_no").cast("string"))))
    rooms = fitted.groupBy("capacity", "container_id").agg((F.first("capacity") - F.sum("tokens")).cast("int").alias("tokens")).where("tokens > 0")
    rooms = stored(rooms, "rooms")
    rows = left.select("capacity").unionByName(rooms.select("capacity")).groupBy("capacity").agg(F.count("*").alias("n")).collect()  # a row per capacity
    groups = {r.capacity: -(-r.n // GROUP) for r in rows}
    of = F.coalesce(*(F.when(F.col("capacity") == c, F.lit(n)) for c, n in groups.items()), F.lit(1)) if groups else F.lit(1)
    none = lambda t: F.lit(None).cast(t)
    grp = lambda *c: F.pmod(F.xxhash64(*c), of).cast("int")
    mixed = left.select("capacity", grp("doc_id", "piece_no").alias("grp"), "doc_id", "piece_no", "start_token", "tokens", none("string").alias("container_id")).unionByName(
        rooms.select("capacity", grp("container_id").alias("grp"), none("bigint").alias("doc_id"), none("int").alias("piece_no"), none("bigint").alias("start_token"), "tokens", "container_id")
    )
    filled = mixed.repartition(partitions_for(sum(groups.values()), 4, spark), "capacity", "grp").groupBy("capacity", "grp").applyInArrow(_fill, "capacity int, grp int, doc_id bigint, piece_no int, start_token bigint, tokens int, container_id string")
    cols = ["capacity", "container_id", "doc_id", "piece_no", "start_token", "tokens"]
    out = whole.select(*cols).unionByName(fitted.select(*cols)).unionByName(filled.select(*cols))
    return out.join(F.broadcast(kinds) if len(capacities) < 1000 else kinds, "capacity").select("bin_kind", F.col("capacity").alias("capacity_tokens"), *cols[1:])


def fill_report(packed: DataFrame) -> DataFrame:
    """bin_kind, texts, containers, tokens, fill, and the share of texts shorter than the capacity that stand in containers
    which patterns began."""
    real = packed.where("container_id <> 'none'")
    short = F.col("tokens") < F.col("capacity_tokens")
    g = real.groupBy("bin_kind", "capacity_tokens", "container_id").agg(F.count("*").alias("texts"), F.count_if(short).alias("short"), F.sum("tokens").alias("tokens"))
    begun = F.col("container_id").startswith("p")
    out = g.groupBy("bin_kind", "capacity_tokens").agg(F.sum("texts").alias("texts"), F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), (F.sum(F.when(begun, F.col("short")).otherwise(0)) / F.sum("short")).alias("in_patterns"))
    return out.select("bin_kind", "texts", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"), F.round("in_patterns", 6).alias("in_pattern_containers"))
