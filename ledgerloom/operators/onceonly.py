"""Exactly one copy of messages delivered at least once, by sorted identifier arrays per hash prefix.

An identifier is a 128-bit hash of its parts. The index keeps, for each prefix of the hash, immutable runs of sorted
identifiers in the shared folder. Incoming deliveries are reduced per Arrow batch first, so that a group of copies that
holds a third of all rows sends one candidate per batch; candidates go to the task of their prefix, prefix by prefix and
in order of receipt. There each batch is binary-searched in the runs of its prefix, its novel identifiers are
deduplicated and become a new sorted run; runs are merged when there are many. A task holds one prefix at a time, and
prefixes are as many as the bytes of the index and the batch ask for. What a batch brought is one immutable run that
carries the batch's id and its surplus deliveries, so a batch that is admitted again after a crash gives what it gave.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import identifier
from ledgerloom.session import ROW_OVERHEAD, _hadoop, known_size, new_path, stored, stored_with

#: Runs in a task's memory before they are merged, and stored runs before the index is rewritten as one.
MAX_RUNS = 8
#: Identifiers in one stored array.
CHUNK = 65_536
#: Bytes of candidates and stored arrays that a task is meant for, and prefixes that it takes one after another (2^4).
BYTES_PER_TASK, MORE_BITS = 64 << 20, 4
#: Batches in order of receipt that a whole table is admitted in.
SPLITS = 4

#: What a row of the exchange is: a candidate, a delivery known to be surplus, or a stored array.
CANDIDATE, SURPLUS, STORED = 0, 1, 2
_ROW = "slot int, kind int, h1 bigint, h2 bigint, at bigint, delivery_id bigint, ids binary"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])
_LAST = 2**63 - 1


def _firsts(h1: np.ndarray, h2: np.ndarray, order: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by identifier, then by order; and which of them begin an identifier."""
    p = np.lexsort((*order[::-1], h2, h1))
    a, b = h1[p], h2[p]
    first = np.ones(len(p), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return p, first


def _rows(n: int, kind: int, slot=None, h1=None, h2=None, at=None, delivery_id=None, ids=None) -> pa.RecordBatch:
    zero = lambda x, t: pa.array(np.zeros(n, t) if x is None else x)
    return pa.RecordBatch.from_arrays([zero(slot, "i4"), pa.array(np.full(n, kind, "i4")), zero(h1, "i8"), zero(h2, "i8"), zero(at, "i8"), zero(delivery_id, "i8"), pa.nulls(n, pa.binary()) if ids is None else pa.array(ids, pa.binary())], names=_NAMES)


def _slots(h1: np.ndarray, bits: int) -> np.ndarray:
    return (h1 >> np.uint64(64 - bits)).astype("i4")


def _locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the earliest delivery of each identifier of a batch as candidate; the others are surplus for certain."""
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, at, did = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        p, first = _firsts(h1.view("u8"), h2.view("u8"), (at, did))
        keep = p[first]
        yield _rows(len(keep), CANDIDATE, None, h1[keep], h2[keep], at[keep], did[keep])
        if len(keep) < len(p):
            yield _rows(len(p) - len(keep), SURPLUS, delivery_id=did[p[~first]])


def _arrays(run: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """A sorted run cut at prefixes, and at CHUNK identifiers."""
    slots = _slots(run["a"], bits)
    edges = [0, *(np.flatnonzero(np.diff(slots)) + 1), len(run)]
    for s, e in zip(edges, edges[1:]):
        for i in range(s, e, CHUNK):
            yield int(slots[i]), run[i : min(i + CHUNK, e)].tobytes()


def _placed(bits: int):
    """mapInArrow function: candidates and stored arrays under prefixes of so many bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.column(1).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(kind == CANDIDATE)
            h1, h2, at, did = (b.column(i).to_numpy(zero_copy_only=False)[new] for i in (2, 3, 4, 5))
            if len(new):
                yield _rows(len(new), CANDIDATE, _slots(h1.view("u8"), bits), h1, h2, at, did)
            cut = [x for ids in b.column(6).filter(pa.array(kind == STORED)).to_pylist() for x in _arrays(np.frombuffer(ids, _PAIR), bits)]
            if cut:
                yield _rows(len(cut), STORED, np.array([s for s, _ in cut], "i4"), ids=[x for _, x in cut])

    return run


class Runs:
    """Sorted arrays of identifiers of one task."""

    def __init__(self) -> None:
        self.runs: list[np.ndarray] = []

    def known(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h1), bool)
        for run in self.runs:
            at = np.searchsorted(run["a"], h1)
            left = np.arange(len(h1))
            while len(left):  # more than one step only where first halves collide
                left = left[at[left] < len(run)]
                left = left[run["a"][at[left]] == h1[left]]
                hit = run["b"][at[left]] == h2[left]
                found[left[hit]] = True
                left = left[~hit]
                at[left] += 1
        return found

    def add(self, run: np.ndarray) -> None:
        if len(run):
            self.runs.append(run)
        if len(self.runs) > MAX_RUNS:
            self.runs = [self.merged()]

    def merged(self) -> np.ndarray:
        every = np.concatenate(self.runs) if self.runs else np.empty(0, _PAIR)
        return every[np.lexsort((every["b"], every["a"]))]


def _admit(bits: int):
    """mapInArrow function: rows of a task by prefix, of each stored arrays first, then candidates by receipt; yields
    surplus deliveries and each prefix's novel run."""

    def novel_run(slot: int, novel: Runs) -> Iterator[pa.RecordBatch]:
        cut = list(_arrays(novel.merged(), bits))
        if cut:
            yield _rows(len(cut), STORED, np.full(len(cut), slot, "i4"), ids=[x for _, x in cut])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, novel, slot = Runs(), Runs(), None
        for whole in batches:
            slots = whole.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(slots)) + 1), len(slots)]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                if slots[s] != slot:
                    if slot is not None:
                        yield from novel_run(slot, novel)
                    index, novel, slot = Runs(), Runs(), slots[s]
                b = whole.slice(s, e - s)
                kind = b.column(1).to_numpy(zero_copy_only=False)
                for ids in b.column(6).filter(pa.array(kind == STORED)).to_pylist():
                    index.add(np.frombuffer(ids, _PAIR))
                new = np.flatnonzero(kind == CANDIDATE)
                if not len(new):
                    continue
                h1, h2 = (b.column(i).to_numpy(zero_copy_only=False)[new].view("u8") for i in (2, 3))
                did = b.column(5).to_numpy(zero_copy_only=False)[new]
                p, first = _firsts(h1, h2)  # a stable sort: of equal identifiers the one received first leads
                keep = first & ~(index.known(h1[p], h2[p]) | novel.known(h1[p], h2[p]))
                found = np.empty(int(keep.sum()), _PAIR)
                found["a"], found["b"] = h1[p][keep], h2[p][keep]
                novel.add(found)
                if not keep.all():
                    yield _rows(int((~keep).sum()), SURPLUS, delivery_id=did[p[~keep]])
        if slot is not None:
            yield from novel_run(slot, novel)

    return run


def _as_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids in b.column(6).to_pylist():
            x = np.frombuffer(ids, _PAIR)
            yield _rows(len(x), CANDIDATE, None, x["a"].view("i8").copy(), x["b"].view("i8").copy())


class IdentifierIndex:
    """The identifiers admitted so far, as immutable runs in a folder that all executors share.

    A run's folder is named by its number, and by 'm' where it is a merged one or a digest of the id of its batch.
    Folders without the mark of a finished write are leavings of a crash: they are ignored and written over.
    """

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root, self.runs, self.batches = spark, root or new_path(spark, "identifiers"), [], {}
        p, fs = _hadoop(spark, self.root)
        if fs.exists(p):
            done = sorted(s.getPath().toString() for s in fs.listStatus(p) if fs.exists(_hadoop(spark, s.getPath().toString() + "/_SUCCESS")[0]))
            merged = max((i for i, x in enumerate(done) if x.endswith("m")), default=0)
            self.runs = done[merged:]
            self.batches = {x.rpartition("-b")[2]: x for x in done if "-b" in x.rpartition("/")[2]}

    def _next(self) -> str:
        last = int(re.search(r"run-(\d+)[^/]*$", self.runs[-1])[1]) if self.runs else -1
        return f"{self.root}/run-{last + 1:06d}"

    def stored(self) -> DataFrame | None:
        return self.spark.read.schema(_ROW).parquet(*self.runs).where(F.col("kind") == STORED) if self.runs else None

    def _bits(self, rows: DataFrame | None = None) -> tuple[int, int]:
        """Tasks for the index and the rows, and bits of their prefixes; by sizes of files, and by a count only where
        the rows don't come from files."""
        size = known_size(rows) if rows is not None else 0
        if size is None:
            size = ROW_OVERHEAD * rows.count()
        for run in self.runs:
            p, fs = _hadoop(self.spark, run)
            size += fs.getContentSummary(p).getLength()
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BYTES_PER_TASK), 1)
        return tasks, min(30, (tasks - 1).bit_length() + MORE_BITS)

    def admit(self, deliveries: DataFrame, parts: list[Column], received: str, delivery_id: str, batch_id: str | None = None) -> DataFrame:
        """Surplus deliveries of a batch: delivery_id. Deliveries with a null part are never copies and not indexed.

        Of the copies within the batch the one with the earliest receipt stays (null receipts last), then the smallest
        id; a copy of an identifier admitted before never stays. Null ids are not accepted as deliveries. A batch_id
        that was admitted before gives the surplus found then, and changes nothing.
        """
        return self.admit_rows(stored(candidates(deliveries, parts, received, delivery_id), "candidates"), batch_id)

    def admit_rows(self, rows: DataFrame, batch_id: str | None = None) -> DataFrame:
        """As admit, of rows that candidates() made."""
        mark = hashlib.sha1(batch_id.encode()).hexdigest()[:20] if batch_id is not None else None
        if mark in self.batches:
            return self._surplus(self.batches[mark])
        tasks, bits = self._bits(rows)
        known = self.stored()
        every = rows.unionByName(known) if known is not None else rows
        ordered = every.where(F.col("kind") != SURPLUS).mapInArrow(_placed(bits), _ROW).repartition(tasks, "slot").sortWithinPartitions("slot", F.col("kind").desc(), "at", "delivery_id")
        path = self._next() + (f"-b{mark}" if mark else "")
        out = ordered.mapInArrow(_admit(bits), _ROW).unionByName(rows.where(F.col("kind") == SURPLUS))
        out.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.runs.append(path)
        if mark:
            self.batches[mark] = path
        if len(self.runs) > MAX_RUNS:
            self.merge()
        return self._surplus(path)

    def _surplus(self, path: str) -> DataFrame:
        return self.spark.read.schema(_ROW).parquet(path).where(F.col("kind") == SURPLUS).select("delivery_id")

    def merge(self) -> None:
        """Replaces all stored runs by one; the old runs' files stay for readers and for batches that come again."""
        tasks, bits = self._bits()
        path = self._next() + "m"
        rows = self.stored().mapInArrow(_as_candidates, _ROW).mapInArrow(_placed(bits), _ROW).repartition(tasks, "slot").sortWithinPartitions("slot")
        rows.mapInArrow(_admit(bits), _ROW).where(F.col("kind") == STORED).write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.runs = [path]


def candidates(deliveries: DataFrame, parts: list[Column], received: str, delivery_id: str) -> DataFrame:
    """Rows for admit_rows: one candidate per identifier of an Arrow batch, and the other deliveries of it as surplus."""
    names = [f"p{i}" for i in range(len(parts))]
    cols = [F.when(F.lit(True), c).alias(n) for n, c in zip(names, parts)]
    picked = deliveries.select(*cols, F.coalesce(F.unix_micros(F.col(received).cast("timestamp")), F.lit(_LAST)).alias("at"), F.col(delivery_id).cast("bigint").alias("delivery_id")).dropna()
    hashed = picked.select(F.xxhash64(*names).alias("h1"), F.xxhash64(F.lit("second"), *names).alias("h2"), "at", "delivery_id")
    return hashed.mapInArrow(_locally, _ROW)


def surplus_deliveries(envelopes: DataFrame, root: str | None = None, table: str = "table", splits: int = SPLITS) -> DataFrame:
    """delivery_id of every delivery that repeats another's run, sequence and op (first and last as identifiers).

    The table is read and hashed once; its candidates are then admitted in batches by equal spans of receipt, each
    searched in the runs that the ones before it left. Equal receipts are in one batch, so the result is that of one
    batch; table names the batches' ids in an index that is kept below root.
    """
    index = IdentifierIndex(envelopes.sparkSession, root)
    rows = candidates(envelopes, [identifier("run_id"), F.col("sequence"), identifier("op_id")], "received_at", "delivery_id")
    real = F.when((F.col("kind") == CANDIDATE) & (F.col("at") < _LAST), F.col("at"))
    rows, seen = stored_with(rows, "candidates", low=F.min(real), high=F.max(real))
    surplus = rows.where(F.col("kind") == SURPLUS).select("delivery_id")
    low, high = (0, 0) if seen["low"] is None else (seen["low"], seen["high"])
    edges = [low + (high - low) * k // splits for k in range(1, splits)]
    for k, (a, b) in enumerate(zip([None, *edges], [*edges, None])):
        part = rows.where(F.col("kind") == CANDIDATE)
        part = part.where(F.col("at") >= a) if a is not None else part
        part = part.where(F.col("at") < b) if b is not None else part
        surplus = surplus.unionByName(index.admit_rows(part, f"{table}-{k}"))
    return surplus
