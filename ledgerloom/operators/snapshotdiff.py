"""What changed between full snapshots, by content-defined chunks of the key-sorted rows.

Snapshots are sorted by key, scope by scope; a scope of very many rows is split by a hash of the key, alike in all its
snapshots. A chunk ends where the hash of a key says so, hence equal stretches of two snapshots give equal chunks
wherever they stand. Chunks whose digest also occurs in the neighbouring snapshot are dropped by comparing digests only;
the rows of the others are joined by key. Any cut into chunks gives the same result, so the edges of parts and batches do
no harm. A row's hash is only ever held against that of the same key's row next to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import BLANKS, collapse, tidy
from ledgerloom.session import join_measured, stored

#: Mean rows of a chunk, a power of two.
CHUNK_ROWS = 64
#: Rows that a part of a scope is meant for: of a scope with more, keys go to parts by their hash.
PART_ROWS = 1 << 16
_GROUP = ["source_table", "scope_id", "snapshot_no"]
_CHUNK = "source_table string, scope_id string, snapshot_no bigint, d1 bigint, d2 bigint, keys array<string>, hashes array<bigint>"


def _mix(x: np.ndarray) -> np.ndarray:
    """A well-known 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (group, key, key hash, row hash), the row that counts first among equal keys, to chunk rows."""
    last = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        group = [b.column(i) for i in range(3)]
        key, kh, rh = b.column(3), b.column(4).to_numpy(zero_copy_only=False).view("u8"), b.column(5).to_numpy(zero_copy_only=False).view("u8")
        codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in (*group, key)]
        turn = np.zeros(n, bool)
        for c in codes[:3]:
            turn[1:] |= c[1:] != c[:-1]
        again = np.zeros(n, bool)
        again[1:] = ~turn[1:] & (codes[3][1:] == codes[3][:-1])
        again[0] = last == tuple(c[0].as_py() for c in (*group, key))
        last = tuple(c[n - 1].as_py() for c in (*group, key))
        keep = np.flatnonzero(~again)
        if not len(keep):
            continue
        kh, rh = kh[keep], rh[keep]
        turn = np.cumsum(turn)[keep]
        start = np.ones(len(keep), bool)
        start[1:] = (turn[1:] != turn[:-1]) | (_mix(kh[1:]) % np.uint64(CHUNK_ROWS) == 0)
        s = np.flatnonzero(start)
        g = _mix(_mix(kh) + rh)
        d1, d2 = np.add.reduceat(g, s), np.add.reduceat(_mix(g + np.uint64(1)), s)
        offsets = pa.array(np.append(s, len(keep)).astype("i4"))
        rows = pa.array(keep)
        first = pa.array(keep[s])
        yield pa.RecordBatch.from_arrays(
            [*(c.take(first) for c in group), pa.array(d1.view("i8")), pa.array(d2.view("i8")), pa.ListArray.from_arrays(offsets, key.take(rows)), pa.ListArray.from_arrays(offsets, pa.array(rh.view("i8")))],
            names=["source_table", "scope_id", "snapshot_no", "d1", "d2", "keys", "hashes"],
        )


def snapshot_changes(rows: DataFrame) -> DataFrame:
    """source_table, scope_id, snapshot_no, record_key, change_kind from rows of full snapshots.

    rows: source_table, scope_id, snapshot_no, record_key, row_hash, loaded (timestamp). Each snapshot is compared with
    the next lower number present in its table and scope; a first snapshot has no changes. Of rows of one key in one
    snapshot the one loaded last counts, then the greatest hash. Rows without a snapshot number or key belong to no
    snapshot; a null scope is a scope of its own.
    """
    scope = F.coalesce("scope_id", F.lit("")).alias("scope_id")
    large = rows.groupBy("source_table", scope).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")).where("parts > 1")
    ready = rows.select("source_table", scope, F.col("snapshot_no").cast("bigint").alias("snapshot_no"), "record_key", F.xxhash64("record_key").alias("key_hash"), "row_hash", "loaded").dropna(subset=["snapshot_no", "record_key", "row_hash"])
    parted = join_measured(ready, large, ["source_table", "scope_id"], "left")
    part = F.when(F.col("parts").isNotNull(), F.pmod("key_hash", "parts")).otherwise(0)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = parted.repartition(n, "source_table", "scope_id", part).sortWithinPartitions(*_GROUP, "record_key", F.desc_nulls_last("loaded"), F.desc("row_hash"))
    chunks = stored(cut.select(*_GROUP, "record_key", "key_hash", "row_hash").mapInArrow(_chunks, _CHUNK), "chunks")
    order = Window.partitionBy("source_table", "scope_id").orderBy("snapshot_no")
    near = chunks.select(*_GROUP).distinct().select(*_GROUP, F.lag("snapshot_no").over(order).alias("lower"), F.lead("snapshot_no").over(order).alias("higher"))
    placed = join_measured(chunks, near, _GROUP)
    #: A chunk is the later side of its own snapshot (2) and the earlier side of the next one (1).
    roles = F.array_compact(F.array(F.when(F.col("lower").isNotNull(), F.struct(F.col("snapshot_no").alias("pair"), F.lit(2).alias("side"))), F.when(F.col("higher").isNotNull(), F.struct(F.col("higher").alias("pair"), F.lit(1).alias("side")))))
    of = lambda df, *more: df.select("source_table", "scope_id", F.explode(roles).alias("r"), "d1", "d2", *more).select("source_table", "scope_id", "r.pair", "r.side", "d1", "d2", *more)
    pair = ["source_table", "scope_id", "pair", "d1", "d2"]
    unmatched = of(placed).groupBy(*pair).agg(F.bit_or("side").alias("sides")).where("sides <> 3").drop("sides")
    left = of(placed, "keys", "hashes").join(unmatched, pair, "left_semi")
    each = left.select("source_table", "scope_id", "pair", "side", F.explode(F.arrays_zip("keys", "hashes")).alias("x"))
    both = each.groupBy("source_table", "scope_id", "pair", F.col("x.keys").alias("record_key")).agg(F.max(F.when(F.col("side") == 1, F.col("x.hashes"))).alias("a"), F.max(F.when(F.col("side") == 2, F.col("x.hashes"))).alias("b"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return both.where("not (a <=> b)").select("source_table", "scope_id", F.col("pair").alias("snapshot_no"), "record_key", kind.alias("change_kind"))


def content_hash(*cols: Column) -> Column:
    """Hash in which null differs from every value."""
    return F.xxhash64(*(x for c in cols for x in (c.isNull(), c)))


def lint_rows(lint: DataFrame) -> DataFrame:
    """Lint entries as rows of snapshot_changes; null parts of the key read as ''."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    path = F.regexp_replace(tidy(F.translate(F.col("path"), "\\", "/")), r"^\./", "")
    key = F.concat_ws(":", text(path), text(F.col("line")), text(F.col("col")), text(F.upper(tidy("code"))))
    content = content_hash(collapse("message"), F.coalesce("severity", F.lit("warning")), F.col("param"))
    return lint.select(F.lit("lint_entries").alias("source_table"), "scope_id", "snapshot_no", key.alias("record_key"), content.alias("row_hash"), F.col("loaded_at").alias("loaded"))


def metric_rows(metrics: DataFrame) -> DataFrame:
    """Advisory metrics as rows of snapshot_changes."""
    text = lambda c: F.coalesce(tidy(c), F.lit(""))
    content = F.xxhash64(F.coalesce("baseline_count", F.lit(0)), F.coalesce("current_count", F.lit(0)))
    return metrics.select(F.lit("advisory_metrics").alias("source_table"), "scope_id", "snapshot_no", F.concat_ws("/", text("advisory"), text("metric_key")).alias("record_key"), content.alias("row_hash"), F.col("loaded_at").alias("loaded"))
