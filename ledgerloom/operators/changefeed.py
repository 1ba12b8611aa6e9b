"""Current state from a feed of inserts, updates and deletes, by upserts into an embedded DuckDB per bucket.

Changes are spread over buckets by a hash of their whole key, so a hot run or table splits over all buckets. Before
that shuffle every Arrow batch is reduced to one change per key, so a hot key sends one row per batch. Each bucket then
streams its changes into an in-memory DuckDB table with a primary key; a conflict updates the row only if the incoming
sequence is higher than the stored one. Deletes stay as tombstones, so a late older change can't revive a key. Buckets
export their rows, and Spark's commit and publish() make all of them visible at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import identifier, read_object, scalar_text
from ledgerloom.session import join_measured, known_size, new_path, partitions_for, publish, published, stored

#: Changes per bucket that the number of buckets is chosen for.
ROWS_PER_BUCKET = 1_000_000
#: Stored bytes of changes per bucket likewise, for wide values; and the memory of a bucket's DuckDB, many times that.
BYTES_PER_BUCKET = 16 << 20
BUCKET_MEMORY = "400MB"
#: Sequence of state that precedes every change.
BASE = -(2**63)


def _connect():
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": BUCKET_MEMORY})
    con.execute("SET temp_directory = ''")
    con.execute("SET preserve_insertion_order = false")
    return con


def _reduced(keys: list[str]) -> str:
    """One change per key of a batch; ties of sequence: a delete wins, then the greatest value."""
    k = ", ".join(keys)
    return f"SELECT {k}, max(rank).seq AS seq, max(rank).dead AS dead, max(rank).val AS val FROM (SELECT {k}, struct_pack(seq := seq, dead := dead, val := coalesce(val, '')) AS rank, val FROM incoming) GROUP BY {k}"


def combine_batches(keys: list[str]):
    """mapInArrow function: reduces each batch (keys, seq, dead, val) to one row per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()
        for batch in batches:
            if batch.num_rows:
                con.register("incoming", pa.Table.from_batches([batch]))
                yield from con.sql(_reduced(keys)).to_arrow_table().to_batches()
                con.unregister("incoming")
        con.close()

    return run


def upsert_bucket(keys: list[str]):
    """mapInArrow function: upserts all batches of a bucket and exports its rows, tombstones included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()
        k = ", ".join(keys)
        con.execute(f"CREATE TABLE state ({', '.join(f'{x} VARCHAR' for x in keys)}, seq BIGINT, dead BOOLEAN, val VARCHAR, PRIMARY KEY ({k}))")
        for batch in batches:
            if not batch.num_rows:
                continue
            con.register("incoming", pa.Table.from_batches([batch]))
            con.execute(
                f"INSERT INTO state {_reduced(keys)} ON CONFLICT ({k}) DO UPDATE SET seq = excluded.seq, dead = excluded.dead, val = excluded.val "
                "WHERE excluded.seq > state.seq OR (excluded.seq = state.seq AND (excluded.dead > state.dead OR (excluded.dead = state.dead AND excluded.val > state.val)))"
            )
            con.unregister("incoming")
        schema = pa.schema([*((x, pa.string()) for x in keys), ("seq", pa.int64()), ("dead", pa.bool_()), ("val", pa.string())])
        for out in con.sql("SELECT * FROM state").to_arrow_reader(50_000):
            yield out.cast(schema)
        con.close()

    return run


def apply_changes(changes: DataFrame, keys: list[str], rows: int, root: str | None = None, size: int = 0) -> DataFrame:
    """Final row of every key from changes (keys as strings, seq bigint, dead boolean, val string), tombstones included.

    rows: an upper bound of the number of changes, for the number of buckets; size: bytes of the files that wide values
    come from, for the same. Rows with a null key or sequence are
    ignored; repeated changes have no effect; of equal sequences a delete wins, then the greatest value. An empty feed
    gives an empty state. The result is published below root (a folder of this application if None) in one step.
    """
    spark = changes.sparkSession
    schema = ", ".join([*(f"{k} string" for k in keys), "seq bigint", "dead boolean", "val string"])
    clean = changes.select(*keys, "seq", "dead", "val").dropna(subset=[*keys, "seq", "dead"])
    combined = clean.mapInArrow(combine_batches(keys), schema)
    n = max(partitions_for(rows, ROWS_PER_BUCKET, spark), size // BYTES_PER_BUCKET)
    buckets = combined.repartition(n, *keys)
    root = root or new_path(spark, "state")
    publish(buckets.mapInArrow(upsert_bucket(keys), schema), root)
    return published(spark, root)


def _json(value) -> str:
    return json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def _payload_changes(values: bool):
    """mapInArrow function: (run_id, seq, kind, payload) to changes; unreadable payloads and empty keys do nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vals = [], []
            for text in batch.column(3).to_pylist():
                record = read_object(text)
                key = scalar_text(record.get("key")) if record is not None else None
                keys.append(key or None)
                value = record.get("value") if values and record is not None else None
                vals.append(_json(value) if values else None)
            kind = batch.column(2)
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), batch.column(1), pc.equal(kind, "delete"), pa.array(vals, pa.string())], names=["run_id", "state_key", "seq", "dead", "val"])
            yield out.filter(pc.is_valid(out.column(1)))

    return run


def _snapshot_rows(keys: bool, values: bool = False):
    """mapInArrow function: readable snapshots' ids, or the keys of their states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, c = [], [], []
            for sid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                state = read_object(text)
                if state is None:
                    continue
                for k, v in state.items() if keys else [("", None)]:
                    a.append(sid)
                    b.append(k)
                    c.append(_json(v) if values else None)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, batch.column(0).type), pa.array(b, pa.string()), pa.array(c, pa.string())], names=["id", "state_key", "val"])

    return run


def run_bounds(snapshots: DataFrame, markers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The snapshot that each run starts from (run_id, cursor, id), and each run's bounds (run_id, cursor, last).

    The rules are those of replay(); a null bound doesn't bind.
    """
    states = snapshots.select(F.col("snapshot_id").alias("id"), identifier("run_id").alias("run_id"), "seq", "replay_cursor", "state_json").where("run_id is not null")
    readable = states.select("id", "state_json").mapInArrow(_snapshot_rows(False), "id bigint, state_key string, val string").select("id")
    best = stored(
        states.select("id", "run_id", "seq", "replay_cursor").join(readable, "id")
        .groupBy("run_id").agg(F.max(F.struct(F.coalesce("seq", F.lit(BASE)), F.coalesce("replay_cursor", F.lit(BASE)).alias("cursor"), "id")).alias("m"))
        .select("run_id", "m.cursor", "m.id"),
        "snapshots",
    )
    commits = markers.select(identifier("run_id").alias("run_id"), "last_durable_sequence").dropna().groupBy("run_id").agg(F.max("last_durable_sequence").alias("last"))
    return best, best.select("run_id", "cursor").join(commits, "run_id", "full")


def replay(envelopes: DataFrame, snapshots: DataFrame, markers: DataFrame, values: bool = False, root: str | None = None) -> DataFrame:
    """State keys of every run after its snapshot and the messages up to its committed sequence.

    Columns run_id, state_key, sequence (0 if from the snapshot), and value_json if values. The snapshot is the
    readable one with the highest seq (then the highest cursor, then the highest id; a null seq is below all); a null cursor
    lies below every sequence; a run without a non-null marker has no upper bound. Rows without run or sequence, kinds
    other than set and delete, unreadable payloads and empty keys do nothing. Empty tables are fine.
    """
    spark = envelopes.sparkSession
    states = snapshots.select(F.col("snapshot_id").alias("id"), "state_json")
    best, bounds = run_bounds(snapshots, markers)
    feed = envelopes.select(identifier("run_id").alias("run_id"), F.col("sequence").alias("seq"), identifier("op_kind").alias("kind"), F.col("payload_json").alias("payload"))
    feed = feed.where("run_id is not null and seq is not null and kind in ('set', 'delete') and payload is not null")
    feed = join_measured(feed, bounds, "run_id", "left").where("(cursor is null or seq > cursor) and (last is null or seq <= last)")
    schema = "run_id string, state_key string, seq bigint, dead boolean, val string"
    changes = feed.select("run_id", "seq", "kind", "payload").mapInArrow(_payload_changes(values), schema)
    rows = join_measured(states.select("id", "state_json"), best.select("id", "run_id"), "id")
    base = rows.select("id", "state_json").mapInArrow(_snapshot_rows(True, values), "id bigint, state_key string, val string")
    base = join_measured(base, best.select("id", "run_id"), "id").select("run_id", "state_key", F.lit(BASE).alias("seq"), F.lit(False).alias("dead"), "val")
    size = (known_size(envelopes) or 0) + (known_size(snapshots) or 0) if values else 0
    state = apply_changes(changes.unionByName(base), ["run_id", "state_key"], envelopes.count(), root, size).where("not dead")
    out = state.select("run_id", "state_key", F.when(F.col("seq") == BASE, 0).otherwise(F.col("seq")).cast("bigint").alias("sequence"), "val")
    return out.withColumnRenamed("val", "value_json") if values else out.drop("val")
