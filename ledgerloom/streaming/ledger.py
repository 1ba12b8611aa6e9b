"""Structured Streaming over the event ledger: windows with late data, once-only delivery and continuous state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import identifier
from ledgerloom.operators.changefeed import apply_changes, combine_batches
from ledgerloom.operators.onceonly import IdentifierIndex
from ledgerloom.session import _hadoop, known_size, new_path, published


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the Parquet files below path (a file or a folder)."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(folder)


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What the stream gives for the data present now, through a Parquet sink in the shared folder."""
    spark = stream.sparkSession
    out, mark = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tumbling(stream: DataFrame, time: str, size: str, delay: str, keys: list[str]) -> DataFrame:
    """Counts per window and keys; windows close when the watermark passes, later rows are dropped."""
    w = stream.withWatermark(time, delay).groupBy(F.window(time, size).alias("w"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(stream: DataFrame, time: str, gap: str, delay: str, keys: list[str]) -> DataFrame:
    """Counts per session: rows of one key no further apart than gap."""
    w = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


class LedgerState:
    """Current state under a stream of changes, as a published base and the changes of the batches since.

    Each micro-batch is reduced to one change per key and stored under its id, written over if it comes again after a
    crash. Base and batches are upserted together when the state is read, and become the new base when there are
    MAX_BATCHES of them, so a micro-batch costs its own rows. State rows re-enter as changes with their sequences,
    tombstones included: neither the order of batches nor a batch that is still there after its merge matters.
    """

    MAX_BATCHES = 8

    def __init__(self, spark: SparkSession, keys: list[str], root: str | None = None) -> None:
        self.spark, self.keys, self.root = spark, keys, root or new_path(spark, "ledger")
        self.schema = ", ".join([*(f"{k} string" for k in keys), "seq bigint", "dead boolean", "val string"])

    def _batches(self) -> list[str]:
        p, fs = _hadoop(self.spark, self.root)
        names = [s.getPath().toString() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in names if n.rpartition("/")[2].startswith("batch-") and fs.exists(_hadoop(self.spark, f"{n}/_SUCCESS")[0]))

    def _known(self, batches: list[str]) -> DataFrame:
        parts = [self.spark.read.schema(self.schema).parquet(*batches)] if batches else []
        current, fs = _hadoop(self.spark, f"{self.root}/_current")
        if fs.exists(current):
            parts.append(published(self.spark, self.root).select(*self.keys, "seq", "dead", "val"))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def apply(self, batch: DataFrame, batch_id: int | str = 0) -> None:
        clean = batch.select(*self.keys, "seq", "dead", "val").dropna(subset=[*self.keys, "seq", "dead"])
        clean.mapInArrow(combine_batches(self.keys), self.schema).write.mode("overwrite").parquet(f"{self.root}/batch-{batch_id}")
        if len(self._batches()) >= self.MAX_BATCHES:
            self.merge()

    def merge(self) -> None:
        """Makes base and batches the new base; the batches go only after it is published."""
        batches = self._batches()
        known = self._known(batches)
        apply_changes(known, self.keys, known.count(), self.root, known_size(known) or 0)
        for b in batches:
            p, fs = _hadoop(self.spark, b)
            fs.delete(p, True)

    def current(self) -> DataFrame:
        known = self._known(self._batches())
        return apply_changes(known, self.keys, known.count(), size=known_size(known) or 0).where("not dead").drop("dead")

    def follow(self, stream: DataFrame, checkpoint: str | None = None):
        """Starts the stream; awaitTermination() or stop() as usual."""
        mark = checkpoint or new_path(self.spark, "ledger-checkpoint")
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", mark).trigger(availableNow=True).start()


def surplus_stream(stream: DataFrame, index: IdentifierIndex, sink: list[DataFrame], checkpoint: str | None = None):
    """Feeds micro-batches of deliveries to the identifier index; sink gets each batch's surplus deliveries.

    A micro-batch that is run again after a crash is known by its checkpoint and number, and gives the same surplus.
    """
    mark = checkpoint or new_path(index.spark, "once-checkpoint")

    def admit(batch: DataFrame, batch_id: int) -> None:
        sink.append(index.admit(batch, [identifier("run_id"), F.col("sequence"), identifier("op_id")], "received_at", "delivery_id", f"{mark}#{batch_id}"))

    return stream.writeStream.foreachBatch(admit).option("checkpointLocation", mark).trigger(availableNow=True).start()
