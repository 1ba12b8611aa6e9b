"""References to records that do not exist, by compressed bitmaps of dictionary-encoded keys per key range and month.

Referenced keys and the months they are referred to in are reduced to one row each, lifetimes to the spans of whole
months that they cover; both meet by key. Every stretch of the joined rows is a key range: its keys get integers, and
for each month a bitmap says which of them are referred to and another which have a parent alive throughout. Bitmaps are
compressed by density: sorted 16-bit positions, runs, or plain bits. References AND NOT parents are decoded; only the
references of the keys and months left are then held against the exact lifetimes, which also gives the reason. A target
that holds a third of all references is one row of months before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import tidy

#: Keys of a range: as many as 16-bit positions can tell apart.
RANGE = 1 << 16
#: Stands for "no revision asked for" among keys.
ANY = -(2**63)
_LEFT = "target string, need bigint, months array<int>"


def _month(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.year(c) * 12 + F.month(c) - 1


@dataclass(frozen=True)
class Bitmap:
    """Positions below size, in the smallest of three forms: 'list' (sorted), 'runs' (starts, ends) or 'bits' (packed)."""

    form: str
    data: np.ndarray
    size: int

    @classmethod
    def of(cls, positions: np.ndarray, size: int) -> Bitmap:
        """positions: sorted, each once."""
        p = positions.astype("i8")
        cut = np.flatnonzero(np.diff(p) != 1)
        starts, ends = (p[np.r_[0, cut + 1]], p[np.r_[cut, len(p) - 1]]) if len(p) else (p, p)
        cost = {"list": 2 * len(p), "runs": 4 * len(starts), "bits": -(-size // 8)}
        form = min(cost, key=cost.get)
        if form == "list":
            return cls(form, p.astype("u2"), size)
        if form == "runs":
            return cls(form, np.stack([starts, ends]).astype("u2"), size)
        flags = np.zeros(size, bool)
        flags[p] = True
        return cls(form, np.packbits(flags, bitorder="little"), size)

    @property
    def nbytes(self) -> int:
        return self.data.nbytes

    def has(self, positions: np.ndarray) -> np.ndarray:
        """Which of the positions are set, found in the compressed form."""
        p = positions.astype("i8")
        if self.form == "bits":
            return (self.data[p >> 3] >> (p & 7).astype("u1") & 1).astype(bool)
        if not self.data.size:
            return np.zeros(len(p), bool)
        keys = self.data if self.form == "list" else self.data[0]
        at = np.searchsorted(keys, p, "right").astype("i8") - 1
        last = self.data if self.form == "list" else self.data[1]
        return (at >= 0) & (last[np.maximum(at, 0)] >= p)

    def positions(self) -> np.ndarray:
        if self.form == "list":
            return self.data.astype("i8")
        if self.form == "bits":
            return np.flatnonzero(np.unpackbits(self.data, count=self.size, bitorder="little"))
        starts, ends = self.data.astype("i8")
        n = ends - starts + 1
        return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(int(n.sum()))

    def and_not(self, other: Bitmap) -> Bitmap:
        p = self.positions()
        return Bitmap.of(p[~other.has(p)], self.size)


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row that each element of a list column belongs to, and the elements; null lists have none."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), n), column.flatten()


def _uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per key range (target, need, months referred to, spans of whole months alive): the months without a parent."""
    for whole in batches:
        for s in range(0, whole.num_rows, RANGE):
            b = whole.slice(s, RANGE)
            need = b.column(1).to_numpy(zero_copy_only=False)
            ref_key, ref_month = _flat(b.column(2))
            ref_month = ref_month.to_numpy(zero_copy_only=False)
            key, spans = _flat(b.column(3))
            first, last, revision = (np.asarray(spans.field(i).to_numpy(zero_copy_only=False), "i8") for i in range(3))
            enough = revision >= need[key]
            key, first, last = key[enough], first[enough], last[enough]
            keys, months = [], []
            for m in np.unique(ref_month):
                refs = Bitmap.of(np.unique(ref_key[ref_month == m]), b.num_rows)
                parents = Bitmap.of(np.unique(key[(first <= m) & (m <= last)]), b.num_rows)
                left = refs.and_not(parents).positions()
                keys.append(left)
                months.append(np.full(len(left), m, "i4"))
            if not keys:
                continue
            keys, months = np.concatenate(keys), np.concatenate(months)
            o = np.argsort(keys, kind="stable")
            named, starts = np.unique(keys[o], return_index=True)
            at = pa.array(named)
            offsets = pa.array(np.r_[starts, len(o)].astype("i4"))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.ListArray.from_arrays(offsets, pa.array(months[o]))], names=["target", "need", "months"])


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """One row per distinct orphan: ref_table, row_id, target, reason, period_month (YYYY-MM).

    refs: ref_table, row_id, target, need (revision asked for, or null), at (time). parents: node_id, revision,
    valid_from, valid_to (null = open). An orphan's target has no lifetime with valid_from <= at < valid_to: 'deleted'
    if one ended by then, else 'late' if the node exists at all, else 'missing'. Where it lives but need exceeds the
    highest revision alive (null = 0), the reason is 'missing_revision'. References without target or time are none;
    parents without valid_from are known but never alive. Repeated rows change nothing; empty tables are fine.
    """
    clean = refs.select("ref_table", "row_id", "target", F.coalesce(F.col("need").cast("bigint"), F.lit(ANY)).alias("need"), "at", _month("at").alias("month")).dropna(subset=["target", "at"])
    lives = parents.select("node_id", F.coalesce("revision", F.lit(0)).cast("bigint").alias("revision"), "valid_from", "valid_to").dropna(subset=["node_id"])
    cells = clean.groupBy("target", "need").agg(F.collect_set("month").alias("months"))
    #: Months that a lifetime covers from their first to their last moment; at most one row per node and pair of months.
    first = _month("valid_from") + F.when(F.date_trunc("month", "valid_from") < F.col("valid_from"), 1).otherwise(0)
    last = F.coalesce(_month("valid_to") - 1, F.lit(2**31 - 1))
    spans = lives.where("valid_from is not null").select("node_id", first.cast("bigint").alias("f"), last.cast("bigint").alias("l"), "revision").where("f <= l")
    spans = spans.groupBy("node_id", "f", "l").agg(F.max("revision").alias("revision")).groupBy("node_id").agg(F.collect_list(F.struct("f", "l", "revision")).alias("spans"))
    known = cells.join(spans, F.col("target") == F.col("node_id"), "left").select("target", "need", "months", F.coalesce("spans", F.array().cast("array<struct<f:bigint,l:bigint,revision:bigint>>")).alias("spans"))
    doubtful = known.mapInArrow(_uncovered, _LEFT).toDF("target", "asked", "months")
    checked = clean.join(doubtful, "target").where("need = asked and array_contains(months, month)").select("ref_table", "row_id", "target", "need", "at")
    ends = lives.groupBy(F.col("node_id").alias("target")).agg(F.min("valid_to").alias("ended"))
    l = lives.where("valid_from is not null").select(F.col("node_id").alias("n"), "revision", "valid_from", "valid_to")
    at = F.col("at")
    then = (F.col("target") == F.col("n")) & (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))
    dated = checked.join(ends.withColumn("known", F.lit(True)), "target", "left").join(l, then, "left")
    flags = dated.groupBy("ref_table", "row_id", "target", "need", "at").agg(F.max("revision").alias("revision"), F.max(F.col("ended") <= at).alias("ended"), F.max("known").alias("known"))
    dead = F.col("revision").isNull()
    reason = F.when(dead & F.coalesce("ended", F.lit(False)), "deleted").when(dead & F.col("known"), "late").when(dead, "missing").when(F.col("need") > F.col("revision"), "missing_revision")
    return flags.select("ref_table", "row_id", "target", reason.alias("reason"), F.date_format("at", "yyyy-MM").alias("period_month")).where("reason is not null").distinct()


def _named(c: str) -> Column:
    """The reference in a target that isn't blank; a bare ./ names nothing, as the empty string, and is an orphan."""
    return F.when(tidy(c) != "", F.regexp_replace(tidy(c), r"^\./", ""))


def collect_references(links: DataFrame, frontmatter: DataFrame) -> DataFrame:
    """The three kinds of references as rows of orphan_references; null and blank targets have no target."""
    none = F.lit(None).cast("bigint")
    a = links.select(F.lit("impact_links").alias("ref_table"), F.col("link_id").alias("row_id"), _named("target").alias("target"), none.alias("need"), F.col("seen_at").alias("at"))
    b = frontmatter.select(F.lit("doc_requires").alias("ref_table"), "row_id", F.explode("doc_requires").alias("t"), F.col("published_at").alias("at"))
    c = frontmatter.select(F.lit("doc_reviewed_as_of").alias("ref_table"), "row_id", F.explode("doc_reviewed_as_of").alias("t", "need"), F.col("published_at").alias("at"))
    b = b.select("ref_table", "row_id", _named("t").alias("target"), none.alias("need"), "at")
    c = c.select("ref_table", "row_id", _named("t").alias("target"), F.col("need").cast("bigint").alias("need"), "at")
    return a.unionByName(b).unionByName(c)
