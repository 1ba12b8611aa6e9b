"""Reading level of documents by smoothed unigram language models, one per level.

The models are trained on the labelled documents (the level most raters chose) or, for levels nobody labelled, on
documents that a reading formula places there. A sentence's likelihood under a level is that of its words; a document's
is the product over its sentences, in which each sentence's evidence is bounded, as a document may hold some sentences
of another level. The level with the highest posterior is assigned.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import identifier
from ledgerloom.session import join_measured

LEVELS = ("basic", "intermediate", "advanced")
#: Labelled documents used for training at most, by the order of a hash of their ids.
MAX_LABELLED = 20_000
#: Words of running prose below which a document gets no level.
LEAST_WORDS = 40
#: Share of a level's model that is the mixture of all levels, and pseudo-counts of a word never seen.
MIXED, UNSEEN = 0.05, 0.5
#: Bound of one sentence's evidence, as log odds.
BOUND = 3.0
# Words per sentence and letters per word between the levels, for seeding only.
SEED_LIMITS = (60.0, 120.0)

_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
_FRONT = re.compile(r"\A﻿?\s*---[ \t]*\r?\n.*?^(?:---|\.\.\.)[ \t]*\r?$", re.M | re.S)
_INLINE = re.compile(r"`[^`\n]*`|<[^<>\n]{1,200}>|https?://\S+")
#: Headings, lists, tables, rules and indented code.
_OTHER = re.compile(r"^(?:[ \t]{0,3}#{1,6}(?:[ \t].*)?|[ \t]*(?:[-*+•]|\d{1,4}[.)])[ \t].*|[ \t]*\|.*|.*\|[ \t]*|[ \t]*[-=*_]{3,}[ \t]*|(?: {4}|\t).*)$", re.M)
_SETEXT = re.compile(r"^[^\n]+\n(?:={3,}|-{3,})[ \t]*$", re.M)
#: Ends of sentences: a stop before a capital, an empty line, or a line that begins with a capital.
_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[\"'(\[]?[A-Z])|\n\s*\n|\n(?=[A-Z])")
_WORD = re.compile(r"[a-z]+(?:['’-][a-z]+)*")


def english(lang) -> F.Column:
    """lang denotes English: en, eng or english in any spelling, also with a region."""
    return F.coalesce(F.regexp_like(identifier(lang), F.lit(r"^(en|eng|english)([-_ ].*)?$")), F.lit(False))


def prose(text: str) -> str:
    """The running prose of a Markdown text."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "---" in text[:200]:
        text = _FRONT.sub("\n\n", text)
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "===" in text or "---" in text:
        text = _SETEXT.sub("\n\n", text)
    text = _OTHER.sub("\n", text)
    return _INLINE.sub(" ", text)


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence of the running prose of a text."""
    return [w for s in _END.split(prose(text)) if (w := _WORD.findall(s.lower()))]


def difficulty(split: list[list[str]]) -> float:
    """Words per sentence times letters per word."""
    n = sum(map(len, split))
    return n / max(len(split), 1) * sum(len(w) for s in split for w in s) / max(n, 1)


class LevelModel:
    """Log likelihoods of words per level, less those under the mixture of all levels."""

    def __init__(self, counts: dict[str, np.ndarray], documents: np.ndarray) -> None:
        table = np.array([counts[w] for w in counts]).reshape(-1, len(LEVELS)).astype(float)
        self.index = {w: i for i, w in enumerate(counts)}
        share = (table + UNSEEN) / (table.sum(axis=0) + UNSEEN * (len(table) + 1))
        mixture = share.mean(axis=1, keepdims=True)
        gain = np.log((1 - MIXED) * share + MIXED * mixture) - np.log(mixture)
        self.gain = np.vstack([gain, np.zeros((1, len(LEVELS)))])  # a word in no model speaks for none
        self.prior = np.log((documents + 1) / (documents + 1).sum())

    def levels(self, docs: list[list[list[str]]]) -> np.ndarray:
        """Posterior log probabilities of each document (a list of sentences)."""
        flat = [w for d in docs for s in d for w in s]
        ids = np.fromiter(map(self.index.get, flat, repeat(len(self.index))), "i8", len(flat))
        counts = np.array([len(s) for d in docs for s in d], "i8")
        out = np.tile(self.prior, (len(docs), 1))
        if len(counts):
            begin = np.cumsum(counts) - counts
            score = np.add.reduceat(self.gain[ids], begin, axis=0)
            score -= np.logaddexp.reduce(score, axis=1, keepdims=True)
            score = np.maximum(score, -BOUND)
            np.add.at(out, np.repeat(np.arange(len(docs)), [len(d) for d in docs]), score)
        return out - np.logaddexp.reduce(out, axis=1, keepdims=True)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(level, text) to (level, word, n), summed per batch; word '' counts documents."""
    for b in batches:
        total: dict[tuple[int, str], int] = {}
        for level, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            split = sentences(text or "")
            if level is None:
                d = difficulty(split)
                level = sum(d > x for x in SEED_LIMITS)
            for w in chain([""], *split):
                total[level, w] = total.get((level, w), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["level", "word", "n"])


def train(documents: DataFrame, labels: DataFrame) -> LevelModel:
    """Models from at most MAX_LABELLED labelled documents; levels without any are seeded by the formula from all
    documents in English.

    A document's label is the level most of its ratings name (repeated ratings of a rater count once); ties and
    ratings of other names are left out. Without any documents all levels are alike and the prior decides.
    """
    rated = labels.select("doc_id", "rater", identifier("reading_level").alias("r")).where(F.col("r").isin(*LEVELS) & F.col("doc_id").isNotNull()).distinct()
    votes = rated.groupBy("doc_id").agg(*(F.count(F.when(F.col("r") == x, 1)).alias(x) for x in LEVELS))
    most = F.greatest(*LEVELS)
    one = sum(((F.col(x) == most).cast("int") for x in LEVELS), F.lit(0)) == 1
    level = F.coalesce(*(F.when(F.col(x) == most, i) for i, x in enumerate(LEVELS)))
    chosen = votes.where(one).select("doc_id", level.alias("level")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    text = documents.select("doc_id", "text").where("text is not null")
    got = join_measured(text, chosen, "doc_id").select("level", "text").mapInArrow(_counts, "level int, word string, n bigint")
    rows = got.groupBy("level", "word").agg(F.sum("n").alias("n")).collect()  # words of a bounded sample
    missing = set(range(len(LEVELS))) - {r.level for r in rows}
    if missing:
        every = documents.where(english("lang") & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
        seeds = every.select(F.lit(None).cast("int").alias("level"), "text").mapInArrow(_counts, "level int, word string, n bigint")
        rows += seeds.where(F.col("level").isin(*missing)).groupBy("level", "word").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        counts.setdefault(r.word, np.zeros(len(LEVELS)))[r.level] += r.n
    return LevelModel(counts, counts.pop("", np.zeros(len(LEVELS))))


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, reading_level, confidence (posterior), words of documents in English with at least LEAST_WORDS of prose.

    Null and short texts and other languages have no row; repeated rows of a document give repeated rows.
    """
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 500):
                b = whole.slice(s, 500)
                split = [sentences(t) for t in b.column(1).to_pylist()]
                n = np.array([sum(map(len, d)) for d in split])
                post = model.value.levels(split)
                keep = np.flatnonzero(n >= LEAST_WORDS)
                best = post.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(keep)), pa.array([LEVELS[i] for i in best[keep]], pa.string()), pa.array(np.exp(post[keep, best[keep]])), pa.array(n[keep].astype("i8"))], names=["doc_id", "reading_level", "confidence", "words"]
                )

    docs = documents.where(english("lang") & F.col("text").isNotNull()).select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id bigint, reading_level string, confidence double, words bigint")
