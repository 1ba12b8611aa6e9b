"""Evaluation texts inside corpus documents, by template windows and a check of their slots.

Items and documents are reduced to words in a normal form (no hidden characters, no accents, no line-break hyphens, no
case). Words are canonicalised: numbers, names, units and months become typed placeholders, so windows of template
words also meet where a question was re-parameterised. Windows are hash-joined by template alone. A document whose
windows cover enough of an item is aligned with it by template words, and the slots of the aligned words are compared
word by word: equal ones are the item's own words, others are altered, consistently if the same word of the item always
became the same word. A document holds the item if enough of the item's words are there as its own and few of the words
between them are altered, consistent slots aside.

A window is as long as the shortest block that counts and the cover asked for before alignment is the share asked for
after it, so no pair that alignment would accept is lost before it. The set of items is read against all documents in
blocks of a fixed number of items, whose index goes to the executors; documents are read once per block, never shuffled,
whole, and no window or partner is capped.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache, reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a window, and of the shortest block of aligned words that counts: fewer meet by chance.
WINDOW = 3
#: Share of an item's words that must stand in the document; altered words are among those that needn't.
SHARE = 0.40
#: Share of the words between the first and the last aligned one, consistent slots aside, that must be the item's own.
DENSITY = 2 / 3
#: Share of an item's words under aligned template words from which a re-parameterised copy is reported, with however
#: few words of its own.
TEMPLATE_COVER = 0.60
#: Items of one index; further items are another pass over the documents.
ITEMS_PER_BLOCK = 10_000

# Words of units (SI and those used with it, time, information, currencies of ISO 4217) in the singular,
# and of months.
_UNITS = """
second minute hour day week month year decade metre meter kilometre kilometer centimetre centimeter millimetre millimeter
mile yard foot inch litre liter millilitre milliliter gallon gram kilogram milligram tonne ton pound ounce kelvin degree
ampere volt watt kilowatt joule newton pascal hertz ohm mole candela percent bit byte kilobyte megabyte gigabyte terabyte
dollar euro cent yen rupee franc krona krone peso rouble yuan won rand lira real shilling
s ms min h km cm mm m kg g mg l ml kb mb gb tb kwh hz khz mhz ghz
"""
MONTHS = frozenset("january february march april may june july august september october november december".split())
UNITS = frozenset(x for w in _UNITS.split() for x in (w, f"{w}s" if len(w) > 3 else w, {"foot": "feet", "inch": "inches"}.get(w, w)))

_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_WRAP = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_NAME, _NUM, _UNIT, _MONTH = 1, 2, 3, 4
_FIRST = 5


def normal(text: str) -> str:
    """Hidden characters, accents, compatibility forms and line-break hyphens removed; case is kept."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _HIDDEN.sub("", text))
        if not text.isascii():
            text = "".join(c for c in text if not unicodedata.combining(c))
    return _WRAP.sub("", text) if "-" in text else text


def words(text: str) -> list[str]:
    return _WORD.findall(normal(text).lower())


def _names(texts: list[str]) -> set[str]:
    """Words that stand capitalised within a sentence and never in lower case."""
    upper, lower = set(), set()
    for t in texts:
        n = normal(t)
        for m in _WORD.finditer(n):
            w = m.group()
            if w[0].isupper():
                before = n[: m.start()].rstrip(" \t\n\"'(“‘")
                if before and before[-1] not in ".?!:":
                    upper.add(w.lower())
            else:
                lower.add(w)
    return upper - lower - MONTHS


@lru_cache(1 << 16)
def _fixed(word: str) -> int:
    """The placeholder of a word whatever its case, or 0."""
    return _MONTH if word in MONTHS else _UNIT if word in UNITS else _NUM if any(map(str.isdigit, word)) else 0


def _template(word: str, number: int, names: set[str]) -> int:
    """The placeholder of an item's word, or its own number."""
    return _fixed(word) or (_NAME if word in names else number)


def _hash(ids: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Hash of each window of so many ids."""
    n = max(len(ids) - size + 1, 0)
    h = np.full(n, size, "u8")
    for k in range(size):
        h = (h ^ (ids[k : k + n].astype("u8") + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Hit:
    item_id: int
    verdict: str
    share: float


class LeakIndex:
    """Template windows of a block of items; built on the driver, used by every task."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        items = sorted((i, t) for i, t in items if t and words(t))
        self.ids = np.array([i for i, _ in items], "i8")
        names = _names([t for _, t in items])
        split = [words(t) for _, t in items]
        self.raw: dict[str, int] = {}
        self.template: dict[str, int] = {}
        for w in (w for s in split for w in s):
            if w not in self.raw:
                n = self.raw[w] = _FIRST + len(self.raw)
                self.template[w] = _template(w, n, names)
        self.kinds = np.array([0] * _FIRST + [self.template[w] for w in self.raw], "i8")
        self.words = [[self.raw[w] for w in s] for s in split]
        self.lengths = np.array([len(w) for w in self.words], "i8")
        t, item, pos = [np.empty(0, "u8")], [np.empty(0, "i8")], [np.empty(0, "i8")]
        for i, w in enumerate(self.words):
            if len(w) >= WINDOW:
                t.append(_hash(self.kinds[w]))
                item.append(np.full(len(t[-1]), i))
                pos.append(np.arange(len(t[-1])))
        t, item, pos = map(np.concatenate, (t, item, pos))
        o = np.argsort(t, kind="stable")
        self.t, self.item, self.pos = t[o], item[o], pos[o]
        self.templates = np.unique(self.t)
        #: Items shorter than a window, by the hash of all their words.
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, w in enumerate(self.words):
            if len(w) < WINDOW:
                self.short.setdefault(len(w), {}).setdefault(int(_hash(np.array(w), len(w))[0]), []).append(i)

    def _ids(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """The item words' numbers, 0 for others; the placeholders of other words, 0 for the rest; and numbers that
        tell the words behind the placeholders apart."""
        n = normal(text)
        low = _WORD.findall(n.lower())
        get = self.raw.get
        r = [get(w, 0) for w in low]
        found = _WORD.findall(n)
        if len(low) != len(found):  # letters whose lower case falls apart
            found = low
        kinds = [0 if x else _fixed(w) or (_NAME if f[0].isupper() else 0) for x, w, f in zip(r, low, found)]
        return r, kinds, [-crc32(w.encode()) - 1 if k else x for w, k, x in zip(low, kinds, r)]

    def search(self, texts: list[str | None], reports: bool = False) -> list[list[Hit]]:
        """Hits of each text; if reports, also copies whose template covers the item but whose words are too few."""
        out: list[list[Hit]] = [[] for _ in texts]
        if not len(self.ids):
            return out
        rs, others, surface, starts, at = [], [], [], [], 0
        for x in texts:
            r, kinds, seen = self._ids(x) if x else ([], [], [])
            starts.append(at)
            rs += r
            rs.append(0)  # no window spans two texts
            others += kinds
            others.append(0)
            surface += seen
            surface.append(0)
            at += len(r) + 1
        raw, surface = np.array(rs, "i8"), np.array(surface, "i8")
        tem = self.kinds[raw] + np.array(others, "i8")
        starts = np.array(starts)
        for size, of in self.short.items():
            h = _hash(raw, size)
            at = np.flatnonzero(np.isin(h, np.fromiter(of, "u8")))
            for d, i in sorted({(int(np.searchsorted(starts, p, "right")) - 1, i) for p in at.tolist() for i in of[int(h[p])]}):
                out[d].append(Hit(int(self.ids[i]), "leaked", 1.0))
        if len(raw) < WINDOW or not len(self.t):
            return out
        th = _hash(tem)
        at = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(tem, WINDOW).all(axis=1))
        k = np.minimum(np.searchsorted(self.templates, th[at]), len(self.templates) - 1)
        at = at[self.templates[k] == th[at]]
        dpos, which = _expand(self.t, th[at], at)  # the hash join of template windows
        doc = np.searchsorted(starts, dpos, "right") - 1
        for d, i, dp, ip in _groups(doc, self.item[which], dpos, self.pos[which], self.lengths * SHARE / WINDOW):
            hit = self._aligned(i, dp, ip, surface, tem, starts[d], starts[d + 1] if d + 1 < len(starts) else len(raw), reports)
            if hit:
                out[d].append(hit)
        return out

    def _aligned(self, i: int, dp: np.ndarray, ip: np.ndarray, surface: np.ndarray, tem: np.ndarray, first: int, end: int, reports: bool) -> Hit | None:
        """The best verdict on item i in the regions of one document."""
        n, item = int(self.lengths[i]), self.words[i]
        template = self.kinds[item].tolist()
        best, reported = (0.0, ""), 0.0
        for a, b, p in _regions(dp, ip, n):
            if _cover(p, n) < SHARE * n:
                continue
            s = slice(max(first, a - n // 2), min(end, b + WINDOW + n // 2))
            words, kinds = surface[s].tolist(), tem[s].tolist()
            same = [m for m in SequenceMatcher(None, template, kinds, autojunk=False).get_matching_blocks() if m.size >= WINDOW]
            if not same:
                continue
            pairs = [(item[m.a + k], words[m.b + k]) for m in same for k in range(m.size)]
            own = sum(x == y for x, y in pairs)
            slots = _consistent([(x, y) for x, y in pairs if x != y])
            stretch = same[-1].a + same[-1].size - same[0].a
            if own >= SHARE * n and own >= DENSITY * (stretch - slots):
                best = max(best, (own / n, "leaked" if own >= DENSITY * stretch else "re-parameterised"))
            elif len(pairs) >= TEMPLATE_COVER * n and own + slots >= DENSITY * len(pairs):
                reported = max(reported, len(pairs) / n)
        if best[0]:
            return Hit(int(self.ids[i]), best[1], round(best[0], 4))
        return Hit(int(self.ids[i]), "re-parameterised", round(reported, 4)) if reports and reported else None


def _consistent(slots: list[tuple[int, int]]) -> int:
    """How many of the altered slots (item's word, document's word) became what the item's word became most often."""
    became: dict[int, Counter] = {}
    for x, y in slots:
        became.setdefault(x, Counter())[y] += 1
    return sum(max(c.values()) for c in became.values())


def _expand(sorted_keys: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its values repeated, and the positions of its equals in sorted_keys."""
    a, b = np.searchsorted(sorted_keys, keys, "left"), np.searchsorted(sorted_keys, keys, "right")
    n = b - a
    ends = np.cumsum(n)
    which = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(a, n)
    return np.repeat(values, n), which


def _groups(doc: np.ndarray, item: np.ndarray, dpos: np.ndarray, ipos: np.ndarray, least: np.ndarray) -> Iterator[tuple]:
    """Hits by document and item, where there are as many as the least cover of the item takes."""
    if not len(doc):
        return
    o = np.lexsort((dpos, item, doc))
    doc, item, dpos, ipos = doc[o], item[o], dpos[o], ipos[o]
    s = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(item) != 0)])
    e = np.r_[s[1:], len(doc)]
    enough = e - s >= least[item[s]]
    for a, b in zip(s[enough].tolist(), e[enough].tolist()):
        yield int(doc[a]), int(item[a]), dpos[a:b], ipos[a:b]


def _regions(dp: np.ndarray, ip: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Stretches of the document near each other: at most twice the item's length and a little, overlapping by half."""
    span = 2 * n + 20
    start = int(dp[0])
    while True:
        a, b = np.searchsorted(dp, start), np.searchsorted(dp, start + span, "right")
        yield int(dp[a]), int(dp[b - 1]), ip[a:b]
        if b >= len(dp):
            return
        start = max(int(dp[np.searchsorted(dp, start + span // 2)]), int(dp[a]) + 1)


def _cover(ipos: np.ndarray, n: int) -> int:
    hit = np.zeros(n, bool)
    for k in range(WINDOW):
        hit[np.minimum(ipos + k, n - 1)] = True
    return int(hit.sum())


def find_leaks(documents: DataFrame, items: DataFrame, reports: bool = False) -> DataFrame:
    """doc_id, item_id, verdict, share: items of which documents hold at least SHARE of the words, in order and near.

    Null and empty texts and items have no rows; items of fewer words than a window count where they stand whole;
    repeated rows of a document give repeated rows; items of one id are searched each. verdict is re-parameterised where
    too many words are altered but for consistent slots. reports adds documents with fewer of the words, where template
    words are aligned with TEMPLATE_COVER of the item and the slots are consistent; their share is that cover. Extra
    columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text")
    picked = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").dropna().orderBy("item_id")
    schema = "doc_id bigint, item_id bigint, verdict string, share double"
    blocks, block = [], []
    for r in picked.toLocalIterator():  # one block of items at a time
        block.append((r.item_id, r.text))
        if len(block) == ITEMS_PER_BLOCK:
            blocks.append(spark.sparkContext.broadcast(LeakIndex(block)))
            block = []
    if block or not blocks:
        blocks.append(spark.sparkContext.broadcast(LeakIndex(block)))

    def search(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for s in range(0, whole.num_rows, 500):
                    b = whole.slice(s, 500)
                    ids = b.column(0).to_pylist()
                    rows = [(d, h.item_id, h.verdict, h.share) for d, hits in zip(ids, index.value.search(b.column(1).to_pylist(), reports)) for h in hits]
                    cols = list(zip(*rows)) or [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.float64()))], names=["doc_id", "item_id", "verdict", "share"])

        return run

    return reduce(DataFrame.unionByName, [docs.mapInArrow(search(x), schema) for x in blocks])
