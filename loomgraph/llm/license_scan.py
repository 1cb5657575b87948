"""License scan: winnowed fingerprints pick candidates, local alignment confirms them.

Words are runs of letters and digits, ASCII lower-cased.  Templates and documents are
fingerprinted alike: hashes of ``K`` words, of which each window of ``W`` keeps its
least, so that any common run of ``W + K - 1`` words shares a fingerprint at the same
place.  A template too short for a window keeps all its hashes, and such templates'
hashes are probed in full, so that none is missed.  The templates' fingerprints form a
small inverted index (its size depends on the templates alone); the document's words
around a hit, wide enough for any alignment through it, are aligned with the template.
The alignment is local and has no band: words added, left out or changed anywhere cost a
point each and matched words give two, so that parts before and after a change join.  A
passage is reported when its matched words cover ``coverage`` of the template; of
overlapping reports for one document the one with more matched words stays.

A notice of which no K words in a row are left as they were has no fingerprint in common
with its template and is not found.

Defined results: null or empty text has no rows; a template found twice in a document
gives a row for each place; of overlapping reports with equally many matched words the
template that comes first in the list stays; rows may repeat, and each has its reports;
very long texts are scanned whole, and only the words around hits are aligned; a null doc_id
is returned as it is; an empty table gives no rows; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tuned
from .hashing import BASE, buffers, mix, slices, sliding_min, words
from .license_templates import TEMPLATES

K, W = 3, 4
MATCH, MISMATCH, SKIP = 2, -1, -1
#: A point of score and a matched word in an alignment's cell; below them is the first word.
POINT, WORD = 1 << 42, 1 << 21
#: What separates words: every byte that is no ASCII letter or digit and no part of a longer character.
GAPS = np.ones(256, bool)
GAPS[48:58] = GAPS[65:91] = GAPS[97:123] = GAPS[128:] = False
SCHEMA = "doc_id long, template string, license string, coverage double, matched int, span_start int, span_end int"


def grams(h: np.ndarray, k: int = K) -> np.ndarray:
    n = max(0, len(h) - k + 1)
    acc = np.zeros(n, np.uint64)
    for i in range(k):
        acc = acc * BASE + h[i : i + n]
    return mix(acc)


class Templates:
    def __init__(self, templates: list[tuple[str, str, str]] = TEMPLATES):
        self.names = [(t, x) for t, x, _ in templates]
        self.words, keys, owner, place = [], [], [], []
        for t, (_, _, text) in enumerate(templates):
            raw = np.frombuffer(text.encode(), np.uint8)
            h, *_ = words(raw, np.array([0, len(raw)]), gaps=GAPS)
            self.words.append(h)
            g = grams(h) if len(h) >= K else np.zeros(0, np.uint64)
            least = set(sliding_min(g, W).tolist()) if len(g) >= 2 * W else set(g.tolist())
            for i, x in enumerate(g.tolist()):
                if x in least:
                    keys.append(x)
                    owner.append(t)
                    place.append(i)
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.keys = np.array(keys, np.uint64)[order]
        self.owner, self.place = np.array(owner)[order], np.array(place)[order]

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document place, template, template place) of each shared fingerprint."""
        lo, hi = np.searchsorted(self.keys, g, "left"), np.searchsorted(self.keys, g, "right")
        at = np.flatnonzero(hi > lo)
        n = hi[at] - lo[at]
        spot = np.repeat(lo[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(at) else at
        return np.repeat(at, n), self.owner[spot], self.place[spot]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of a document's words ``a`` with a template's ``b``, without a band:
    (matched words, first and last + 1 aligned word of ``a``)."""
    at = np.arange(len(a))
    # a cell holds score, matched words and first word in one number; 0: no alignment ends here
    lift = at * POINT
    cell, before = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    best, end = 0, 0
    for w in b:
        before[1:] = cell[:-1]
        step = np.where(before, before, at) + np.where(a == w, MATCH * POINT + WORD, MISMATCH * POINT)
        step = np.maximum(step, cell + SKIP * POINT)  # a template word is skipped
        step[step < POINT] = 0
        cell = np.maximum.accumulate(step - SKIP * lift) + SKIP * lift  # document words are skipped
        cell[cell < POINT] = 0
        i = int(cell.argmax())
        if cell[i] // POINT > best // POINT:
            best, end = int(cell[i]), i + 1
    return best % POINT // WORD, best % WORD, end


def passages(a: np.ndarray, b: np.ndarray, coverage: float) -> list[tuple[int, int, int]]:
    """(matched words, first and last + 1 word of ``a``) of the alignments that cover the template
    and do not overlap, best first."""
    found, rest = [], [(0, len(a))]
    while rest:
        lo, hi = rest.pop()
        # words of the template that are there at all bound the matched words from above
        if np.isin(b, a[lo:hi]).sum() < coverage * len(b):
            continue
        matched, x, y = align(a[lo:hi], b)
        if y and matched / len(b) >= coverage:
            found.append((matched, lo + x, lo + y))
        if y:
            rest += [(lo, lo + x), (lo + y, hi)]
    return found


def scan_words(h: np.ndarray, hits: list[tuple[int, int, int]], templates: Templates, coverage: float) -> list[tuple[int, int, float, int, int]]:
    """(template, matched, coverage, first, last + 1 word) for one document's words and hits."""
    by: dict[int, set[int]] = {}
    for at, t, _ in hits:
        # a score above zero keeps an alignment below thrice the template's words, so that it
        # lies whole in one of the windows of twice that, of which each starts in the last's middle
        k = at // (3 * len(templates.words[t]))
        by.setdefault(t, set()).update((k, max(0, k - 1)))
    found = set()
    for t, windows in by.items():
        n = len(templates.words[t])
        for k in windows:
            for matched, lo, hi in passages(h[3 * n * k : 3 * n * (k + 2)], templates.words[t], coverage):
                found.add((t, matched, matched / n, 3 * n * k + lo, 3 * n * k + hi))
    kept: list = []
    for x in sorted(found, key=lambda x: (-x[1], -x[2], x[3], x[0])):
        if not any(x[3] < y[4] and y[3] < x[4] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: (x[3], x[0]))


def license_scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, coverage: float = 0.75) -> DataFrame:
    """A row for each license passage: template, license, share of the template's words
    that match, matched words, and the passage's byte span in the text."""
    spark = docs.sparkSession
    tuned(spark)
    shared = spark.sparkContext.broadcast(Templates(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            buf, offsets = buffers(b.column(1))
            for i, j in slices(offsets):
                h, start, end, doc = words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], gaps=GAPS)
                g = grams(h) if len(h) >= K else np.zeros(0, np.uint64)
                at, owner, place = t.hits(g)
                inside = doc[at] == doc[at + K - 1] if len(at) else np.zeros(0, bool)
                at, owner, place = at[inside], owner[inside], place[inside]
                first = np.searchsorted(doc, np.arange(j - i + 1))
                for d in np.unique(doc[at]).tolist():
                    mine = np.flatnonzero(doc[at] == d)
                    lo, hi = int(first[d]), int(first[d + 1])
                    hits = list(zip((at[mine] - lo).tolist(), owner[mine].tolist(), place[mine].tolist(), strict=True))
                    begin = offsets[i + d] - offsets[i]
                    for k, matched, share, x, y in scan_words(h[lo:hi], hits, t, coverage):
                        rows.append((ids[i + d], *t.names[k], share, matched, int(start[lo + x] - begin), int(end[lo + y - 1] - begin)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "template", "license", "coverage", "matched", "span_start", "span_end"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA)
