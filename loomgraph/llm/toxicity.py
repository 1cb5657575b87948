"""Toxicity by maximum-scoring segments.

Each word (a run of letters, ASCII lower-cased) has a log-odds of toxic against clean
training documents under an informative Dirichlet prior, whose pseudo-counts follow the
word's frequency in *all* documents.  Words with a significant positive log-odds form
the lexicon, every other word has one small negative score, and a linear-time scan finds
all maximal-scoring segments of a document.  Extreme-value statistics turn a segment's
score into the log of an expected count; what exceeds chance is summed over a document's
significant segments, and a logistic curve fitted on the training documents gives the
score.

Bound: ``max_train`` labelled documents (chosen by a hash of doc_id) fit the lexicon and the
curve.  Every word whose counts in them are significant is a candidate, and everything else
covers all rows.

Defined results: null or empty text has no segment and gets the score of a document
without one; without labels every score is 0.5; a doc_id that is labelled twice is toxic if
one label says so; rows may repeat, each is scored on its own text, and equal texts get
equal scores; a very long text is scanned whole, with one slice's memory; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tuned, written
from .hashing import NOT_LETTER, buffers, slices, words

MAX_TRAIN = 20_000
PRIOR = 50.0
#: Least signed root of the likelihood ratio, and least log-odds, of a word in the lexicon.
LEAST_ROOT = 5.0
LEAST_ODDS = 3.0
GAP = -0.1
MOST = 8.0
SIGNIFICANT = 0.05
SEGMENTS = "doc_id long, held_out boolean, score double, predicted int, segments array<struct<start:int,end:int,score:double,log_expected:double>>"


@dataclass
class Model:
    keys: np.ndarray
    scores: np.ndarray
    rate: float
    weights: tuple[float, float]


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def segments(at: np.ndarray, score: np.ndarray, gap: float = GAP) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first hit, last hit, score) of positive scores at the
    token positions ``at``, with ``gap`` for every token between, in linear time."""
    found: list[tuple[int, int, float, float]] = []  # first, last, sum to the left of it, sum up to its end
    total, last = 0.0, None
    for i, (p, s) in enumerate(zip(at.tolist(), score.tolist(), strict=True)):
        if last is not None:
            total += gap * (p - last - 1)
        last = p
        now = (i, i, total, total + s)
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j -= 1
            if j < 0 or found[j][3] >= now[3]:
                found.append(now)
                break
            now = (found[j][0], i, found[j][2], now[3])
            del found[j:]
    return [(a, b, right - left) for a, b, left, right in found]


def hits(text: pa.Array, keys: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of documents: its range, words per document, and for each word found
    in ``keys``: document, word number within it, index of the key, byte start and end."""
    buf, offsets = buffers(text)
    for i, j in slices(offsets):
        h, start, end, doc = words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], gaps=NOT_LETTER)
        count = np.bincount(doc, minlength=j - i)
        if len(keys):
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            at = np.flatnonzero(keys[k] == h)
        else:
            k, at = np.zeros(len(h), np.int64), np.zeros(0, np.int64)
        first = np.concatenate(([0], np.cumsum(count)))
        begin = offsets[i:j] - offsets[i]
        yield i, j, count, np.stack((doc[at], at - first[doc[at]], k[at])), start[at] - begin[doc[at]], end[at] - begin[doc[at]], first


def _long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    spark = docs.sparkSession
    tuned(spark)
    labels = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    sample = labels.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # a table of max_train rows at most; copies of one text count once
    train = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    train = train.groupBy(F.xxhash64("text").alias("_h")).agg(F.first("text").alias("text"), F.max("_toxic").alias("_toxic")).select("text", "_toxic")
    train = written(train.repartition(max(1, max_train // 500), F.xxhash64("text")), "training")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b.column(1).to_numpy(zero_copy_only=False)
            buf, offsets = buffers(b.column(0))
            for i, j in slices(offsets):
                h, _, _, doc = words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], gaps=NOT_LETTER)
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                keep = np.ones(len(h), bool)
                keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, y = h[keep], toxic[i:j][doc[keep]]
                keys, at, n = np.unique(h, return_index=True, return_counts=True)
                bad = np.add.reduceat(y, at) if len(at) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(_long(keys)), pa.array(bad.astype(np.int64)), pa.array(n.astype(np.int64))], ["h", "bad", "n"])

    n_bad, n_all = train.agg(F.coalesce(F.sum("_toxic"), F.lit(0)), F.count("*")).first()
    rows = train.mapInArrow(count, "h long, bad long, n long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    # the words whose counts alone can make the lexicon: their number is bounded by the training sample
    rows = rows.where(f"bad >= 3 and bad * {max(1, n_all)} > n * {n_bad}").where(_least_root(n_bad, n_all)).toPandas()
    rows["h"] = rows["h"].to_numpy(np.int64).view(np.uint64)
    rows = rows.sort_values("h")
    keys = rows["h"].to_numpy(np.uint64)
    y_bad, y_all = rows["bad"].to_numpy(float), rows["n"].to_numpy(float)

    # the background: in how many of all documents, and how often, each candidate is found
    shared = spark.sparkContext.broadcast(keys)

    def background(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        seen, often, n_docs, n_words = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), 0, 0
        for b in batches:
            for i, j, count, found, *_ in hits(b.column(0), keys):
                often += np.bincount(found[2], minlength=len(keys))
                pair = np.unique(found[0] * max(1, len(keys)) + found[2])
                seen += np.bincount(pair % max(1, len(keys)), minlength=len(keys))
                n_docs += j - i
                n_words += int(count.sum())
        at = np.flatnonzero(often)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n_docs)), pa.array(np.append(often[at], n_words))], ["k", "docs", "words"])

    table = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(background, "k long, docs long, words long")
    table = table.groupBy("k").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).toPandas().set_index("k")
    n_docs, n_words = (int(x) for x in table.loc[-1]) if -1 in table.index else (0, 0)
    table = table.reindex(range(len(keys)), fill_value=0)
    alpha = PRIOR * (table["docs"].to_numpy(float) + 0.5) / (n_docs + 1)
    n_good, y_good = n_all - n_bad, y_all - y_bad

    def log_odds(y, n):
        return np.log(y + alpha) - np.log(n + PRIOR - y - alpha)

    delta = log_odds(y_bad, n_bad) - log_odds(y_good, n_good)
    keep = (_root_ratio(y_bad, n_bad, y_good, n_good) >= LEAST_ROOT) & (delta >= LEAST_ODDS)
    keys, scores = keys[keep], np.minimum(delta[keep], MOST)
    # the rate of the extreme-value law: the positive root of E[exp(rate * score)] = 1 in clean text
    clean = np.maximum(0, table["words"].to_numpy(float)[keep] * (y_good[keep] + 0.5) / np.maximum(y_all[keep], 1)) / max(1, n_words)
    clean *= min(1.0, 0.5 / max(clean.sum(), 1e-12))
    rate = _root(clean, scores)
    model = Model(keys, scores, rate, (0.0, 0.0))

    shared_model = spark.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([e for _, e, _ in evidence(b.column(0), shared_model.value)])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), b.column(1)], ["x", "y"])

    xy = train.mapInArrow(features, "x double, y int").toPandas()
    model.weights = _logistic(np.log1p(xy["x"].to_numpy(float)), xy["y"].to_numpy(float))
    return model


def _least_root(n_bad: int, n_all: int) -> F.Column:
    """The test of ``_root_ratio`` as a filter of (bad, n), with a little room for rounding."""
    p = F.col("n") / F.lit(float(max(1, n_all)))

    def part(y: F.Column, expected: F.Column) -> F.Column:
        return F.when(y > 0, y * F.log(F.greatest(y, F.lit(1e-12)) / F.greatest(expected, F.lit(1e-12)))).otherwise(0.0)

    bad, good = F.col("bad").cast("double"), (F.col("n") - F.col("bad")).cast("double")
    b, g = F.lit(float(n_bad)), F.lit(float(n_all - n_bad))
    return 2 * (part(bad, b * p) + part(b - bad, b * (1 - p)) + part(good, g * p) + part(g - good, g * (1 - p))) >= LEAST_ROOT**2 - 1e-6


def _root_ratio(y1, n1, y0, n0) -> np.ndarray:
    """Square root of the likelihood-ratio statistic of the two-by-two table."""
    p = (y1 + y0) / max(1, n1 + n0)

    def part(y, expected):
        return np.where(y > 0, y * np.log(np.maximum(y, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    g = part(y1, n1 * p) + part(n1 - y1, n1 * (1 - p)) + part(y0, n0 * p) + part(n0 - y0, n0 * (1 - p))
    return np.sqrt(np.maximum(0.0, 2 * g))


def _root(p: np.ndarray, s: np.ndarray) -> float:
    rest = 1 - p.sum()
    if not len(s) or (p * s).sum() + rest * GAP >= 0:
        return 0.1
    lo, hi = 1e-6, 50.0
    for _ in range(80):
        mid = (lo + hi) / 2
        if (p * np.exp(np.minimum(mid * s, 500))).sum() + rest * np.exp(mid * GAP) > 1:
            hi = mid
        else:
            lo = mid
    return lo


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope with one pseudo-document of each label; Newton steps."""
    if not len(y):
        return 0.0, 0.0
    x, y = np.append(x, [0, 0]), np.append(y, [0, 1])
    w = np.zeros(2)
    design = np.stack((np.ones_like(x), x), 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (p - y) + 0.05 * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2), g)
        w -= np.clip(step, -3, 3)
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(0.0, w[1]))


def evidence(text: pa.Array, model: Model) -> Iterator[tuple[int, float, list[dict]]]:
    """Per document: words, summed evidence beyond chance, significant segments."""
    for i, j, count, found, start, end, _ in hits(text, model.keys):
        cut = np.searchsorted(found[0], np.arange(j - i + 1))
        for d in range(j - i):
            a, b = cut[d], cut[d + 1]
            if a == b:
                yield int(count[d]), 0.0, []
                continue
            chance = np.log(max(1, count[d]))
            total, out = 0.0, []
            for x, y, s in segments(found[1, a:b], model.scores[found[2, a:b]]):
                log_e = chance - model.rate * s
                if log_e <= np.log(SIGNIFICANT):
                    total -= log_e
                    out.append({"start": int(start[a + x]), "end": int(end[a + y]), "score": s, "log_expected": float(log_e)})
            yield int(count[d]), float(total), out


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, and the significant toxic segments as byte spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("log_expected", pa.float64())]))
        for b in batches:
            found = list(evidence(b.column(2), model))
            x = np.log1p(np.array([e for _, e, _ in found], float))
            p = 1 / (1 + np.exp(-np.clip(model.weights[0] + model.weights[1] * x, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array([s for *_, s in found], kind)], ["doc_id", "held_out", "score", "predicted", "segments"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, SEGMENTS)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    return score(docs, fit(docs, labels), threshold)
