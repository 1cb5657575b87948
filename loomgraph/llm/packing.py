"""Best-fit packing by patterns fitted with non-negative least squares.

Documents are encoded, end with an end id, and those longer than a sequence are cut so
that only the first piece may be short.  The histogram of piece lengths (at most one
entry for each length, whatever the corpus size) goes to the driver.  There all patterns
of up to three lengths that fill a sequence exactly are enumerated, repeat counts are
fitted to the histogram by non-negative least squares and rounded to what the histogram
holds, and the residual lengths are packed by best fit, longest first, as counts.  The
plan is a table of runs whose size is bounded by the sequence length; each piece finds
its place from its number among pieces of its length, which comes from counts of hashed
blocks, so that no length is ever gathered in one task.

Defined results: null text counts as empty and gives one piece of the end id alone;
rows may repeat, each is packed; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, tuned, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: The byte-level splitter's pattern, which the tokenizer's file does not spell out.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_open: dict[int, "ByteLevel"] = {}


class ByteLevel:
    """tiktoken for texts without added tokens; a text that holds an added token's content goes
    to the tokenizers library, which maps it to the token's id."""

    def __init__(self, spec: str, ranks: dict[bytes, int], added: list[str]):
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = tiktoken.Encoding("packing", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.library, self.added = Tokenizer.from_str(spec), added

    def encode_ordinary(self, text: str) -> list[int]:
        if any(x in text for x in self.added):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.plain.encode_ordinary(text)


def byte_level(spec: str) -> ByteLevel:
    """An encoder with the vocabulary and merge order of a byte-level BPE file of the
    tokenizers library; where merges are numbered in order, its ids are those of the
    library (tests compare them), at a third of the time."""
    if hash(spec) not in _open:
        model = json.loads(spec)["model"]
        written = {chr(c): b for b, c in alphabet().items()}
        ranks = {bytes(written[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in written for c in piece)}
        order = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
        if order != sorted(order):
            raise ValueError("the merges of this tokenizer are not numbered in order")
        added = [x["content"] for x in json.loads(spec)["added_tokens"]]
        ranks = {k: v for k, v in ranks.items() if k not in {x.encode() for x in added}}
        _open[hash(spec)] = ByteLevel(spec, ranks, added)
    return _open[hash(spec)]


def alphabet() -> dict[int, int]:
    """Byte-level tokenizers write each byte as a character: printable Latin-1 as itself, the rest from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(rest)}


def pieces(docs: DataFrame, tokenizer: str, sequence: int, end_id: int) -> DataFrame:
    """Pieces of each document; ``tokenizer`` is a file of the tokenizers library with byte-level splitting."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = byte_level(spec.value)
        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), map(library.encode_ordinary, b.column(1).to_pylist()), strict=True):
                ids = array("I", ids).tobytes() + end
                n, at = len(ids) // 4, 0
                view = memoryview(ids)
                for piece in range(-(-n // sequence)):
                    size = (n - at) % sequence or sequence if piece == 0 else sequence
                    rows.append((doc, piece, at, size, zlib.crc32(view[4 * at : 4 * (at + size)])))
                    at += size
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES)


def patterns(n: int) -> np.ndarray:
    """All multisets of two or three positive lengths with sum ``n``, in rows of three (0: none)."""
    a = np.arange(1, n // 2 + 1)
    two = np.stack((n - a, a, np.zeros_like(a)), 1)
    c, b = np.meshgrid(np.arange(1, n // 3 + 1), np.arange(1, n), indexing="ij")
    c, b = c.ravel(), b.ravel()
    a = n - b - c
    keep = (b >= c) & (a >= b)
    return np.concatenate((two, np.stack((a[keep], b[keep], c[keep]), 1)))


def fit_counts(table: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the weighted squared misfit of the pattern sums to
    the histogram: accelerated projected gradients; entry 0 of the histogram is no length.
    Long lengths weigh more, as short ones that are left over still fit into gaps."""
    goal = histogram.astype(float)
    goal[0] = 0
    size = len(goal)
    weight = np.maximum((np.arange(size) / (size - 1)) ** 2, 0.001)

    def apply(x):
        out = np.bincount(table.ravel(), weights=np.repeat(x, table.shape[1]), minlength=size)
        out[0] = 0
        return out

    v = np.ones(len(table))
    for _ in range(20):
        v = (apply(v) * weight)[table].sum(1)
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(table))
    t = 1.0
    for _ in range(rounds):
        r = (apply(y) - goal) * weight
        new = np.maximum(0, y - r[table].sum(1) / (1.05 * norm))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x


def best_fit(histogram: np.ndarray, n: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: (lengths in a sequence, how many sequences)."""
    room: dict[int, list[list]] = {}  # free space -> [lengths, count]
    for size in range(n, 0, -1):
        left = int(histogram[size])
        while left:
            free = next((r for r in range(size, n) if room.get(r)), None)
            if free is None:
                each = n // size
                full, rest = divmod(left, each)
                for lengths, count in (((size,) * each, full), ((size,) * rest, 1)):
                    if count and lengths:
                        room.setdefault(n - size * len(lengths), []).append([lengths, count])
                break
            group = room[free][-1]
            used = min(left, group[1])
            room.setdefault(free - size, []).append([(*group[0], size), used])
            group[1] -= used
            if not group[1]:
                room[free].remove(group)
            left -= used
    return [(tuple(g), c) for groups in room.values() for g, c in groups]


def plan(histogram: np.ndarray, n: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for a histogram (index: length): fitted patterns, then the residual."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[n]:
        out.append(((n,), int(left[n])))
        left[n] = 0
    if left.sum():
        table = patterns(n)
        table = table[(left[table] > 0).astype(int).sum(1) == (table > 0).sum(1)]
        if len(table):
            x = fit_counts(table, left)
            for i in np.argsort(-x, kind="stable"):
                count = int(round(x[i]))
                if not count:
                    break
                lengths = [int(v) for v in table[i] if v]
                need = {v: lengths.count(v) for v in lengths}
                count = min(count, *(int(left[v]) // k for v, k in need.items()))
                if count > 0:
                    out.append((tuple(lengths), count))
                    for v, k in need.items():
                        left[v] -= k * count
        out += best_fit(left, n)
    return out


def runs(packed: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first number, count, first sequence, offset), sorted."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, count in packed:
        at = 0
        for v in lengths:
            rows.append((v, used.get(v, 0), count, base, at))
            used[v] = used.get(v, 0) + count
            at += v
        base += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, sequence: int = 1024, end_id: int = 2) -> DataFrame:
    spark = docs.sparkSession
    tuned(spark)
    # a number of its own deals each piece, those of repeated rows too; it is written, so that it stays
    cut = written(pieces(docs, tokenizer, sequence, end_id).withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    total = cut.count()
    block = F.pmod(F.xxhash64("_piece"), F.lit(fold(total, 1 << 17))).alias("_block")
    counts = cut.groupBy("length", block).agg(F.count("*").alias("n"))
    histogram = np.zeros(sequence + 1, np.int64)
    for size, n in counts.groupBy("length").agg(F.sum("n")).collect():  # a row for each length at most
        histogram[size] = n
    table = spark.sparkContext.broadcast(runs(plan(histogram, sequence)))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_block").orderBy("doc_id", "piece", "ids_crc32", "start")
    numbered = cut.withColumn("_block", block).withColumn("_number", F.row_number().over(inside) - 1).join(bases, ["length", "_block"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_number")).alias("_number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        wide = np.int64(1) << np.int64(50)
        key = t[:, 0] * wide + t[:, 1]
        for b in batches:
            length, number = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(key, length * wide + number, "right") - 1
            row = t[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(row[:, 3] + number - row[:, 1]), pa.array(row[:, 4])], [*b.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
