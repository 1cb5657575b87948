"""Exact k nearest binary codes by incremental multi-index hashing.

A code (one sign bit for each component of a vector) is cut into 16-bit segments, each
with its own index.  For a query, the segments' search radii grow one segment at a time;
after radius ``a`` in the first ``j + 1`` of ``m`` segments and ``a - 1`` in the others,
every code within ``m * a + j`` has been verified, by the pigeonhole principle.  The
search ends when the k-th verified distance is within that cover, so the answer is exact
whatever the data.

Codes are dealt to blocks and queries to blocks; each pair of blocks is one task's work,
which returns k rows for each query; these are merged by a window.  In a block, equal
codes are held once with their k least ids, which is all that an answer can use.

Ties go to the smaller id.  Defined results: null, empty or non-finite vectors have no
code, are never found and get no rows as queries; rows repeated as they are count once;
vectors of unlike dimensions are never compared, and long ones are codes of as many segments;
a query does not find its own id; with fewer than k others, all are returned; an empty table
of codes or of queries gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, tuned, written

BASE_BLOCK = 1 << 16
QUERY_BLOCK = 1 << 11
_masks: dict[int, list[np.ndarray]] = {}


def masks(bits: int) -> list[np.ndarray]:
    """All ``bits``-wide numbers by how many bits are set."""
    if bits not in _masks:
        x = np.arange(1 << bits, dtype=np.uint32)
        n = np.bitwise_count(x)
        _masks[bits] = [x[n == i] for i in range(bits + 1)]
    return _masks[bits]


class Block:
    """A multi-index over distinct codes (rows of packed bytes, two for each segment)."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.bits = codes, bits
        self.words = np.ascontiguousarray(codes).view("<u2").astype(np.uint32)
        self.m = self.words.shape[1]
        self.order, self.start = [], []
        for j in range(self.m):
            w = self.words[:, j]
            self.order.append(np.argsort(w, kind="stable"))
            self.start.append(np.concatenate(([0], np.cumsum(np.bincount(w, minlength=1 << 16)))))

    def search(self, query: np.ndarray, enough) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances that hold every code as near as the k-th; ``enough(rows,
        distances, covered)`` says whether the k-th is within the cover."""
        word = np.ascontiguousarray(query).view("<u2").astype(np.uint32)
        seen = np.zeros(len(self.codes), bool)
        rows, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        total = 0
        for a in range(17):
            for j in range(self.m):
                value = word[j] ^ masks(16)[a]
                lo, hi = self.start[j][value], self.start[j][value + 1]
                n = hi - lo
                full = n > 0
                lo, n = lo[full], n[full]
                if len(n):
                    at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    new = self.order[j][at]
                    new = new[~seen[new]]
                    if len(new):
                        seen[new] = True
                        rows.append(new)
                        far.append(np.bitwise_count(self.words[new] ^ word).sum(1).astype(np.int64))
                        total += len(new)
                if total == len(self.codes) or enough(rows, far, self.m * a + j):
                    return np.concatenate(rows), np.concatenate(far)
        return np.concatenate(rows), np.concatenate(far)


def codes(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, dim and the packed sign bits (bit set: component above zero)."""
    v = F.col(vector).cast("array<double>")
    rows = rows.select(F.col(id_column).cast("long").alias("id"), v.alias("v"))
    sound = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.coalesce(sound, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, at = b.column(1).flatten().to_numpy(), b.column(1).offsets.to_numpy()
            at = at - at[0]
            out = []
            for x, y in zip(at[:-1], at[1:], strict=True):
                packed = np.packbits(flat[x:y] > 0)
                out.append(np.pad(packed, (0, len(packed) % 2)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at).astype(np.int32)), pa.array(out, pa.binary())], ["id", "dim", "code"])

    return rows.mapInArrow(run, "id long, dim int, code binary").distinct()


def top_k(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, distance from (id, dim, code) tables."""
    spark = base.sparkSession
    tuned(spark)
    base, queries = written(base, "codes"), written(queries, "query-codes")
    nb, nq = fold(base.count(), BASE_BLOCK), fold(queries.count(), QUERY_BLOCK)
    b = base.withColumn("bb", F.pmod(F.xxhash64("id"), F.lit(nb))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(nq))).withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    shape = [F.col("dim"), F.col("bb").cast("long").alias("bb"), F.col("qb").cast("long").alias("qb"), "id", "code"]

    def cell(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(b):
            b = b.sort_values("id")
            width = len(b["code"].iloc[0])
            every = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), width)
            unique, owner = np.unique(every, axis=0, return_inverse=True)
            order = np.argsort(owner.ravel(), kind="stable")  # ids ascend within a code
            first = np.searchsorted(owner.ravel()[order], np.arange(len(unique) + 1))
            ids = b["id"].to_numpy()[order]
            held = np.minimum(np.diff(first), k + 1)
            index = Block(unique, width * 8)

            def enough(rows, far, covered):
                near = [held[r[f <= covered]].sum() for r, f in zip(rows, far, strict=True)]
                return sum(near) > k  # one more, as the query itself may be among them

            for name, code in zip(q["id"].to_numpy(), q["code"], strict=True):
                rows, far = index.search(np.frombuffer(code, np.uint8), enough)
                near = np.argsort(far, kind="stable")
                cut = np.searchsorted(np.cumsum(held[rows[near]]), k + 1) if len(near) else 0
                limit = far[near[min(cut, len(near) - 1)]] if len(near) else -1
                best = [(int(d), int(i)) for r, d in zip(rows, far, strict=True) if d <= limit for i in ids[first[r] : first[r] + held[r]]]
                out += [(name, i, d) for d, i in sorted(x for x in best if x[1] != name)[:k]]
        return pd.DataFrame(out, columns=["query_id", "id", "distance"]).astype({"query_id": "int64", "id": "int64", "distance": "int32"})

    key = ["dim", "bb", "qb"]
    found = q.select(*shape).groupBy(*key).cogroup(b.select(*shape).groupBy(*key)).applyInPandas(cell, "query_id long, id long, distance int")
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
