"""A content-addressed store of token ids.

Layout under a store's path, all Parquet, so that any store Spark writes to will do:

* ``objects/kind=chunk``: each distinct chunk once: ``digest`` (SHA-256 of the ids' bytes)
  and ``ids`` (little-endian unsigned integers, 2 bytes wide where the vocabulary allows, else 4);
* ``recipes``: a row for each document, range-partitioned and sorted by doc_id: ``doc_id,
  start, n_tokens, chunks`` (digests in a row) and ``root`` (SHA-256 of ``chunks``);
* ``manifest``: Merkle nodes: ``level, node, hash``; level 1 joins the roots of documents
  that start within 2**18 ids, each further level 2**10 nodes, the last has one node.

A rolling hash over the last ids cuts the stream: a chunk ends where the hash's low bits
are zero, within least and largest sizes, so that equal passages give equal chunks.

Defined results: null text is empty and has the end id alone; rows may repeat, and each
is a document; documents of one doc_id follow each other; an empty table gives an empty
store.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, running_total, scratch, tuned
from .run_memo import run_memo

LEAST, MASK, MOST, WINDOW = 64, 255, 1024, 16
DIGEST = 32
ROLL = np.random.default_rng(11).integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FIRST_LEVEL, FAN = 18, 10
LEVELS = 4


def marks(ids: np.ndarray) -> np.ndarray:
    """Where the rolling hash of the last ids lets a chunk end (the next id's number)."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(len(ids), np.uint64)
    for i in range(min(WINDOW, len(ids))):
        h[i:] += mixed[: len(ids) - i] * ROLL[i]
    return np.flatnonzero((h >> np.uint64(40)) & np.uint64(MASK) == 0) + 1


def cuts(found: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of the document whose ids are ``start`` to ``end``.  Marks less than
    LEAST from a chunk's start do not count, so none depends on the document before."""
    out, at = [], start
    k = bisect_left(found, at + LEAST)
    while end - at > LEAST:
        while k < len(found) and found[k] < at + LEAST:
            k += 1
        at = min(found[k] if k < len(found) else end, at + MOST, end)
        out.append(at)
    if at < end:
        out.append(end)
    return out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, vocabulary: int = 49408) -> None:
    """Encode all documents into the store at ``path``; ``tokenizer`` is a file of the tokenizers
    library that lower-cases, drops white space and splits words as ``run_memo`` says."""
    spark = docs.sparkSession
    tuned(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    width = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
    n_parts = partitions(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, sent = run_memo(spec.value), set()
        size = width.itemsize
        for b in batches:
            rows: list[tuple] = []
            ids, begin = memo.encode(b.column(1), end_id)
            found, narrow = marks(ids).tolist(), ids.astype(width).tobytes()
            begin = begin.tolist()
            for doc, at, stop in zip(b.column(0).to_pylist(), begin[:-1], begin[1:], strict=True):
                first, recipe = at, []
                for to in cuts(found, at, stop):
                    data = narrow[size * at : size * to]
                    digest = hashlib.sha256(data).digest()
                    recipe.append(digest)
                    if digest not in sent:  # once from each task; once in the store
                        if len(sent) >= 200_000:
                            sent.clear()
                        sent.add(digest)
                        rows.append(("chunk", digest, data, None, None))
                    at = to
                chunks = b"".join(recipe)
                rows.append(("recipe", hashlib.sha256(chunks).digest(), chunks, doc, stop - first))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["kind", "digest", "ids", "doc_id", "n_tokens"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            keep = []
            for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keep.append(k == "recipe" or d != last)
                last = d if k == "chunk" else None
            yield b.filter(pa.array(keep, pa.bool_()))

    schema = "kind string, digest binary, ids binary, doc_id long, n_tokens long"
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
    # copies of one document share a recipe: its rows are spread by doc_id
    rows = rows.repartition(n_parts, "digest", "doc_id").sortWithinPartitions("kind", "digest").mapInArrow(once, schema)
    rows.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/objects")
    made = spark.read.schema(f"{schema[13:]}, kind string").parquet(f"{path}/objects").where("kind = 'recipe'")
    made = made.select("doc_id", "n_tokens", F.col("ids").alias("chunks"), F.col("digest").alias("root"))
    placed = running_total(made, ["doc_id", "root"], "n_tokens", "start")
    placed.select("doc_id", "start", "n_tokens", "chunks", "root").write.parquet(f"{path}/recipes")
    manifest(spark.read.schema("doc_id long, start long, n_tokens long, chunks binary, root binary").parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def manifest(recipes: DataFrame) -> DataFrame:
    """Merkle nodes above the documents' roots."""
    nodes = recipes.select(F.col("start").alias("at"), F.shiftright("start", FIRST_LEVEL).alias("node"), F.lower(F.hex("root")).alias("hash"))
    levels = None
    for level in range(1, LEVELS + 1):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"]), "")
        nodes = nodes.groupBy("node").agg(F.sha2(joined, 256).alias("hash"))
        here = nodes.select(F.lit(level).alias("level"), "node", "hash")
        levels = here if levels is None else levels.union(here)
        up = F.shiftright("node", FAN) if level < LEVELS - 1 else F.lit(0).cast("long")
        nodes = nodes.select(F.col("node").alias("at"), up.alias("node"), "hash")
    return levels


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest binary, ids binary, doc_id long, n_tokens long, kind string").parquet(f"{path}/objects").where("kind = 'chunk'")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("doc_id long, start long, n_tokens long, chunks binary, root binary").parquet(f"{path}/recipes")
    return rows.where(F.when(F.unhex(F.sha2("chunks", 256)) == F.col("root"), True).otherwise(F.raise_error(F.lit("a recipe does not match its root")).cast("boolean")))


def _parts(recipes: DataFrame) -> DataFrame:
    n = F.expr(f"int(octet_length(chunks) div {DIGEST})")
    return recipes.select("doc_id", "start", "n_tokens", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("chunks", i * DIGEST + 1, F.lit(DIGEST)))).alias("at", "digest"))


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Nodes whose stored and recomputed hashes differ; none in a sound store."""
    stored = spark.read.parquet(f"{path}/manifest")
    again = manifest(_recipes(spark, path)).withColumnRenamed("hash", "again")
    return stored.join(again, ["level", "node"], "full").where("not hash <=> again")


def read_ids(spark: SparkSession, path: str, doc_ids: DataFrame | None = None, vocabulary: int = 49408) -> DataFrame:
    """doc_id, start and the ids of each document (or of those in ``doc_ids``), put together from its chunks."""
    recipes = _recipes(spark, path)
    if doc_ids is not None:
        recipes = recipes.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = _parts(recipes).join(_chunks(spark, path).select("digest", "ids"), "digest").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("_c"))
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(c["ids"] for c in parts), width).astype(np.int32) for parts in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return rows.mapInArrow(run, "doc_id long, start long, ids array<int>")


def read_digests(spark: SparkSession, path: str, vocabulary: int = 49408) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files.

    Every stored chunk is read, checked against its digest, and gives its length and the
    CRC of its ids; the CRC of a document is combined from those of its chunks in the
    recipe's order, so ids never move.  Counts that disagree with the recipe are an error.
    """
    tuned(spark)
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, crc = [], []
            for digest, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if hashlib.sha256(data).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} does not match its digest")
                ids = np.frombuffer(data, width).astype("<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["digest", "n", "crc"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros = bytes(4 * MOST)
        for b in batches:
            out = []
            for want, parts in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                crc = total = 0
                for p in parts:  # crc(A + B) is linear in crc(A) and crc(B)
                    pad = zeros[: 4 * p["n"]]
                    crc = zlib.crc32(pad, crc) ^ zlib.crc32(pad) ^ p["crc"] if total else p["crc"]
                    total += p["n"]
                if total != want:
                    raise ValueError("a document's chunks do not add up to its length")
                out.append(crc)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    chunks = _chunks(spark, path).select("digest", "ids").mapInArrow(check, "digest binary, n long, crc long")
    rows = _parts(_recipes(spark, path)).join(chunks, "digest", "left")
    rows = rows.groupBy("doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("parts"))
    return rows.mapInArrow(combine, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_and_read(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write the store, check its Merkle manifest, and return ``read_digests`` of it."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write(docs, path, tokenizer, **options)
    if verify_manifest(spark, path).limit(1).count():
        raise ValueError("the manifest does not match the recipes")
    return read_digests(spark, path)
