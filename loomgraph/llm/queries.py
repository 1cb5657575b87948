"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeat_report

    return repeat_report(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    rows = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted", F.size("segments").alias("n_segments"))


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op2_sentence_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentence_piece import digests

    return digests(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_binary_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .binary_topk import codes, top_k

    base = codes(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(base, base.where("id % 20 = 0"), k=10)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), sequence=1024, end_id=2)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import store_and_read

    return store_and_read(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


def op6_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .set_join import near_sets

    return near_sets(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    rows = line_dedup(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("kept_md5"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_sentence_piece": op2_sentence_piece,
    "op3_binary_topk": op3_binary_topk,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_token_store": op5_token_store,
    "op6_set_join": op6_set_join,
    "op7_line_dedup": op7_line_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_license_scan": op10_license_scan,
}
ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op3_binary_topk": r"""
WITH p AS (SELECT q.vec_id AS query_id, b.vec_id AS id,
  len(list_filter(range(1, len(q.embedding) + 1), lambda i: (q.embedding[i] > 0) <> (b.embedding[i] > 0)))::INTEGER AS distance
  FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id AND len(q.embedding) = len(b.embedding) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank, id, distance FROM p)
SELECT query_id, rank, id, distance FROM r WHERE rank <= 10""",
    "op6_set_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op7_line_dedup": r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, trim(line, chr(32) || chr(9) || chr(13)) AS t FROM l),
bad AS (SELECT t FROM k WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 10),
j AS (SELECT k.*, bad.t IS NOT NULL AS gone FROM k LEFT JOIN bad USING (t)),
g AS (SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM j GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, strlen(kept)::BIGINT AS n_bytes, md5(kept) AS kept_md5 FROM g""",
}
