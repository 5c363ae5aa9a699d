"""Shards, datasets in Arrow files, and the embedding cache."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from manyvec.plans.fixtures import query, sixes, sql, table
from manyvec.session import scratch_root
from manyvec.sources import cache, shards

BOUND = 1 << 20


@query(f"""WITH w AS (SELECT doc_id, 80 + coalesce(strlen(text), 0) + coalesce(strlen(lang), 0) + coalesce(strlen(source), 0) AS w FROM documents),
short AS (SELECT *, sum(w) OVER (ORDER BY doc_id) - w AS s FROM w WHERE w <= {BOUND // 2}),
placed AS (SELECT doc_id, (s // ({BOUND} - (SELECT max(w) FROM short)))::BIGINT AS shard FROM short)
SELECT doc_id, shard FROM placed UNION ALL SELECT doc_id, (SELECT coalesce(max(shard), -1) FROM placed) + row_number() OVER (ORDER BY doc_id) FROM w WHERE w > {BOUND // 2}""")
def shard_assignment(spark, sf_dir):
    """The shard of each document at a megabyte a shard."""
    docs = table(spark, sf_dir, "documents")
    return shards.assigned(docs, "doc_id", BOUND, shards.row_bytes(docs.schema)).select("doc_id", "shard")


@query("SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents")
def arrow_documents(spark, sf_dir):
    """All documents written as Arrow files of at most 16 MB to the shared folder, and read back from them."""
    path = f"{scratch_root(spark)}/arrow-{uuid.uuid4().hex}"
    shards.save(table(spark, sf_dir, "documents"), path, "doc_id", 16 << 20)
    return shards.load(spark, path).select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@query(sql("SELECT vec_id // 6 AS page, 'page_' || CASE WHEN vec_id // 6 < 100 THEN lpad((vec_id // 6)::VARCHAR, 3, '0') ELSE (vec_id // 6)::VARCHAR END AS path, count(*) AS n_tokens FROM e GROUP BY ALL"))
def cached_pages(spark, sf_dir):
    """Page embeddings committed to the cache with their metadata and read back under it."""
    pages = sixes(spark, sf_dir).select(F.col("pid").alias("page"), F.concat(F.lit("page_"), F.when(F.col("pid") < 100, F.lpad(F.col("pid").cast("string"), 3, "0")).otherwise(F.col("pid").cast("string"))).alias("path"), "toks")
    held = cache.EmbeddingCache(spark, f"{scratch_root(spark)}/cache-{uuid.uuid4().hex}")
    found = held.load_or_encode(cache.Key("embeddings", "clean"), {"model": "given", "prompt": None}, lambda: pages, pages)
    return found.select("page", "path", F.size("toks").cast("long").alias("n_tokens"))
