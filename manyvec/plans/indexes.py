"""The residual-compressed index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from manyvec.operators import residual as R
from manyvec.plans.fixtures import fiftieths, query, sixes, sql, vectors
from manyvec.session import stored

#: A codec that SQL can follow: the first eight vectors as centroids, sixteen buckets of one width.
STEP = 0.04


def plain_codec(spark, sf_dir) -> R.Codec:
    rows = vectors(spark, sf_dir).where("vec_id < 8").orderBy("vec_id").select("v").collect()  # eight
    return R.Codec(np.array([r["v"] for r in rows]), STEP * np.arange(-7, 8), STEP * (np.arange(16) - 7.5), np.full(len(rows), STEP))


CODED = f"""tk AS (SELECT vec_id // 6 AS pid, vec_id % 6 AS tok, v FROM e), ce AS (SELECT vec_id AS centroid, v AS c FROM e WHERE vec_id < 8),
near AS (SELECT pid, tok, v, centroid, c FROM tk, ce QUALIFY row_number() OVER (PARTITION BY pid, tok ORDER BY list_dot_product(v, c) DESC, centroid) = 1),
fq AS (SELECT vec_id // 50 AS qid, vec_id % 50 AS qtok, v AS q FROM e WHERE vec_id % 50 < 4),
rough AS (SELECT qid, pid, sum(m) AS score FROM (SELECT qid, qtok, pid, max(list_dot_product(q, c)) AS m FROM fq, near GROUP BY ALL) GROUP BY ALL)"""
DIGIT = f"len(list_filter(range(-7, 8), lambda b: {STEP}::DOUBLE * b <= x - c[i]))"


@query(sql(f"SELECT pid, tok, centroid, array_to_string(list_transform(v, lambda x, i: lower(hex({DIGIT}))[-1:]), '') AS rest FROM near", CODED))
def residual_codes(spark, sf_dir):
    """What the index stores of every token."""
    return R.codes(R.build(sixes(spark, sf_dir), plain_codec(spark, sf_dir)))


@query(sql("SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pid) AS rank, pid, round(score, 6) AS score FROM rough QUALIFY rank <= 10", CODED))
def centroid_top10(spark, sf_dir):
    """Ranking by stored centroid numbers alone."""
    index = R.build(sixes(spark, sf_dir), plain_codec(spark, sf_dir))
    return R.search(fiftieths(spark, sf_dir), index, width=None).select("qid", "rank", "pid", F.round("score", 6).alias("score"))


@query(sql("SELECT count(DISTINCT pid) AS n_docs, count(*) AS n_tokens, count(*) * 34 AS n_bytes, count(*) * 512 AS plain_bytes FROM tk", CODED))
def residual_index_size(spark, sf_dir):
    pages = sixes(spark, sf_dir)
    return R.build(pages, R.fit(pages)).size()


@query()
def residual_top10(spark, sf_dir):
    """Every page in an index of four bits a component, searched by every fiftieth vector and the three after it; fifty
    found by the index are ranked by their original vectors. The tests hold recall against all pages."""
    pages = stored(sixes(spark, sf_dir), "pages")
    queries = stored(fiftieths(spark, sf_dir), "fiftieths")
    index = R.build(pages, R.fit(pages))
    index = R.Index(stored(index.chunks, "chunks"), index.codec)
    found = R.search(queries, index, k=50)
    return R.reranked(found, queries, pages).select("qid", "rank", "pid", F.round("score", 6).alias("score"))
