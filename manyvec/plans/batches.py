"""Ragged pixel sequences and batches of mixed kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from manyvec.functions import ragged as R
from manyvec.functions import texts as T
from manyvec.plans.algebra import six
from manyvec.plans.fixtures import bags, d_tokens, query, sql, table

#: The documents of 41 vectors in a row are a batch of images, their tokens laid end to end.
LONGEST = "max(n) OVER (PARTITION BY pid // 6)"


def laid(spark, sf_dir):
    """(batch, pixels, grids): all documents of a batch end to end, with the grid (1, 1, tokens) of each."""
    docs = bags(d_tokens(spark, sf_dir), "pid").select(F.expr("pid div 6").alias("batch"), "pid", "toks")
    rows = docs.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("pid", "toks"))).alias("held"))  # six
    return rows.select("batch", F.flatten(F.transform("held", lambda d: d["toks"])).alias("pixels"), F.transform("held", lambda d: F.array(F.lit(1), F.lit(1), F.size(d["toks"]))).alias("grids"))


@query(sql(f"""SELECT pid // 6 AS batch, (pid % 6)::INT AS image, n AS real, t.tok, coalesce(list_transform(v, lambda y: round(y, 6) + 0.0::DOUBLE), list_transform(range(64), lambda i: 0.0::DOUBLE)) AS v
FROM (SELECT *, {LONGEST} AS most FROM (SELECT pid, count(*) AS n FROM dt GROUP BY pid)) CROSS JOIN range(8) t(tok) LEFT JOIN dt USING (pid, tok) WHERE t.tok < most"""))
def split_and_padded_pixels(spark, sf_dir):
    """Pixel sequences split by their grids and padded to the longest of the batch."""
    rows = laid(spark, sf_dir).withColumn("sizes", R.by_grid(F.col("grids")))
    rows = rows.select("batch", "sizes", F.posexplode(R.padded(R.split(F.col("pixels"), F.col("sizes")), F.lit(64))).alias("image", "part"))
    return rows.select("batch", "image", F.get("sizes", "image").cast("long").alias("real"), F.posexplode("part").alias("tok", "v")).select("batch", "image", "real", F.col("tok").cast("long").alias("tok"), six(F.col("v")).alias("v"))


@query(sql("SELECT pid // 6 AS batch, row_number() OVER (PARTITION BY pid // 6 ORDER BY pid, tok) - 1 AS place, list_transform(v, lambda y: round(y, 6) + 0.0::DOUBLE) AS v FROM dt"))
def rejoined_pixels(spark, sf_dir):
    """The same brought back end to end without its padding."""
    rows = laid(spark, sf_dir).withColumn("sizes", R.by_grid(F.col("grids")))
    back = R.joined(R.padded(R.split(F.col("pixels"), F.col("sizes")), F.lit(64)), F.col("sizes"))
    return rows.select("batch", F.posexplode(back).alias("place", "v")).select("batch", F.col("place").cast("long").alias("place"), six(F.col("v")).alias("v"))


def items(spark, sf_dir):
    """(batch, pos, item): eight documents a batch; those divisible by three come as bytes instead of text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    picture = F.col("doc_id") % 3 == 0
    item = F.struct(F.when(picture, "image").otherwise("text").alias("kind"), F.when(~picture, F.col("t")).alias("text"), F.when(picture, F.encode("t", "UTF-8")).alias("image"))
    return docs.select(F.expr("doc_id div 8").alias("batch"), (F.col("doc_id") % 8).alias("pos"), item.alias("item"))


PROCESSORS = {"text": lambda t: F.md5(T.augment_query(t, "<pad>", "Query: ", times=2)), "image": lambda data: F.md5(T.plain_base64(data))}


@query("SELECT doc_id // 8 AS batch, doc_id % 8 AS pos, CASE WHEN doc_id % 3 = 0 THEN 'image' ELSE 'text' END AS doc_kind, md5(CASE WHEN doc_id % 3 = 0 THEN base64(encode(coalesce(text, ''))) ELSE 'Query: ' || coalesce(text, '') || '<pad><pad>' END) AS doc_input FROM documents")
def mixed_batches(spark, sf_dir):
    """Each item of a mixed batch by the processor of its kind."""
    return R.collated(items(spark, sf_dir), "item", PROCESSORS, "doc_", mixed="split")
