"""Ranking and retrieval metrics over a long score table (qid, pid, score) and relevance (qid, pid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NAMES = ("ndcg", "recall", "mrr")


def ranked(scores: DataFrame, *by: str) -> DataFrame:
    """Adds ``rank`` from 1: score descending, ties to the smaller pid."""
    window = W.partitionBy("qid", *by).orderBy(F.round("score", 9).desc(), "pid")
    return scores.withColumn("rank", F.row_number().over(window).cast("long"))


def top_k(scores: DataFrame, k: int, *by: str) -> DataFrame:
    return ranked(scores, *by).where(F.col("rank") <= k)


def with_relevance(rows: DataFrame, qrels: DataFrame) -> DataFrame:
    marks = qrels.select("qid", "pid").distinct().withColumn("rel", F.lit(True))
    return rows.join(marks, ["qid", "pid"], "left").withColumn("rel", F.coalesce("rel", F.lit(False)))


def gain(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def ideal(n_rel: Column, k: int) -> Column:
    """The gains of a ranking that begins with all relevant documents."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n_rel, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + gain(i))


def per_query(scores: DataFrame, qrels: DataFrame, k: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """(qid, ndcg, recall, mrr, n_rel) with binary gains; queries without relevant documents score 0.

    One shuffle by query ranks; the aggregate reuses its partitioning."""
    rows = with_relevance(ranked(scores, *by), qrels)
    rel, top = F.col("rel"), F.col("rel") & (F.col("rank") <= k)
    found = rows.groupBy("qid", *by).agg(
        F.sum(F.when(top, gain(F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.count_if(top).alias("hits"),
        F.min(F.when(rel, F.col("rank"))).alias("first"),
    )
    sizes = qrels.select("qid", "pid").distinct().groupBy("qid").agg(F.count("*").alias("n_rel"))
    out = found.join(sizes, "qid", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    some = F.col("n_rel") > 0
    return out.select(
        "qid", *by,
        F.when(some, F.col("dcg") / ideal(F.col("n_rel"), k)).otherwise(0.0).alias("ndcg"),
        F.when(some, F.col("hits") / F.col("n_rel")).otherwise(0.0).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        "n_rel",
    )


def macro(metrics: DataFrame, *by: str) -> DataFrame:
    return metrics.groupBy(*by).agg(*[F.avg(m).alias(m) for m in NAMES], F.count("*").alias("n_queries"))


def evaluate(scores: DataFrame, qrels: DataFrame, k: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """Macro means, n_queries and n_docs."""
    docs = scores.groupBy(*by).agg(F.countDistinct("pid").alias("n_docs"))
    means = macro(per_query(scores, qrels, k, by), *by)
    return means.join(docs, list(by)) if by else means.crossJoin(docs)  # one row each


def diagonal(scores: DataFrame) -> DataFrame:
    """Relevance where query i belongs to document i."""
    return scores.select("qid").distinct().withColumn("pid", F.col("qid"))


def first_relevant_rank(scores: DataFrame, qrels: DataFrame, *by: str) -> DataFrame:
    """(qid, first): null where no relevant document is ranked."""
    rows = with_relevance(ranked(scores, *by), qrels)
    return rows.groupBy("qid", *by).agg(F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"))


def rank_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts of queries whose first relevant rank improved, worsened or stayed; unranked ones don't count."""
    both = before.select("qid", F.col("first").alias("a")).join(after.select("qid", F.col("first").alias("b")), "qid").where("a is not null and b is not null")
    d = F.col("b") - F.col("a")
    return both.agg(F.count_if(d < 0).alias("improved"), F.count_if(d > 0).alias("worsened"), F.count_if(d == 0).alias("unchanged"))


def metric_deltas(metrics: DataFrame, baseline: str) -> DataFrame:
    """Differences of each condition's means from one condition's, to ten digits."""
    base = metrics.where(F.col("condition") == baseline).select(*[F.col(m).alias(f"__{m}") for m in NAMES])
    return metrics.crossJoin(F.broadcast(base)).select("condition", *[F.round(F.col(m) - F.col(f"__{m}"), 10).alias(f"delta_{m}") for m in NAMES])  # one row


def summary(metrics: DataFrame, degraded: str = "degraded", order: tuple[str, ...] = ("clean", "degraded")) -> DataFrame:
    """Condition rows with means and the nDCG gain over the degraded one."""
    deltas = metric_deltas(metrics, degraded).select("condition", F.col("delta_ndcg").alias("gain"))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("condition")), F.lit(99))
    place = F.when(place == 0, 99).otherwise(place)
    return metrics.join(deltas, "condition").orderBy(place, "condition").select("condition", *NAMES, "gain")


def average_metric(metrics: DataFrame, name: str) -> DataFrame:
    """Mean over subsets; a missing value counts as 0."""
    return metrics.agg(F.avg(F.coalesce(F.col(name), F.lit(0.0))).alias(f"avg_{name}"))


def drift(before: DataFrame, after: DataFrame, clean: DataFrame) -> DataFrame:
    """How page vectors (pid, v) moved: cosine to clean before and after, L2 change, pages improved or worsened."""
    from manyvec.functions import vectors as V

    rows = before.select("pid", F.col("v").alias("b")).join(after.select("pid", F.col("v").alias("a")), "pid").join(clean.select("pid", F.col("v").alias("c")), "pid")
    gap = F.zip_with("a", "b", lambda x, y: x - y)
    rows = rows.select(V.cosine(F.col("b"), F.col("c")).alias("cb"), V.cosine(F.col("a"), F.col("c")).alias("ca"), V.norm(gap).alias("l2"), V.cosine(F.col("a"), F.col("b")).alias("own"))
    return rows.agg(
        F.count("*").alias("n_pages"), F.avg("cb").alias("mean_before"), F.min("cb").alias("min_before"), F.avg("ca").alias("mean_after"), F.min("ca").alias("min_after"),
        F.avg("l2").alias("mean_l2"), F.avg("own").alias("mean_identity"), F.count_if(F.col("ca") > F.col("cb")).alias("improved"), F.count_if(F.col("ca") < F.col("cb")).alias("worsened"),
    )
