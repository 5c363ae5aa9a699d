"""What the physical plans must keep: pruned scans, no all-pairs shuffles, limits before shuffles."""

from pyspark.sql import functions as F

from manyvec.operators import datasets, prefix, scoring, selection
from manyvec.plans.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scores_prune_columns_and_shuffle_no_pair(spark, sf_dir):
    p = plan(QUERIES["maxsim_scores"](spark, sf_dir))
    assert "CartesianProduct" not in p and "label" not in p
    assert p.count("Exchange hashpartitioning") == 2  # each side is packed by its own key, pairs are not moved


def test_top_k_limits_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in plan(QUERIES["retrieve_top10"](spark, sf_dir))
    rows = spark.range(100).selectExpr("id", "id % 3 AS source")
    assert "WindowGroupLimit" in plan(datasets.cap_sources(rows, "source", {"1": 5}, "id"))


def test_positive_pairs_are_an_equi_join(spark, sf_dir):
    p = plan(QUERIES["positive_pair_scores"](spark, sf_dir))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_numbering_never_sorts_in_one_task(spark):
    assert "SinglePartition" not in plan(prefix.numbered(spark.range(500).selectExpr("id * 3 AS k"), "k")).split("BroadcastExchange")[0]


def test_large_query_sides_meet_in_blocks(spark):
    q = spark.range(50).select(F.col("id").alias("qid"), F.array(F.array(F.lit(1.0))).alias("q"))
    d = spark.range(50).select(F.col("id").alias("pid"), F.array(F.array(F.lit(2.0))).alias("d"))
    p = plan(scoring.pairs(q, d, blocks=3))
    assert "NestedLoop" not in p and "Cartesian" not in p
    assert scoring.measured_bytes(q) == 50 * (16 + 8 + 8)


def test_filters_reach_the_scan(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'fr'")
    assert "EqualTo(lang,fr)" in plan(selection.missing(docs, labels, "doc_id").select("doc_id"))
