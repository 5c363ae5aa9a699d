"""Metrics from one scoring of all pairs, against those of a ranked score table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from manyvec.operators import evaluation as E
from manyvec.operators import metrics, scoring
from manyvec.plans.fixtures import qrels, queries_and_docs


def made(spark, seed=1, n_docs=40, n_queries=9, dim=4):
    rng = np.random.default_rng(seed)
    bag = lambda: np.round(rng.normal(size=(rng.integers(1, 5), dim)), 1).tolist()  # noqa: E731  coarse, so there are ties
    docs = [(i, bag()) for i in range(n_docs)]
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, []), (103, None)]
    queries = [(i, bag()) for i in range(n_queries)] + [(50, []), (51, docs[3][1])]
    pairs = {(int(q), int(rng.integers(0, n_docs))) for q in range(n_queries - 2) for _ in range(3)}
    rel = [*pairs, *list(pairs)[:2], (51, 101), (0, 999), (7, 888), (77, 1)]
    return spark.createDataFrame(queries, "qid long, toks array<array<double>>"), spark.createDataFrame(docs, "pid long, toks array<array<double>>").repartition(3), spark.createDataFrame(rel, "qid long, pid long")


@pytest.mark.parametrize("options", [{}, {"reduction": "topk_mean", "top_k": 2}, {"reduction": "smoothmax", "temperature": 0.3}, {"reduction": "lse", "temperature": 0.3}])
def test_metrics_equal_those_of_a_ranked_table(spark, monkeypatch, options):
    q, d, rel = made(spark)
    scores = scoring.score_multi_vector(q.where(F.size("toks") > 0), d.where(F.size("toks") > 0), **options)
    want = {r["qid"]: r.asDict() for r in metrics.per_query(scores, rel).collect()}
    first = {r["qid"]: r["first"] for r in metrics.first_relevant_rank(scores, rel).collect()}
    for chunk, block in ((2048, 256), (7, 2)):
        monkeypatch.setattr(E, "CHUNK", chunk)
        monkeypatch.setattr(E, "BLOCK", block)
        found = {r["qid"]: r.asDict() for r in E.per_query(q, d, rel, **options).collect()}
        assert found.keys() == want.keys()
        for qid, row in want.items():
            assert found[qid]["first"] == first[qid] and found[qid]["n_rel"] == row["n_rel"]
            assert all(found[qid][m] == pytest.approx(row[m], abs=1e-12) for m in metrics.NAMES)


def test_settings_share_one_pass(spark):
    q, d, rel = made(spark, seed=4)
    settings = [{}, {"reduction": "smoothmax", "temperature": 0.2}, {"reduction": "smoothmax", "temperature": 0.9}, {"reduction": "topk_mean", "top_k": 2}]
    found = {(r["setting"], r["qid"]): r for r in E.per_query_settings(q, d, rel, settings).collect()}
    assert len(found) == 4 * 10
    for i, options in enumerate(settings):
        for r in E.per_query(q, d, rel, **options).collect():
            assert found[i, r["qid"]].asDict() == {"setting": i} | r.asDict()
    p = E.places(q, d, rel, settings=settings)._jdf.queryExecution().executedPlan().toString()
    assert p.count("NestedLoopJoin") == 1


def test_temperature_search_finds_what_trying_all_finds(spark):
    from manyvec.operators import search

    q, d, rel = made(spark, seed=7)
    swarm = search.Swarm([(0.05, 2.0)], particles=3, iters=2)
    best, score = search.temperature_search(q, d, rel, swarm)
    tried = lambda t: E.evaluate(q, d, rel, reduction="smoothmax", temperature=float(t)).first()["ndcg"]
    want, top = swarm.optimize(lambda p: tried(p[0]))
    assert best == want[0] and score == pytest.approx(top)


def test_means_count_queries_and_documents_once(spark):
    q, d, rel = made(spark)
    row = E.evaluate(q, d, rel).first()
    assert (row["n_queries"], row["n_docs"]) == (10, 42)
    scores = scoring.score_multi_vector(q.where(F.size("toks") > 0), d.where(F.size("toks") > 0))
    want = metrics.evaluate(scores, rel).first()
    assert all(row[m] == pytest.approx(want[m]) for m in (*metrics.NAMES, "n_queries", "n_docs"))


def test_vectors_of_other_dimensions_never_meet(spark):
    q = spark.createDataFrame([(1, [[1.0, 0.0]]), (2, [[1.0]])], "qid long, toks array<array<double>>")
    d = spark.createDataFrame([(1, [[1.0, 0.0]]), (2, [[2.0]])], "pid long, toks array<array<double>>")
    found = E.places(q, d, spark.createDataFrame([(1, 1), (2, 2)], "qid long, pid long")).where("pid is not null").collect()
    assert {(r["qid"], r["pid"]) for r in found} == {(1, 1), (2, 2)}


def test_nothing_to_rank(spark):
    q, d, rel = made(spark)
    assert E.per_query(q.limit(0), d, rel).count() == 0
    assert E.per_query(q, d.limit(0), rel).count() == 0
    bare = E.per_query(q, d, rel.limit(0)).collect()
    assert len(bare) == 10 and all(r["ndcg"] == r["mrr"] == 0.0 and r["first"] is None for r in bare)


def test_one_scoring_and_no_window_over_pairs(spark, sf_dir):
    q, d = queries_and_docs(spark, sf_dir)
    met = E.places(q, d, qrels(spark, sf_dir))
    p = met._jdf.queryExecution().executedPlan().toString()
    assert p.count("NestedLoopJoin") == 1 and "Window" not in p
    after = E.per_query(q, d, qrels(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in after and "MapInPandas" not in after and "WindowGroupLimit" in after


def test_summaries_score_nothing_again(spark):
    q, d, rel = made(spark)
    rows = E.evaluate_conditions(q, {"clean": (d, {}), "degraded": (d, {"reduction": "lse"})}, rel)
    p = metrics.summary(rows)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in p and p.count("Scan parquet") >= 1
    assert {r["condition"] for r in metrics.summary(rows).collect()} == {"clean", "degraded"}


def test_relevance_by_marks_equals_relevance_by_pairs(spark, monkeypatch):
    q, d, _ = made(spark, seed=9)
    asked = q.selectExpr("qid", "CASE WHEN qid = 3 THEN NULL WHEN qid = 4 THEN 99 ELSE qid % 3 END AS mark")
    held = d.selectExpr("pid", "explode(array(pid % 3, pid % 2)) AS mark").union(spark.createDataFrame([(999, 1)], "pid long, mark long"))
    pairs = asked.join(held, "mark").select("qid", "pid").distinct()
    assert "n_rel" in E.Shared(asked, held).sizes().columns
    for chunk, block, carried in ((2048, 256, 1_000_000), (7, 2, 5)):
        monkeypatch.setattr(E, "CHUNK", chunk)
        monkeypatch.setattr(E, "BLOCK", block)
        monkeypatch.setattr(E.B, "CARRIED", carried)
        want = {r["qid"]: r.asDict() for r in E.per_query(q, d, pairs).collect()}
        assert {r["qid"]: r.asDict() for r in E.per_query(q, d, E.Shared(asked, held)).collect()} == want


def test_shared_relevance_makes_no_pairs(spark, sf_dir):
    from manyvec.plans.fixtures import shared

    q, d = queries_and_docs(spark, sf_dir)
    p = E.per_query(q, d, shared(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert "mark" in p and "qid" in p and not any("mark" in line and "qid" in line and "pid" in line for line in p.splitlines() if "Join" in line)


@pytest.mark.parametrize("options", [{}, {"reduction": "topk_mean", "top_k": 2}, {"reduction": "smoothmax", "temperature": 0.05}, {"reduction": "lse"}])
def test_pairs_below_their_bounds_change_nothing(spark, monkeypatch, options):
    """The same metrics as from a whole ranking, with and without bounds, and with rows merged often."""
    rng = np.random.default_rng(3)
    bag = lambda n: (rng.integers(-2, 3, size=(n, 3)) / 2).tolist()  # noqa: E731  many ties
    q = spark.createDataFrame([(i, bag(1 + i % 3)) for i in range(12)], "qid long, toks array<array<double>>")
    d = spark.createDataFrame([(i, bag(1 + i % 5)) for i in range(120)], "pid long, toks array<array<double>>")
    rel = spark.createDataFrame([(i, (i * 17 + 40 * j) % 120) for i in range(11) for j in range(3)], "qid long, pid long")
    want = {r["qid"]: r for r in metrics.per_query(scoring.score_multi_vector(q, d, **options), rel, 5).collect()}
    for many, loose in ((1.0, 1 << 18), (0.0, 7)):
        monkeypatch.setattr(E, "MANY", many)
        monkeypatch.setattr(E.Best, "LOOSE", loose)
        found = {r["qid"]: r for r in E.per_query(q, d, rel, 5, **options).collect()}
        assert found.keys() == want.keys()
        for qid, r in want.items():
            assert [found[qid][m] for m in ("ndcg", "recall", "mrr")] == pytest.approx([r[m] for m in ("ndcg", "recall", "mrr")]), (qid, many)


def test_tasks_give_k_rows_a_query_and_nothing_large_is_sorted(spark):
    q = spark.createDataFrame([(i, [[1.0, i / 9]]) for i in range(9)], "qid long, toks array<array<double>>")
    d = spark.range(900).selectExpr("id AS pid", "array(array(rand(1), rand(2))) AS toks")
    rel = q.select("qid", F.col("qid").alias("pid"))
    found = E.places(q, d, rel, 2)
    assert found.where("pid is not null").count() == 9 * 2 and found.where("pid is null").count() == 9
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
