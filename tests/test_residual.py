"""The residual-compressed index: codec, pruning, recall against all pages, and what it moves."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from manyvec.operators import ann, scoring
from manyvec.operators import residual as R
from manyvec.plans import indexes
from manyvec.plans.fixtures import fiftieths, sixes

BAGS = "pid long, toks array<array<double>>"


def codec(dim=8, k=5, bits=4, seed=1):
    rng = np.random.default_rng(seed)
    limits = np.linspace(-1, 1, 2**bits - 1) if bits > 1 else np.zeros(1)
    values = np.concatenate([[limits[0] - 0.1], (limits[1:] + limits[:-1]) / 2, [limits[-1] + 0.1]])
    return R.Codec(rng.normal(size=(k, dim)), limits, values, np.full(k, 0.3))


@given(st.integers(0, 10_000), st.sampled_from([1, 2, 4, 8]))
@settings(max_examples=60, deadline=None)
def test_codes_hold_bucket_numbers(seed, bits):
    c, x = codec(bits=bits), np.random.default_rng(seed).normal(size=(7, 8))
    near, packed = c.encode(x)
    assert packed.shape == (7, bits)
    back = c.decode(near, packed)
    for v, n, b in zip(x, near, back):
        assert n == int(np.argmax(c.centroids @ v))
        want = [c.values[sum(limit <= r for limit in c.limits)] for r in v - c.centroids[n]]
        assert np.allclose(b, c.centroids[n] + want, atol=1e-12)


def test_codec_is_checked_and_kept_as_text():
    c = codec()
    again = R.Codec.from_json(c.to_json())
    assert (again.centroids == c.centroids).all() and again.bits == 4 and (again.spread == c.spread).all()
    with pytest.raises(ValueError):
        R.Codec(c.centroids, c.limits[:-1], c.values, c.spread)
    with pytest.raises(ValueError):
        R.Codec(np.zeros((2, 7)), np.zeros(1), np.zeros(2), np.zeros(2))


def ragged(spark, seed=3, n=90, dim=8):
    rng = np.random.default_rng(seed)
    bags = [(i, rng.normal(size=(rng.integers(1, 7), dim)).tolist()) for i in range(n)]
    bags += [(200, bags[4][1]), (201, bags[4][1]), (300, []), (301, None)]
    return bags, spark.createDataFrame(bags, BAGS).repartition(3)


def test_search_of_infinite_width_scores_every_decompressed_page(spark):
    bags, docs = ragged(spark)
    c = codec()
    queries = [(i, np.random.default_rng(50 + i).normal(size=(3, 8)).tolist()) for i in range(5)] + [(9, [])]
    q = spark.createDataFrame(queries, "qid long, toks array<array<double>>")
    for chunk in (1024, 7):
        found = R.search(q, R.build(docs, c, chunk), k=6, width=float("inf"), block=2).collect()
        want = []
        for qid, toks in queries[:-1]:
            scored = []
            for pid, bag in bags:
                if bag:
                    scored.append((-round(float((np.array(toks) @ c.decode(*c.encode(np.array(bag))).T).max(axis=1).sum()), 9), pid))
            want += [(qid, r + 1, pid) for r, (_, pid) in enumerate(sorted(scored)[:6])]
        assert sorted((r["qid"], r["rank"], r["pid"]) for r in found) == want


def test_centroid_scores_use_stored_numbers_alone(spark):
    bags, docs = ragged(spark, seed=8)
    c = codec()
    q = spark.createDataFrame([(1, np.eye(8)[:2].tolist())], "qid long, toks array<array<double>>")
    found = [(r["pid"], round(r["score"], 9)) for r in R.search(q, R.build(docs, c, 16), k=4, width=None).orderBy("rank").collect()]
    rough = sorted((-round(float((np.eye(8)[:2] @ c.centroids[c.encode(np.array(b))[0]].T).max(axis=1).sum()), 9), p) for p, b in bags if b)
    assert found == [(p, -s) for s, p in rough[:4]]


def test_index_is_kept_with_its_codec(spark, tmp_path):
    _, docs = ragged(spark)
    index = R.build(docs, codec(), 16)
    index.save(f"file://{tmp_path}/index")
    again = R.Index.load(spark, f"file://{tmp_path}/index")
    assert sorted(map(tuple, R.codes(again).collect())) == sorted(map(tuple, R.codes(index).collect()))
    size = again.size().first()
    assert size["n_docs"] == 92 and size["n_bytes"] == size["n_tokens"] * (2 + 4)


def test_no_documents(spark):
    empty = spark.createDataFrame([], BAGS)
    q = spark.createDataFrame([(1, [[1.0] * 8])], "qid long, toks array<array<double>>")
    assert R.search(q, R.build(empty, codec())).count() == 0
    with pytest.raises(ValueError):
        R.fit(empty)


def test_pruning_follows_the_data():
    """Few documents are decompressed where pages lie in groups, whatever their number."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    tokens = centres[rng.integers(0, 40, 2000).repeat(3)] + rng.normal(size=(6000, 32)) * 0.1
    tokens /= np.linalg.norm(tokens, axis=1, keepdims=True)
    centroids = ann.k_means(tokens, 64, 5, 1)
    c = R.learned(tokens, centroids, 4)
    near, packed = c.encode(tokens)
    held = R.Chunk(c, range(2000), [3] * 2000, near.tobytes(), packed.tobytes())
    query = tokens[:3]
    found = held.best(query, 10, 4.0)
    assert held.decompressed < 6000 / 2
    everything = held.best(query, 10, float("inf"))
    assert held.decompressed == 6000
    assert [p for p, _ in found] == [p for p, _ in everything]


def shuffled_bytes(spark, df):
    """Bytes that the stages of one query write for others to read."""
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    group = f"g{id(df)}"
    spark.sparkContext.setJobGroup(group, group)
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    total = 0
    for job in tracker.getJobIdsForGroup(group):
        for stage in tracker.getJobInfo(job).stageIds:
            if tracker.getStageInfo(stage):
                total += store.lastStageAttempt(stage).shuffleWriteBytes()
    return total


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_on_all_vectors(spark, folder):
    if not os.path.exists(folder):
        pytest.skip("no such table")
    exact = scoring.retrieve(fiftieths(spark, folder), sixes(spark, folder), k=10)
    found = indexes.residual_top10(spark, folder)
    row = R.recall(found, exact).agg(F.avg("recall").alias("mean"), F.count("*").alias("n")).first()
    assert row["n"] == {"sf0.01": 10, "sf0.1": 40}[folder.rsplit("/", 1)[-1]] and row["mean"] >= 0.9


def test_search_moves_less_than_exact_retrieval_where_queries_are_too_many_to_broadcast(spark, monkeypatch):
    """Both sides then meet block by block: vectors here, codes there."""
    folder = "/root/testdata/sf0.1"
    if not os.path.exists(folder):
        pytest.skip("no such table")
    pages, queries = sixes(spark, folder).cache(), fiftieths(spark, folder)
    pages.count()
    index = R.build(pages, R.fit(pages))
    index = R.Index(index.chunks.cache(), index.codec)
    index.chunks.count()
    monkeypatch.setattr(scoring, "BROADCAST_BYTES", 20_000)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        searched = shuffled_bytes(spark, R.search(queries, index, k=10, block=8))
        exact = shuffled_bytes(spark, scoring.retrieve(queries, pages, k=10))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    pages.unpersist()
    index.chunks.unpersist()
    assert 0 < searched < exact / 4


def test_build_shuffles_nothing_and_search_only_results(spark):
    _, docs = ragged(spark)
    index = R.build(spark.createDataFrame([(1, [[1.0] * 8])], BAGS), codec())
    assert "Exchange" not in index.chunks._jdf.queryExecution().executedPlan().toString()
    q = spark.createDataFrame([(1, [[1.0] * 8])], "qid long, toks array<array<double>>")
    p = R.search(q, index)._jdf.queryExecution().executedPlan().toString()
    assert p.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in p.split("Exchange hashpartitioning")[1]
