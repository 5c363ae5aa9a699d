"""Small cases with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from manyvec.functions import grids as G
from manyvec.functions import texts as T
from manyvec.functions import vectors as V
from manyvec.operators import adapter, ann, datasets, encoder, losses, maps, metrics, pooling, prefix, scoring, search, selection


def bags(spark, key, items):
    return spark.createDataFrame([(i, [[float(x) for x in v] for v in bag]) for i, bag in enumerate(items)], f"{key} long, toks array<array<double>>")


def scores(spark, matrix):
    return spark.createDataFrame([(q, p, float(s)) for q, row in enumerate(matrix) for p, s in enumerate(row)], "qid long, pid long, score double")


def rels(spark, pairs):
    return spark.createDataFrame(pairs, "qid long, pid long")


def value(df):
    return df.collect()[0][0]


def one_query(spark, row, relevant, k):
    return metrics.per_query(scores(spark, [row]), rels(spark, [(0, p) for p in relevant]), k).collect()[0]


def test_ndcg_recall_rank(spark):
    assert one_query(spark, [0.9, 0.7, 0.5, 0.3, 0.1], [0], 5)["ndcg"] == 1
    assert one_query(spark, [0.1, 0.3, 0.5, 0.7, 0.9], [0], 5)["ndcg"] == pytest.approx(1 / math.log2(6))
    order = [0, 5, 0, 4, 0, 3, 0, 2, 0, 1]
    assert one_query(spark, order, [1, 3, 7], 3)["recall"] == pytest.approx(2 / 3)
    assert one_query(spark, [0, 2, 3, 1], [1], 5)["mrr"] == 0.5
    lost = one_query(spark, [0, 2, 3, 1], [99], 5)
    assert lost["mrr"] == 0 and lost["ndcg"] == 0
    tied = metrics.ranked(scores(spark, [[1, 1, 1]])).orderBy("rank").collect()
    assert [r["pid"] for r in tied] == [0, 1, 2]


def test_evaluate_and_k_beyond_documents(spark):
    out = metrics.evaluate(scores(spark, [[0.1, 0.9, 0], [0.8, 0.2, 0.1]]), rels(spark, [(0, 1), (1, 0)]), 50).collect()[0]
    assert (out["ndcg"], out["recall"], out["mrr"], out["n_queries"], out["n_docs"]) == (1, 1, 1, 2, 3)


def test_robust_reductions(spark):
    q = bags(spark, "qid", [[[1, 0]]])
    assert scoring.score_multi_vector(q, bags(spark, "pid", [[[1, 0], [0.5, 0], [-1, 0]]]), "topk_mean", 2).collect()[0]["score"] == 0.75
    d = bags(spark, "pid", [[[-1, 0]], [[-1, 0], [-0.5, 0], [-0.25, 0]]])
    assert [r["score"] for r in scoring.score_multi_vector(q, d, "topk_mean", 2).orderBy("pid").collect()] == [-1.0, -0.375]
    assert [r["score"] for r in scoring.score_multi_vector_padded(q, d).orderBy("pid").collect()] == [0.0, -0.25]
    assert math.isfinite(scoring.score_multi_vector(q, d, "smoothmax").collect()[1]["score"])
    lse = scoring.score_multi_vector(q, d, "lse", temperature=0.5).orderBy("pid").collect()[1]["score"]
    assert lse == pytest.approx(0.5 * math.log(sum(math.exp(x / 0.5) for x in (-1, -0.5, -0.25))))
    for bad in ({"reduction": "sum"}, {"top_k": 0}, {"temperature": 0}):
        with pytest.raises(ValueError):
            scoring.score_multi_vector(q, d, **bad)
    with pytest.raises(ValueError):
        scoring.score("multi", q.limit(0), d)


def test_block_pairs_equal_broadcast_pairs(spark):
    a, b = spark.range(37).withColumnRenamed("id", "x"), spark.range(23).withColumnRenamed("id", "y")
    assert sorted(map(tuple, scoring.pairs(a, b, blocks=4).select("x", "y").collect())) == sorted(map(tuple, scoring.pairs(a, b).select("x", "y").collect()))


def test_unpadding(spark):
    left = bags(spark, "pid", [[[0, 0], [0, 0], [1, 2], [3, 4]], [[0, 0], [5, 6], [0, 0], [9, 10]], [[0, 0]]])
    sizes = [r[0] for r in left.orderBy("pid").select(F.size(V.unpad(F.col("toks"), "left"))).collect()]
    assert sizes == [2, 3, 0]
    right = bags(spark, "pid", [[[1, 2], [0, 0], [3, 4], [0, 0]]])
    assert right.select(V.unpad(F.col("toks"), "right")).collect()[0][0] == [[1, 2], [0, 0], [3, 4]]
    with pytest.raises(ValueError):
        V.unpad(F.col("toks"), "middle")


def test_hierarchical_pooling(spark):
    e = np.eye(3)
    page = [e[0], e[1], e[2], e[0], e[0], e[0]]
    out = pooling.hierarchical(bags(spark, "pid", [page]), 2).collect()[0]
    assert np.allclose(np.array(out["toks"]), e)
    assert out["clusters"] == {0: [0, 3, 4, 5], 1: [1], 2: [2]}
    for factor in range(1, 6):
        assert len(pooling.pool_page(np.array(page) + np.random.default_rng(factor).normal(0, 0.01, (6, 3)), factor)[0]) == max(6 // factor, 1)
    with pytest.raises(ValueError):
        pooling.pool_page(np.ones((1, 3)), 2)


def test_ward_is_greedy_merging():
    rng = np.random.default_rng(3)
    for _ in range(10):
        x = rng.normal(size=(12, 4))
        held = {i: [i] for i in range(12)}
        heights = []
        while len(held) > 1:
            cost = {(a, b): math.sqrt(2 * len(held[a]) * len(held[b]) / (len(held[a]) + len(held[b]))) * np.linalg.norm(x[held[a]].mean(0) - x[held[b]].mean(0)) for a in held for b in held if a < b}
            a, b = min(cost, key=cost.get)
            heights.append(cost[a, b])
            held[a] += held.pop(b)
        assert np.allclose([m[2] for m in pooling.ward_merges(x)], heights)


def test_pool_embeddings_pads_and_unpads(spark):
    pages = bags(spark, "pid", [[[0, 0], [0, 0], [1, 0], [0, 1]], [[0, 0], [1, 0], [0, 1], [1, 0]]])
    out = pooling.pool_embeddings(pages, 1, padding=True, repad=True).orderBy("pid").collect()
    assert [len(r["toks"]) for r in out] == [3, 3] and out[0]["toks"][0] == [0, 0]
    assert pooling.pool_embeddings(pages.limit(0), 2).count() == 0


def test_maps(spark):
    m = spark.createDataFrame([(0, 0, x, y, float(s)) for (x, y), s in {(0, 0): 1, (1, 0): 1, (0, 1): 0, (1, 1): -1}.items()], "page long, q_tok long, x long, y long, sim double")
    assert [r["sim"] for r in maps.normalized(m).orderBy("y", "x").collect()] == pytest.approx([1, 1, 0.5, 0], abs=1e-6)
    flat = m.withColumn("sim", F.lit(1.0))
    assert {r["sim"] for r in maps.normalized(flat).collect()} == {0.0}
    pages = spark.createDataFrame([(0, [[1.0, 0.0]] * 6)], "page long, toks array<array<double>>")
    query = spark.createDataFrame([(0, 0, [1.0, 0.0])], "page long, q_tok long, q array<double>")
    assert maps.similarity_maps(query, pages, 2, 3).count() == 6
    with pytest.raises(Exception, match="grid"):
        maps.similarity_maps(query, pages, 2, 2).collect()


def test_negative_filter_and_zero_losses(spark):
    out = {(r["qid"], r["pid"]): r["score"] for r in losses.down_weight_negatives(scores(spark, [[1, 0.96], [0.5, 1]])).collect()}
    assert out == {(0, 0): 1, (0, 1): pytest.approx(0.48), (1, 0): 0.5, (1, 1): 1}
    zero = scores(spark, np.zeros((3, 3)))
    assert value(losses.in_batch(zero, 1.0)) == pytest.approx(math.log(3))
    assert value(losses.symmetric(zero, 1.0)) == pytest.approx(math.log(3))
    for loss in (losses.pairwise(zero, 1.0), losses.sigmoid(zero, 1.0), losses.block_sigmoid(zero, 1.0)):
        assert value(loss) == pytest.approx(math.log(2))
    pos, neg = zero.where("qid = pid"), zero.where("qid <> pid")
    assert value(losses.negatives(pos, neg, zero, 1.0, weight=0)) == pytest.approx(math.log(2))
    assert value(losses.negatives(pos, neg, zero, 1.0)) == pytest.approx((math.log(2) + math.log(3)) / 2)
    with pytest.raises(ValueError):
        losses.in_batch(zero, 0)
    with pytest.raises(ValueError):
        losses.negatives(pos, neg, zero, 1.0, weight=2)
    with pytest.raises(Exception, match="shapes"):
        losses.distillation(zero, zero.where("pid < 2")).collect()
    assert value(losses.multi_positive(zero, rels(spark, [(9, 9)]))) == 0


def test_metric_deltas_and_summary(spark):
    m = spark.createDataFrame([("clean", 0.57, 0.58, 0.65), ("degraded", 0.45, 0.30, 0.60), ("gaussian", 0.48, 0.25, 0.61)], "condition string, ndcg double, recall double, mrr double")
    out = {r["condition"]: r for r in metrics.metric_deltas(m, "degraded").collect()}["gaussian"]
    assert (out["delta_ndcg"], out["delta_recall"], out["delta_mrr"]) == (0.03, -0.05, 0.01)
    rows = metrics.summary(m).collect()
    assert [r["condition"] for r in rows] == ["clean", "degraded", "gaussian"] and rows[1]["gain"] == 0


def test_batch_sampler(spark):
    for sizes, batches in (([10, 6], 3), ([12], 3), ([13], 3), ([7, 9], 3), ([4, 4, 4], 3)):
        rows = spark.createDataFrame([(f"d{d}", d * 100 + i) for d, n in enumerate(sizes) for i in range(n)], "dataset string, id long")
        out = datasets.single_dataset_batches(rows, "dataset", "id", 4).toPandas()
        assert out["batch"].nunique() == batches and set(out.groupby("batch").size()) == {4} and set(out.groupby("batch")["dataset"].nunique()) == {1}
        again = datasets.single_dataset_batches(rows, "dataset", "id", 4).toPandas()
        assert out.sort_values("id").reset_index(drop=True).equals(again.sort_values("id").reset_index(drop=True))


def test_lookup(spark):
    corpus = spark.createDataFrame([(i, f"doc_{i}") for i in range(3)], "docid long, doc string")
    samples = spark.createDataFrame([(0, [2, 0]), (1, [1])], "id long, pos array<long>")
    assert [r["docs"] for r in selection.lookup(samples, corpus, "pos", "docid", "doc", "docs").orderBy("id").collect()] == [["doc_2", "doc_0"], ["doc_1"]]
    with pytest.raises(Exception, match="unknown id"):
        selection.lookup(samples.limit(0).union(spark.createDataFrame([(5, [9])], samples.schema)), corpus, "pos", "docid", "doc", "docs").collect()


def test_collate_and_vqa(spark):
    rows = spark.createDataFrame([(1, "q", ["a"], ["x", "y"]), (2, "r", ["b"], None)], "id long, query string, pos array<string>, neg array<string>")
    out = datasets.collated(rows).orderBy("id").collect()
    assert (out[0]["doc_text"], out[0]["neg_doc_text"], out[1]["neg_doc_text"]) == ("a", ["x", "y"], None)


def test_splits(spark):
    variants = selection.split_variants(selection.all_variants(spark)).toPandas()
    assert variants["variant"].is_unique
    assert variants[variants["variant"] == "PD_MB_GN_JC_LR_CS"]["split"].tolist() == ["test"]
    assert variants["split"].value_counts().to_dict() == {"train": 30, "val": 16, "test": 6}
    q = spark.createDataFrame([(i, f"answer-{i // 3}") for i in range(18)], "query_id long, raw_answers string")
    groups = selection.split_groups(selection.query_groups(q)).collect()
    assert len(groups) == 6 and all(len(g["query_ids"]) == 3 for g in groups) and {g["split"] for g in groups} == {"train", "val", "test"}
    many = selection.query_groups(spark.range(40).selectExpr("id AS query_id", "id AS raw_answers"))
    assert selection.split_groups(many).groupBy("split").count().toPandas().set_index("split")["count"].to_dict() == {"train": 17, "val": 6, "test": 6}
    with pytest.raises(ValueError):
        selection.split_groups(selection.query_groups(q.where("query_id < 6")))
    with pytest.raises(ValueError):
        selection.validated_methods(["nlmeans", "x"], ("nlmeans",))
    assert selection.validated_methods(["b", "a", "b"], ("a", "b")) == ["b", "a"]
    with pytest.raises(ValueError):
        selection.chosen_variants(["z"], ["a"])


def test_numbering_without_a_single_task(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1009 AS k")
    out = prefix.numbered(rows, "k").orderBy("k").collect()
    assert [r["rn"] for r in out] == list(range(1, 1001))


def test_grids(spark):
    row = spark.range(1).select(*G.resized(F.lit(100), F.lit(301), 200), *G.resized(F.lit(5), F.lit(4000), 200), *G.resized(F.lit(70), F.lit(30), None)).collect()[0]
    assert tuple(row) == (66, 200, 1, 200, 70, 30)
    with pytest.raises(Exception, match="square"):
        spark.range(1).select(G.square_side(F.lit(7))).collect()
    odd = spark.createDataFrame([(0, 0, True), (0, 1, True), (0, 2, True)], "s long, pos long, img boolean")
    with pytest.raises(Exception, match="blocks"):
        G.scatter_blocks(odd, "s", F.col("img"), 2).collect()


def test_texts(spark):
    with pytest.raises(ValueError):
        T.exclusive(None, None)
    with pytest.raises(ValueError):
        T.payload(None, None)
    with pytest.raises(ValueError):
        T.conversation("smell", F.lit("x"))
    row = spark.range(1).select(T.variant_name(F.lit("/x/page_001_GN_JC.png")), T.variant_name(F.lit("/x/page_002.png")), T.augment_query(F.lit("q"), "<e>", "p", "s"), T.payload(F.array(*[F.lit("a").cast("binary")] * 9), None)).collect()[0]
    assert (row[0], row[1], row[2]) == ("GN_JC", None, "pqs") and "error" in row[3]
    assert set(T.VISUAL_PROMPTS) <= set(T.AUGMENTATION_TOKENS)


def test_matryoshka_and_pool_errors():
    with pytest.raises(ValueError):
        V.matryoshka(F.col("v"), 100)
    with pytest.raises(ValueError):
        V.pool(F.col("toks"), "max")


def test_adapter_starts_as_identity_and_learns():
    rng = np.random.default_rng(0)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 6)))
    a = adapter.Adapter(6, 5)
    x = unit(5)
    assert np.allclose(a.forward(x), x)
    with pytest.raises(ValueError):
        a.forward(np.ones((2, 3)))
    ex = adapter.Example([unit(3), unit(2)], [unit(4), unit(3), unit(2)], rng.normal(size=(2, 3)), [{0, 2}, {1, 9}])
    a.weights = {k: v + rng.normal(0, 0.1, v.shape) for k, v in a.weights.items()}
    parts, grads = adapter.loss_and_gradient(a, ex, temperature=0.5)
    for name, g in grads.items():
        flat = a.weights[name].ravel()
        for i in range(0, len(flat), max(1, len(flat) // 4)):
            kept, step = flat[i], 1e-5
            flat[i] = kept + step
            up = adapter.loss_and_gradient(a, ex, temperature=0.5)[0]["total"]
            flat[i] = kept - step
            down = adapter.loss_and_gradient(a, ex, temperature=0.5)[0]["total"]
            flat[i] = kept
            assert (up - down) / (2 * step) == pytest.approx(g.ravel()[i], abs=2e-4)
    fresh = adapter.Adapter(6, 5)
    best, history = adapter.train(fresh, [ex], lambda m: -adapter.loss_and_gradient(m, ex)[0]["total"], epochs=15, rate=0.01)
    assert history[-1]["loss"] < history[0]["loss"]
    assert np.allclose(adapter.Adapter.from_json(best.to_json(ndcg=1.0)).forward(x), best.forward(x))
    stopped = adapter.train(adapter.Adapter(6, 5), [ex], lambda m: 0.0, epochs=50, patience=3)[1]
    assert len(stopped) == 4


def test_swarm(spark):
    best, score = search.Swarm([(0, 10), (0, 10)], particles=10, iters=30).optimize(lambda p: -((p[0] - 3) ** 2 + (p[1] - 7) ** 2))
    assert score > -5 and (best >= 0).all() and (best <= 10).all()
    at, top = search.Swarm([(0, 1)], particles=3, iters=2).optimize_frame(spark, lambda f: f.select("particle", (-F.abs(F.col("params")[0] - 0.5)).alias("score")))
    assert top == pytest.approx(-abs(at[0] - 0.5))


def test_approximate_search_recall(spark):
    rng = np.random.default_rng(5)
    unit = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.normal(size=(n, 16))).tolist()
    docs, q = bags(spark, "pid", [unit(6) for _ in range(120)]), bags(spark, "qid", [unit(4) for _ in range(8)])
    c = ann.fit_centroids(docs, 16)
    got = {(r["qid"], r["pid"]) for r in ann.search(q, docs, ann.build(docs, c), c, 10, 8).collect()}
    want = {(r["qid"], r["pid"]) for r in scoring.retrieve(q, docs, 10).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_encoder_plugs_in(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    out = {r["id"]: r["toks"] for r in encoder.encoded(rows, "id", "text", encoder.HashingEncoder(4)).collect()}
    assert len(out[1]) == 2 and out[2] == [] and np.linalg.norm(out[1][0]) == pytest.approx(1)


def test_restoration_objective(spark):
    from manyvec.operators import images

    rng = np.random.default_rng(2)
    shots = [np.kron(rng.integers(0, 255, (6, 6, 1)), np.ones((4, 4, 1))).astype(np.uint8) for _ in range(4)]
    rows = spark.createDataFrame([(i, *s.shape, bytearray(s.tobytes())) for i, s in enumerate(shots)], images.IMAGE)
    enc = encoder.RowEncoder(24)
    queries = search.encoded_images(rows, enc).withColumnRenamed("pid", "qid")
    assert search.restoration_objective(rows, queries, enc)([0.0, 0.0]) > 0.9


def test_token_filter_and_patch_kinds(spark):
    row = spark.range(1).select(T.without_special(F.array(*map(F.lit, [1, 100, 101, 102, 103, 2, 0])), [0, 1, 2]).alias("t"), *G.n_patches("single", F.lit(1), F.lit(1))).collect()[0]
    assert [x["index"] for x in row["t"]] == [1, 2, 3, 4] and row[1:] == (1, 1)
    with pytest.raises(NotImplementedError):
        G.n_patches("omni", F.lit(1), F.lit(1))
    with pytest.raises(ValueError):
        T.payload(F.lit(1), F.lit(1))
