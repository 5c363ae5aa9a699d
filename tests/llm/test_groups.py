"""Operators that compare documents, and the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from manyvec.llm import ann, components, exchange, jaccard, queries, substrings, suffixes
from tests.comparing import same


def key(r):
    return (r[0] is not None, r[0] or 0, *map(repr, r[1:]))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 3: neighbours


def plain_nearest(rows, every, k):
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for own, (q, u) in enumerate(good):
        if q % every == 0:
            near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(u, v)))), i) for n, (i, v) in enumerate(good) if n != own and len(v) == len(u))
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (200, None), (300, [0.0] * 64), (400, [None] + [1.0] * 63), (500, [float("nan")] * 64), (600, [float("inf")] * 64), (None, rows[1][1]), (700, [1.0, 2.0]), (701, [1.5, 2.0]), (7, rows[7][1]), (8, rows[9][1]), (20, rows[5][1])]
    df = spark.createDataFrame([(i, v, 9, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, score string")
    got = sorted(map(tuple, ann.search(df, every=10, k=5, vector_block=16, query_block=3).collect()))
    want = plain_nearest(rows, 10, 5)
    assert len(got) == len(want)
    assert len(set((g[0], g[2]) for g in got) & set((w[0], w[2]) for w in want)) >= 0.95 * len(want)
    assert {g[0] for g in got} == {w[0] for w in want} and 200 not in {g[2] for g in got}
    exact = defaultdict(list)
    for w in plain_nearest(rows, 10, 10**6):
        exact[w[0], w[2]].append(w[3])
    assert all(min(abs(g[3] - x) for x in exact[g[0], g[2]]) < 1e-12 for g in got)
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.where("vec_id in (700, 701)"), every=100).count() == 1


@pytest.mark.parametrize("dim", [8, 64, 100])
def test_codes_estimate_distances(dim):
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(500, dim))
    codes = ann.Codes(v)
    q = rng.normal(size=dim)
    exact = ((v - q) ** 2).sum(axis=1)
    guess, low = codes.estimates(q, 3.0)
    assert np.corrcoef(guess, exact)[0, 1] > 0.5
    assert (low <= exact + 1e-9).mean() > 0.98


def test_neighbours_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.select("vec_id", "embedding").collect()]
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(df).collect()}
    m, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    hit = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = ann.distances(m, m[i])
        near = [j for j in np.lexsort((ids, d)) if j != i][:10]
        hit, total = hit + sum((ids[i], ids[j]) in got for j in near), total + 10
    assert hit / total >= 0.97


# 4 and 7: repeats


def plain_repeats(rows, units, width):
    """Which units of each row go."""
    first = {}
    held = [(d, units(t) if d is not None else []) for d, t, *_ in rows]
    for d, u in held:
        for i in range(len(u) - width + 1):
            w = tuple(u[i : i + width]) if isinstance(u, list) else u[i : i + width]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, u in held:
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - width + 1):
            w = tuple(u[i : i + width]) if isinstance(u, list) else u[i : i + width]
            if first[w] < d:
                gone[i : i + width] = True
        out.append(gone)
    return out


def word_digests(rows):
    out = []
    for (d, t, *_), gone in zip(rows, plain_repeats(rows, words, 13)):
        w = words(t)
        kept = [x for i, x in enumerate(w) if not (len(gone) and gone[i])]
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def byte_digests(rows):
    out = []
    for (d, t, *_), gone in zip(rows, plain_repeats(rows, lambda t: (t or "").encode(), 50)):
        data = np.frombuffer((t or "").encode(), np.uint8)
        gone = gone if len(gone) else np.zeros(len(data), bool)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((d, len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
    return out


def test_word_repeats(docs, odd, none):
    assert sorted(map(tuple, substrings.digests(docs).collect()), key=key) == sorted(word_digests(odd), key=key)
    assert substrings.digests(none).count() == 0


def test_word_repeats_with_hot_blocks_and_small_buckets(docs, odd):
    assert sorted(map(tuple, substrings.digests(docs, bucket_words=500, hot=2).collect()), key=key) == sorted(word_digests(odd), key=key)


def test_word_repeats_come_through_the_anchors(docs, odd, monkeypatch):
    """Without the answers to probes nothing goes, not even within a batch; nor without the extension of hits."""
    assert any(r[2] for r in word_digests(odd))
    true = substrings.shared_keys
    monkeypatch.setattr(substrings, "_repeats", lambda pdf: pdf[["batch"]].assign(gone=b"").head(0))
    assert {r["n_removed"] for r in substrings.digests(docs).collect()} == {0}
    monkeypatch.undo()
    monkeypatch.setattr(substrings, "shared_keys", lambda *a, **k: true(*a, **k).where("false"))
    assert {r["n_removed"] for r in substrings.digests(docs).collect()} == {0}


def test_byte_repeats(docs, odd, none):
    assert sorted(map(tuple, suffixes.digests(docs, bucket_bytes=5000).collect()), key=key) == sorted(byte_digests(odd), key=key)
    assert suffixes.digests(none).count() == 0


def test_repeats_across_many_batches(spark, monkeypatch):
    """Small batches and buckets, so that windows meet across them."""
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdef ") for _ in range(90)) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice("abc ") for _ in range(60)) for _ in range(rng.randint(1, 6)))) for i in range(80)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    small = exchange.packed
    for module in (substrings, suffixes):
        monkeypatch.setattr(module, "packed", lambda d, count: small(d, count, 700))
    assert sorted(map(tuple, substrings.digests(df).collect())) == sorted(word_digests(rows))
    assert sorted(map(tuple, suffixes.digests(df, bucket_bytes=2000).collect())) == sorted(byte_digests(rows))


def test_dedupe_keeps_rows_columns_and_white_space(spark, docs):
    text = "  " + " ".join(f"w{i}" for i in range(20)) + "\n tail  end "
    df = spark.createDataFrame([(1, 7, text), (2, 8, "head\t" + text), (3, 9, None)], "doc_id long, batch int, text string")
    out = [tuple(r) for r in substrings.dedupe(df).orderBy("doc_id").collect()]
    assert out == [(1, 7, text), (2, 8, "head\t  "), (3, 9, None)]
    assert substrings.dedupe(docs).columns == docs.columns and substrings.dedupe(docs).count() == docs.count()
    same_ = suffixes.dedupe(df).orderBy("doc_id").collect()
    assert [r["text"] for r in same_][0::2] == [text, None] and same_[1]["text"] == "head\t"


def test_collection_order(monkeypatch, tmp_path):
    """The transform's suffix order and common prefixes against sorting all suffixes, over blocks of a few entries."""
    monkeypatch.setattr(suffixes, "BLOCK", 7)
    rng = random.Random(2)
    for trial in range(60):
        docs = [[rng.choice((0, 1) if trial % 2 else (0, 7, 300, 65535, 65536, 200000)) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(1, 9))]
        docs += docs[: trial % 3]
        size = np.array([len(s) for s in docs])
        start = np.cumsum(size) - size
        origin, shared = suffixes.collection_order(np.array([x for d in docs for x in d], np.uint32), start, size, 5 if trial % 5 else 60, str(tmp_path) if trial % 2 else None)
        at = [int(np.searchsorted(start, o, side="right")) - 1 for o in origin]
        got = [docs[i][o - start[i] :] for i, o in zip(at, origin.tolist())]
        assert len(set(origin.tolist())) == len(got) and got == sorted(d[i:] for d in docs for i in range(len(d)))
        for a, b, n in zip(got, got[1:], shared[1:]):
            k = 0
            while k < min(len(a), len(b), 5 if trial % 5 else 60) and a[k] == b[k]:
                k += 1
            assert k == n


def test_byte_repeats_come_through_the_transform(spark, docs, odd, monkeypatch):
    """Nothing goes that the transform has not named, not even of exact copies or within a batch."""
    passage = b"the passage that both of these texts share, as they are, and that goes"
    strings = [b"x" * 5 + passage, passage + b"y" * 5]
    found = suffixes.least_owners(strings, np.array([4, 3]), None)
    assert found[0, :26].tolist() == [4] * 5 + [3] * 21 and found[1, :21].tolist() == [3] * 21
    monkeypatch.setattr(suffixes, "collection_order", lambda *_, **__: (np.zeros(0, np.uint32), np.zeros(0, np.uint8)))
    assert (suffixes.least_owners(strings, np.array([4, 3]), None) == suffixes.NO_OWNER).all()
    real = suffixes._earlier

    def without(root):
        def run(pdf):
            held = suffixes.collection_order
            suffixes.collection_order = lambda *_, **__: (np.zeros(0, np.uint32), np.zeros(0, np.uint8))
            try:
                return real(root)(pdf)
            finally:
                suffixes.collection_order = held  # workers are used again

        return run

    monkeypatch.setattr(suffixes, "_earlier", without)
    assert {r["n_removed"] for r in suffixes.digests(docs).collect()} == {0}
    assert sum(r[2] for r in byte_digests(odd)) > 0


def test_batches_of_very_long_texts_stay_bounded(spark):
    """A batch ends at the text that fills it, wherever it stands among the 500 rows that are read together."""
    df = spark.range(50).selectExpr("id AS doc_id", "repeat(chr(cast(97 + id % 26 as int)), 2000000) AS text").coalesce(1)
    rows = exchange.packed(df, len).collect()
    tables = [exchange.unpacked(r["data"]) for r in sorted(rows, key=lambda r: r["batch"])]
    assert all(sum(map(len, t.column("text").to_pylist())) <= 2 * exchange.BATCH_BYTES for t in tables)
    assert [i for t in tables for i in t.column("doc_id").to_pylist()] == list(range(50))
    firsts = sorted((r["first"], len(t)) for r, t in zip(sorted(rows, key=lambda r: r["batch"]), tables))
    assert all(a + n == b for (a, n), (b, _) in zip(firsts, firsts[1:]))


def test_long_texts_lose_their_repeats(spark):
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=400_000))
    df = spark.createDataFrame([(i, "".join(rng.choices("ijklmnop ", k=100)) + passage) for i in range(6)], "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: r["n_removed"] for r in suffixes.digests(df).collect()}
    assert found[0] == 0 and all(found[i] >= 400_000 for i in range(1, 6))


def test_byte_repeats_with_hot_minimizers(odd, docs):
    assert sorted(map(tuple, suffixes.digests(docs, bucket_bytes=5000, hot=2).collect()), key=key) == sorted(byte_digests(odd), key=key)


# 8: joins


def shingle_set(text, n):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)])


def plain_classes(rows, n, percent):
    nodes = defaultdict(set)
    sets = [(d, shingle_set(t, n)) for d, t, *_ in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                nodes[a].add(b)
                nodes[b].add(a)
    low = {}
    for d, _ in sets:
        seen, todo = {d}, [d]
        while todo:
            for b in nodes[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        low[d] = min((x for x in seen if x is not None), default=None)
    return [(d, len(s), low[d]) for d, s in sets]


def near_copies(seed, count):
    rng = random.Random(seed)
    bases = [[rng.choice("abcdefghijklmnop") + str(rng.randint(0, 9)) for _ in range(rng.randint(40, 130))] for _ in range(5)]
    rows = []
    for i in range(count):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = "z" + str(rng.randint(0, 5))
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("n,percent,block", [(3, 90, 1_000_000), (5, 80, 1_000_000), (3, 90, 600), (2, 70, 300)])
def test_classes_of_near_copies(spark, n, percent, block):
    rows = near_copies(n, 160)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, jaccard.classes(df, n, percent, block_tokens=block, pivots=2).collect())) == sorted(plain_classes(rows, n, percent))


def test_classes_of_odd_rows(docs, odd, none):
    assert sorted(map(tuple, jaccard.classes(docs).collect()), key=key) == sorted(plain_classes(odd, 3, 90), key=key)
    assert jaccard.classes(none).count() == 0


def descending(tokens):
    return np.array(sorted(tokens, reverse=True), np.uint64)


def linked_groups(sets, percent, labels):
    """Groups of sets joined by links or a label, by comparing every pair."""
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if labels[i] == labels[j] or 100 * len(a & b) >= percent * len(a | b):
                top[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def test_one_trie_joins_exactly_what_links():
    rng = random.Random(8)
    for _ in range(300):
        pool, percent = rng.choice([12, 30]), rng.choice([50, 60, 80, 90])
        sets = [set(rng.sample(range(pool), rng.randint(3, 11))) for _ in range(rng.randint(1, 14))]
        sets += [s ^ {rng.randrange(pool)} or s for s in sets[:5]]
        sets = [s if s else {1} for s in sets]
        labels = [rng.choice([i, i, 100]) for i in range(len(sets))]
        links = jaccard.spanning_links([(i, len(s), descending(s), c) for i, (s, c) in enumerate(zip(sets, labels))], percent)
        assert all(100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) for a, b in links)
        want = linked_groups(sets, percent, labels)
        # each link joins two classes, and together they join all
        classes = {c: i for i, c in enumerate(dict.fromkeys(labels))}
        top = list(range(len(classes)))

        def find(x, top=top):
            while top[x] != x:
                x = top[x]
            return x

        for a, b in links:
            x, y = find(classes[labels[a]]), find(classes[labels[b]])
            assert x != y
            top[x] = y
        got = [find(classes[c]) for c in labels]
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(sets)) for j in range(i))


@pytest.mark.parametrize("count", [200, 1600])
def test_sets_that_share_paths_and_prefixes_are_walked_together(count):
    """Sets that do not link: frequent tokens in eight arrangements, others from a pool, and rare ones that each set
    shares with the next, so all of them are one candidate. The larger a token, the more frequent."""
    rng = random.Random(count)
    items = []
    for i in range(count):
        common = [10**6 + t for t in range(100) if (t * 7 + i % 8) % 5]
        own = common + [10**5 + t for t in rng.sample(range(200), 30)] + [10 * i + k for k in range(5)] + [10 * i + 10 + k for k in range(5)]
        items.append((i, len(own), descending(own), i))
    rng.shuffle(items)
    trie = jaccard.Trie(90)
    assert jaccard.spanning_links(items, 90, trie) == []
    pairs, nodes_a_path = count * (count - 1) // 2, 3
    assert trie.visited * 5 <= pairs * nodes_a_path


def test_a_cluster_of_near_copies_is_left_once_it_is_joined():
    rng = random.Random(3)
    base = rng.sample(range(100_000), 200)
    items = []
    for i in range(1500):
        own = set(base) - set(rng.sample(base, 3)) | {200_000 + rng.randrange(10**6) for _ in range(3)}
        items.append((i, len(own), descending(own), i))
    trie = jaccard.Trie(90)
    assert len(jaccard.spanning_links(items, 90, trie)) == 1499
    assert trie.visited < 1500 * 60


@pytest.mark.parametrize("flip", [False, True])
def test_a_shared_doc_id_has_the_links_of_each_of_its_texts(spark, flip):
    a, b = (" ".join(f"{k}{i}" for i in range(120)) for k in "ab")
    rows = [(1, a), (2, b), (5, a + " x"), (5, b + " y")][:: -1 if flip else 1]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted(plain_classes(rows, 3, 90))
    assert {r[2] for r in want} == {1} and sorted(map(tuple, jaccard.classes(df).collect())) == want


def plain_kept(rows, n, percent):
    """Rows that stay, each judged as a row of its own."""
    order = sorted((i for i, r in enumerate(rows) if r[0] is not None), key=lambda i: rows[i][0])
    low = plain_classes([(k, rows[i][1]) for k, i in enumerate(order)], n, percent)
    return Counter((rows[order[k]][0], rows[order[k]][1]) for k, _, c in low if c == k) + Counter((r[0], r[1]) for r in rows if r[0] is None)


def test_keep_first_keeps_one_of_each_group(docs, odd):
    out = jaccard.keep_first(docs, 5, 80)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == plain_kept(odd, 5, 80)


@pytest.mark.parametrize("flip", [False, True])
def test_keep_first_judges_rows_that_share_a_doc_id_by_their_texts(spark, flip):
    a, b, c = (" ".join(f"{k}{i}" for i in range(120)) for k in "abc")
    rows = [(5, a), (5, b), (5, a + " x"), (6, b + " y"), (7, c), (None, a), (8, None), (8, None)][:: -1 if flip else 1]
    df = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, __keep long").coalesce(1)
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_first(df, 5, 80).collect()]
    assert len(kept) == 6 and {(5, b), (7, c), (None, a), (8, None)} < set(kept)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2200)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = sorted((find(a), find(b)))
            top[rb] = ra
    out = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: find(x) for x in list(top)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, duck, sf_dir, name, monkeypatch):
    """Over batches of 200 KB, so the small table has a dozen of them."""
    small = exchange.packed
    for module in (substrings, suffixes, jaccard):
        monkeypatch.setattr(module, "packed", lambda d, count: small(d, count, 200_000))
    same(queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLES[name]))


# the pipeline


def test_pipeline_stages_keep_their_contract(spark, docs, none):
    for start in (docs, none):
        at = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = corpus_pipeline.stored(stage(spark, at, ""), name)
            assert out.columns == start.columns and out.count() <= at.count()
            at = out
        packed = corpus_pipeline.STAGES[-1][1](spark, at, "")
        assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in at.collect()}


def test_pipeline_against_plain_stages(spark, odd):
    """Each stage's decisions against the plain version of its rule, on that stage's own input."""
    from manyvec.llm import pii, rules

    rows = [r for r in odd if r[0] not in (None, 50)] + [(60, odd[0][1] + " write to a.b@c.org now", "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stages = dict(corpus_pipeline.STAGES)
    one = corpus_pipeline.stored(stages["quality_rules"](spark, df, ""), "one")
    verdict = {r["doc_id"]: r["kept"] for r in rules.quality_rules(df).collect()}
    assert {r["doc_id"] for r in one.collect()} == {d for d, k in verdict.items() if k}
    two = corpus_pipeline.stored(stages["near_duplicates"](spark, one, ""), "two")
    held = [tuple(r) for r in one.collect()]
    assert Counter((r["doc_id"], r["text"]) for r in two.collect()) == plain_kept(held, 5, 80)
    three = corpus_pipeline.stored(stages["repeats"](spark, two, ""), "three")
    held = [tuple(r) for r in two.collect()]
    gone = plain_repeats(held, words, 13)
    want = {r[0]: [w for w, g in zip(words(r[1]), list(x) or [False] * 10**6) if not g] for r, x in zip(held, gone)}
    assert {r["doc_id"]: words(r["text"]) for r in three.collect()} == want
    four = stages["personal_data"](spark, three, "")
    model = pii.fitted()
    before = {r["doc_id"]: r["text"] for r in three.collect()}
    assert {r["doc_id"]: r["text"] for r in four.collect()} == {d: pii.redacted(t, model.spans(t)[1]) for d, t in before.items()}


def test_pipeline_query(spark, sf_dir):
    out = corpus_pipeline.QUERIES["pipeline"](spark, sf_dir).collect()
    assert len(out) > 50 and all(r["length"] <= 2048 for r in out)
