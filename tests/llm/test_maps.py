"""Operators that judge each document by itself, and the models they fit."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from manyvec.llm import bpe, common, langid, packing, pii, quality, rules

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def key(r):
    return (r[0] is not None, r[0] or 0, *map(repr, r[1:]))


# 1: byte-level BPE


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_library_on_random_text(library):
    codec, rng = bpe.codec(RANKS, P.PATTERN), random.Random(1)
    alphabet = "etaoin shrdlu  \n\t'sé漢😀012.,!?abcABC"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
        assert codec.encode(text) == library.encode_ordinary(text)
        assert codec.bpe.decode(codec.encode(text)) == text.encode()


def test_bpe_long_pieces_are_linear(library):
    codec = bpe.codec(RANKS, P.PATTERN)
    for text in ("a" * 50_000, "ab" * 20_000, "!" * 30_000, " " * 20_000 + "x", "abcdefghij" * 3000):
        assert codec.encode(text) == library.encode_ordinary(text)


def test_bpe_rows(docs, odd, none, library):
    want = []
    for d, text, *_ in odd:
        ids = library.encode_ordinary(text or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(docs, RANKS, P.PATTERN).collect()), key=key) == sorted(want, key=key)
    assert bpe.digests(none, RANKS, P.PATTERN).count() == 0


def test_bpe_round_trip(docs, odd):
    back = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect()
    assert sorted(((r["doc_id"], bytes(r["bytes"]).decode()) for r in back), key=key) == sorted(((d, t or "") for d, t, *_ in odd), key=key)


def test_latin_splitter_equals_pattern():
    import regex

    split, whole, rng = common.splitter(P.PATTERN), regex.compile(P.PATTERN).findall, random.Random(2)
    for _ in range(2000):
        text = "".join(chr(rng.choice([rng.randrange(256), rng.randrange(256), 32, 10, 0x4E00])) for _ in range(30))
        assert split(text) == whole(text)


# 2: personal data


def naive_spans(text):
    """Base spans by the plain patterns."""
    found = [(*m.span(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(*m.span(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for n, pattern in ((2, r"[0-9]([\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (12 <= len(d) <= 19 and pii.luhn(d)) if n == 2 else 9 <= len(d) <= 15:
                found.append((*m.span(), n))
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_pii_base_equals_plain_patterns():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "@x", ".", "1", "22", "333", "4", "-", " ", "+", "(", ")", "%", "_", "\n", "é", "x@y.z", "+1 (555) 010-9999", "4111 1111 1111 1111", "10.0.0.1", "256.1.1.1"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == naive_spans(text), text


def test_pii_model_finds_disguised_entities_and_spares_numbers():
    model = pii.fitted()
    hit = total = wrong = 0
    for text, gold in pii.examples(300, 77):
        base, spans = model.spans(text)
        assert set(base) <= set(spans)
        hit, total = hit + len(set(gold) & set(spans)), total + len(gold)
        wrong += len(set(spans) - set(gold) - set(base))
    assert hit / total > 0.97 and wrong / total < 0.03
    for clean in ("order 6044423740532315 came", "on 2024-05-17 at 12:30", "version 4.0, page 3.", 'token = "269b1cea0846965f2d3ecb5cdb87c0edc7a7a587"', "meet at noon. then go"):
        assert model.spans(clean)[1] == []
    assert [s[2] for s in model.spans("call (017) 555-7713 or write ann [at] mail [dot] com")[1]] == [3, 0]


def test_pii_segmentation_is_the_best_of_all():
    """Dynamic programming against every segmentation of small lattices."""
    model = pii.fitted()
    for text, _ in pii.examples(60, 9):
        for cuts, segments in pii.lattices(text, []):
            if len(segments) > 14:
                continue
            scored = [(i, j, max(sum(w.get(x, 0.0) for x in pii.features(text, a, b)) for w in model.weights)) for i, j, a, b in segments]

            def best(at):
                return max([0.0] + [s + best(j) for i, j, s in scored if i >= at and s > 0])

            got = sum(max(sum(w.get(x, 0.0) for x in pii.features(text, a, b)) for w in model.weights) for a, b, _ in model.added(text, []) if cuts[0] <= a and b <= cuts[-1])
            assert got == pytest.approx(best(0))


def test_pii_rows(spark, docs, odd, none):
    model = pii.fitted()
    out = {r["doc_id"]: r for r in pii.find(docs, model).collect()}
    assert out[30]["spans"] == "" and out[30]["n_email"] == 0 and out[30]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find(none, model).count() == 0
    rows = spark.createDataFrame([(1, "write to a.b@c.org or 10.1.2.3 now", 5), (2, None, 6)], "doc_id long, text string, spans int")
    assert [tuple(r) for r in pii.redact(rows, model).orderBy("doc_id").collect()] == [(1, "write to [EMAIL] or [IP] now", 5), (2, None, 6)]


def test_pii_long_texts_are_linear():
    model = pii.fitted()
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "@" * 100_000):
        assert model.spans(text)[1] == []


def test_pii_finds_entities_anywhere_in_long_chains_of_numbers():
    model = pii.fitted()
    for count in range(30):
        lead = "".join(f"{count + i:03} " for i in range(count))
        for entity, kind in (("(555) 123-4567", 3), ("4111.1111.1111.1111", 2), ("13x at mail dot com", 0)):
            text = f"{lead}{entity}"
            assert (len(lead), len(text), kind) in model.spans(text)[1], text
    row = " ".join(f"{i} (415) 555-26{i}" for i in range(10, 60))
    assert [row[a:b] for a, b, _ in model.spans(row)[1]] == [f"(415) 555-26{i}" for i in range(10, 60)]


# 5: packing


def test_packing_holds_every_token_once(docs, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    cut = packing.pieces(docs, JSON, P.PATTERN, with_ids=True)
    by = defaultdict(list)
    for r in cut.collect():
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 2048
        by[r["doc_id"]].append(r)
    for d, text, *_ in odd:
        if d in (None, 50):
            continue
        parts = sorted(by[d], key=lambda r: r["piece"])
        assert [x for r in parts for x in r["ids"]] == library.encode(text or "", add_special_tokens=False).ids + [0]
        assert [r["start"] for r in parts] == list(np.cumsum([0] + [r["length"] for r in parts])[:-1])
        assert all(r["length"] == 2048 for r in parts[1:])
    packed = packing.pack(packing.pieces(docs, JSON, P.PATTERN)).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for x in by.values() for r in x)
    bins = defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in packed)
    assert len(bins) <= -(-total // 2048) + 1
    assert packing.pack(packing.pieces(none, JSON, P.PATTERN)).count() == 0


def test_packing_of_special_strings_as_the_library_does():
    from tokenizers import Tokenizer

    library, tok = Tokenizer.from_file(JSON), packing.tokenizer(JSON, P.PATTERN)
    texts = ["hi <|endoftext|> there", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|endoftext| >", "plain"]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in tok.batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert tok.batch(texts[:1])[0] == np.array([5303, 220, 50256, 612], "<u4").tobytes()


def test_packing_deals_rows_without_ids_over_all_groups(spark):
    df = spark.createDataFrame([(None, "same text " * 40)] * 300, "doc_id long, text string").repartition(3)
    cut = packing.pieces(df, JSON, P.PATTERN)
    out = packing.pack(cut, group_tokens=3000).collect()
    sizes = Counter(r["sequence_id"] >> 32 for r in out)
    assert len(out) == 300 and len(sizes) > 4 and max(sizes.values()) < 150


def test_best_two_fit_beats_greedy():
    """[60, 35] leaves 5; exchanging the 35 for 20 + 20 fills the sequence."""
    bins, offsets = packing.best_two_fit(np.array([60, 35, 20, 20]), 100)
    assert sorted(np.bincount(bins, [60, 35, 20, 20])) == [35, 100]
    rng = np.random.default_rng(0)
    for _ in range(50):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets = packing.best_two_fit(lengths, 100)
        assert (np.bincount(bins, lengths) <= 100).all()
        for b in set(bins.tolist()):
            mine = np.flatnonzero(bins == b)
            order = mine[np.argsort(offsets[mine])]
            assert (offsets[order] == np.cumsum(lengths[order]) - lengths[order]).all()


# 6: quality, 9: language


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.94
    assert ((out["score"] >= 0) & (out["score"] <= 1)).all()


def test_quality_against_a_plain_version(spark):
    """The score of every row from the model's dictionaries, by plain calls of the library."""
    import zstandard

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    size = lambda known, data: len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(known), write_content_size=False, write_dict_id=False).compress(data))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    for r in quality.score(docs, model).collect()[::10]:
        blocks = [texts[r["doc_id"]][i : i + quality.BLOCK].encode() for i in range(0, len(texts[r["doc_id"]]), quality.BLOCK)]
        gap = sum(size(model.bad, b) - size(model.good, b) for b in blocks) / max(1, sum(map(len, blocks)))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(model.weights[0] * gap + model.weights[1], -30, 30))), abs=0.02)
        assert r["predicted"] == int(r["score"] >= 0.7)
    assert quality.blocks_of("a" * quality.BLOCK * 40, 3) == [b"a" * quality.BLOCK] * 3 and len(quality.blocks_of("é" * (quality.BLOCK + 1), 16)) == 2


def test_quality_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, None), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert quality.score(none, quality.fit(none, labels.limit(0))).count() == 0
    for r in out:
        assert r["held_out"] == common.is_held_out(r["doc_id"])


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = langid.identify(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.99


def test_language_backs_off_and_handles_odd_rows(spark, docs, none):
    train = spark.createDataFrame([(i, t, lang, "s") for i, (t, lang) in enumerate([("the cat sat", "en"), ("die katze schlief", "de")] * 8)], "doc_id long, text string, lang string, source string")
    model = langid.fit(train)
    probe = spark.createDataFrame([(1, "the the"), (2, "katzen schliefen"), (3, "sat!"), (4, None), (5, "123 ,, ²½"), (6, "THE CAT")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(probe, model).collect()} == {1: "en", 2: "de", 3: "en", 4: "und", 5: "und", 6: "en"}
    out = langid.identify(docs, langid.fit(docs)).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert langid.identify(none, langid.fit(none)).count() == 0
    assert all(r["lang_pred"] == "und" for r in langid.identify(docs, langid.fit(none)).collect())


def test_language_with_few_texts_keeps_its_words_and_draws_no_others(spark):
    rng = random.Random(3)
    big = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    small = ["".join(rng.choice("pqrstuvwxyz") for _ in range(6)) for _ in range(20)]
    text = lambda words: " ".join([*rng.choices(words, k=12), "no"])
    ids = [i for i in range(700) if not common.is_held_out(i)]
    rows = [(d, text(big), "aa") for d in ids[:400]] + [(d, text(small), "bb") for d in ids[400:404]]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train, most_words=60, most_grams=200)
    seen = {w for _, t, lang in rows if lang == "bb" for w in t.split()}
    assert seen <= set(model.words) and 40 < len(model.words) <= 60 and 150 < len(model.gram_row) <= 200
    # totals are those of all counted rows, and one: 13 words a text, of which "no" is one
    totals = np.array([13 * 400 + 1, 13 * 4 + 1])
    shares = np.array([400, 4]) / totals
    assert np.allclose(np.exp(model.words["no"]), (shares * totals + langid.PRIOR * shares.mean()) / (totals + langid.PRIOR))
    probe = spark.createDataFrame([(i, text(big if i % 2 else small)) for i in range(40)], "doc_id long, text string")
    assert all(r["lang_pred"] == ("aa" if r["doc_id"] % 2 else "bb") for r in langid.identify(probe, model).collect())


# 10: rules


def naive_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_rules_counts(docs, odd, none):
    out = sorted((tuple(r)[:7] for r in rules.quality_rules(docs).collect()), key=key)
    want = []
    for d, text, *_ in odd:
        s = naive_stats(text)
        want.append((d, *s, s[0] < 20 or 100 * s[4] > 30 * s[0]))
    assert out == sorted(want, key=key)
    assert rules.quality_rules(none).count() == 0


def test_rules_reject_outliers_and_keep_clean_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = rules.quality_rules(docs).join(labels, "doc_id").where("not base_failed").toPandas()
    assert out[out["quality"] == 1]["kept"].mean() > 0.99
    assert out[out["quality"] == 0]["kept"].mean() < 0.05


def test_rules_keep_returns_the_rows(docs, none):
    kept = rules.keep(docs)
    assert kept.columns == docs.columns
    verdicts = Counter(r["doc_id"] for r in rules.quality_rules(docs).where("kept").collect())
    assert Counter(r["doc_id"] for r in kept.collect()) == verdicts
    assert rules.keep(none).count() == 0


def test_concentration_finds_the_clean_scatter(spark):
    """A fifth of gross outliers leaves location and scatter of the rest nearly as they are."""
    rng = np.random.default_rng(1)
    clean = rng.normal(2.0, 0.5, (4000, rules.P))
    rows = np.concatenate([clean, rng.normal(9.0, 0.2, (1000, rules.P))])
    df = spark.createDataFrame([("=en", "=a", *map(float, r)) for r in rows], "lang_g string, source_g string, " + ", ".join(f"{f} double" for f in rules.FEATURES))
    r = rules.estimates(df).first()
    assert np.allclose(r["mu"], 2.0, atol=0.1)
    spread = np.linalg.inv(np.array(r["inverse"]).reshape(rules.P, rules.P))
    want, _ = rules.bounded(np.cov(clean.T))
    assert np.allclose(spread, np.linalg.inv(want), atol=0.08)
    assert rules.chi2_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3)


def plain_mcd(x, share):
    """Concentration steps from the same kind of starts and from many random ones, in memory; the best."""
    h = int(np.ceil(share * len(x)))
    rng = np.random.default_rng(5)

    def settle(mu, cov):
        goal = np.inf
        for _ in range(200):
            inverse, new = rules.bounded(cov)
            if new > goal - 1e-9:
                break
            goal = new
            d2 = np.einsum("ij,jk,ik->i", x - mu, inverse, x - mu)
            near = x[d2 <= np.sort(d2)[h - 1]]
            mu, cov = near.mean(axis=0), np.cov(near.T, bias=True)
        return goal, mu, cov

    begun = [x[rng.choice(len(x), 12, replace=False)] for _ in range(60)]
    return min((settle(b.mean(axis=0), np.cov(b.T, bias=True)) for b in begun), key=lambda t: t[0])


def test_estimates_reach_the_least_determinant(spark):
    """Each group against plain concentration from sixty random starts."""
    rng = np.random.default_rng(2)
    rows, groups = [], {}
    for g in "abc":
        turn = rng.normal(size=(rules.P, rules.P))
        x = np.concatenate([rng.normal(size=(400, rules.P)) @ turn + 3, rng.normal(4, 3, (90, rules.P)) @ turn])
        groups[g] = x
        rows += [("=en", f"={g}", *map(float, r)) for r in x]
    df = spark.createDataFrame(rows, "lang_g string, source_g string, " + ", ".join(f"{f} double" for f in rules.FEATURES))
    factor = rules.SHARE / rules.chi2_cdf(rules.chi2_quantile(rules.SHARE, rules.P), rules.P + 2)
    for r in rules.estimates(df).collect():
        _, mu, cov = plain_mcd(groups[r["source_g"][1:]], rules.SHARE)
        assert np.allclose(r["mu"], mu, atol=0.25 * np.sqrt(np.diag(cov)).max())
        got = -np.linalg.slogdet(np.array(r["inverse"]).reshape(rules.P, rules.P))[1]
        assert got <= -np.linalg.slogdet(rules.bounded(cov * factor)[0])[1] + 0.05
