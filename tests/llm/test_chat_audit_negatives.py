"""Chat formatting, the audit of filters and hard negatives, against plain versions."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from manyvec.llm import audit, chat, negatives


def key(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


# 11: chat formatting

PIECES = ["<", "[", "\\", "/", "s>", "INST]", "[INST]", "[/INST]", "</s>", "<s>", "[IMG:", "[IMG:1]", "[ROLE]", "ANS]", "x", "\n", "é😀", "]", ">", ""]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@given(TEXTS)
@settings(max_examples=400, deadline=None)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escape = chat.Escape(chat.Template())
    out = escape.escaped(text)
    assert escape.plain(out) == text
    assert not any(c in out for c in chat.Template().controls)


@given(TEXTS, TEXTS)
@settings(max_examples=300, deadline=None)
def test_escape_is_one_to_one(a, b):
    escape = chat.Escape(chat.Template())
    assert (escape.escaped(a) == escape.escaped(b)) == (a == b)


@given(st.sampled_from(["system", "user", "assistant", "tool", "", "[ROLE]", None]), st.lists(TEXTS, max_size=4))
@settings(max_examples=300, deadline=None)
def test_turns_read_back(role, texts):
    template = chat.Template()
    parts = []
    for i, t in enumerate(texts):  # images between the texts
        parts += [{"kind": "text", "text": t, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}]
        parts += [{"kind": "image", "text": None, "ref": f"r{i}", "width": 56, "height": 28, "seconds": None, "pages": None}] * (i % 2)
    segment, mask, attachments = chat.Writer(template, chat.Costs()).segment(role, parts)
    got_role, got = chat.Reader(template).turn(segment)
    want, n = "", 0
    for p in parts:
        n += p["kind"] == "image"
        want += (p["text"] or "") if p["kind"] == "text" else f"[IMG:{n}]"
    assert got_role == (role or "") and (got == want or "[IMG:" in "".join(texts))
    assert [a["ref"] for a in attachments] == [p["ref"] for p in parts if p["kind"] == "image"]
    assert all(segment[a["at"] :].startswith(f"[IMG:{a['number']}]") and a["tokens"] == 2 for a in attachments)
    escape = chat.Escape(template)
    assert "".join(escape.plain(segment[m["start"] : m["end"]]) for m in mask) == ("".join(texts) if role == "assistant" else "")


def test_visitor_takes_every_kind_in_order():
    part = lambda kind, **x: {"kind": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | x
    parts = [part("text", text="a [IN"), part("text", text="ST] b"), part("audio", ref="s.wav", seconds=1.5), None, part("document", ref="d.pdf", pages=3), part("video", ref="v"), part("image", ref="i"), part("text", text="end"), part("audio", seconds=float("nan"))]
    segment, mask, attachments = chat.Writer(chat.Template(), chat.Costs()).segment("assistant", parts)
    assert segment == "[ANS]a [\\INST] b[AUD:1][DOC:2][ATT:3][IMG:4]end[AUD:5]</s>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in attachments] == [("audio", "s.wav", 38), ("document", "d.pdf", 768), ("video", "v", 1), ("image", "i", 1), ("audio", None, 1)]
    assert [segment[m["start"] : m["end"]] for m in mask] == ["a [\\INST] b", "end"]


def test_template_refuses_ambiguous_marks():
    for bad in (("x", "[A", "[A]"), ("x", "A]", "[B]"), ("x", "[[A]", "[B]")):
        with pytest.raises(ValueError):
            chat.Template(turns=(bad,))


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def plain_segment(role, text):
    escape = chat.Escape(chat.Template()).escaped
    begin, end = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>")}.get(role, (f"[ROLE]{escape(role or '')}[/ROLE]", "</s>"))
    return begin + escape(text or "") + end


def plain_conversations(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", plain_segment(*r[2:])))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        size = sum(len(plain_segment(*r[2:])) for r in own)
        out.append((conv, len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size, 0, 0))
    return sorted(out, key=key)


def test_conversations_against_plain_version(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, -1, 0, 1, 2, 3]), rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", "system", "tool", "a[ROLE]", "", None]), rng.choice([None, "", "".join(rng.choices(PIECES, k=9))])) for _ in range(80)]
    rows += [(7, i, "assistant", "word [INST] " * 20_000) for i in range(3)] + [(8, 0, "user", "x")] * 3
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(3).withColumns({c: F.lit("z") for c in ("segment", "mask", "n_turns", "parts", "attachments")})
    found = chat.conversations(chat.formatted(chat.text_parts(df))).collect()
    assert sorted(map(tuple, found), key=key) == plain_conversations(rows)
    none = spark.createDataFrame([], CONVERSATIONS)
    assert chat.conversations(chat.formatted(chat.text_parts(none))).count() == 0


def test_conversations_longer_than_a_batch_of_rows(spark):
    """One conversation with nearly all rows streams through, whatever the batches."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i} </s>") for i in range(25_000)] + [(2, 0, "user", "y")]
    found = chat.conversations(chat.formatted(chat.text_parts(spark.createDataFrame(rows, CONVERSATIONS)))).collect()
    assert sorted(map(tuple, found), key=key) == plain_conversations(rows)


def test_parts_of_a_frame_become_placeholders(spark):
    df = spark.createDataFrame([(1, 0, "user")], "conv_id long, turn long, role string").withColumn(
        "parts", F.expr(f"cast(array(named_struct('kind','image','text',null,'ref','a.png','width',57,'height',28,'seconds',null,'pages',null), named_struct('kind','text','text','what?','ref',null,'width',null,'height',null,'seconds',null,'pages',null)) as array<{chat.PART}>)")
    )
    row = chat.formatted(df).first()
    assert row["segment"] == "[INST][IMG:1]what?[/INST]" and row["attachments"][0]["ref"] == "a.png" and row["attachments"][0]["tokens"] == 3
    told = chat.conversations(chat.formatted(df)).first()
    assert (told["n_attachments"], told["expanded_tokens"]) == (1, 3)
    empty = df.withColumn("parts", F.lit(None).cast(f"array<{chat.PART}>"))
    assert chat.formatted(empty).first()["segment"] == "[INST][/INST]"


# 12: audit of filters


def fails(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text))]


def plain_audit(docs, labels):
    """Filters applied one after the other to every part in every order."""
    smallest = {}
    for d, text, *_ in docs:
        if d is not None:
            smallest[text or ""] = min(d, smallest.get(text or "", d))
    good, toxic = ({d for d, q, t in labels if (q, t)[i] == 1 and d is not None} for i in (0, 1))
    rows = [(lang or "", d, fails(text or "") + [d is not None and d > smallest[text or ""]]) for d, text, lang, *_ in docs]
    out = []
    for part in {r[0] for r in rows}:
        own, shap, lines = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                i = "ABCDE".index(f)
                gone, left = [r for r in left if r[2][i]], [r for r in left if not r[2][i]]
                shap[f] += len(gone)
                lines.append([part, "".join(order), step, len(left), len(gone), sum(r[2][i] for r in own) - len(gone), sum(r[2][i] and sum(r[2]) == 1 for r in own), sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone), f])
        out += [tuple(line[:-1]) + (shap[line[-1]],) for line in lines]
    return sorted(out)


LABELS = "doc_id long, quality int, toxic int"


def test_audit_against_plain_version(spark, docs, odd, none):
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 45, 2)] + [(20, 1, 1), (20, 0, None), (50, 1, 1), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("q"))
    out = audit.interactions(docs, frame)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, out.collect())) == plain_audit(odd, labels)
    assert audit.interactions(none, frame).count() == 0
    assert audit.interactions(docs, spark.createDataFrame([], LABELS)).where("good_lost + toxic_lost > 0").count() == 0


def test_zeta_is_the_sum_over_subsets(spark):
    counts = [random.Random(6).randrange(50) for _ in range(32)]
    got = spark.range(1).select(audit.zeta(F.array(*[F.lit(c).cast("long") for c in counts]), 5).alias("z")).first()["z"]
    assert got == [sum(counts[s] for s in range(32) if s & m == s) for m in range(32)]


def test_copies_collapse_before_they_are_shuffled_by_hash(spark):
    """A text that nearly all documents share is a row a task when it is dealt by hash."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "if(id % 3 = 0, concat('t', id), 'all alike') AS text", "'en' AS lang")
    counted = audit.masks(docs, spark.createDataFrame([], LABELS))
    rows = {r["mask"]: r["n"] for r in counted.collect()}
    assert rows == {1: 2001, 17: 3999}
    p = counted._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in p and "Cartesian" not in p and "SinglePartition" not in p
    assert p.count("partial_min") >= 1  # combined before the shuffle


# 13: hard negatives


def plain_negatives(rows, every=100, positives=5, k=5):
    """Every row with every other."""
    usable = []
    for n, (i, v, label) in enumerate(rows):
        if i is None or v is None or label is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        usable.append((n, i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for a in usable:
        if a[1] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[3], b[3])), b[1], b[0], b[2]) for b in usable if b[0] != a[0] and len(b[3]) == len(a[3]))
        for s, p, *_ in [x for x in scored if x[3] == a[2]][:positives]:
            inside = [x for x in scored if x[3] != a[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a[1], p, r, x[1], -s, -x[0]) for r, x in enumerate(inside, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int"


def clustered(rng, n, dim):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    return [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)], rng.choice([0, 0, 0, 1, 2, 9])) for i in range(n)]


def test_negatives_against_plain_version(spark):
    rng = random.Random(8)
    rows = clustered(rng, 500, 6)
    rows += [(600, None, 1), (601, [None] * 6, 1), (602, [float("nan")] * 6, 1), (603, [float("inf")] + [0.0] * 5, 1), (604, [1.0] * 6, None), (None, [1.0] * 6, 1), (700, [0.0] * 6, 2), (701, [0.0] * 6, 2), (702, [0.0] * 6, 3)]
    rows += [(800, [1.0, 2.0], 0), (801, [1.0, 2.0], 0), (803, [0.9, 2.0], 1), (900, [], 0), (901, [], 0), (902, [], 4)]
    rows += [(200, rows[200][1], rows[200][2]), (5, rows[5][1], rows[5][2]), (6, rows[5][1], 9), (6, rows[5][1], 9)]
    df = spark.createDataFrame(rows, VECTORS).coalesce(1).withColumns({c: F.lit(1) for c in ("row", "id", "score", "cell", "rank")})
    for block_rows in (32_768, 40):
        found = negatives.mine(df, block_rows=block_rows)
        assert sorted(map(tuple, found.collect())) == plain_negatives(rows)
    assert dict(found.dtypes)["rank"] == "int"
    assert negatives.mine(df.limit(0)).count() == 0


def test_negatives_of_huge_components(spark):
    rows = [(100, [1e300, 1.0], 1), (101, [1e300, 2.0], 1), (102, [1e300, 3.0], 2), (200, [3e9, 1.0], 3), (201, [3e9, 2.0], 3), (202, [2.9e9, 3.0], 4), (203, [1e308, 3.0], 4)]
    found = {(r[0], r[1], r[3]): r[5] for r in negatives.mine(spark.createDataFrame(rows, VECTORS)).collect()}
    assert found[100, 101, 102] == 2**63 - 1


@pytest.mark.parametrize("v, n", [([], 0), ([0, -5, 32767], 6), ([-32768, 1], 16), ([1e300, -1.0], 16)])
def test_vectors_are_packed_exactly(v, n):
    data = negatives.laid_down(np.array(v, float))
    assert len(data) == n and negatives.taken_up(data, len(v)).tolist() == v


def test_brackets_hold_the_scores():
    rng = np.random.default_rng(2)
    rows = np.floor(rng.normal(size=(300, 16)) * 100)
    square = float((rows * rows).sum(axis=1).max())
    pivots = negatives.Pivots.farthest(list(rows[:80]), square, 6)
    block = negatives.Block(pivots, 16, [(i, i, 0, r.tobytes(), pivots.of_row(r).tobytes()) for i, r in enumerate(rows)])
    for q in rows[:40]:
        low, high = block.bracket(q, np.arange(300))
        exact = rows @ q
        assert (low <= exact).all() and (exact <= high).all()


def test_brackets_spare_exact_scores_where_rows_lie_in_groups():
    """Far clusters are left out by their stored distances."""
    rng = np.random.default_rng(3)
    rows = np.floor((rng.normal(size=(8, 32)) * 300)[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 32)))
    pivots = negatives.Pivots.farthest(list(rows[:500]), float((rows * rows).sum(axis=1).max()), 8)
    block = negatives.Block(pivots, 32, [(i, i, 0, r.tobytes(), pivots.of_row(r).tobytes()) for i, r in enumerate(rows)])
    checked, scores = [], block.scores
    block.scores = lambda q, at: (checked.append(len(at)), scores(q, at))[1]
    assert len(list(block.positives(0, 0, rows[0], 5))) == 5 and sum(checked) < 1500
