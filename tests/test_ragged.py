"""Ragged pixel sequences and batches of several kinds."""

import pytest
from pyspark.sql import functions as F

from manyvec.functions import ragged as R

ITEMS = f"batch long, pos long, item {R.ITEM}"
PROCESSORS = {"text": lambda t: F.concat(F.lit("t:"), t), "image": lambda i: F.concat(F.lit("i:"), F.hex(i))}


def rows(spark, *made):
    return spark.createDataFrame([(b, p, k and {"kind": k, "text": x if k == "text" else None, "image": bytearray(x.encode()) if k == "image" and x else None}) for b, p, k, x in made], ITEMS)


def test_sequences_split_pad_and_join(spark):
    df = spark.createDataFrame([([[float(i), 1.0] for i in range(6)], [[1, 1, 2], [1, 1, 0], [2, 2, 2]])], "s array<array<double>>, g array<array<int>>").withColumn("n", R.by_grid(F.col("g")))
    parts = R.split(F.col("s"), F.col("n"))
    row = df.select(parts.alias("p"), R.padded(parts, F.lit(2)).alias("q"), R.joined(R.padded(parts, F.lit(2)), F.col("n")).alias("j"), "s").first()
    assert row["p"] == [row["s"][:2], [], row["s"][2:]]
    assert [len(p) for p in row["q"]] == [4, 4, 4] and row["q"][1] == [[0.0, 0.0]] * 4
    assert row["j"] == row["s"]


def test_sizes_must_cover_the_sequence(spark):
    df = spark.createDataFrame([([[1.0]] * 3, [1, 1])], "s array<array<double>>, n array<int>")
    with pytest.raises(Exception, match="cover"):
        df.select(R.split(F.col("s"), F.col("n"))).collect()


def test_items_go_to_the_processor_of_their_kind(spark):
    df = rows(spark, (1, 0, "text", "a"), (1, 1, "text", ""), (2, 0, "image", "b"))
    found = {(r["batch"], r["pos"]): (r["d_kind"], r["d_input"]) for r in R.collated(df, "item", PROCESSORS, "d_").collect()}
    assert found == {(1, 0): ("text", "t:a"), (1, 1): ("text", "t:"), (2, 0): ("image", "i:62")}


def test_a_mixed_batch_is_an_error_unless_it_is_split(spark):
    df = rows(spark, (1, 0, "text", "a"), (1, 1, "image", "b"))
    with pytest.raises(Exception, match="mixed kinds: image, text"):
        R.collated(df, "item", PROCESSORS).collect()
    assert {r["input"] for r in R.collated(df, "item", PROCESSORS, mixed="split").collect()} == {"t:a", "i:62"}
    with pytest.raises(ValueError):
        R.collated(df, "item", PROCESSORS, mixed="other")


@pytest.mark.parametrize("kind, value, said", [("sound", "x", "no processor for sound"), ("image", "", "holds none")])
def test_items_nobody_can_process_are_errors(spark, kind, value, said):
    with pytest.raises(Exception, match=said):
        R.collated(rows(spark, (1, 0, kind, value)), "item", PROCESSORS).collect()


def test_lists_keep_their_order_and_must_be_even(spark):
    one = lambda *texts: [{"kind": "text", "text": t, "image": None} for t in texts]
    df = spark.createDataFrame([(1, 0, one("a", "b")), (1, 1, one("c", "d")), (2, 0, one("e"))], f"batch long, pos long, items array<{R.ITEM}>")
    found = {(r["batch"], r["pos"]): r["neg_inputs"] for r in R.collated_lists(df, "items", PROCESSORS, "neg_").collect()}
    assert found == {(1, 0): ["t:a", "t:b"], (1, 1): ["t:c", "t:d"], (2, 0): ["t:e"]}
    with pytest.raises(Exception, match="unequal"):
        R.collated_lists(df.union(spark.createDataFrame([(2, 1, one("f", "g"))], df.schema)), "items", PROCESSORS).collect()
    assert R.collated_lists(df.limit(0), "items", PROCESSORS).count() == 0
