"""What each of a chain of filters does, alone and in every order, by subset sums.

A document's failures are one bit mask. Documents are counted by part and mask, so all that follows works on at most
2**k counts a part. The subset-zeta transform turns the counts of exact masks into the counts of masks within a set;
a filter subset keeps the documents whose mask lies within the rest, so the transform gives the survivors of every
filter subset at once. A step of an order is then a difference between two neighbouring subsets, for documents and
for labelled documents alike, and a filter's removals over all orders are differences weighted by how many orders pass
between those subsets.

Plan: texts are read once and leave as a 32-byte hash with a mask. Labels join by doc_id; rows that share doc_id and text
are counted where they meet. Whether an earlier document has the same text needs the smallest doc_id of each hash: documents
are first counted by hash, part and labels (tasks send a row for each of these, however many copies there are),
and the smallest doc_id of a hash is taken over these counts.

Edge cases: null texts are empty; the empty text is a text like others; null parts are the empty string; rows with a
null doc_id neither are nor have an earlier copy, and have no labels; rows that share the smallest doc_id are all first;
a document with several label rows counts as good or toxic if one of them says so; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from manyvec.functions.vectors import let
from manyvec.llm.common import narrow

FILTERS = "ABCDE"
SPACES = "[\\x20\\x09-\\x0D]+"
COUNTS = ("n", "good", "toxic")


def text_failures(text: Column) -> list[Column]:
    """A: under 200 words; B: under half of the words are distinct; C: over 3 % of the characters are A to Z;
    D: a symbol."""

    def words(found: Column) -> list[Column]:
        n = F.size(found)
        return [n < 200, 100 * F.size(F.array_distinct(found)) < 50 * n]

    by_words = let(F.filter(F.split(text, SPACES), lambda w: w != ""), lambda w: F.array(*words(w)))
    return [by_words[0], by_words[1], 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text), text.rlike("[#$%&*|]")]


def mask_of(failures: list[Column]) -> Column:
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures)]
    return sum(bits[1:], bits[0]).cast("int")


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failures, E (bit 4) being an earlier equal text."""
    rows = narrow(docs, "doc_id", "text", part).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("h"), mask_of(text_failures(F.col("text"))).alias("mask"))
    marks = narrow(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("is_good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("is_toxic"))
    told = rows.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_good", "is_toxic")})
    alike = ["h", "mask", "part", "is_good", "is_toxic"]
    each = told.groupBy("doc_id", *alike).agg(F.count("*").alias("c"))  # dealt by doc_id already
    known = F.col("doc_id").isNotNull()
    counted = each.groupBy(*alike).agg(
        F.sum("c").alias("c"), F.coalesce(F.sum(F.when(~known, F.col("c"))), F.lit(0)).alias("unnamed"), F.min(F.when(known, F.struct("doc_id", "c"))).alias("first"),
    )
    counted = counted.withColumn("least", F.min(F.col("first.doc_id")).over(W.partitionBy("h")))
    firsts = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.c")).otherwise(0)
    sides = counted.withColumn("side", F.explode(F.array(F.struct(F.col("mask").alias("mask"), firsts.alias("c")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("c") - firsts).alias("c")))))
    n = F.col("side.c")
    return sides.where(n > 0).groupBy("part", F.col("side.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("is_good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("is_toxic"), n).otherwise(0)).alias("toxic")
    )


def zeta(counts: Column, k: int) -> Column:
    """Sums over all subsets, of an array indexed by bit mask: one pass a bit."""

    def over(bit: int):
        return lambda a: F.transform(a, lambda x, i: x + F.when(i.bitwiseAND(bit) != 0, F.get(a, i - bit)).otherwise(0))

    for b in range(k):
        counts = let(counts, over(1 << b))
    return counts


def survivors(counted: DataFrame, k: int) -> DataFrame:
    """(part, n, good, toxic): arrays by filter subset of what passes all filters of the subset."""
    blank = F.array_repeat(F.lit(0).cast("long"), 1 << k)
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS))))  # at most 2**k entries a part
    exact = lambda c: F.transform(blank, lambda zero, i: F.coalesce(F.col("by_mask")[i][c], zero))
    # what passes a subset has its mask within the complement, which stands at the mirrored place
    return counted.groupBy("part").agg(by_mask.alias("by_mask")).select("part", *[F.reverse(zeta(exact(c), k)).alias(c) for c in COUNTS])


def over_all_orders(n: Column, bit: Column, k: int) -> Column:
    """A filter's removals summed over all orders: |S|! (k - 1 - |S|)! orders pass the subset S just before the filter."""
    weights = F.array(*[F.lit(math.factorial(s.bit_count()) * math.factorial(max(0, k - 1 - s.bit_count()))).cast("long") for s in range(1 << k)])
    lost = lambda w, s: F.when(s.bitwiseAND(bit) == 0, w * (F.get(n, s) - F.get(n, s + bit))).otherwise(0)
    return F.aggregate(F.transform(weights, lost), F.lit(0).cast("long"), lambda a, x: a + x)


def steps(kept: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step: differences between the subsets before and after it."""
    k = len(filters)
    orders = F.array(*[F.lit("".join(o)) for o in permutations(filters)])
    bit_of = F.create_map(*[F.lit(x) for i, f in enumerate(filters) for x in (f, 1 << i)])
    within = lambda n: F.aggregate(F.slice(F.col("bits"), 1, n), F.lit(0), lambda a, b: a + b)
    rows = kept.select("*", F.explode(orders).alias("filter_order")).withColumn("bits", F.transform(F.split("filter_order", ""), lambda f: bit_of[f]))
    rows = rows.select("*", F.posexplode("bits").alias("pos", "bit")).select("*", within(F.col("pos")).alias("before"), within(F.col("pos") + 1).alias("after"))
    n, full = F.col("n"), (1 << k) - 1
    lost = lambda c: F.get(c, F.col("before")) - F.get(c, F.col("after"))
    return rows.select(
        "part", "filter_order", (F.col("pos") + 1).cast("int").alias("step"), F.get(n, "after").alias("kept"), lost("n").alias("removed"),
        (F.get(n, F.lit(0)) - F.get(n, "bit") - lost("n")).alias("redundant"), (F.get(n, F.lit(full) - F.col("bit")) - F.get(n, F.lit(full))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), over_all_orders(n, F.col("bit"), k).alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of filters A to E."""
    return steps(survivors(masks(docs, labels, part), len(FILTERS)))
