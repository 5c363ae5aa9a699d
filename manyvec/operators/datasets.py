"""Dataset preparation: unions, caps, splits, mining, batch sampling. Random choices are orders by hash, hence repeatable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from manyvec.functions.texts import stable_hash
from manyvec.operators.prefix import numbered


def union(named: dict[str, DataFrame]) -> DataFrame:
    """All rows, with the name of their dataset."""
    return reduce(DataFrame.unionByName, [d.withColumn("dataset", F.lit(n)) for n, d in named.items()])


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    return rows.orderBy(stable_hash(F.col(key), seed), key)


def shuffled_places(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds ``place``: each row's number from 1 in the seeded order."""
    return numbered(rows.withColumn("__h", _hash_number(key, seed)), "__h", "place", key).drop("__h")


def _hash_number(key: str, seed: int) -> Column:
    """The seeded hash's leading 52 bits, a number to order by."""
    return F.conv(F.substring(stable_hash(F.col(key), seed), 1, 13), 16, 10).cast("double")


def cap_sources(rows: DataFrame, source: str, caps: dict[str, int], key: str, seed: int = 42) -> DataFrame:
    """At most so many rows of each capped source, the first in hash order; the window's limit also runs before the shuffle."""
    cap = F.coalesce(*[F.when(F.col(source) == s, F.lit(n)) for s, n in caps.items()], F.lit(None).cast("int"))
    free = rows.where(cap.isNull())
    by = W.partitionBy(source).orderBy(stable_hash(F.col(key), seed), key)
    held = rows.where(cap.isNotNull()).withColumn("__r", F.row_number().over(by))
    held = held.where((F.col("__r") <= max(caps.values(), default=0)) & (F.col("__r") <= cap))  # the first bound is what Spark pushes down
    return free.unionByName(held.drop("__r"))


def head_split(rows: DataFrame, key: str, n: int, seed: int | None = None) -> DataFrame:
    """Adds ``split``: the first ``n`` rows test, the rest train; in the order of ``key``, or of its seeded hash."""
    if seed is None:
        out = numbered(rows, key, "__rn")
    else:
        out = numbered(rows.withColumn("__h", _hash_number(key, seed)), "__h", "__rn", key).drop("__h")
    return out.withColumn("split", F.when(F.col("__rn") <= n, "test").otherwise("train")).drop("__rn")


def take_range(rows: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """Rows ``start`` to ``stop`` - 1 in the order of ``key``."""
    return numbered(rows, key, "__rn").where((F.col("__rn") > start) & (F.col("__rn") <= stop)).drop("__rn")


def first_by_key(rows: DataFrame, key: str, index: str) -> DataFrame:
    """The first row of each key, ordered by key; ``min_by`` pre-aggregates before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.min_by(F.struct(*rest), index).alias("__x"))
    return picked.select(key, *[F.col(f"__x.{c}").alias(c) for c in rest]).orderBy(key)


def mine_negatives(scores: DataFrame, gold: DataFrame, k: int = 100) -> DataFrame:
    """(qid, gold, gold_in_top, negatives): the k best documents without the gold one, best first."""
    by = W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "pid")
    top = scores.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= k)
    lists = top.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("__r", "pid"))), lambda x: x["pid"]).alias("__top"))
    rows = lists.join(gold.select("qid", F.col("pid").alias("gold")), "qid")
    return rows.select("qid", "gold", F.array_contains("__top", F.col("gold")).alias("gold_in_top"), F.array_remove("__top", F.col("gold")).alias("negatives"))


def training_set(mined: DataFrame, num_negatives: int = 3) -> DataFrame:
    """Rows whose gold was found, with the first negatives."""
    return mined.where("gold_in_top").withColumn("negatives", F.slice("negatives", 1, num_negatives))


def whole_batches(rows: DataFrame, dataset: str, key: str, size: int) -> DataFrame:
    """Each dataset cut to a multiple of ``size`` rows, in the order of ``key``."""
    held = numbered(rows, key, "__r", by=(dataset,)).join(rows.groupBy(dataset).agg(F.count("*").alias("__n")), dataset)
    return held.where(F.col("__r") <= F.floor(F.col("__n") / size) * size).drop("__r", "__n")


def single_dataset_batches(rows: DataFrame, dataset: str, key: str, size: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Adds ``batch``: full batches of one dataset each, rows and batches in an order that the seed and epoch decide."""
    now = seed + epoch
    held = rows.withColumns({"__h": _hash_number(key, now), "__s": stable_hash(F.col(key), now)})
    held = numbered(held, "__h", "__r", "__s", key, by=(dataset,)).join(rows.groupBy(dataset).agg(F.count("*").alias("__n")), dataset)
    held = held.withColumn("__own", F.floor((F.col("__r") - 1) / size)).where(F.col("__own") < F.floor(F.col("__n") / size))
    tag = F.concat_ws("/", dataset, F.col("__own").cast("string"))
    held = held.withColumn("__tag", tag)
    tags = numbered(held.select("__tag").distinct().withColumn("__h", _hash_number("__tag", now)), "__h", "__b", "__tag")
    return held.join(tags.select("__tag", (F.col("__b") - 1).alias("batch")), "__tag").drop("__r", "__n", "__h", "__s", "__own", "__tag")


def sampled_list(items: Column, key: Column, n: int = 3, seed: int = 42) -> Column:
    """Up to ``n`` items of a list in an order by hash."""
    tagged = F.transform(items, lambda x: F.struct(F.sha1(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), x.cast("string")).cast("binary")).alias("h"), x.alias("x")))
    return F.when(F.size(items) <= n, items).otherwise(F.transform(F.slice(F.sort_array(tagged), 1, n), lambda t: t["x"]))


def chosen(items: Column, key: Column, seed: int = 42) -> Column:
    """One item of a list by hash."""
    number = F.conv(F.substring(F.sha1(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.element_at(items, (F.pmod(number, F.size(items)) + 1).cast("int"))


def as_list(c: Column) -> Column:
    return F.array(c)


def prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.toDF(*[prefix + c for c in rows.columns])


def flattened(rows: DataFrame, column: str, key: str) -> DataFrame:
    """(key, place, value) of a list column."""
    return rows.select(key, F.posexplode(column).alias("place", "value"))


def regrouped(flat: DataFrame, key: str, out: str) -> DataFrame:
    return flat.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias(out))


def collated(rows: DataFrame) -> DataFrame:
    """Prefixed query, document and negative columns of samples (id, query, pos, neg)."""
    some = F.col("neg").isNotNull()
    return rows.select(F.col("id"), F.col("query").alias("query_text"), chosen(F.col("pos"), F.col("id")).alias("doc_text"), F.when(some, sampled_list(F.col("neg"), F.col("id"))).alias("neg_doc_text"))


def vqa_reshaped(rows: DataFrame, renames: dict[str, str], id_columns: list[str], dataset: str) -> DataFrame:
    """Renamed columns, an id from the first filled of ``id_columns``, and the dataset's name."""
    out = rows
    for a, b in renames.items():
        out = out.withColumnRenamed(a, b)
    return out.withColumn("id", F.coalesce(*[F.col(c).cast("string") for c in id_columns])).withColumn("dataset", F.lit(dataset)).drop(*id_columns)
