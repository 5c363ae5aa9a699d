"""Selecting queries, pages and relevance from corpus, query and qrel tables; variants and splits.

corpus (corpus_id, doc_id, page_number_in_doc), queries (query_id, query, language, raw_answers), qrels (query_id, corpus_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from manyvec.functions.texts import components, stable_hash
from manyvec.operators.prefix import numbered

COMPONENTS = ("PD", "MB", "GN", "JC", "LR", "CS")


def with_pages(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """qrels with document and page; those without a page keep nulls."""
    return qrels.join(corpus.select("corpus_id", "doc_id", "page_number_in_doc"), "corpus_id", "left")


def single_document_queries(pages: DataFrame, doc_id: str) -> DataFrame:
    """Queries relevant to ``doc_id`` and to no other document: one aggregate over the touched queries."""
    each = pages.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n"), F.max(F.when(F.col("doc_id") == doc_id, True)).alias("here"))
    return each.where("here and n = 1").select("query_id")


def relevance(pages: DataFrame, queries: DataFrame, doc_id: str) -> DataFrame:
    """(query_id, pages): the relevant pages of each query within the document, in order."""
    rows = pages.where(F.col("doc_id") == doc_id).join(queries, "query_id", "left_semi")
    return rows.groupBy("query_id").agg(F.sort_array(F.collect_set("page_number_in_doc")).alias("pages"))


def selection_counts(pages: DataFrame, doc_id: str) -> DataFrame:
    """Counts of queries that touch the document, of those within it alone and across documents, and of their qrels."""
    each = pages.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n"), F.count_if(F.col("doc_id") == doc_id).alias("here"))
    here, alone = F.col("here") > 0, (F.col("here") > 0) & (F.col("n") == 1)
    return each.agg(F.count_if(here).alias("focus"), F.count_if(alone).alias("single_doc"), F.count_if(here & ~alone).alias("cross_doc"), F.coalesce(F.sum(F.when(alone, F.col("here"))), F.lit(0)).alias("qrels"))


def prune_pages(relevant: DataFrame, max_docs: int) -> DataFrame:
    return relevant.withColumn("pages", F.filter("pages", lambda p: p < max_docs))


def in_given_order(rows: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows of the listed ids, in the list's order."""
    order = rows.sparkSession.createDataFrame([(i, n) for n, i in enumerate(ids)], f"{key} {dict(rows.dtypes)[key]}, place long")
    return rows.join(F.broadcast(order), key).orderBy("place")


def lookup(samples: DataFrame, corpus: DataFrame, column: str, key: str, value: str, out: str, strict: bool = True) -> DataFrame:
    """Replaces a list of ids by the looked-up values in the same order; a missing id is an error where ``strict``."""
    names = [c for c in samples.columns if c != column]
    exploded = samples.select("*", F.posexplode_outer(column).alias("__pos", "__id"))
    found = exploded.join(corpus.select(F.col(key).alias("__id"), F.col(value).alias("__value"), F.lit(True).alias("__there")), "__id", "left")
    if strict:
        lost = F.col("__id").isNotNull() & F.col("__there").isNull()
        found = found.withColumn("__value", F.when(lost, F.raise_error(F.concat(F.lit("unknown id "), F.col("__id").cast("string")))).otherwise(F.col("__value")))
    bag = F.transform(F.sort_array(F.collect_list(F.when(F.col("__pos").isNotNull(), F.struct("__pos", "__value")))), lambda x: x["__value"])
    return found.groupBy(*names).agg(bag.alias(out))


def first_index(names: DataFrame, name: str = "name", index: str = "idx") -> DataFrame:
    return names.groupBy(name).agg(F.min(index).alias(index))


def missing(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return expected.join(found, key, "left_anti")


def missing_pages(found: DataFrame, pages: int = 111) -> DataFrame:
    """Page numbers from 1 that have no file."""
    return found.sparkSession.range(1, pages + 1).select(F.col("id").alias("page")).join(found, "page", "left_anti")


def validated_methods(methods: list[str], allowed: tuple[str, ...]) -> list[str]:
    """The methods without repeats, in order; unknown ones are an error."""
    if unknown := sorted(set(methods) - set(allowed)):
        raise ValueError(f"unknown methods {unknown}")
    return list(dict.fromkeys(methods))


def variant_of(bits: Column) -> Column:
    """The variant with the components whose bits are set."""
    picked = F.filter(F.array(*[F.when(bits.bitwiseAND(1 << i) > 0, F.lit(c)) for i, c in enumerate(COMPONENTS)]), lambda x: x.isNotNull())
    return F.array_join(picked, "_")


def with_components(variants: DataFrame) -> DataFrame:
    return variants.withColumn("n_components", F.size(components(F.col("variant"))).cast("long"))


def all_variants(spark: SparkSession) -> DataFrame:
    """(variant, n_components) of every non-empty combination."""
    return with_components(spark.range(1, 1 << len(COMPONENTS)).select(variant_of(F.col("id")).alias("variant")))


def hard_variants(variants: DataFrame, n: int) -> DataFrame:
    """The first ``n`` by most components, then name."""
    return variants.orderBy(F.desc("n_components"), "variant").limit(n)


def chosen_variants(variants: list[str], split: list[str]) -> list[str]:
    if unknown := sorted(set(variants) - set(split)):
        raise ValueError(f"not in the split: {unknown}")
    return list(variants)


def split_variants(variants: DataFrame, held_out: str = "_".join(COMPONENTS), seed: int = 13) -> DataFrame:
    """(variant, split): singles, doubles and the first nine triples train; the other triples and five of four components
    validate; the held-out variant and five of five components test, topped up from those of four."""
    rows = variants.dropDuplicates(["variant"]).where(F.col("variant") != held_out)
    order = W.partitionBy("n_components").orderBy(stable_hash(F.col("variant"), seed), "variant")
    rows = rows.withColumn("r", F.row_number().over(order)).withColumn("fives", F.count_if(F.col("n_components") == 5).over(W.partitionBy(F.lit(0))))
    n, r = F.col("n_components"), F.col("r")
    extra = F.greatest(5 - F.col("fives"), F.lit(0))
    split = (
        F.when(n <= 2, "train").when(n == 3, F.when(r <= 9, "train").otherwise("val"))
        .when(n == 4, F.when(r <= 5, "val").when(r <= 5 + extra, "test")).when(n == 5, F.when(r <= 5, "test"))
    )
    held = variants.sparkSession.createDataFrame([(held_out, "test")], "variant string, split string")
    return rows.select("variant", split.alias("split")).where("split is not null").unionByName(held)


def with_answers(selected: DataFrame, queries: DataFrame) -> DataFrame:
    """Selected queries (query_id, query) with language and answers; unknown ones keep nulls."""
    return selected.select("query_id", "query").join(queries.select("query_id", "language", "raw_answers"), "query_id", "left")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in both."""
    return a.intersect(b)


def query_groups(queries: DataFrame, seed: int = 13) -> DataFrame:
    """Queries grouped by their answers: (group_key, group_hash, query_ids in order), numbered by hash, then key."""
    rows = queries.withColumn("group_key", F.col("raw_answers").cast("string"))
    groups = rows.groupBy("group_key").agg(F.sort_array(F.collect_list("query_id")).alias("query_ids"))
    groups = groups.withColumn("group_hash", stable_hash(F.col("group_key"), seed))
    lead = F.conv(F.substring("group_hash", 1, 13), 16, 10).cast("double")
    return numbered(groups.withColumn("__h", lead), "__h", "place", "group_hash", "group_key").withColumn("place", F.col("place").cast("int")).drop("__h")


def split_groups(groups: DataFrame) -> DataFrame:
    """Adds ``split``: 17, 6 and 6 groups where there are 29 or more (others get none), else 60, 20 and 20 percent with
    at least one each; fewer than three are an error."""
    n = groups.count()
    if n < 3:
        raise ValueError("at least three groups are needed")
    if n >= 29:
        train, val, test = 17, 6, 6
    else:
        train, val = max(1, n * 6 // 10), max(1, n * 2 // 10)
        if train + val >= n:
            train, val = n - 2, 1
        test = n - train - val
    p = F.col("place")
    split = F.when(p <= train, "train").when(p <= train + val, "val").when(p <= train + val + test, "test")
    return groups.withColumn("split", split).where("split is not null")


def batches(rows: DataFrame, size: int, place: str = "place") -> DataFrame:
    if size <= 0:
        raise ValueError("size must be positive")
    return rows.withColumn("batch", F.floor((F.col(place) - 1) / size))
