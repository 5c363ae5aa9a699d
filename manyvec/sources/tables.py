"""Readers and writers: tables, images, caches, manifests, results."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manyvec.functions.texts import page_name, variant_name

CORPUS_TABLES = ("corpus", "queries", "qrels")
PAGES = 111


def load_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The corpus, query and relevance tables below ``root``."""
    return {name: spark.read.parquet(f"{root}/{name}") for name in CORPUS_TABLES}


def load_dataset(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Any of Spark's file formats; JSON and CSV want a schema, which saves the scan that infers it."""
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def load_splits(spark: SparkSession, named: dict[str, str], kind: str = "parquet") -> DataFrame:
    """Several datasets as one, with a ``dataset`` column."""
    return reduce(DataFrame.unionByName, [load_dataset(spark, p, kind).withColumn("dataset", F.lit(n)) for n, p in named.items()])


def dummy_dataset(spark: SparkSession, rows: int = 8) -> DataFrame:
    """Small made-up samples for trying a pipeline."""
    return spark.range(rows).select(F.col("id"), F.concat(F.lit("query "), F.col("id")).alias("query"), F.array(F.concat(F.lit("doc "), F.col("id"))).alias("pos"), F.lit(None).cast("array<string>").alias("neg"))


def first_sample(rows: DataFrame) -> DataFrame:
    """One row, read lazily."""
    return rows.limit(1)


def list_variants(spark: SparkSession, page_dir: str) -> DataFrame:
    """Degradation variants found among a page's files, in order; only names are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "page_001_*").load(page_dir).select("path")
    return files.select(variant_name(F.col("path")).alias("variant")).where("variant is not null").distinct().orderBy("variant")


def page_paths(spark: SparkSession, folder: str, variant: str | None = None, pages: int = PAGES, max_docs: int | None = None) -> DataFrame:
    """(page, path) of each page's image; a missing page is an error, and ``max_docs`` keeps the first."""
    tag = F.lit("" if variant is None else f"_{variant}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    stem = F.regexp_extract("path", r"([^/]+)\.[A-Za-z]+$", 1)
    wanted = spark.range(1, pages + 1).select((F.col("id") - 1).alias("page"), F.concat(page_name(F.col("id")), tag).alias("stem"))
    found = wanted.join(files.select(stem.alias("stem"), "path"), "stem", "left").groupBy("page").agg(F.min("path").alias("path"))
    lost = found.where("path is null").select("page").limit(5).collect()  # at most five, for the message
    if lost:
        raise FileNotFoundError(f"no file for pages {[r['page'] for r in lost]}")
    return found if max_docs is None else found.where(F.col("page") < max_docs)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, h, w, c, data) with channels in red, green, blue order."""
    rows = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")
    turned = F.array_join(F.transform(F.sequence(F.lit(0), (F.length("data") / 3 - 1).cast("int")), lambda i: F.concat(*[F.substr(F.hex("data"), (i * 6 + k).cast("int"), F.lit(2)) for k in (5, 3, 1)])), "")
    return rows.select("origin", F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("c"), F.when(F.col("nChannels") == 3, F.unhex(turned)).otherwise(F.col("data")).alias("data"))


def save_results(metrics: DataFrame, path: str) -> None:
    """One JSON row; the folder is named by the caller (see ``texts.result_name``)."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def save_shards(rows: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


CACHE_KEYS = ("doc_id", "mode", "variant")


def save_cache(embeddings: DataFrame, path: str, doc_id: str, mode: str, variant: str | None) -> None:
    """Token vectors (page, path, toks) of one document, mode and variant, as a partition of the cache."""
    keyed = embeddings.withColumns({"doc_id": F.lit(doc_id), "mode": F.lit(mode), "variant": F.lit(variant or "clean")})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*CACHE_KEYS).parquet(path)


def load_cache(spark: SparkSession, path: str, doc_id: str, mode: str, variant: str | None, expected: DataFrame | None = None) -> DataFrame:
    """A cache partition, pruned by its keys; an empty one, or one whose pages and paths differ from ``expected``, is an error."""
    rows = spark.read.parquet(path).where((F.col("doc_id") == doc_id) & (F.col("mode") == mode) & (F.col("variant") == (variant or "clean"))).drop(*CACHE_KEYS)
    if rows.isEmpty():
        raise ValueError(f"no cache for {doc_id}, {mode}, {variant or 'clean'}")
    if expected is not None:
        a, b = rows.select("page", "path"), expected.select("page", "path")
        if not a.exceptAll(b).union(b.exceptAll(a)).isEmpty():
            raise ValueError("the cache's pages or paths differ from the expected ones")
    return rows


def cached(spark: SparkSession, path: str, doc_id: str, mode: str, variant: str | None, encode, expected: DataFrame | None = None) -> DataFrame:
    """The cached partition, or what ``encode()`` returns, once written."""
    try:
        return load_cache(spark, path, doc_id, mode, variant, expected)
    except Exception as e:
        if not isinstance(e, ValueError) and "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        if isinstance(e, ValueError) and "no cache" not in str(e):
            raise
    save_cache(encode(), path, doc_id, mode, variant)
    return load_cache(spark, path, doc_id, mode, variant, expected)


def save_manifest(splits: DataFrame, path: str) -> None:
    """(split, variant or group rows) as JSON lines."""
    splits.coalesce(1).write.mode("overwrite").json(path)


def load_or_build_manifest(spark: SparkSession, path: str, schema: str, build) -> DataFrame:
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    save_manifest(build(), path)
    return spark.read.schema(schema).json(path)


def id_list_line(ids: Column) -> Column:
    """A list of ids as a line of text, and back by ``id_list``."""
    return F.concat(F.lit("["), F.array_join(ids.cast("array<string>"), ", "), F.lit("]"))


def id_list(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"[\[\]\s]", ""), ","), lambda x: x.cast("long"))


def sanitized(value):
    """Nested metadata with plain keys and JSON-ready leaves."""
    if isinstance(value, dict):
        return {str(k): sanitized(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [sanitized(v) for v in (sorted(value, key=str) if isinstance(value, set) else value)]
    try:
        json.dumps(value)
        return value
    except TypeError:
        return str(value)
