"""A cache of page embeddings whose metadata is committed with the data.

A partition (document, mode, variant) is written to a folder of its own, under a name never used before. Then one row is added
to the manifest table: the partition's keys, the folder, a fingerprint of the metadata (model, prompt, whatever makes the
vectors what they are), the number of pages and a digest of pages and paths. A partition is what the last row of its keys says;
data without a row is no partition, so a lost job leaves the one before in force. On reading, fingerprint, number and
digest are held against what is asked for and what is there.

Pages are (page, path, toks). Null pages or paths and repeated pages are kept as they are and count in the digest; an empty
partition is an error; metadata is compared by value, so the order of its keys does not matter."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyvec.sources.tables import sanitized

MANIFEST = "doc_id string, mode string, variant string, folder string, fingerprint string, metadata string, n_pages long, pages_digest string, committed_ns long"


class CacheMismatch(ValueError):
    """What is cached is not what is asked for."""


def canonical(metadata: dict) -> str:
    return json.dumps(sanitized(metadata), sort_keys=True, separators=(",", ":"))


def fingerprint(metadata: dict) -> str:
    return hashlib.sha256(canonical(metadata).encode()).hexdigest()


def contents(pages: DataFrame) -> tuple[int, str]:
    """(number, digest) of pages and paths, whatever their order: sums of row hashes, taken apart in two halves so they
    never overflow."""
    h = F.xxhash64(F.struct("page", "path"))
    row = pages.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in (("low", h.bitwiseAND(0xFFFFFFFF)), ("high", F.shiftrightunsigned(h, 32)))]).first()
    return row["n"], f"{row['high']:x}.{row['low']:x}"


@dataclass(frozen=True)
class Key:
    doc_id: str
    mode: str
    variant: str = "clean"


@dataclass(frozen=True)
class EmbeddingCache:
    """Partitions and manifest below ``root``, a folder that all executors share."""

    spark: SparkSession
    root: str

    def manifest(self) -> DataFrame:
        """All rows ever committed."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest") if there else self.spark.createDataFrame([], MANIFEST)

    def in_force(self) -> DataFrame:
        """The last row of each partition."""
        return self.manifest().groupBy("doc_id", "mode", "variant").agg(F.max_by(F.struct("folder", "fingerprint", "metadata", "n_pages", "pages_digest"), F.struct("committed_ns", "folder")).alias("r")).select("doc_id", "mode", "variant", "r.*")

    def save(self, pages: DataFrame, key: Key, metadata: dict) -> None:
        folder = f"{key.mode}-{uuid.uuid4().hex}"
        pages.select("page", "path", "toks").write.option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
        n, digest = contents(self.spark.read.parquet(f"{self.root}/data/{folder}"))
        row = (key.doc_id, key.mode, key.variant, folder, fingerprint(metadata), canonical(metadata), n, digest, time.time_ns())
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def load(self, key: Key, metadata: dict, expected: DataFrame | None = None) -> DataFrame | None:
        """The partition's pages, or None where there is none. Other metadata, other contents than were committed, and other
        pages or paths than ``expected`` (page, path) are errors."""
        row = self.in_force().where((F.col("doc_id") == key.doc_id) & (F.col("mode") == key.mode) & (F.col("variant") == key.variant)).first()
        if row is None:
            return None
        if row["fingerprint"] != fingerprint(metadata):
            raise CacheMismatch(f"{key} was made with {self._differences(json.loads(row['metadata']), json.loads(canonical(metadata)))}")
        pages = self.spark.read.parquet(f"{self.root}/data/{row['folder']}")
        if contents(pages) != (row["n_pages"], row["pages_digest"]):
            raise CacheMismatch(f"{key} no longer holds what was committed")
        if not row["n_pages"]:
            raise CacheMismatch(f"{key} is empty")
        if expected is not None and (n := contents(expected)) != (row["n_pages"], row["pages_digest"]):
            raise CacheMismatch(f"{key} holds {row['n_pages']} pages, {n[0]} are expected" if n[0] != row["n_pages"] else f"{key} holds other pages or paths than expected")
        return pages

    @staticmethod
    def _differences(there: dict, wanted: dict) -> str:
        return ", ".join(f"{k} {there.get(k)!r} instead of {wanted.get(k)!r}" for k in sorted({*there, *wanted}) if there.get(k) != wanted.get(k))

    def load_or_encode(self, key: Key, metadata: dict, encode: Callable[[], DataFrame], expected: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
        """The cached partition; where there is none, or ``overwrite`` asks for it, what ``encode()`` gives, once committed."""
        found = None if overwrite else self.load(key, metadata, expected)
        if found is None:
            self.save(encode(), key, metadata)
            found = self.load(key, metadata, expected)
        return found

    def unused(self) -> DataFrame:
        """Folders that no partition in force points to (an older version's or a lost job's), for a caller to delete."""
        rows = self.manifest().select("folder").distinct()
        return rows.join(self.in_force().select("folder"), "folder", "left_anti")
