"""What the corpus operators share: reading, text helpers, bounded memos."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that separate words: space and \t \n \v \f \r. ``bytes.split()`` splits on exactly these.
SPACES = " \t\n\v\f\r"

#: Rows whose crc32(doc_id as text) mod HELD_OUT_MOD is HELD_OUT are never learned from.
HELD_OUT_MOD, HELD_OUT = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id):
    """Column: whether the row belongs to the held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_MOD == HELD_OUT, F.lit(False))


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_OUT_MOD == HELD_OUT


def narrow(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by position of their first match, so extra or clashing columns do no harm;
    a missing one becomes a null string."""
    have = {}
    for i, c in enumerate(docs.columns):
        have.setdefault(c.lower(), i)
    renamed = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    return renamed.select(*[(F.col(f"__c{have[n]}") if n in have else F.lit(None).cast("string")).alias(n) for n in names])


def spread(docs: DataFrame) -> DataFrame:
    """Deals a plain scan over all cores where it has fewer partitions than there are: such an input is small, being at
    most a partition a core. Larger scans, and inputs that already come from a shuffle, stay as they are."""
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        return docs
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs._jdf.rdd().getNumPartitions() < cores else docs


def map_rows(docs: DataFrame, make: Callable[[], Callable[..., tuple]], schema: T.StructType | str) -> DataFrame:
    """One output row per input row by an Arrow-batched function.

    ``make`` runs once per task and returns the row function, so models load once;
    batches stream, hence memory holds one batch at a time."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, row = to_arrow_schema(schema), make()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = [row(*values) for values in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return spread(docs).mapInArrow(run, schema)


class Memo(dict):
    """A dict that fills itself by ``make`` and starts anew at ``most`` entries: bounded memory, same values."""

    def __init__(self, make: Callable, most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a pre-token pattern. Texts within Latin-1 take an equal pattern with its classes written
    out, which the standard engine matches faster."""
    import regex

    whole = regex.compile(pattern).findall
    latin = [chr(i) for i in range(256)]
    letters, numbers, blanks = (re.escape("".join(c for c in latin if regex.match(k, c))) for k in (r"\p{L}", r"\p{N}", r"\s"))
    short = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]")
    for name, chars in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", blanks)):
        short = short.replace(name, f"[{chars}]")
    quick = re.compile(short.replace(r"\S", f"[^{blanks}]")).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return whole(text)
        return quick(text)

    return split
