"""A corpus pipeline of five of the operators, each stage working on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
before the next; a stage deletes the scratch tables of those before. All but the last return the columns of ``docs``; an empty table passes through as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyvec.llm import jaccard, packing, pii, rules, substrings
from manyvec.llm.queries import BPE_JSON
from manyvec.session import held, release, stored


#: Scratch tables of earlier stages: done with once a later stage gets their output.
_made: list[str] = []


def stage(f):
    """Deletes the scratch tables of the stages before, and notes those of this one."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _made, keep=docs)
        before = held()
        out = f(spark, docs, sf_dir)
        _made[:] = [p for p in held() if p in _made or p not in before]
        return out

    return run


def recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where there is such a column."""
    return docs.withColumns({c: F.length("text").cast("long") for c in docs.columns if c.lower() == "n_chars"})


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the rules reject. The verdict follows from a row's text, lang and source, so rows with null or
    repeated doc_id are judged each by itself."""
    return rules.keep(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five words, similarity 0.8."""
    return jaccard.keep_first(docs, n=5, percent=80)


@stage
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has."""
    return recounted(substrings.dedupe(docs))


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return recounted(pii.redact(docs, pii.fitted()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into token sequences; its scratch tables stay, as its result is still to be computed."""
    release(spark, _made, keep=docs)
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path(BPE_JSON), public_tokenizers.PATTERN))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Robust outliers, redaction and packing are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
