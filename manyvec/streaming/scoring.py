"""Late interaction over a stream of arriving documents. The reference workload is batch; this is an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyvec.operators.scoring import BROADCAST_BYTES, late_interaction, measured_bytes


def score_stream(docs: DataFrame, queries: DataFrame, least: float | None = None) -> DataFrame:
    """(qid, pid, score) for each arriving document (pid, toks), stateless; ``least`` keeps scores from it on. The query
    set is static and broadcast, so its size is checked when the stream is defined."""
    if measured_bytes(queries) > BROADCAST_BYTES:
        raise ValueError(f"standing queries of more than {BROADCAST_BYTES} bytes")
    pairs = docs.select("pid", F.col("toks").alias("d")).crossJoin(F.broadcast(queries.select("qid", F.col("toks").alias("q"))))
    out = pairs.select("qid", "pid", late_interaction(F.col("q"), F.col("d")).alias("score"))
    return out if least is None else out.where(F.col("score") >= least)
