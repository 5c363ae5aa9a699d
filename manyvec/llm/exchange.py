"""Corpus-wide lookups of n-gram keys without shuffling the texts they came from.

``packed`` lays the corpus down once as batches of a few megabytes, one row each, in the shared folder.
A batch then speaks for all its documents: it sends each distinct key once, however often it occurs, as sorted
differences in compressed binary; keys are dealt to buckets by their leading bits; and a bucket answers a batch
only about keys that matter to it. So the traffic is a few bytes a key, a key held by a third of all rows
costs one entry a batch, and the answers are as large as what is really shared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyvec.session import stored

BATCH_BYTES = 8_000_000
MESSAGE = "bucket long, batch long, keys binary, extra binary"
U64 = np.uint64


def packed(docs: DataFrame, count: Callable[[str], int], batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(batch, first, n, data): all columns of ``docs`` as compressed Arrow batches, ``n`` the sum of ``count(text)``.
    Rows are numbered through the table: a batch's rows from ``first`` on, no number twice. A batch ends with the 500 rows in
    which it comes to ``batch_bytes``, or at the text with which it comes to twice as much."""
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part_id = TaskContext.get().partitionId()
        made, row, held, size, total = part_id << 32, part_id << 36, [], 0, 0
        options = pa.ipc.IpcWriteOptions(compression="zstd")

        def flush():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as out:
                for b in held:
                    out.write_batch(b)
            values = {"batch": [made], "first": [row], "n": [total], "data": [sink.getvalue().to_pybytes()]}
            return pa.RecordBatch.from_pydict(values, schema=pa.schema([("batch", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("data", pa.binary())]))

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                piece = batch.slice(start, 500)
                texts, begin = piece.column(at).to_pylist(), 0
                for end, text in enumerate(texts, 1):
                    size += len(text or "")
                    total += count(text or "")
                    if size >= 2 * batch_bytes or end == len(texts):
                        held.append(piece.slice(begin, end - begin))
                        begin = end
                        if size >= batch_bytes:
                            yield flush()
                            made, row, held, size, total = made + 1, row + sum(b.num_rows for b in held), [], 0, 0
        if held:
            yield flush()

    return stored(docs.mapInArrow(run, "batch long, first long, n long, data binary"), "packed")


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads sums over all 64 bits."""
    h = h ^ (h >> U64(31))
    h *= U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(29)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(32)
    return h


def window_keys(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit key of each run of ``width`` consecutive entries."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    factors = np.random.default_rng(seed).integers(1, 2**63, width, dtype=U64) * U64(2) + U64(1)
    total = np.zeros(n, U64)
    for k in range(width):
        total += words[k : k + n] * factors[k]
    return mix(total)


def deflate(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, byte plane by byte plane, compressed."""
    import zstandard

    steps = np.diff(keys, prepend=U64(0)).astype("<u8")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def inflate(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=U64)


def squeeze(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unsqueeze(data: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def pack_arrays(arrays: list[np.ndarray], layout: tuple[str, ...]) -> bytes:
    """Arrays of the kinds in ``layout``, their lengths first, compressed."""
    head = np.array([len(a) for a in arrays], "<i8").tobytes()
    return squeeze(np.frombuffer(head + b"".join(np.asarray(a).astype(t).tobytes() for a, t in zip(arrays, layout)), np.uint8))


def unpack_arrays(data: bytes, layout: tuple[str, ...]) -> list[np.ndarray]:
    raw, at, out = unsqueeze(data, np.uint8).tobytes(), 8 * len(layout), []
    for n, t in zip(np.frombuffer(raw[:at], "<i8").tolist(), layout):
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


class Sizes:
    """How many buckets, and how many bits of a key are sent, for so many keys in all."""

    def __init__(self, keys: int, per_bucket: int = 1_500_000, spare_bits: int = 8):
        self.bucket_bits = max(0, math.ceil(math.log2(max(1, keys) / per_bucket))) if keys > per_bucket else 0
        self.drop = max(0, 64 - math.ceil(math.log2(max(2, keys))) - spare_bits)

    def short(self, keys: np.ndarray) -> np.ndarray:
        """The leading bits, enough that few keys meet by chance."""
        return keys >> U64(self.drop)

    def cut(self, sorted_keys: np.ndarray, dropped: bool = True) -> np.ndarray:
        """Where each bucket begins in sorted keys."""
        bits = 64 - (self.drop if dropped else 0)
        edges = np.arange(1, 1 << self.bucket_bits, dtype=U64) << U64(bits - self.bucket_bits) if self.bucket_bits else np.zeros(0, U64)
        return np.concatenate([[0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]])


def total(batches: DataFrame) -> int:
    return batches.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def messages(batches: DataFrame, make: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], sizes: Sizes, dropped: bool = True) -> DataFrame:
    """MESSAGE rows: ``make(table)`` gives a batch's sorted distinct keys and an array beside them."""

    def run(parts):
        for part in parts:
            for batch, data in zip(part["batch"], part["data"]):
                yield from message_rows(batch, *make(unpacked(data)), sizes, dropped)

    return batches.select("batch", "data").mapInPandas(run, MESSAGE)


def message_rows(batch: int, keys: np.ndarray, extra: np.ndarray, sizes: Sizes, dropped: bool = True) -> Iterator[pd.DataFrame]:
    at = sizes.cut(keys, dropped)
    rows = [(b, batch, deflate(keys[i:j]), squeeze(extra[i:j])) for b, (i, j) in enumerate(zip(at, at[1:])) if j > i]
    if rows:
        yield pd.DataFrame(rows, columns=["bucket", "batch", "keys", "extra"])


def shared_keys(sent: DataFrame, kind: str = "uint8", needs: int = 0) -> DataFrame:
    """Answers (batch, keys, extra): keys known to at least two batches, or that a batch has in two documents.

    ``extra`` entries are counts of the key's documents within the batch, in the low seven bits; of the top bit,
    at least one sender must have it where ``needs`` is set. The answer's extra is eight times the binary logarithm
    of the summed count."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [inflate(k) for k in pdf["keys"]]
        keys = np.concatenate(lists)
        extra = np.concatenate([unsqueeze(e, np.uint8) for e in pdf["extra"]])
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        starts = np.flatnonzero(first)
        count = np.add.reduceat((extra[order] & 127).astype(np.int64), starts)
        good = count >= 2
        if needs:
            good &= np.bitwise_or.reduceat(extra[order], starts) & 128 > 0
        kept, scale = ordered[starts][good], np.minimum(255, 8 * np.log2(np.maximum(count[good], 1))).astype(np.uint8)
        rows = []
        for batch, own in zip(pdf["batch"], lists):
            at = np.searchsorted(kept, own)
            at[at == len(kept)] = 0
            hit = kept[at] == own if len(kept) else np.zeros(len(own), bool)
            if hit.any():
                rows.append((batch, deflate(own[hit]), squeeze(scale[at[hit]])))
        return pd.DataFrame(rows, columns=["batch", "keys", "extra"])

    return sent.groupBy("bucket").applyInPandas(run, "batch long, keys binary, extra binary")


def with_answers(batches: DataFrame, answers: DataFrame, work: Callable[[int, pa.Table, pd.DataFrame], Iterator[pd.DataFrame]], schema) -> DataFrame:
    """Each batch with all its answers: ``work(batch, table, answers)`` yields rows of ``schema``."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [x for data in left["data"] for x in work(key[0], unpacked(data), right)]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame([], columns=names)

    names = [f.name for f in schema] if not isinstance(schema, str) else [f.split()[0] for f in schema.split(", ")]
    return batches.select("batch", "data").groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(run, schema)


def answered(answers: pd.DataFrame, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the shortened keys an answer of ``shared_keys`` names, and the scale of each of these."""
    known = np.concatenate([np.zeros(0, U64), *(inflate(k) for k in answers["keys"])])
    scale = np.concatenate([np.zeros(0, np.uint8), *(unsqueeze(e, np.uint8) for e in answers["extra"])])
    order = np.argsort(known, kind="stable")
    known, scale = known[order], scale[order]
    if not len(known):
        return np.zeros(0, np.int64), scale
    at = np.searchsorted(known, short)
    at[at == len(known)] = 0
    hit = np.flatnonzero(known[at] == short)
    return hit, scale[at[hit]]
