"""Removal of word passages that an earlier document has, by fixed-block anchors.

The reference index holds each document's non-overlapping blocks of ``BLOCK`` = 7 words. Any 13 consecutive words
contain exactly one such block of the document they are read from, so probing the index with every rolling
7-word window of every document finds each repeated window. A hit is extended on both sides, by every way to part the
6 words that are missing: where a reference block stands between the same words, word for word, the 13 are a repeat of
its document. Neighbouring repeats join to maximal exact repeats. The smallest doc_id that has a window keeps it;
any other document loses the words it covers.

Index and probes meet as compressed keys (see ``exchange``). Only hits go on, as the words from 6 before to 6 after the
block, equal ones of a batch once; they meet in buckets by block. A block that ``HOT`` documents or more have is
extended before it is sent: each 13 words around it go to a bucket of their own, so a common line fills none. Whole texts
never leave their batch.

Edge cases: null text has no words; rows with null doc_id keep all words and are no reference; rows that share a
doc_id don't remove each other's words; texts under 13 words are kept; long texts are read whole; windows of one
smallest doc_id all stay (ties); an empty table gives an empty result. ``dedupe`` returns the given columns, whatever
their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from manyvec.llm.common import Memo, narrow
from manyvec.llm.exchange import U64, Sizes, answered, messages, mix, pack_arrays, packed, shared_keys, total, unpack_arrays, unpacked, window_keys, with_answers

WINDOW, BLOCK = 13, 7
SIDE = WINDOW - BLOCK
#: Documents from which on a block counts as hot.
HOT = 4096
#: Arrays of a message. For each distinct passage: bytes, occurrences, smallest doc_id that has it around a reference
#: block; for each occurrence: its first word in the batch, its doc_id; then the bytes.
SENT = ("<u2", "<u4", "<i8", "<u4", "<i8", "u1")
#: Of passages with long words, lengths are sent wider.
WIDE = ("<u4", *SENT[1:])
#: Arrays of an answer, for each occurrence that loses windows: first word, a bit for each window that goes.
GONE = ("<u4", "u1")
NONE = np.iinfo(np.int64).max
word_at = re.compile(r"[^\x20\x09-\x0D]+").finditer
_hashes: list[Memo] = []


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


class Batch:
    """Word hashes of a batch's documents in one row, with the number of the document at each word."""

    def __init__(self, table: pa.Table):
        import xxhash

        if not _hashes:
            _hashes.append(Memo(xxhash.xxh64_intdigest))
        look = _hashes[0].__getitem__
        names = [n.lower() for n in table.column_names]
        ids = table.column(names.index("doc_id")).to_pylist()
        hashed, sizes = [], []
        self.text: list[bytes] = []
        for d, text in zip(ids, table.column(names.index("text")).to_pylist()):
            words = words_of(text) if d is not None else []
            sizes.append(len(words))
            self.text += words
            hashed.append(np.fromiter(map(look, words), U64, len(words)))
        self.words = np.concatenate(hashed) if hashed else np.zeros(0, U64)
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.row = np.repeat(np.arange(len(ids)), self.sizes)
        self.ids = np.array([-1 if d is None else d for d in ids], np.int64)

    def probes(self) -> tuple[np.ndarray, np.ndarray]:
        """(key at each word, whether its 7 words lie within one document of at least 13)."""
        keys = window_keys(self.words, BLOCK, 71)
        n = len(keys)
        inside = (self.row[BLOCK - 1 :] == self.row[:n]) & (self.sizes[self.row[:n]] >= WINDOW) if n else np.zeros(0, bool)
        return keys, inside

    def anchors(self) -> np.ndarray:
        """Which words begin a reference block."""
        n = max(0, len(self.words) - BLOCK + 1)
        return (np.arange(n) - self.starts[self.row[:n]]) % BLOCK == 0


def _probe_messages(sizes: Sizes):
    def make(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        b = Batch(table)
        keys, inside = b.probes()
        at = np.flatnonzero(inside)
        short, row, anchor = sizes.short(keys[at]), b.row[at], b.anchors()[at]
        order = np.argsort(short, kind="stable")  # rows stay in order within a key
        short, row, anchor = short[order], row[order], anchor[order]
        if not len(short):
            return short, np.zeros(0, np.uint8)
        starts = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
        change = np.concatenate([[1], ((short[1:] != short[:-1]) | (b.ids[row[1:]] != b.ids[row[:-1]])).astype(np.int64)])
        docs = np.minimum(127, np.add.reduceat(change, starts)).astype(np.uint8)
        return short[starts], docs | (np.logical_or.reduceat(anchor, starts).astype(np.uint8) << 7)

    return make


def _extended(sizes: Sizes, buckets: int, hot: int):
    """The passages around hits, see ``SENT``."""

    def work(batch: int, table: pa.Table, answers: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(answers):
            return
        b = Batch(table)
        keys, inside = b.probes()
        at = np.flatnonzero(inside)
        hit, scale = answered(answers, sizes.short(keys[at]))
        at, row = at[hit], b.row[at[hit]]
        left = np.minimum(SIDE, at - b.starts[row])
        right = np.minimum(SIDE, b.starts[row] + b.sizes[row] - at - BLOCK)
        reference, key = b.anchors()[at], keys[at]
        begin, width = at - left, left + BLOCK + right
        if (many := (scale >= 8 * np.log2(hot)) & (width >= WINDOW)).any():
            windows = width[many] - WINDOW + 1
            each = np.repeat(begin[many], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            whole = window_keys(b.words, WINDOW, 131)
            begin, width = np.append(begin[~many], each), np.append(width[~many], np.full(len(each), WINDOW))
            row, reference = np.append(row[~many], np.repeat(row[many], windows)), np.append(reference[~many], np.repeat(reference[many], windows))
            key = np.append(key[~many], whole[each])
        bucket, doc, text = (mix(key.copy()) % U64(buckets)).astype(np.int64), b.ids[row], b.text
        order = np.argsort(bucket, kind="stable")
        order = order[width[order] >= WINDOW]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for k in np.flatnonzero(np.diff(edges)):
            mine = order[edges[k] : edges[k + 1]]
            seen: dict[bytes, int] = {}
            number = np.array([seen.setdefault(b" ".join(text[i : i + n]), len(seen)) for i, n in zip(begin[mine].tolist(), width[mine].tolist())], np.int64)
            owner = np.full(len(seen), NONE)
            grid = reference[mine]
            np.minimum.at(owner, number[grid], doc[mine][grid])
            by = np.argsort(number, kind="stable")
            size = np.array(list(map(len, seen)))
            layout = SENT if size.max() < 1 << 16 else WIDE
            arrays = [size, np.bincount(number), owner, begin[mine][by], doc[mine][by], np.frombuffer(b"".join(seen), np.uint8)]
            rows.append((int(k), batch, layout == WIDE, pack_arrays(arrays, layout)))
        yield pd.DataFrame(rows, columns=["bucket", "batch", "wide", "passages"])

    return work


def _repeats(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each batch, the windows around hits that a smaller doc_id has around a reference block, see ``GONE``."""
    known: dict[bytes, int] = {}
    sent = []
    for wide, data in zip(pdf["wide"], pdf["passages"]):
        size, occurs, owner, begin, doc, text = unpack_arrays(data, WIDE if wide else SENT)
        raw, windows, at = text.tobytes(), np.full((len(size), SIDE + 1), -1, np.int64), 0
        for i, n in enumerate(size.tolist()):
            words = raw[at : at + n].split(b" ")
            at += n
            for k in range(len(words) - WINDOW + 1):  # k words fewer on the left
                windows[i, k] = known.setdefault(b" ".join(words[k : k + WINDOW]), len(known))
        sent.append((windows, occurs, owner, begin, doc))
    least = np.full(len(known) + 1, NONE)  # the last is for what is no window
    for windows, _, owner, _, _ in sent:
        has = owner < NONE
        np.minimum.at(least, windows[has].ravel(), np.repeat(owner[has], SIDE + 1))
        least[-1] = NONE
    rows = []
    for batch, (windows, occurs, _, begin, doc) in zip(pdf["batch"], sent):
        later = np.repeat(least[windows], occurs, axis=0) < doc[:, None]
        some = np.flatnonzero(later.any(axis=1))
        if len(some):
            order = some[np.argsort(begin[some], kind="stable")]
            rows.append((batch, pack_arrays([begin[order], np.packbits(later[order], axis=1, bitorder="little").ravel()], GONE)))
    return pd.DataFrame(rows, columns=["batch", "gone"])


class Cut:
    """A batch's rows and which of their words go."""

    def __init__(self, table: pa.Table, answers: pd.DataFrame):
        names = [n.lower() for n in table.column_names]
        ids = table.column(names.index("doc_id")).to_pylist()
        self.words = [words_of(t) for t in table.column(names.index("text")).to_pylist()]
        sizes = np.array([len(w) if d is not None else 0 for w, d in zip(self.words, ids)], np.int64)
        self.ends = np.cumsum(sizes)
        cover = np.zeros(int(sizes.sum()) + 1, np.int64)
        for data in answers["gone"]:
            begin, bits = unpack_arrays(data, GONE)
            passage, k = np.nonzero(bits[:, None] >> np.arange(SIDE + 1, dtype=np.uint8) & 1)
            at = begin[passage].astype(np.int64) + k
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
        self.gone, self.sizes = np.cumsum(cover[:-1]) > 0, sizes

    def marks(self, i: int) -> np.ndarray:
        """For the words of row i, whether they go; nothing for rows that keep all without a look."""
        return self.gone[self.ends[i] - self.sizes[i] : self.ends[i]]


def cut_words(text: str, gone: np.ndarray) -> str:
    """The text without the words marked, each with the white space after it; the rest stays as it was."""
    if not gone.any():
        return text
    spans = [m.span() for m in word_at(text)]
    out, at = [], 0
    for i, (start, _) in enumerate(spans):
        end = spans[i + 1][0] if i + 1 < len(spans) else len(text)
        if gone[i]:
            out.append(text[at:start])
            at = end
    return "".join(out) + text[at:]


def _answers(docs: DataFrame, bucket_words: int, hot: int) -> tuple[DataFrame, DataFrame]:
    batches = packed(docs, lambda t: len(t) // 4)
    n = total(batches)
    probes, buckets = Sizes(n), max(1, n // bucket_words)
    hits = shared_keys(messages(batches, _probe_messages(probes), probes), needs=128)
    extended = with_answers(batches, hits, _extended(probes, buckets, hot), "bucket long, batch long, wide boolean, passages binary")
    return batches, extended.groupBy("bucket").applyInPandas(_repeats, "batch long, gone binary")


def digests(docs: DataFrame, bucket_words: int = 1_000_000, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    batches, answers = _answers(narrow(docs, "doc_id", "text"), bucket_words, hot)

    def work(batch: int, table: pa.Table, found: pd.DataFrame) -> Iterator[pd.DataFrame]:
        cut = Cut(table, found)
        rows = []
        for i, (d, words) in enumerate(zip(table.column(0).to_pylist(), cut.words)):
            mine = cut.marks(i)
            kept = [w for w, g in zip(words, mine) if not g] if mine.any() else words
            rows.append((d, len(words), int(mine.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
        out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])
        yield out.astype({"doc_id": "Int64"})

    return with_answers(batches, answers, work, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedupe(docs: DataFrame, bucket_words: int = 1_000_000, hot: int = HOT) -> DataFrame:
    """The same rows and columns, repeated words cut from ``text``; the white space of the rest stays."""
    batches, answers = _answers(docs, bucket_words, hot)
    at = [c.lower() for c in docs.columns].index("text")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for data in left.column("data").to_pylist():
            table = unpacked(data)
            cut = Cut(table, right.to_pandas())
            texts = [t if t is None else cut_words(t, cut.marks(i)) for i, t in enumerate(table.column(at).to_pylist())]
            out.append(table.set_column(at, table.schema.field(at), pa.array(texts, table.schema.field(at).type)))
        return pa.concat_tables(out)

    return batches.select("batch", "data").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, docs.schema)
