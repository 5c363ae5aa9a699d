"""Best-fit packing of token sequences by best-two-fit.

Tokenised texts are cut into pieces of at most ``capacity`` tokens. Pieces are dealt by hash into groups of
bounded size, each packed by itself, so a group loses at most its last sequence. In a group a sequence starts
with the longest piece left and is filled greedily with the longest that fits; then its smallest piece is
exchanged for the two unpacked pieces that fit the widened gap best, where they fit it more tightly.

Edge cases: null text counts as empty, which is the single end token; a piece of full length is a sequence
of its own; very long texts are cut into as many pieces as they need; pieces of one length are alike, so ties change
nothing but the numbers; repeated rows and rows with null or shared doc_id are packed as often as they occur, dealt
row by row; a text that holds the string of a special token gets that token's id, as the library does; other
columns are ignored; an empty table packs into nothing.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyvec.llm.common import narrow, splitter, spread
from manyvec.session import stored

CAPACITY, END = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class PieceTokenizer:
    """Ids of whole texts by the tokenizers library. A text is split by the pattern of the byte-level
    pre-tokenizer, across whose splits nothing merges; the library sees each distinct piece once. A text with the string
    of an added token goes to the library whole, which looks for these before it splits."""

    def __init__(self, path: str, pattern: str, most: int = 900_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or r"(?!)").search
        self.split, self.most = splitter(pattern), most
        self.line_break, self.plain = self.ids("\n")[0], re.compile(r" ?\S+").fullmatch
        self.memo: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.memo) > self.most:
            self.memo.clear()
        memo, split = self.memo, [[] if self.added(t) else self.split(t) for t in texts]
        unknown = set().union(*split).difference(memo)
        # pieces with no white space but a leading blank are the lines of one text: the line break between
        # them is a token of its own, which none of them contains
        plain = list(filter(self.plain, unknown))
        for at in range(0, len(plain), 2000):
            part = plain[at : at + 2000]
            ids = self.ids("\n".join(part))
            cuts = [-1, *np.flatnonzero(ids == self.line_break).tolist(), len(ids)]
            if len(cuts) == len(part) + 1:
                data = ids.tobytes()
                memo.update((p, data[4 * i + 4 : 4 * j]) for p, i, j in zip(part, cuts, cuts[1:]))
        memo.update((p, self.ids(p).tobytes()) for p in unknown if p not in memo)
        return [self.ids(t).tobytes() if self.added(t) else b"".join(map(memo.__getitem__, pieces)) for t, pieces in zip(texts, split)]


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> PieceTokenizer:
    return PieceTokenizer(path, pattern)


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token pieces of every whole text with their end token; ``with_ids`` adds the ids themselves."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        tok = tokenizer(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = []
                for d, ids in zip(part.column(0).to_pylist(), tok.batch([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    start, length, k = 0, (n - 1) % capacity + 1, 0
                    while start < n:
                        own = ids[4 * start : 4 * (start + length)]
                        rows.append((d, k, start, length, zlib.crc32(own), *([np.frombuffer(own, "<i4")] * with_ids)))
                        start, length, k = start + length, capacity, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spread(narrow(docs, "doc_id", "text")).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Pieces of one length are alike, so the plan works on counts; a bit for
    each length that is left finds the longest that fits in one step."""
    counts = np.bincount(lengths, minlength=capacity + 1).tolist()
    left = sum(1 << n for n, c in enumerate(counts) if c)
    plan: list[tuple[int, int, int]] = []
    number = 0

    def at_most(n: int) -> int:
        return (left & ((1 << (n + 1)) - 1)).bit_length() - 1 if n > 0 else -1

    def take(n: int) -> None:
        nonlocal left
        counts[n] -= 1
        if not counts[n]:
            left ^= 1 << n

    while left:
        content, gap = [], capacity
        while gap and (n := at_most(gap)) > 0:
            content.append(n)
            gap -= n
            take(n)
        if gap and len(content) > 1 and left:
            smallest = content[-1]  # greedy filling adds ever shorter pieces
            best, pair, a = smallest, None, at_most(gap + smallest - 1)
            while a > 0 and 2 * a > best:
                b = at_most(min(a, gap + smallest - a))
                if b == a and counts[a] < 2:
                    b = at_most(a - 1)
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == gap + smallest:
                        break
                a = at_most(a - 1)
            if pair:
                content[-1:] = pair
                take(pair[0])
                take(pair[1])
                counts[smallest] += 1
                left |= 1 << smallest
        at = 0
        for n in content:
            plan.append((n, number, at))
            at += n
        number += 1
    table = np.array(sorted(plan), np.int64).reshape(-1, 3)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    bins[order], offsets[order] = table[:, 1], table[:, 2]
    return bins, offsets


def pack(cut: DataFrame, capacity: int = CAPACITY, group_tokens: int = 8_000_000) -> DataFrame:
    """Adds sequence_id and offset to pieces. Groups hold about ``group_tokens`` tokens, whatever the input's
    size; one aggregate decides their number."""
    cut = stored(cut, "pieces")
    total = cut.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-total // group_tokens))
    schema = f"{PIECES}, sequence_id long, offset long"
    names = [f.split()[0] for f in PIECES.split(", ")]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32", "start"], kind="stable")
        bins, offsets = best_two_fit(pdf["length"].to_numpy(), capacity)
        return pdf[names].assign(sequence_id=key[0] * (1 << 32) + bins, offset=offsets)

    # by the place in the stored table, which a rerun finds again: no key, null or shared, is heavy
    dealt = cut.select(*names, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("g"))
    return dealt.groupBy("g").applyInPandas(run, schema)
