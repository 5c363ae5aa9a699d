"""Byte-level BPE: encoding and decoding by longest matches with backtracking.

A token sequence is the BPE encoding of its bytes exactly when every adjacent pair of tokens is
*compatible*: encoding the pair's joined bytes gives that pair again. So the encoder needs no merge
loop. An Aho-Corasick automaton over the vocabulary (bytes mapped to Latin-1 characters) finds all
tokens that match anywhere; from the left, the longest token compatible with its predecessor is
taken, and a dead end steps back to the next shorter choice. Positions that proved dead are marked,
so each is left at most once and the work is linear in the bytes. Compatibility of a pair is decided
by undoing merges at the border, and memoised.

Edge cases: null text encodes as the empty text (no ids); any Unicode text, however long, round-trips;
repeated rows give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame

from manyvec.llm.common import Memo, map_rows, narrow


class ByteBPE:
    """Encoder and decoder for ranks where the 256 single bytes are tokens and ids are merge ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.bytes_of = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.shorter: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.fits = Memo(self._compatible, 1_000_000)
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut], i), ranks.get(token[cut:], i)
                if left < i and right < i and self._compatible((left, right)):
                    self.halves[i] = left, right
                    self.merged[left, right] = i
                    break
            for end in range(len(token) - 1, 0, -1):
                if (prefix := ranks.get(token[:end])) is not None:
                    self.shorter[i] = prefix
                    break
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()

    @classmethod
    def from_file(cls, path: str) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether BPE keeps the border between the two tokens. The later of the merges that made the
        two border tokens is undone first; ``limit`` is the rank at which the border tokens now shown
        stop existing, so a merge across the border of lower rank would have come before."""
        left, right = pair
        limit = 1 << 60
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            # the token made last comes apart; on equal ranks the left one was made first
            if left > right and left in self.halves:
                limit, left = left, self.halves[left][1]
            elif right in self.halves:
                limit, right = right + 1, self.halves[right][0]
            elif left in self.halves:
                limit, left = left, self.halves[left][1]
            else:
                return True

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Ids of one pre-split piece."""
        longest: list[int] = [-1] * len(piece)
        length, shorter, fits = self.length, self.shorter, self.fits
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            start = end - length[i] + 1
            if longest[start] < 0 or length[i] > length[longest[start]]:
                longest[start] = i
        ids: list[int] = []
        dead, at = bytearray(len(piece) + 1), 0
        choice = longest[0] if piece else -1
        while at < len(piece):
            end = at + length[choice] if choice >= 0 else 0
            if choice >= 0 and not dead[end] and (not ids or fits[ids[-1], choice]):
                ids.append(choice)
                at = end
                choice = longest[at] if at < len(piece) else -1
                continue
            choice = shorter.get(choice, -1) if choice >= 0 else -1
            while choice < 0:
                dead[at] = 1
                back = ids.pop()
                at -= length[back]
                choice = shorter.get(back, -1)
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """The codec of a rank file, once per Python worker."""
    return ByteBPE.from_file(path)


class TextCodec:
    """Whole texts: splits by the pre-token pattern, encodes each match, remembers frequent ones."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.bpe, self.split = load(path), regex.compile(pattern).findall
        #: The one memo: a piece's ids in decimal, joined by spaces.
        self.ids = Memo(lambda piece: " ".join(map(str, self.bpe.encode_bytes(piece.encode("utf-8", "surrogatepass")))), 500_000)
        self.bytes_of = {str(i): t for i, t in self.bpe.bytes_of.items()}

    def joined(self, text: str) -> str:
        """The ids of a text in decimal, joined by one space."""
        return " ".join(map(self.ids.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.joined(text).split()))

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, sha256 of the ids in decimal, sha256 of the decoded bytes)."""
        joined = self.joined(text)
        ids = joined.split(" ") if joined else []
        decoded = b"".join(map(self.bytes_of.__getitem__, ids))
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> TextCodec:
    return TextCodec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>): the encoding of every whole text."""
    return map_rows(narrow(docs, "doc_id", "text"), lambda: lambda d, t, c=codec(path, pattern): (d, c.encode(t or "")), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes binary) from (doc_id, ids)."""
    return map_rows(narrow(encoded, "doc_id", "ids"), lambda: lambda d, ids, b=load(path): (d, b.decode(ids or [])), "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every whole text and returns the digests: one scan, no shuffle; memory holds
    one batch of texts and bounded memos."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(narrow(docs, "doc_id", "text"), lambda: lambda d, t, c=codec(path, pattern): (d, *c.digest(t or "")), schema)
