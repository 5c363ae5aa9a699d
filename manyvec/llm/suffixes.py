"""Removal of byte passages that an earlier document has, by a collection's Burrows-Wheeler transform.

A repeat of ``LENGTH`` = 50 bytes has the same minimizer (the ``SEED``-byte substring with the least hash) wherever it
occurs. So each text is cut into runs of 50-byte windows with one minimizer, which overlap by 49 bytes and are
at most ``SPAN`` windows long; windows that are equal end up in runs with equal minimizers. Minimizers that no second
document has are dropped (see ``exchange``), equal runs of a batch are sent once, and runs go to buckets by minimizer.

A minimizer that ``HOT`` documents or more have is split further by a second minimizer of each window, so one common
passage doesn't fill one bucket.

A bucket holds a collection of short strings, equal ones once, with the documents that have them as membership. All of them
enter the transform; it names the windows that are equal, and only then membership tells whose they are. A symbol
is ``WIDE`` = 10 bytes, numbered in their order; a string enters the transform as ten documents, which begin at its first
ten bytes. So a window is 5 symbols of one of them, and a tenth of the rounds does. Strings of a bucket are taken ``LOT`` bytes
at a time, those with one minimizer together, so memory does not follow the bucket. The suffix order is built column by column from the right: each round inserts
one symbol of every document, at the place that the last round's transform gives it, and updates the common prefix
lengths of the neighbours it parts. The transform, the prefix lengths and the origin of each suffix lie in sequential
files of the shared folder: a round reads the last one's block by block, counting symbols as it goes, and writes the
next. In memory are only a block, the places of the documents and a count for each symbol. Suffixes whose neighbours
share 5 symbols are equal windows; each group's smallest doc_id keeps them.

Edge cases: null text is empty; rows with null doc_id keep all bytes and are no reference; rows that share a doc_id
don't remove each other's bytes; texts under 50 bytes are kept; long texts are read whole, and periodic ones give
runs no longer than others; equal windows of one smallest doc_id all stay (ties); an empty table gives an empty result;
``dedupe`` returns the given columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyvec.llm.common import narrow
from manyvec.llm.exchange import U64, Sizes, answered, messages, mix, pack_arrays, packed, shared_keys, total, unpack_arrays, unpacked, with_answers
from manyvec.session import scratch_root, stored

LENGTH, SEED, SPAN = 50, 24, 32
#: Documents from which on a minimizer counts as hot.
HOT = 4096
#: Bytes of a symbol, symbols of a window, and entries of the transform that a round holds at a time.
WIDE, SYMBOLS, BLOCK = 10, LENGTH // 10, 1 << 17
#: Bytes of strings from which on a bucket's strings make a further collection: few enough to be numbered in 16 bits each
LOT = 64_000
#: Stands for the owner of a window that the transform does not name.
NO_OWNER = np.iinfo(np.int64).max
#: Stands for a null doc_id within a batch.
NO_ID = -(2**63)
#: Bytes hashed at a time.
CHUNK = 32_768
RUNS = "bucket long, batch long, runs binary"
#: Arrays of a message. For each distinct string: length, occurrences, smallest doc_id, a byte that follows from its
#: minimizer; for each occurrence: its place in the batch, and whether its doc_id is larger than that; then the bytes.
SENT = ("u1", "<u4", "<i8", "u1", "<u4", "u1", "u1")
#: Arrays of an answer, for each occurrence that loses windows: place, number of windows, a bit for each that goes.
GONE = ("<u4", "u1", "<u4")


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the SEED bytes beginning at each byte, by doubling: 8 of them, 16, then 16 + 8."""
    factors = np.random.default_rng(24).integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
    h = factors[data]
    for width in (1, 2, 4):
        h = h[: max(0, len(h) - width)] * U64(0x9E3779B97F4A7C15) + (h[width:] ^ (h[width:] >> U64(29)))
    eight = h
    n = len(data) - SEED + 1
    if n <= 0:
        return np.zeros(0, U64)
    a, b, c = eight[:n], eight[8 : 8 + n], eight[16 : 16 + n]
    h = (a * U64(0xBF58476D1CE4E5B9) + (b ^ (b >> U64(31)))) * U64(0x94D049BB133111EB) + (c ^ (c >> U64(27)))
    return mix(h)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= width:
        h = np.minimum(h[: len(h) - reach], h[reach:])
        reach *= 2
    off = width - reach
    return np.minimum(h[: len(h) - off], h[off:]) if off else h


class Batch:
    """All texts of a batch in one row of bytes, and the runs of windows with one minimizer."""

    def __init__(self, table: pa.Table):
        names = [c.lower() for c in table.column_names]
        ids = table.column(names.index("doc_id")).to_pylist()
        self.texts = [(t or "").encode("utf-8", "surrogatepass") for t in table.column(names.index("text")).to_pylist()]
        self.ids = np.array([NO_ID if d is None else d for d in ids], np.int64)
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        n = len(self.data) - LENGTH + 1
        if n <= 0:
            self.begin = self.count = self.row = np.zeros(0, np.int64)
            self.key = np.zeros(0, U64)
            return
        least = np.empty(n, U64)
        for at in range(0, n, CHUNK):  # pieces that stay in the processor's cache
            piece = self.data[at : at + CHUNK + LENGTH - 1]
            least[at : at + CHUNK] = sliding_min(seed_hashes(piece), LENGTH - SEED + 1)[: min(CHUNK, n - at)]
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(least[1:], least[:-1], out=new[1:])
        new[self.starts[(self.starts < n) & (self.sizes > 0)]] = True
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, n))
        filled = np.flatnonzero(self.sizes > 0)
        row = filled[np.searchsorted(self.starts[filled], begin, side="right") - 1]
        # windows that cross into the next text end their run, as its last ones
        fits = np.minimum(count, self.starts[row] + self.sizes[row] - LENGTH + 1 - begin)
        good = (fits > 0) & (self.ids[row] != NO_ID)
        begin, count, row = begin[good], fits[good], row[good]
        pieces = -(-count // SPAN)
        first = np.repeat(begin, pieces)
        offset = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SPAN
        self.begin = first + offset
        self.count = np.minimum(SPAN, np.repeat(count, pieces) - offset)
        self.key, self.row = least[self.begin], np.repeat(row, pieces)

    def split(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The runs ``some`` parted where a second minimizer of their windows changes: (begin, count, row, key)."""
        size = self.count[some] + LENGTH - 1
        start = np.cumsum(size) - size
        run = np.repeat(np.arange(len(some)), size)
        at = self.begin[some][run] + np.arange(len(run)) - start[run]
        least = sliding_min(mix(seed_hashes(self.data[at]) ^ U64(0xD6E8FEB86659FD93)), LENGTH - SEED + 1)
        n = len(least)
        new = np.zeros(n, bool)
        new[1:] = least[1:] != least[:-1]
        new[start] = True
        new &= (np.arange(n) - start[run[:n]]) < self.count[some][run[:n]]
        first = np.flatnonzero(new)
        own = run[first]
        last = np.minimum(np.append(first[1:], n), start[own] + self.count[some][own])
        return at[first], last - first, self.row[some][own], mix(self.key[some][own] ^ least[first])


def _seed_messages(sizes: Sizes):
    def make(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        b = Batch(table)
        short, doc = sizes.short(b.key), b.ids[b.row]
        order = np.argsort(short, kind="stable")
        short, doc = short[order], doc[order]
        if not len(short):
            return short, np.zeros(0, np.uint8)
        starts = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]]))
        change = np.concatenate([[True], (short[1:] != short[:-1]) | (doc[1:] != doc[:-1])]).astype(np.int64)
        return short[starts], np.minimum(127, np.add.reduceat(change, starts)).astype(np.uint8)

    return make


def _shared(b: Batch, answers: pd.DataFrame, sizes: Sizes, limit: int) -> tuple[np.ndarray, ...]:
    """(begin, count, row, key) of the runs whose minimizer a second document has."""
    hit, scale = answered(answers, sizes.short(b.key))
    hot = scale >= 8 * np.log2(limit)
    plain = hit[~hot]
    parts = [(b.begin[plain], b.count[plain], b.row[plain], b.key[plain])]
    if hot.any():
        parts.append(b.split(hit[hot]))
    return tuple(map(np.concatenate, zip(*parts)))


def _run_messages(sizes: Sizes, buckets: int, limit: int):
    """Distinct runs with shared minimizers and where they occur, see ``SENT``."""

    def work(batch: int, table: pa.Table, answers: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if not len(answers):
            return
        b = Batch(table)
        begin, count, row, key = _shared(b, answers, sizes, limit)
        doc, raw, seen = b.ids[row], b.data.tobytes(), {}
        number = np.array([seen.setdefault(raw[s : s + n], len(seen)) for s, n in zip(begin.tolist(), (count + LENGTH - 1).tolist())], np.int64)
        strings = list(seen)
        order = np.lexsort((begin, doc, number))
        number, begin, doc, key = number[order], begin[order], doc[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, np.int64)
        occurs = np.diff(np.append(first, len(number)))
        later = doc > np.repeat(doc[first], occurs)
        bucket = (mix(key[first]) % U64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
        rows = []
        for k in np.flatnonzero(np.diff(edges)):
            mine = by[edges[k] : edges[k + 1]]
            at = np.repeat(first[mine] - np.cumsum(occurs[mine]) + occurs[mine], occurs[mine]) + np.arange(occurs[mine].sum())
            text = [strings[i] for i in mine.tolist()]
            arrays = [np.array(list(map(len, text))), occurs[mine], doc[first[mine]], mix(key[first[mine]]) >> U64(56), begin[at], later[at], np.frombuffer(b"".join(text), np.uint8)]
            rows.append((int(k), batch, pack_arrays(arrays, SENT)))
        yield pd.DataFrame(rows, columns=["bucket", "batch", "runs"])

    return work


class Files:
    """The arrays of a round in two sequential files: symbol and origin of each place as halves of one number, and the prefix
    lengths; the next round reads them front to back, ``BLOCK`` entries at a time. Files lie, unnamed, in ``folder``, so they end with the task; where that is no mounted folder,
    in memory."""

    KINDS = (np.dtype("<u8"), np.dtype(np.uint8))

    def __init__(self, folder: str | None = None):
        self.files = [tempfile.TemporaryFile(dir=folder) if folder else io.BytesIO() for _ in self.KINDS]

    @staticmethod
    def both(bwt: np.ndarray, origin: np.ndarray) -> np.ndarray:
        return bwt.astype("<u8") << U64(32) | origin

    @staticmethod
    def symbol(both: np.ndarray) -> np.ndarray:
        return both.view("<u4")[1::2]

    @staticmethod
    def origin(both: np.ndarray) -> np.ndarray:
        return both.view("<u4")[::2]

    def write(self, both: np.ndarray, lcp: np.ndarray) -> None:
        for file, a in zip(self.files, (both, lcp)):
            file.write(a.data if len(a) else b"")

    def read(self) -> Iterator[list[np.ndarray]]:
        for file in self.files:
            file.seek(0)
        while True:
            part = [np.frombuffer(f.read(BLOCK * k.itemsize), k) for f, k in zip(self.files, self.KINDS)]
            if not len(part[0]):
                return
            yield part

    def close(self) -> None:
        for file in self.files:
            file.close()


def mounted(root: str) -> str | None:
    """The shared folder as a path of this machine, if it is one."""
    url = urlparse(root)
    path = url.path if url.scheme in ("", "file") else ""
    return path if path and os.path.isdir(path) else None


class RangeMin:
    """min(values[left:right]) for many ranges of at least one entry: minima from each entry to either end of its block
    of 16, and doublings of the blocks' minima. Blocks are columns, so each step runs over whole rows."""

    WIDTH = 16

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // self.WIDTH)
        wide = np.full(blocks * self.WIDTH, 255, np.uint8)
        wide[: len(values)] = values
        self.wide = wide
        grid = wide.reshape(blocks, self.WIDTH).T.copy()
        self.ahead, self.behind = grid.copy(), grid
        for i in range(1, self.WIDTH):
            np.minimum(self.ahead[i], self.ahead[i - 1], out=self.ahead[i])
            np.minimum(self.behind[-i - 1], self.behind[-i], out=self.behind[-i - 1])
        levels = max(1, blocks.bit_length())
        self.table = np.full((levels, blocks), 255, np.uint8)
        self.table[0] = self.ahead[-1]
        for k in range(1, levels):
            step = 1 << (k - 1)
            np.minimum(self.table[k - 1, : blocks - 2 * step + 1], self.table[k - 1, step : blocks - step + 1], out=self.table[k, : blocks - 2 * step + 1])

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        width, last = self.WIDTH, right - 1
        lb, rb = left // width, last // width
        out = np.minimum(self.behind[left % width, lb], self.ahead[last % width, rb])
        inner = rb - lb - 1
        some = np.flatnonzero(inner > 0)
        if len(some):
            n = inner[some]
            k = self.log[n] if n.max() < len(self.log) else np.frexp(n.astype(float))[1] - 1
            at, end = lb[some] + 1, rb[some]
            out[some] = np.minimum(out[some], np.minimum(self.table[k, at], self.table[k, end - (1 << k)]))
        close = np.flatnonzero(inner < 0)
        if len(close):
            at, end = left[close], last[close]
            least = self.wide[at].copy()
            for step in range(1, int((end - at).max()) + 1):
                np.minimum(least, self.wide[np.minimum(at + step, end)], out=least)
            out[close] = least
        return out

    log = np.frexp(np.arange(1 << 14).astype(float))[1].astype(np.int64) - 1


def stable_order(values: np.ndarray) -> np.ndarray:
    """Stable order of 32-bit numbers, by counting their halves."""
    order = np.argsort(values.astype(np.uint16), kind="stable")
    high = (values >> np.uint32(16)).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


class Scan:
    """What a round keeps while it reads the last transform from front to back: for each symbol how often it came, the
    least prefix length since it last came, and which of the round's insertions came with it last."""

    def __init__(self, active: np.ndarray, kinds: int, most: int):
        self.active, self.most = active, most
        self.seen, self.carry, self.last = np.zeros(kinds, np.int64), np.full(kinds, 255, np.uint8), np.full(kinds, -1, np.int64)
        self.symbol, self.before = np.zeros(len(active), np.int64), np.zeros(len(active), np.int64)
        #: prefix shared with the neighbour before and after, for each active place
        self.up, self.down = np.zeros(len(active), np.uint8), np.zeros(len(active), np.uint8)
        self.at = 0

    def block(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        n, at = len(bwt), self.at
        self.at += n
        order = stable_order(bwt)
        ordered = bwt[order]
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        edge = np.flatnonzero(new)
        kinds = ordered[edge].astype(np.int64)
        head = np.minimum.accumulate(lcp)[order[edge]]
        reach = np.minimum(self.carry[kinds], head)  # from each symbol's last place to its first one here
        waiting = self.last[kinds]
        some = waiting >= 0
        self.down[waiting[some]] = np.minimum(self.most - 1, reach[some]) + 1
        lo, hi = np.searchsorted(self.active, (at, at + n))
        ends = np.append(edge[1:], n) - 1
        number = np.full(n, -1, np.int64)
        if hi > lo:
            mine = np.arange(lo, hi)
            place = self.active[lo:hi] - at
            number[place] = mine
            rank = np.empty(n, np.int32)
            rank[order] = np.arange(n, dtype=np.int32)
            own = rank[place].astype(np.int64)
            kind = np.cumsum(new, dtype=np.int32)[own] - 1
            self.symbol[mine] = bwt[place]
            self.before[mine] = self.seen[kinds[kind]] + own - edge[kind]
            least = RangeMin(lcp)
            first = own == edge[kind]
            k = np.flatnonzero(~first)
            self.up[mine[k]] = np.minimum(self.most - 1, least(order[own[k] - 1] + 1, place[k] + 1)) + 1
            k = np.flatnonzero(first & (self.seen[kinds[kind]] > 0))
            self.up[mine[k]] = np.minimum(self.most - 1, reach[kind[k]]) + 1
            k = np.flatnonzero(own < ends[kind])
            self.down[mine[k]] = np.minimum(self.most - 1, least(place[k] + 1, order[own[k] + 1] + 1)) + 1
        tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1][1:], 255)
        np.minimum(self.carry, lcp.min(), out=self.carry)
        self.carry[kinds] = tail[order[ends]]
        self.last[kinds] = number[order[ends]]
        self.seen[kinds] += np.diff(np.append(edge, n))


def collection_order(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int = SYMBOLS, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``symbols`` at which a suffix begins, prefix shared with the suffix before, at most ``most``) in suffix
    order, for all non-empty suffixes of the documents; equal suffixes stand in order of insertion.

    Round j inserts each document's suffix of length j. The transform has, at each suffix's place, the symbol before
    it, or 0 where the document begins. The symbol that round j adds stands at the place of the suffix of length
    j - 1, and by the count of that symbol up to that place the suffix of length j finds its own."""
    n = len(lengths)
    last, kinds = Files(folder), int(symbols.max()) + 2 if n else 1
    bwt = symbols[starts + lengths - 1].astype(np.uint32) + np.uint32(1)
    # round 0: the empty suffixes, in the documents' order
    last.write(Files.both(bwt, np.zeros(n, np.uint32)), np.zeros(n, np.uint8))
    totals = np.bincount(bwt, minlength=kinds)
    active, own = np.arange(n), np.arange(n)
    for j in range(1, int(lengths.max()) + 1 if n else 1):
        scan = Scan(active, kinds, most)
        for both, p in last.read():
            scan.block(np.ascontiguousarray(Files.symbol(both)), p)
        smaller = np.cumsum(totals) - totals - totals[0]  # symbols before each, without the 0
        fresh = n + smaller[scan.symbol] + scan.before
        order = np.argsort(fresh)
        fresh, own, up, down = fresh[order], own[order], scan.up[order], scan.down[order]
        rest = lengths[own] - j
        prior = np.where(rest > 0, symbols[np.maximum(starts[own] + rest - 1, 0)].astype(np.uint32) + np.uint32(1), np.uint32(0)).astype(np.uint32)
        origin = (starts[own] + rest).astype(np.uint32)
        added = Files.both(prior, origin)
        gap = fresh - np.arange(len(fresh))  # the old entry before which it comes
        following, at = Files(folder), 0
        for b, p in last.read():
            lo, hi = np.searchsorted(gap, (at, at + len(b)))
            here = gap[lo:hi] - at
            p = p.copy()
            p[here] = down[lo:hi]
            come = here + np.arange(hi - lo)
            old = np.ones(len(b) + hi - lo, bool)
            old[come] = False
            merged = []
            for before, new in ((b, added), (p, up)):
                whole = np.empty(len(old), before.dtype)
                whole[old], whole[come] = before, new[lo:hi]
                merged.append(whole)
            following.write(*merged)
            at += len(b)
        lo = int(np.searchsorted(gap, at))
        following.write(added[lo:], up[lo:])
        last.close()
        last = following
        totals += np.bincount(prior, minlength=kinds)
        active, own = fresh[prior > 0], own[prior > 0]
    parts = [(Files.origin(both), p) for both, p in last.read()]
    last.close()
    return np.concatenate([np.zeros(0, np.uint32), *(o for o, _ in parts)])[n:], np.concatenate([np.zeros(0, np.uint8), *(p for _, p in parts)])[n:]


def symbols_of(data: bytes) -> np.ndarray:
    """At each byte, the number of the WIDE bytes from there on (zeros after the end), in their order."""
    half = WIDE // 2
    padded = np.frombuffer(data + bytes(WIDE - 1), np.uint8).astype(U64)
    n = len(padded) - half + 1
    parts = np.zeros(n, U64)
    for i in range(half):
        parts = (parts << U64(8)) | padded[i : i + n]
    parts = np.unique(parts, return_inverse=True)[1].astype(U64)
    return np.unique((parts[:-half] << U64(32)) | parts[half:], return_inverse=True)[1].astype(np.uint32)


def lots(part: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Strings by their byte ``part``, gathered to at least LOT bytes: strings with one minimizer stay together."""
    order = np.argsort(part, kind="stable")
    ends = np.flatnonzero(np.append(part[order][1:] != part[order][:-1], True)) + 1
    begin, upto = 0, np.cumsum(size[order])
    for end in ends:
        if upto[end - 1] - (upto[begin - 1] if begin else 0) >= LOT or end == len(order):
            yield order[begin:end]
            begin = end


def least_owners(strings: list[bytes], owner: np.ndarray, folder: str | None) -> np.ndarray:
    """For each string, the smallest owner of each of its windows, from the groups of the collection's transform; what the
    transform does not name has no owner."""
    size = np.array(list(map(len, strings)), np.int64)
    begin = np.cumsum(size) - size
    numbers = symbols_of(b"".join(strings))
    # documents: the readings of each string from its first bytes on, those that are long enough to hold a window
    every = (size[:, None] - np.arange(WIDE)).ravel() // WIDE
    reading = np.flatnonzero(every >= SYMBOLS)
    length = every[reading]
    start = np.cumsum(length) - length
    doc = np.repeat(reading, length)
    offset = (WIDE * (np.arange(len(doc)) - np.repeat(start, length)) + doc % WIDE).astype(np.uint8)
    doc //= WIDE
    origin, lcp = collection_order(numbers[begin[doc] + offset], start, length, folder=folder)
    out = np.full((len(strings), SPAN), NO_OWNER)
    if len(origin):
        group = np.cumsum(lcp < SYMBOLS)
        string, place = doc[origin], offset[origin]
        window = np.flatnonzero(place <= size[string] - LENGTH)
        group, string, place = group[window], string[window], place[window]
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out[string, place] = np.repeat(np.minimum.reduceat(owner[string], first), np.diff(np.append(first, len(group))))
    return out


def _earlier(root: str):
    """For each batch, the windows that a smaller doc_id has, see ``GONE``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        folder = mounted(root)
        seen: dict[bytes, int] = {}
        sent, numbers, parts = [], [], []
        for data in pdf["runs"]:
            size, occurs, least, part, begin, later, text = unpack_arrays(data, SENT)
            raw, ends = text.tobytes(), np.cumsum(size.astype(np.int64))
            numbers.append(np.array([seen.setdefault(raw[j - n : j], len(seen)) for n, j in zip(size.tolist(), ends.tolist())], np.int64))
            sent.append((size, occurs, least, begin, later))
            parts.append(part)
        owner, of = np.full(len(seen), NO_OWNER), np.zeros(len(seen), np.uint8)
        for number, part, (_, _, least, _, _) in zip(numbers, parts, sent):
            np.minimum.at(owner, number, least)
            of[number] = part
        strings, windows = list(seen), np.full((len(seen), SPAN), NO_OWNER)
        for some in lots(of, np.array(list(map(len, strings)))):
            windows[some] = least_owners([strings[i] for i in some.tolist()], owner[some], folder)
        bits = U64(1) << np.arange(SPAN, dtype=U64)
        rows = []
        for batch, number, (size, occurs, least, begin, later) in zip(pdf["batch"], numbers, sent):
            count = size.astype(np.int64) - LENGTH + 1
            inside = np.arange(SPAN) < count[:, None]
            mine = ((windows[number] < least[:, None]) & inside) @ bits  # for the smallest doc_id of the batch
            every = (windows[number] <= least[:, None]) & inside  # larger ones lose these
            mask = np.where(later.astype(bool), np.repeat(every @ bits, occurs), np.repeat(mine, occurs))
            some = np.flatnonzero(mask)
            if len(some):
                order = some[np.argsort(begin[some], kind="stable")]
                rows.append((batch, pack_arrays([begin[order], np.repeat(count, occurs)[order], mask[order]], GONE)))
        return pd.DataFrame(rows, columns=["batch", "gone"])

    return run


def removed_bytes(table: pa.Table, answers: pd.DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The batch's texts, and which of their bytes go."""
    names = [c.lower() for c in table.column_names]
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in table.column(names.index("text")).to_pylist()]
    cover = np.zeros(sum(map(len, texts)) + 1, np.int64)
    for data in answers["gone"]:
        begin, count, mask = unpack_arrays(data, GONE)
        whole = mask == (U64(1) << count.astype(U64)) - U64(1)
        np.add.at(cover, begin[whole], 1)
        np.add.at(cover, begin[whole].astype(np.int64) + count[whole] + LENGTH - 1, -1)
        some = np.flatnonzero(~whole)
        run, window = np.nonzero(mask[some, None] >> np.arange(SPAN, dtype=np.uint32) & 1)
        at = begin[some][run].astype(np.int64) + window
        np.add.at(cover, at, 1)
        np.add.at(cover, at + LENGTH, -1)
    return texts, np.cumsum(cover[:-1]) > 0


def _answers(docs: DataFrame, bucket_bytes: int, hot: int) -> tuple[DataFrame, DataFrame]:
    batches = packed(docs, len)
    n = total(batches)
    sizes, buckets = Sizes(n // 8), max(1, n // bucket_bytes)
    hits = shared_keys(messages(batches, _seed_messages(sizes), sizes))
    runs = with_answers(batches, hits, _run_messages(sizes, buckets, hot), RUNS)
    return batches, runs.groupBy("bucket").applyInPandas(_earlier(scratch_root(docs.sparkSession)), "batch long, gone binary")


def digests(docs: DataFrame, bucket_bytes: int = 2_000_000, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    batches, answers = _answers(narrow(docs, "doc_id", "text"), bucket_bytes, hot)

    def work(batch: int, table: pa.Table, found: pd.DataFrame) -> Iterator[pd.DataFrame]:
        texts, gone = removed_bytes(table, found)
        rows, s = [], 0
        for d, text in zip(table.column(0).to_pylist(), texts):
            n = len(text)
            mine = gone[s : s + n]
            s += n
            lost = int(mine.sum())
            spans = int((mine[1:] & ~mine[:-1]).sum() + mine[0]) if lost else 0
            kept = np.frombuffer(text, np.uint8)[~mine].tobytes() if lost else text
            rows.append((d, n, lost, spans, hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    return with_answers(batches, answers, work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedupe(docs: DataFrame, bucket_bytes: int = 2_000_000, hot: int = HOT) -> DataFrame:
    """The same rows and columns, repeated bytes cut from ``text``; a character that loses a byte goes."""
    batches, answers = _answers(docs, bucket_bytes, hot)
    at = [c.lower() for c in docs.columns].index("text")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for data in left.column("data").to_pylist():
            table = unpacked(data)
            held, gone = removed_bytes(table, right.to_pandas())
            ends = np.cumsum([len(x) for x in held])
            texts = [
                None if t is None else np.frombuffer(own, np.uint8)[~gone[e - len(own) : e]].tobytes().decode("utf-8", "ignore")
                for t, own, e in zip(table.column(at).to_pylist(), held, ends)
            ]
            out.append(table.set_column(at, table.schema.field(at), pa.array(texts, table.schema.field(at).type)))
        return pa.concat_tables(out)

    return batches.select("batch", "data").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, docs.schema)
