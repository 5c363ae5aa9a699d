"""Jaccard join of word n-gram sets by a prefix tree, down to connected components.

1. Every batch sends its distinct shingles; shared ones come back with their document frequency. That orders
   shingles globally, rarest first. Two sets with overlap ``need`` each lie in shared shingles up to that count,
   so documents with fewer shared shingles are done: they link with nothing. The frequency of copies within a
   batch counts once.
2. Of the rest, documents with equal sets become one. The ``|x| - need + 1`` rarest shingles of a set are its
   prefix; sets that link share a prefix shingle. Components of "shares a prefix shingle" bound the search.
3. Within a component, all sets lie in one trie, most frequent shingle first, so sets share paths. A set walks the trie
   once, carrying the overlap so far, which counts for all sets below; a subtree is left when the overlap and what
   remains on both sides can't reach the need, or when all its sets are in the walking set's class. A link joins two
   classes, and the walk goes on for the others.
4. Components too large for one task are dealt into blocks; what doesn't join its block's largest class through it
   or through the component's first sets is then walked against every block, so no link between classes is lost
   and no pair within a class is repeated.

Edge cases: null or wordless text has the empty set and links with nothing; fewer than n words make one
shingle of all; rows with null doc_id get a null component; equal texts link; rows that share a doc_id are one node, which
has the links of each of their texts; very long texts are read whole; sets of equal size are tried in the order of their
documents; an empty table gives an empty result. ``keep_first`` judges row by row, so a shared doc_id joins nothing; it
returns the given columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from manyvec.llm.common import Memo, narrow
from manyvec.llm.components import components
from manyvec.llm.exchange import U64, Sizes, inflate, messages, packed, shared_keys, total, unpacked, unsqueeze, window_keys, with_answers
from manyvec.session import stored

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SETS = "doc_id long, row int, batch long, n_shingles long, print binary, tokens binary"
_hashes: list[Memo] = []


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit keys of the text's shingles."""
    import xxhash

    if not _hashes:
        _hashes.append(Memo(xxhash.xxh64_intdigest))
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, U64)
    h = np.fromiter(map(_hashes[0].__getitem__, words), U64, len(words))
    return np.unique(window_keys(h, min(n, len(words)), 80 + min(n, len(words))))


def need(a: int, b: int, percent: int) -> int:
    """Least intersection with which sets of these sizes link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(size: int, shared: int, percent: int) -> int:
    """How many of a set's ``shared`` tokens, rarest first, two linked sets have one in common of. Tokens that nobody shares
    are the rarest of all and not among these, so they use up the prefix first."""
    return max(0, size - need(size, -(-percent * size // 100), percent) + 1 - (size - shared))


class Table:
    """The sets of a batch, those of equal texts once."""

    def __init__(self, table: pa.Table, n: int):
        names = [c.lower() for c in table.column_names]
        seen: dict[str | None, np.ndarray] = {}
        self.ids = table.column(names.index("doc_id")).to_pylist()
        self.sets = [seen[t] if t in seen else seen.setdefault(t, shingles(t, n)) for t in table.column(names.index("text")).to_pylist()]

    def distinct(self) -> list[np.ndarray]:
        held = {s.tobytes(): s for s, d in zip(self.sets, self.ids) if d is not None and len(s)}
        return list(held.values())


def print_of(keys: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(keys.tobytes())


def _messages(n: int, sizes: Sizes):
    def make(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        t = Table(table, n)
        sets, rows = t.distinct(), {}
        for i, (s, d) in enumerate(zip(t.sets, t.ids)):  # copies of one set still speak for two rows
            if d is not None and len(s):
                rows.setdefault(s.tobytes(), []).append(i)
        if not sets:
            return np.zeros(0, U64), np.zeros(0, np.uint8)
        weight = np.repeat(np.array([min(2, len(rows[s.tobytes()])) for s in sets]), [len(s) for s in sets])
        keys = sizes.short(np.concatenate(sets))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[starts], np.minimum(127, np.add.reduceat(weight[order], starts)).astype(np.uint8)

    return make


def _candidates(n: int, percent: int, sizes: Sizes):
    """A row for each document; a print where enough of its shingles are shared, and with the first of equal sets its
    shared tokens."""

    def work(batch: int, table: pa.Table, answers: pd.DataFrame) -> Iterator[pd.DataFrame]:
        t = Table(table, n)
        known, scale = np.zeros(0, U64), np.zeros(0, np.uint8)
        if len(answers):
            known = np.concatenate([inflate(k) for k in answers["keys"]])
            scale = np.concatenate([unsqueeze(e, np.uint8) for e in answers["extra"]])
            order = np.argsort(known, kind="stable")
            known, scale = known[order], scale[order]
        made: dict[bytes, bytes | None] = {}
        rows = []
        for i, (d, s) in enumerate(zip(t.ids, t.sets)):
            key, tokens = s.tobytes(), None
            if d is not None and key not in made:
                if len(s) and len(known):
                    short = sizes.short(s)
                    at = np.searchsorted(known, short)
                    at[at == len(known)] = 0
                    hit = known[at] == short
                    if hit.sum() >= need(len(s), -(-percent * len(s) // 100), percent):
                        # the frequency leads, so the order of numbers is the global order, rarest first
                        tokens = np.sort((scale[at[hit]].astype(U64) << U64(56)) | (s[hit] >> U64(8))).tobytes()
                made[key] = print_of(s) if tokens else None
            rows.append((d, i, batch, len(s), made[key] if d is not None else None, tokens))
        yield pd.DataFrame(rows, columns=["doc_id", "row", "batch", "n_shingles", "print", "tokens"]).astype({"doc_id": "Int64"})

    return work


class Node:
    """Part of a path, with what holds for all sets below: their least size, the longest rest of one, and their class
    where it is the same for all (else None). ``kin`` names the children below which a set has a token in its prefix."""

    __slots__ = ("edge", "least", "longest", "label", "children", "sets", "kin")

    def __init__(self, edge: np.ndarray, size: int, longest: int, label: int):
        self.edge, self.least, self.longest, self.label = edge, size, longest, label
        self.children: dict[int, Node] = {}
        self.sets: list[tuple[int, int, int, list[int]]] = []
        self.kin: dict[int, set[int]] = {}

    def end(self, item: int, size: int, label: int, prefix: list[int]) -> None:
        self.sets.append((item, size, label, prefix))

    def below(self) -> Iterator[int]:
        """The prefix tokens of all sets here and below."""
        yield from self.kin
        for *_, prefix in self.sets:
            yield from prefix


class Trie:
    """All sets of a block by their tokens, most frequent first, on compressed paths; classes of sets that are joined."""

    def __init__(self, percent: int):
        self.percent, self.root, self.above, self.visited = percent, None, {}, 0

    def find(self, label: int) -> int:
        above = self.above
        above.setdefault(label, label)
        while above[label] != label:
            above[label] = label = above[above[label]]
        return label

    def common(self, a: int | None, b: int | None) -> int | None:
        return a if a is not None and b is not None and self.find(a) == self.find(b) else None

    def add(self, item: int, size: int, tokens: np.ndarray, label: int) -> None:
        if self.root is None:
            self.root = Node(np.zeros(0, U64), size, len(tokens), label)
        node, at, prefix = self.root, 0, self.prefix(size, tokens)
        self._pass(node, size, len(tokens), label)
        while at < len(tokens):
            first = int(tokens[at])
            for token in prefix:
                node.kin.setdefault(token, set()).add(first)
            child = node.children.get(first)
            if child is None:
                leaf = node.children[first] = Node(tokens[at:], size, 0, label)
                leaf.end(item, size, label, prefix)
                return
            k = min(len(child.edge), len(tokens) - at)
            off = np.flatnonzero(child.edge[:k] != tokens[at : at + k])
            same = int(off[0]) if len(off) else k
            if same < len(child.edge):  # the path parts within this edge
                upper = Node(child.edge[:same], child.least, child.longest + len(child.edge) - same, child.label)
                child.edge = child.edge[same:]
                upper.children[int(child.edge[0])] = child
                upper.kin = {token: {int(child.edge[0])} for token in child.below()}
                node.children[first] = child = upper
            at += same
            node = child
            self._pass(node, size, len(tokens) - at, label)
        node.end(item, size, label, prefix)

    def prefix(self, size: int, tokens: np.ndarray) -> list[int]:
        """The rarest tokens of the set, of which every set that links has one in its own prefix."""
        return tokens[::-1][: prefix_length(size, len(tokens), self.percent)].tolist()

    def _pass(self, node: Node, size: int, rest: int, label: int) -> None:
        node.least, node.longest, node.label = min(node.least, size), max(node.longest, rest), self.common(node.label, label)

    def _label(self, node: Node) -> int | None:
        """The class of all below, looked at anew where there were several: they may have been joined since."""
        if node.label is None:
            one = None
            for label in chain((s[2] for s in node.sets), (c.label for c in node.children.values())):
                if label is None or one is not None and self.find(label) != one:
                    return None  # mostly after a few
                one = self.find(label)
            node.label = one
        return node.label

    def links(self, size: int, tokens: np.ndarray, label: int) -> list[int]:
        """A set of each other class that links with this one; these classes become one. One walk: what a path has in
        common with the set is counted once for all sets below it; a subtree is left when the overlap and what remains on both
        sides can't reach the need, when no prefix below has a token of this one's, or when all of it is joined already.
        ``tokens`` descend, as the paths do."""
        prefix = self.prefix(size, tokens)
        if self.root is None or not prefix:
            return []
        found, ascending, n, held = [], tokens[::-1], len(tokens), set(tokens.tolist())
        stack = [(self.root, 0, 0)]
        while stack:
            node, at, overlap = stack.pop()
            own = self._label(node)
            if own is not None and self.find(own) == self.find(label):
                continue
            self.visited += 1
            target = need(size, max(node.least, -(-self.percent * size // 100)), self.percent)
            edge = node.edge
            if overlap + min(n - at, len(edge) + node.longest) < target:
                continue
            if len(edge):  # how many of its tokens the set has, and where the set stands after the last of them
                where = np.searchsorted(ascending, edge)
                where[where == n] = 0
                overlap += int((ascending[where] == edge).sum())
                at = n - int(np.searchsorted(ascending, edge[-1]))
            for item, other, of, _ in node.sets:
                if overlap >= need(size, other, self.percent) and self.find(of) != self.find(label):
                    found.append(item)
                    self.above[self.find(of)] = self.find(label)
            if node.children and overlap + min(n - at, node.longest) >= target:
                near = set().union(*(node.kin.get(token, ()) for token in prefix))
                for token in sorted(near, key=held.__contains__):  # the likeliest last, so first
                    stack.append((node.children[token], at, overlap))
        return found


def spanning_links(items: list[tuple[int, int, np.ndarray, int]], percent: int, trie: Trie | None = None) -> list[tuple[int, int]]:
    """Links that join all linked items (id, size, descending tokens, class), of which those of one class count
    as joined already. All sets lie in one trie; each walks it once and then becomes part of it."""
    trie, links = trie or Trie(percent), []
    for item, size, tokens, label in sorted(items, key=lambda x: (x[1], x[0])):
        links += [(item, other) for other in trie.links(size, tokens, label)]
        trie.add(item, size, tokens, label)
    return links


def _joiner(percent: int):
    """Links within each candidate of a group, from document to document; each set comes as its first document."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, part in pdf.groupby("candidate", sort=False):
            part = part.drop_duplicates("node").sort_values(["n_shingles", "rep", "node"])
            reps = part["rep"].tolist()
            items = [(i, n, np.frombuffer(t, U64)[::-1], c) for i, (n, t, c) in enumerate(zip(part["n_shingles"].tolist(), part["tokens"], part["class"].tolist()))]
            links += [(reps[i], reps[j]) for i, j in spanning_links(items, percent)]
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def _linked(every: DataFrame, percent: int, block_tokens: int, pivots: int) -> DataFrame:
    """(node, component) over the ids of ``every`` (id, n_shingles, print, tokens), for those with a print."""
    found = every.where("print is not null and id is not null")
    # equal sets become one, with a number of its own and its smallest document
    reps = found.groupBy("print").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.first("n_shingles").alias("n_shingles"), F.first("tokens", ignorenulls=True).alias("tokens"))
    reps = stored(reps.withColumn("node", F.monotonically_increasing_id()), "reps")
    copied = reps.where("rep < last").select("print", "rep")
    same = found.select("id", "print").join(copied, "print").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    def prefixes(parts):
        for pdf in parts:
            rows = [(d, t) for d, size, data in zip(pdf["node"], pdf["n_shingles"], pdf["tokens"]) for t in _prefix(size, data, percent)]
            yield pd.DataFrame(rows, columns=["node", "token"]).astype("int64")

    tokens = stored(reps.select("node", "n_shingles", "tokens").mapInPandas(prefixes, "node long, token long"), "prefixes")
    first = tokens.groupBy("token").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most")
    near = components(tokens.join(first, "token").select(F.col("node").alias("a"), "b"))
    near = near.select("node", F.col("component").alias("candidate"))
    sets = stored(reps.select("node", "rep", "n_shingles", "tokens").join(near, "node").withColumns({"size": F.length("tokens") / 8, "class": F.col("rep")}), "candidates")
    per = sets.groupBy("candidate").agg(F.sum("size").alias("all"))
    per = per.withColumn("blocks", F.ceil(F.col("all") / block_tokens))
    whole = per.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("n")).first()["n"]
    bins = max(1, int(whole // block_tokens) + 1) * 4
    large = stored(per.where("blocks > 1"), "large")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    schema = "a long, b long"
    rows = ["candidate", "node", "rep", "n_shingles", "tokens", "class"]
    small = sets.join(large.select("candidate"), "candidate", "left_anti")
    links = small.select(*rows, F.pmod(F.xxhash64("candidate"), F.lit(bins)).alias("g")).groupBy("g").applyInPandas(_joiner(percent), schema)
    if large.limit(1).count():
        big = stored(sets.join(large.select("candidate", "blocks"), "candidate").withColumn("block", block), "big")
        # the component's first sets, a few of a known number, go to each block
        order = W.partitionBy("candidate").orderBy("node")
        lead = big.select(*rows, "blocks").withColumn("r", F.row_number().over(order)).where(F.col("r") <= pivots).drop("r")
        lead = lead.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
        within = big.select(*rows, "block").unionByName(lead.select(*rows, "block"))
        inner = stored(within.groupBy("candidate", "block").applyInPandas(_joiner(percent), schema), "links")
        merged = components(inner)
        labelled = big.drop("class").join(merged.select(F.col("node").alias("rep"), F.col("component").alias("c")), "rep", "left").withColumn("class", F.coalesce("c", "rep")).drop("c")
        labelled = stored(labelled, "labelled")
        by = labelled.groupBy("candidate", "class").agg(F.count("*").alias("m"))
        largest = by.groupBy("candidate").agg(F.max_by("class", F.struct("m", -F.col("class"))).alias("main"))
        rest = labelled.join(largest, "candidate").where(F.col("class") != F.col("main"))
        open_ = stored(rest.groupBy("candidate").agg(F.sum("size").alias("open")).withColumn("parts", F.ceil(F.col("open") / block_tokens)), "open")
        rest = rest.join(open_, "candidate").withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")))
        rest = rest.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
        others = labelled.join(open_, "candidate").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
        meet = rest.select(*rows, "part", "block").unionByName(others.select(*rows, "part", "block"))
        links = links.union(inner).union(meet.groupBy("candidate", "part", "block").applyInPandas(_joiner(percent), schema))
    return components(links.union(same))


def _sets(batches: DataFrame, n: int, percent: int) -> DataFrame:
    sizes = Sizes(total(batches))
    answers = shared_keys(messages(batches, _messages(n, sizes), sizes))
    return stored(with_answers(batches, answers, _candidates(n, percent, sizes), SETS), "sets")


def classes(docs: DataFrame, n: int = 3, percent: int = 90, block_tokens: int = 1_000_000, pivots: int = 8) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    every = _sets(packed(narrow(docs, "doc_id", "text"), lambda t: len(t) // 4), n, percent)
    linked = _linked(every.withColumnRenamed("doc_id", "id"), percent, block_tokens, pivots)
    named = linked.select(F.col("node").alias("doc_id"), F.col("component").alias("c"))
    return every.select("doc_id", "n_shingles").join(named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))


def _prefix(size: int, data: bytes, percent: int) -> np.ndarray:
    """The rarest tokens of which any linked set has one in its own prefix."""
    tokens = np.frombuffer(data, U64)
    return tokens[: prefix_length(size, len(tokens), percent)].astype(np.int64)


def keep_first(docs: DataFrame, n: int = 3, percent: int = 90, block_tokens: int = 1_000_000, pivots: int = 8) -> DataFrame:
    """The given rows and columns, one row of each component of linked rows: that with the smallest doc_id, of those the
    first as they are laid down. Rows with null doc_id stay. Only numbers of rows that go reach the texts."""
    batches = packed(docs, lambda t: len(t) // 4)
    every = _sets(batches, n, percent)
    numbered = every.where("print is not null").join(batches.select("batch", "first"), "batch").withColumn("id", F.col("first") + F.col("row"))
    linked = _linked(numbered.select("id", "n_shingles", "print", "tokens"), percent, block_tokens, pivots)
    rows = numbered.select("id", "doc_id", "batch", "row").join(linked.withColumnRenamed("node", "id"), "id")
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "id")).alias("keep"))
    gone = rows.join(first, "component").where("id <> keep.id").groupBy("batch").agg(F.collect_list("row").alias("rows"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [unpacked(data) for data in left.column("data").to_pylist()]
        lost = [i for part in right.column("rows").to_pylist() for i in part]
        if lost:
            stay = np.ones(sum(t.num_rows for t in out), bool)
            stay[lost] = False
            return pa.concat_tables(out).filter(pa.array(stay))
        return pa.concat_tables(out)

    return batches.select("batch", "data").groupBy("batch").cogroup(gone.groupBy("batch")).applyInArrow(run, docs.schema)
