"""Language identification by words first, with backoff to character n-grams.

Learned from labelled texts: how often each word occurs in each language, over all of them, and from that
word table how often each character n-gram (inside ``<word>``) does. A text's words are scored by the log
frequency of the word per language; a word the model doesn't know by its longest n-grams that are known to
any language, else by shorter ones. The language with the largest sum wins; the score is its share under the
softmax of the per-word means.

The broadcast model has a proven bound: at most ``most_words`` words and ``most_grams`` n-grams, and at most ``CELLS``
numbers in either table, so with very many languages there are fewer entries but no language is left out. Entries are
chosen by their largest share in any language (an n-gram's among those of its order), so the size of a language
doesn't count: at most 1 / s words of a language have a share of s or more, so among k languages each keeps all its
words with a share of at least k / ``most_words`` (n-grams: k times the number of orders / ``most_grams``). The least
share that is taken follows from a histogram, so only chosen entries reach the driver. What is left out of the word
table falls to the n-grams; the totals that frequencies refer to are those of all counted rows, left out or not.

Edge cases: null text or text without a letter gives ``und`` with score 0; without any learned language all
texts give ``und``; equal sums go to the language first in order; of entries with nearly equal shares at the limit those
with the least hashes are taken; rows with null lang teach nothing; repeated rows teach as often as they occur; words
are lower-cased maximal runs of letters; very long texts are scored whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyvec.llm.common import held_out, is_held_out, map_rows, narrow
from manyvec.session import stored

words_of = re.compile(r"[^\W\d_]+").findall
UNKNOWN = "und"
#: Frequencies are smoothed by so many occurrences at the mean share over all languages: what a language with few
#: texts hasn't shown is taken for about as frequent as elsewhere, not for more.
PRIOR = 1000.0
#: Numbers in a table of the model.
CELLS = 12_000_000


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def word_counts(train: DataFrame) -> DataFrame:
    """(lang, word, n) over all rows: counted within each task first, so the shuffle carries each word once a batch."""

    def run(batches):
        for batch in batches:
            by: dict[str, Counter] = {}
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                by.setdefault(lang, Counter()).update(words_of((text or "").lower()))
            rows = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["lang", "word", "n"]).astype({"n": "int64"}), schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]), preserve_index=False)

    partial = train.select("text", "lang").where("lang is not null").mapInArrow(run, "lang string, word string, n long")
    return partial.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Backoff:
    def __init__(self, langs: list[str], words: dict[str, dict[int, int]], gram_counts: dict[str, dict[int, int]], orders: tuple[int, ...], word_totals: list[int], order_totals: dict[int, list[int]]):
        """The totals are per language over all counted rows, not only over the words and n-grams given."""
        k = len(langs)
        self.langs, self.orders = langs, orders
        totals = 1.0 + np.array(word_totals, float)
        gram_totals = {n: 1.0 + np.array(order_totals[n], float) for n in orders}

        def logs(row, total):
            v = np.zeros(k)
            for lang, n in row.items():
                v[lang] += n
            return np.log((v + PRIOR * (v / total).mean()) / (total + PRIOR))

        self.words = {w: logs(row, totals) for w, row in words.items()}
        self.gram_row = {g: i for i, g in enumerate(gram_counts)}
        self.gram_logs = np.array([logs(row, gram_totals[len(g)]) for g, row in gram_counts.items()]).reshape(len(gram_counts), k)

    def backoff(self, word: str) -> list[int]:
        """Rows of the word's n-grams of the longest order that has a known one."""
        look, marked = self.gram_row.get, f"<{word}>"
        for n in self.orders:
            found = [i for at in range(len(marked) - n + 1) if (i := look(marked[at : at + n])) is not None]
            if found:
                return found
        return []

    def vectors(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies for each word; zeros where nothing is known of it."""
        out = np.zeros((len(words), len(self.langs)))
        flat, starts, at = [], [], []
        for i, w in enumerate(words):
            if (known := self.words.get(w)) is not None:
                out[i] = known
            elif found := self.backoff(w):
                at.append(i)
                starts.append(len(flat))
                flat += found
        if at:
            out[at] = np.add.reduceat(self.gram_logs[flat], starts) / np.diff([*starts, len(flat)])[:, None]
        return out

    def scorer(self):
        """Row function text -> (lang, score). Word vectors seen lately are kept in a bounded table."""
        k = max(1, len(self.langs))
        most = min(400_000, 20_000_000 // k)
        slots: dict[str, int] = {}
        rows = np.zeros((most, k))

        def score(text: str | None) -> tuple[str, float]:
            words = words_of((text or "").lower())
            if not self.langs or not any(c.isalpha() for w in words for c in w):
                return UNKNOWN, 0.0
            if len(words) > most:
                counts = Counter(words)
                total = np.array(list(counts.values())) @ self.vectors(list(counts))
            else:
                if len(slots) + len(words) > most:
                    slots.clear()
                if new := list(dict.fromkeys(w for w in words if w not in slots)):
                    rows[len(slots) : len(slots) + len(new)] = self.vectors(new)
                    slots.update(zip(new, range(len(slots), len(slots) + len(new))))
                total = rows[list(map(slots.__getitem__, words))].sum(axis=0)
            mean = total / len(words)
            best = int(np.argmax(mean))
            return self.langs[best], float(1 / np.exp(mean - mean[best]).sum())

        return score


def fit(docs: DataFrame, orders: tuple[int, ...] = (5, 4, 3, 2, 1), most_words: int = 60_000, most_grams: int = 60_000) -> Backoff:
    """Counts over all rows not held out; the entries with the largest share in a language make the model."""
    docs = narrow(docs, "doc_id", "text", "lang")
    counts = stored(word_counts(docs.where(~held_out(F.col("doc_id")))), "words")
    of_order = [F.sum(F.col("n") * F.greatest(F.length("word") + 3 - n, F.lit(0))).alias(f"n{n}") for n in orders]
    sums = sorted(counts.groupBy("lang").agg(F.sum("n").alias("n"), *of_order).collect(), key=lambda r: r["lang"])  # a row a language
    langs = [r["lang"] for r in sums]
    number = {lang: i for i, lang in enumerate(langs)}
    word_totals, order_totals = [r["n"] for r in sums], {n: [r[f"n{n}"] for r in sums] for n in orders}

    def gram_rows(batches):
        for batch in batches:
            by: dict[str, Counter] = {}
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                c = by.setdefault(lang, Counter())
                for order in orders:
                    for g in grams(word, order):
                        c[g] += n
            rows = [(lang, g, n) for lang, c in by.items() for g, n in c.items()]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["lang", "word", "n"]).astype({"n": "int64"}), schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]), preserve_index=False)

    def top(rows: DataFrame, size, totals: dict[int, list[int]], most: int) -> dict[str, dict[int, int]]:
        """The entries with the largest share of their language's total for their size."""
        known = docs.sparkSession.createDataFrame([(lang, size, float(n)) for size, row in totals.items() for lang, n in zip(langs, row)], "lang string, size int, total double")
        shares = rows.withColumn("size", size).join(F.broadcast(known), ["lang", "size"]).withColumn("share", F.col("n") / F.col("total"))
        kept = shares.groupBy("word").agg(F.max("share").alias("share"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
        kept = kept.withColumns({"bin": F.floor(F.log2("share") * 8).cast("int"), "part": F.pmod(F.xxhash64("word"), F.lit(4096)).cast("int")})
        kept = stored(kept.select("word", "by", "bin", "part"), "entries")
        room = min(most, CELLS // max(1, len(langs)))
        bins = {r["bin"]: r["n"] for r in kept.groupBy("bin").agg(F.count("*").alias("n")).collect()}  # some hundred shares
        choice = F.lit(False)
        for share in sorted(bins, reverse=True):
            if bins[share] > room:  # of this bin as much as there is room for
                parts = kept.where(F.col("bin") == share).groupBy("part").agg(F.count("*").alias("n")).collect()
                upto = -1
                for part, n in sorted((r["part"], r["n"]) for r in parts):
                    if n > room:
                        break
                    room, upto = room - n, part
                choice = (F.col("bin") > share) | (F.col("bin") == share) & (F.col("part") <= upto)
                break
            room -= bins[share]
            choice = F.lit(True)
        taken = kept.where(choice)
        return {r["word"]: {number[lang]: n for lang, n in r["by"].items()} for r in sorted(taken.select("word", "by").collect(), key=lambda r: r["word"])}

    words = top(counts, F.lit(0), {0: word_totals}, most_words)
    chars = counts.mapInArrow(gram_rows, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    model = Backoff(langs, words, top(chars, F.length("word"), order_totals, most_grams), orders, word_totals, order_totals)
    return model


def identify(docs: DataFrame, model: Backoff) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one scan with the broadcast model, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = shared.value.scorer()
        return lambda d, text: (d, is_held_out(d), *score(text))

    return map_rows(narrow(docs, "doc_id", "text"), make, "doc_id long, held_out boolean, lang_pred string, score double")
