"""Quality rules: base counts, and robust multivariate outliers per language and source.

Each text gives exact counts and a transformed statistic vector. Within each (lang, source) group the
minimum-covariance-determinant estimate is sought: location and scatter of that share ``SHARE`` = 3/4 of the rows whose
scatter has the least determinant. Three starts from all rows (medians with absolute deviations, plain moments,
moments of squashed values) take two concentration steps each: distances under the present estimate, the quantile of
each group, new moments of the rows below it. The start with the least determinant goes on until no group's
determinant falls any more. The quantile is exact up to ``ACCURACY`` rows a group and off by at most one in so many
ranks beyond. Every step is a distributed aggregation; only a parameter row a group leaves it. No direction of a
scatter is taken for narrower than the least deviations in ``FEATURES``: eigenvalues below are raised to them, others
stay, so the steps lower the determinant under that bound. A document stays if it passes the base rule and its
squared Mahalanobis distance is at most the chi-square cutoff.

Edge cases: null text has no words (fails the base rule); null lang or source form a group of their own;
groups under ``min_group`` rows are too few for a scatter of five statistics, so they are pooled over the language, then
over everything, which the column ``pooled`` tells; constant statistics are harmless by the least deviations; rows
at the quantile itself all count (ties), repeated rows as often as they occur; very long texts are counted whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import operator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from manyvec.llm.common import SPACES, Memo, map_rows, narrow, spread
from manyvec.session import stored

SYMBOLS = "#*$%&|<>"
WINDOW = 8
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_same_next long"
#: Statistics in the vector, and the least standard deviation each is given.
FEATURES = {
    "word_length": ("log(word_chars / greatest(n_words, 1) + 1)", 0.12),
    "symbols": ("log(1 + 100 * n_symbols / greatest(word_chars, 1))", 0.25),
    "dup_lines": ("log(1 + 100 * n_dup_lines / greatest(n_lines, 1))", 0.72),
    "repeats": ("log(1 + 100 * n_repeat_words / greatest(n_words, 1))", 0.65),
    "same_next": ("log(1 + 100 * n_same_next / greatest(n_words, 1))", 0.6),
}
P = len(FEATURES)
KEYS = ("lang_g", "source_g")
PARAMS = "lang_g string, source_g string, start int, mu array<double>, inverse array<double>, goal double"
SHARE, ACCURACY = 0.75, 10_000


def word_hashes() -> Memo:
    import xxhash

    return Memo(xxhash.xxh64_intdigest)


_weights = np.random.default_rng(8).integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeat_words(words: list[bytes], hashes: Memo) -> int:
    """Words lying in a window of 8 that occurs at least twice, first occurrences included."""
    if len(words) <= WINDOW:
        return 0
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - WINDOW + 1
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key += h[k : k + n] * _weights[k]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def text_stats(text: str | None, hashes: Memo) -> tuple[int, ...]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words, hashes), len(lines), sum(map(operator.eq, words, words[1:]))


def base_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts): one scan, no shuffle."""

    def make():
        hashes = word_hashes()
        return lambda d, text, lang, source: (d, lang, source, *text_stats(text, hashes))

    return map_rows(narrow(docs, "doc_id", "text", "lang", "source"), make, f"doc_id long, lang string, source string, {STATS}")


def chi2_cdf(x: float, k: int) -> float:
    """Regularised lower incomplete gamma by its series."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    for n in range(1, 500):
        term *= z / (a + n)
        total += term
        if term < total * 1e-16:
            break
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a))) if z > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 500.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


#: With at most so many groups their rows of parameters are broadcast, else joined by key.
MOST_GROUPS = 20_000
#: Tasks for the rows of so many groups at most.
FEW_TASKS = 8


def _grouped(stats: DataFrame, min_group: int) -> tuple[DataFrame, bool]:
    """Adds lang_g, source_g: the group whose estimate a row is held against. Also tells whether the groups are few."""
    by = stats.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = by.groupBy(F.col("lang").alias("l")).agg(F.sum(F.when(F.col("n") < min_group, F.col("n"))).alias("pooled"))
    groups = by.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left")
    alone, pooled = F.col("n") >= min_group, F.col("pooled") >= min_group
    groups = groups.select(
        F.col("lang").alias("l"), F.col("source").alias("s"),
        F.when(alone | pooled, F.coalesce(F.concat(F.lit("="), "lang"), F.lit("null"))).otherwise("*").alias("lang_g"),
        F.when(alone, F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).otherwise("*").alias("source_g"),
    )
    few = by.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS
    groups = F.broadcast(groups) if few else groups
    joined = stats.join(groups, stats["lang"].eqNullSafe(F.col("l")) & stats["source"].eqNullSafe(F.col("s")), "left").drop("l", "s")
    return joined, few


def bounded(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """(inverse, goal) of a scatter no direction of which is narrower than the least deviations. The goal is what
    concentration lowers: the logarithm of the bounded scatter's determinant, and the trace of the scatter under it,
    which is constant where nothing had to be raised."""
    least = np.array([f for _, f in FEATURES.values()])
    scaled = cov / np.outer(least, least)
    values, axes = np.linalg.eigh((scaled + scaled.T) / 2)
    raised = np.maximum(values, 1)
    inverse = (axes / raised) @ axes.T / np.outer(least, least)
    return inverse, float(np.log(raised).sum() + 2 * np.log(least).sum() + (values / raised).sum())


def _together(rows: DataFrame, few: bool) -> DataFrame:
    """Rows a group: few groups need no task for each shuffle partition, most of which are empty."""
    return rows.coalesce(FEW_TASKS) if few else rows


def _inverted(moments: DataFrame, few: bool, factor: float = 1.0) -> DataFrame:
    """A parameter row for each row of moments."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                mu = np.array(r.mu, float)
                cross = np.zeros((P, P))
                cross[np.triu_indices(P)] = r.cross
                inverse, goal = bounded((cross + np.triu(cross, 1).T - np.outer(mu, mu)) * factor)
                out.append((r.lang_g, r.source_g, r.start, mu.tolist(), inverse.ravel().tolist(), goal))
            yield pd.DataFrame(out, columns=["lang_g", "source_g", "start", "mu", "inverse", "goal"])

    return _together(moments.select(*KEYS, "start", "mu", "cross"), few).mapInPandas(run, PARAMS)


def _moments(rows: DataFrame, x: list, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array(*[F.avg(a) for a in x]).alias("mu"), F.array(*[F.avg(x[i] * x[j]) for i in range(P) for j in range(i, P)]).alias("cross"))


def _distances(rows: DataFrame, params: DataFrame, few: bool, *more: str) -> DataFrame:
    """Adds d2; the parameters have a row a group, and a start where ``more`` says so."""
    params = params.select(*KEYS, *more, "mu", "inverse")
    joined = rows.join(F.broadcast(params) if few else params, list(KEYS), "left")
    gap = [F.col(f) - F.col("mu")[i] for i, f in enumerate(FEATURES)]
    d2 = sum((gap[i] * gap[j] * F.col("inverse")[i * P + j] for i in range(P) for j in range(P)), F.lit(0.0))
    return joined.withColumn("d2", d2).drop("mu", "inverse")


def starts(rows: DataFrame, few: bool) -> DataFrame:
    """Parameters of three starts a group."""
    hint = F.broadcast if few else lambda x: x
    x = [F.col(f) for f in FEATURES]
    middle = rows.groupBy(*KEYS).agg(*[F.percentile_approx(f, 0.5, ACCURACY).alias(f"m_{f}") for f in FEATURES])
    middle = stored(_together(middle, few), "medians")
    m = [F.col(f"m_{f}") for f in FEATURES]
    off = rows.join(hint(middle), list(KEYS)).groupBy(*KEYS).agg(*[F.percentile_approx(F.abs(a - b), 0.5, ACCURACY).alias(f"s_{f}") for a, b, f in zip(x, m, FEATURES)])
    scale = stored(middle.join(_together(off, few), list(KEYS)).select(*KEYS, *m, *[F.greatest(1.4826 * F.col(f"s_{f}"), F.lit(least)).alias(f"s_{f}") for f, (_, least) in FEATURES.items()]), "scales")
    s = [F.col(f"s_{f}") for f in FEATURES]
    plain = scale.select(*KEYS, F.array(*m).alias("mu"), F.array(*[m[i] * m[j] + (s[i] * s[i] if i == j else 0) for i in range(P) for j in range(i, P)]).alias("cross"))
    squashed = _moments(rows.join(hint(scale), list(KEYS)), [F.tanh((a - b) / c) * c + b for a, b, c in zip(x, m, s)], *KEYS)
    every = [plain, _moments(rows, x, *KEYS), squashed]
    return _inverted(every[0].withColumn("start", F.lit(0)).union(every[1].withColumn("start", F.lit(1))).union(every[2].withColumn("start", F.lit(2))), few)


def concentrated(rows: DataFrame, params: DataFrame, few: bool, share: float, factor: float = 1.0) -> DataFrame:
    """One concentration step of each start."""
    keys = [*KEYS, "start"]
    near = _distances(rows, params, few, "start")
    cut = near.groupBy(*keys).agg(F.percentile_approx("d2", share, ACCURACY).alias("cut"))
    cut = _together(cut, few)
    inner = near.join(F.broadcast(cut) if few else cut, keys).where("d2 <= cut")
    return stored(_inverted(_moments(inner, [F.col(f) for f in FEATURES], *keys), few, factor), "mcd")


def estimates(rows: DataFrame, few: bool = False, share: float = SHARE, trial: int = 2, most_steps: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """MCD parameters of each group from all its rows. ``most_steps`` only guards against a cycle of rounding."""
    params = stored(starts(rows, few), "mcd")
    for _ in range(trial):
        params = concentrated(rows, params, few, share)
    best = params.groupBy(*KEYS).agg(F.min_by(F.struct("start", "mu", "inverse", "goal"), F.struct("goal", "start")).alias("p"))
    params = stored(_together(best.select(*KEYS, "p.*"), few), "mcd")
    for _ in range(most_steps):
        following = concentrated(rows, params, few, share)
        old = params.select(*KEYS, F.col("goal").alias("old"))
        fell = following.join(old, list(KEYS)).agg(F.coalesce(F.max(F.col("old") - F.col("goal")), F.lit(0.0)).alias("x")).first()["x"]
        params = following
        if fell <= tolerance:
            break
    # what the inner share spreads too little, against the whole of a normal group
    return concentrated(rows, params, few, share, share / chi2_cdf(chi2_quantile(share, P), P + 2))


def judged(rows: DataFrame, level: float = 1 - 1e-7, min_group: int = 50, share: float = SHARE) -> DataFrame:
    """Adds base_failed, d2, pooled and kept to rows that have lang, source and the counts of STATS."""
    rows, few = _grouped(stored(rows, "stats").withColumns({f: F.expr(e) for f, (e, _) in FEATURES.items()}), min_group)
    rows = rows.withColumns({"pooled": F.col("source_g") == "*", "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))})
    learned = stored(rows.where("not base_failed").select(*KEYS, *FEATURES), "vectors")
    out = _distances(rows, estimates(learned, few, share), few)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_quantile(level, P), F.lit(True)))


def quality_rules(docs: DataFrame, **options) -> DataFrame:
    """Base counts, base_failed, kept, the squared distance and whether the group was pooled, for every document."""
    out = judged(base_stats(docs), **options)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("d2").alias("distance2"), "pooled")


def keep(docs: DataFrame, **options) -> DataFrame:
    """The given rows and columns, whatever their names, without those that the rules reject. The counts are laid
    down beside the rows, so no text is shuffled."""
    names = docs.columns
    at = {c.lower(): i for i, c in reversed(list(enumerate(names)))}
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    pick = lambda c: F.col(f"__c{at[c]}") if c in at else F.lit(None).cast("string")
    plain = plain.select("*", pick("lang").alias("lang"), pick("source").alias("source"), pick("text").alias("text"))
    fields = [x.split()[0] for x in STATS.split(", ")]

    def run(batches):
        hashes = word_hashes()
        for batch in batches:
            found = [text_stats(t, hashes) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * len(fields)
            kept = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays(kept + columns, names=batch.schema.names[:-1] + fields)

    schema = T.StructType(plain.schema.fields[:-1] + [T.StructField(f, T.LongType()) for f in fields])
    return judged(spread(plain).mapInArrow(run, schema), **options).where("kept").select(*[f"__c{i}" for i in range(len(names))]).toDF(*names)
