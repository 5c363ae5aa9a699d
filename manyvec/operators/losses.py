"""Contrastive and distillation losses as aggregates over a long score table (qid, pid, score).

``offset`` says that query i belongs to document i + offset. Sums of exponentials never overflow, yet need no maximum
beforehand: a group's rows are summed by steps of ``STEP`` in the exponent, each sum relative to its step, and the few steps
of a group are put together against the highest. So every task sums what it has before anything is shuffled, and no
pair is sorted. All return one row with ``loss``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyvec.functions import vectors as V
from manyvec.operators import scoring


#: Exponents of one sum lie within this of each other.
STEP = 64.0


def _step(x: Column) -> Column:
    """What the exponent of ``x`` is taken relative to."""
    return F.floor(x / STEP) * STEP


def _whole(parts: DataFrame, group: str, tops: dict[str, tuple[str, ...]], *plain: str) -> DataFrame:
    """One row a group from those of its steps: the highest of each, the sums that are relative to it, and plain sums."""
    names = [n for top, sums in tops.items() for n in (top, *sums)]
    rows = parts.groupBy(group).agg(F.collect_list(F.struct(*names)).alias("__p"), *[F.max(t).alias(t) for t in tops], *[F.sum(n).alias(n) for n in plain])

    def over_all(top: str, name: str) -> Column:
        part = lambda p: F.coalesce(p[name] * F.exp(p[top] - F.col(top)), V.zero())
        return F.aggregate("__p", V.zero(), lambda s, p: s + part(p)).alias(name)

    return rows.select(group, *tops, *plain, *[over_all(top, n) for top, sums in tops.items() for n in sums])


def _positive(offset: int) -> Column:
    return F.col("pid") == F.col("qid") + offset


def _check(temperature: float, weight: float = 0.5) -> None:
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    if not 0 <= weight <= 1:
        raise ValueError("the in-batch weight must lie between 0 and 1")


def down_weight_negatives(scores: DataFrame, offset: int = 0, threshold: float = 0.95, factor: float = 0.5) -> DataFrame:
    """Off-positive scores above ``threshold`` times the positive one are multiplied by ``factor``."""
    own = scores.where(_positive(offset)).groupBy("qid").agg(F.max("score").alias("__pos"))
    high = ~_positive(offset) & (F.col("score") > threshold * F.col("__pos"))
    return scores.join(own, "qid", "left").withColumn("score", F.when(high, F.col("score") * factor).otherwise(F.col("score"))).drop("__pos")


def _cross_entropy(rows: DataFrame, group: str, positive: Column) -> DataFrame:
    """Mean of log-sum-exp minus the positive, over groups of ``x``."""
    steps = rows.withColumn("m", _step(F.col("x")))
    parts = steps.groupBy(group, "m").agg(F.sum(F.exp(F.col("x") - F.col("m"))).alias("z"), F.sum(F.when(positive, F.col("x"))).alias("own"))
    each = _whole(parts, group, {"m": ("z",)}, "own")
    return each.agg(F.avg(F.col("m") + F.log("z") - F.col("own")).alias("loss"))


def in_batch(scores: DataFrame, temperature: float = 0.02, offset: int = 0, filtered: bool = False) -> DataFrame:
    """InfoNCE of each query over all documents."""
    _check(temperature)
    rows = down_weight_negatives(scores, offset) if filtered else scores
    return _cross_entropy(rows.withColumn("x", F.col("score") / temperature), "qid", _positive(offset))


def symmetric(scores: DataFrame, temperature: float = 0.02, offset: int = 0, queries: DataFrame | None = None) -> DataFrame:
    """Mean of both directions; the documents' direction covers those that have a query. ``queries`` (qid) spares finding
    them among the pairs."""
    _check(temperature)
    rows = scores.withColumn("x", F.col("score") / temperature)
    known = (rows if queries is None else queries).select((F.col("qid") + offset).alias("pid")).distinct()
    owned = rows.join(known if queries is None else scoring.small(known), "pid", "left_semi")
    a, b = _cross_entropy(rows, "qid", _positive(offset)), _cross_entropy(owned, "pid", _positive(offset))
    return a.union(b).agg(F.avg("loss").alias("loss"))


def _blend(loss: DataFrame, scores: DataFrame, temperature: float, offset: int, weight: float, inner) -> DataFrame:
    return _blended(loss, inner(scores, temperature, offset), weight) if weight else loss


def _blended(loss: DataFrame, inner: DataFrame, weight: float) -> DataFrame:
    parts = loss.select((F.col("loss") * (1 - weight)).alias("x")).union(inner.select((F.col("loss") * weight).alias("x")))
    return parts.agg(F.sum("x").alias("loss"))


def _explicit(positives: DataFrame, negatives: DataFrame, temperature: float) -> DataFrame:
    """Mean softplus of negatives (qid, neg, score) over positives (qid, score)."""
    rows = negatives.join(positives.select("qid", F.col("score").alias("__pos")), "qid")
    return rows.agg(F.avg(V.softplus((F.col("score") - F.col("__pos")) / temperature)).alias("loss"))


def negatives(positives: DataFrame, negative: DataFrame, scores: DataFrame, temperature: float = 0.02, offset: int = 0, weight: float = 0.5) -> DataFrame:
    """Explicit negatives, blended with the in-batch loss."""
    _check(temperature, weight)
    return _blend(_explicit(positives, negative, temperature), scores, temperature, offset, weight, in_batch)


def pairwise(scores: DataFrame, temperature: float = 1.0, offset: int = 0) -> DataFrame:
    """Softplus of the hardest in-batch document over the positive: the highest score, or where that equals the positive's the
    second highest, which is the highest of all documents but the positive in either case."""
    _check(temperature)
    own = _positive(offset)
    each = scores.groupBy("qid").agg(F.max(F.when(own, F.col("score"))).alias("pos"), F.max(F.when(~own, F.col("score"))).alias("hardest"))
    return each.agg(F.avg(V.softplus((F.col("hardest") - F.col("pos")) / temperature)).alias("loss"))


def pairwise_negatives(positives: DataFrame, negative: DataFrame, scores: DataFrame, temperature: float = 0.02, offset: int = 0, weight: float = 0.5) -> DataFrame:
    _check(temperature, weight)
    return _blend(_explicit(positives, negative, temperature), scores, temperature, offset, weight, pairwise)


def sigmoid(scores: DataFrame, temperature: float = 0.02, offset: int = 0) -> DataFrame:
    """Mean softplus of -y s / T with y = 1 on positives, else -1."""
    _check(temperature)
    y = F.when(_positive(offset), F.lit(1.0)).otherwise(-1.0)
    return scores.agg(F.avg(V.softplus(-y * F.col("score") / temperature)).alias("loss"))


def block_sigmoid(scores: DataFrame, temperature: float = 0.02, offset: int = 0, size: DataFrame | None = None) -> DataFrame:
    """Sigmoid loss over whole blocks of as many documents as queries, from ``offset`` on and around the end; each block
    counts alike, and only the first has positives. ``size`` (b queries, c documents: one row) spares counting the pairs'."""
    _check(temperature)
    size = scores.agg(F.countDistinct("qid").alias("b"), F.countDistinct("pid").alias("c")) if size is None else size
    rows = scores.crossJoin(F.broadcast(size))  # one row
    spot = F.pmod(F.col("pid") - offset, F.col("c"))
    rows = rows.withColumn("__block", F.floor(spot / F.col("b"))).where(F.col("__block") < F.floor(F.col("c") / F.col("b")))
    y = F.when((F.col("__block") == 0) & _positive(offset), F.lit(1.0)).otherwise(-1.0)
    each = rows.groupBy("__block").agg(F.avg(V.softplus(-y * F.col("score") / temperature)).alias("l"))
    return each.agg(F.avg("l").alias("loss"))


def distillation(student: DataFrame, teacher: DataFrame, temperature: float = 0.07) -> DataFrame:
    """KL(teacher || student) of the softmaxes over documents, summed over pairs and averaged over queries, times T squared."""
    _check(temperature)
    return distilled(student.select("qid", "pid", F.col("score").alias("s")).join(teacher.select("qid", "pid", F.col("score").alias("t")), ["qid", "pid"], "full"), temperature)


def distilled(both: DataFrame, temperature: float = 0.07) -> DataFrame:
    """The same of pairs that have both scores (qid, pid, s of the student, t of the teacher)."""
    _check(temperature)
    rows = both.select("qid", (F.col("s") / temperature).alias("s"), (F.col("t") / temperature).alias("t"))
    rows = rows.withColumns({"ms": _step(F.col("s")), "mt": _step(F.col("t"))})
    weight = F.exp(F.col("t") - F.col("mt"))
    parts = rows.groupBy("qid", "ms", "mt").agg(
        F.sum(F.exp(F.col("s") - F.col("ms"))).alias("zs"), F.sum(weight).alias("zt"),
        F.sum(weight * (F.col("t") - F.col("s"))).alias("gap"), F.count_if(F.col("s").isNull() | F.col("t").isNull()).alias("odd"),
    )
    return _divergence(parts, "qid", temperature)


def _divergence(parts: DataFrame, group: str, temperature: float) -> DataFrame:
    each = _whole(parts, group, {"ms": ("zs",), "mt": ("zt", "gap")}, "odd")
    shapes = F.sum("odd")
    # the sum of p (log p - log q), with both normalisations taken out of it
    total = F.avg(F.col("gap") / F.col("zt") - F.col("mt") - F.log("zt") + F.col("ms") + F.log("zs")) * temperature**2
    return each.agg(F.when(shapes == 0, total).otherwise(F.raise_error(F.lit("score shapes must match"))).alias("loss"))


def multi_positive(scores: DataFrame, qrels: DataFrame) -> DataFrame:
    """Mean over queries with a ranked positive of log-sum-exp of all scores minus that of the positives; 0 without any."""
    marks = qrels.select("qid", "pid").distinct().withColumn("rel", F.lit(True))
    return multi_positive_marked(scores.join(marks, ["qid", "pid"], "left"))


def multi_positive_marked(scores: DataFrame) -> DataFrame:
    """The same where pairs already say whether they are relevant (``rel``, true or null)."""
    rows = scores.withColumn("m", _step(F.col("score")))
    e = F.exp(F.col("score") - F.col("m"))
    parts = rows.groupBy("qid", "m").agg(F.sum(e).alias("every"), F.sum(F.when(F.col("rel"), e)).alias("own"), F.count("rel").alias("n"))
    each = _whole(parts, "qid", {"m": ("every", "own")}, "n")
    return each.agg(F.coalesce(F.avg(F.when(F.col("n") > 0, F.log(F.col("every") / F.col("own")))), F.lit(0.0)).alias("loss"))


def identity(original: DataFrame, adapted: DataFrame) -> DataFrame:
    """Mean over pages of one minus the mean cosine of their tokens (pid, tok, v)."""
    rows = original.select("pid", "tok", F.col("v").alias("o")).join(adapted.select("pid", "tok", F.col("v").alias("a")), ["pid", "tok"])
    each = rows.groupBy("pid").agg((1 - F.avg(V.cosine(F.col("o"), F.col("a")))).alias("l"))
    return each.agg(F.avg("l").alias("loss"))


def adapter_loss(student: DataFrame, teacher: DataFrame, qrels: DataFrame, original: DataFrame, adapted: DataFrame, temperature: float = 0.07, weights: tuple[float, float, float] = (1.0, 0.5, 0.05)) -> DataFrame:
    """(total, score_distill, qrels_rank, identity)."""
    return weighted(distillation(student, teacher, temperature), multi_positive(student, qrels), identity(original, adapted), weights)


def weighted(distill: DataFrame, rank: DataFrame, same: DataFrame, weights: tuple[float, float, float] = (1.0, 0.5, 0.05)) -> DataFrame:
    names = ("score_distill", "qrels_rank", "identity")
    parts = [distill, rank, same]
    row = parts[0].select(F.col("loss").alias(names[0]))
    for name, part in zip(names[1:], parts[1:]):
        row = row.crossJoin(F.broadcast(part.select(F.col("loss").alias(name))))  # one row each
    return row.select(sum((F.col(n) * w for n, w in zip(names, weights)), F.lit(0.0)).alias("total"), *names)


def epoch_mean(losses: DataFrame) -> DataFrame:
    """(epoch, loss): sums over at least one step."""
    return losses.groupBy("epoch").agg((F.sum("loss") / F.greatest(F.count("loss"), F.lit(1))).alias("loss"))


def learning_rate(step: Column, warmup: int, total: int, floor: float = 0.1) -> Column:
    """Linear warm-up, then linear decay down to ``floor``."""
    decay = F.greatest(F.lit(floor), (total - step) / F.lit(max(1, total - warmup)))
    return F.when(step < warmup, step / F.lit(max(1, warmup))).otherwise(decay).cast("double")
