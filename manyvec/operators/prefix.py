"""Running numbers and sums over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, key: str, value: Column, name: str, *ties: str, parts: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to each one, ordered by the numeric ``key``, then ``ties``; with ``by``
    over the rows of the same group only.

    Quantiles of the key cut the order into ranges; a range (of a group) is summed by itself, and gets the totals of
    those before, which are at most ``parts`` + 1 rows a group."""
    bounds = sorted(set(rows.approxQuantile(key, [i / parts for i in range(1, parts)], 0.001)))
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(key))) if bounds else F.lit(0)
    held = rows.withColumns({"__v": value, "__bucket": bucket})
    totals = held.groupBy(*by, "__bucket").agg(F.sum("__v").alias("__t"))
    before = totals.select(*by, "__bucket", F.coalesce(F.sum("__t").over(W.partitionBy(*by).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    run = F.sum("__v").over(W.partitionBy(*by, "__bucket").orderBy(key, *ties).rowsBetween(W.unboundedPreceding, 0))
    return held.join(before if by else F.broadcast(before), [*by, "__bucket"]).withColumn(name, run + F.col("__before")).drop("__v", "__bucket", "__before")


def numbered(rows: DataFrame, key: str, name: str = "rn", *ties: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds row numbers from 1 in the order of ``key``, within each group ``by``."""
    return running_sum(rows, key, F.lit(1).cast("long"), name, *ties, by=by)
