"""Batches of unequal parts: pixel sequences laid end to end, and items of several kinds.

A batch is a row, so its parts never leave it; batches are as long as whoever builds them makes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from manyvec.functions.vectors import let, repad

#: An item of a batch: the kind says which of the fields holds it.
ITEM = "struct<kind: string, text: string, image: binary>"


def starts(sizes: Column) -> Column:
    """Where each part begins, from 0."""
    return F.transform(sizes, lambda n, i: F.aggregate(F.slice(sizes, 1, i), F.lit(0).cast("long"), lambda s, x: s + x))


def split(sequence: Column, sizes: Column) -> Column:
    """The parts of a sequence, ``sizes`` long each; sizes that don't add up to the sequence are an error."""
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x)
    parts = let(starts(sizes), lambda at: F.transform(sizes, lambda n, i: F.slice(sequence, (F.get(at, i) + 1).cast("int"), n.cast("int"))))
    return F.when(total == F.size(sequence), parts).otherwise(F.raise_error(F.lit("the sizes don't cover the sequence")))


def by_grid(grids: Column) -> Column:
    """Sizes of the parts from their grids (frames, height, width): height times width."""
    return F.transform(grids, lambda g: (g[1] * g[2]).cast("int"))


def padded(parts: Column, dim: Column) -> Column:
    """All parts with zero vectors up to the longest."""
    longest = F.array_max(F.transform(parts, lambda p: F.size(p)))
    return let(longest, lambda most: F.transform(parts, lambda p: repad(p, most, dim)))


def joined(parts: Column, sizes: Column) -> Column:
    """Padded parts end to end, without their padding."""
    return F.flatten(F.transform(parts, lambda p, i: F.slice(p, F.lit(1), F.get(sizes, i).cast("int"))))


def collated(rows: DataFrame, item: str, processors: dict[str, Callable[[Column], Column]], prefix: str = "", mixed: str = "error", batch: str = "batch", pos: str = "pos") -> DataFrame:
    """(batch, pos, <prefix>kind, <prefix>input): each item (see ITEM) by the processor of its kind, which gets the field of
    that name. Where ``mixed`` is "error" a batch of several kinds is an error; "split" dispatches each item by itself. Items of
    no known kind, and items whose field is null, are errors."""
    if mixed not in ("error", "split"):
        raise ValueError("mixed is error or split")
    kind, fields = F.col(item)["kind"], {k: F.col(item)[k] for k in processors}
    out = F.raise_error(F.concat(F.lit("no processor for "), F.coalesce(kind, F.lit("null")))).cast("string")
    for name, process in processors.items():
        filled = F.when(fields[name].isNotNull(), process(fields[name])).otherwise(F.raise_error(F.lit(f"an item of kind {name} holds none")).cast("string"))
        out = F.when(kind == name, filled).otherwise(out)
    if mixed == "error":
        kinds = F.array_sort(F.collect_set(kind).over(W.partitionBy(batch)))
        out = F.when(F.size(kinds) <= 1, out).otherwise(F.raise_error(F.concat(F.lit("a batch of mixed kinds: "), F.array_join(kinds, ", "))).cast("string"))
    return rows.select(batch, pos, kind.alias(f"{prefix}kind"), out.alias(f"{prefix}input"))


def collated_lists(rows: DataFrame, items: str, processors: dict[str, Callable[[Column], Column]], prefix: str = "", batch: str = "batch", pos: str = "pos") -> DataFrame:
    """(batch, pos, <prefix>kind, <prefix>inputs): lists of items, flattened, processed and put together again; within a batch
    all lists must be of one kind and one length."""
    sizes, size = W.partitionBy(batch), F.size(items)
    even = F.when((F.min(size).over(sizes) == F.max(size).over(sizes)) & (size > 0), F.lit(True)).otherwise(F.raise_error(F.lit("lists of unequal length in a batch")))
    flat = rows.select(batch, pos, even.alias("__even"), F.posexplode(items).alias("__at", "__item")).where("__even")
    done = collated(flat.withColumn("__pos", F.struct(F.col(pos).alias("pos"), F.col("__at").alias("at"))), "__item", processors, prefix, batch=batch, pos="__pos")
    gathered = F.transform(F.sort_array(F.collect_list(F.struct(F.col("__pos.at").alias("at"), F.col(f"{prefix}input").alias("input")))), lambda x: x["input"])
    return done.groupBy(batch, F.col("__pos.pos").alias(pos)).agg(F.first(f"{prefix}kind").alias(f"{prefix}kind"), gathered.alias(f"{prefix}inputs"))
