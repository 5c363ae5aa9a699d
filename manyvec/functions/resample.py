"""Separable bicubic resampling of grey images (array<array<int>>, rows of levels from 0 to 255) as column expressions.

An output cell weighs the input cells within two cells of its centre (in output cells where the image shrinks) by the cubic
with a = -1/2; weights sum to one and are whole numbers of 2**-22. Rows are resampled first and rounded to levels, then columns.
The weights of a size are a short list of literals; images whose size differs are resampled by a list of their own."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from manyvec.functions.vectors import let

ONE = 1 << 22


def cubic(x: float) -> float:
    """The cubic convolution kernel with a = -1/2."""
    x = abs(x)
    if x < 1:
        return (1.5 * x - 2.5) * x * x + 1
    return ((-0.5 * x + 2.5) * x - 4) * x + 2 if x < 2 else 0.0


def weights(n_in: int, n_out: int) -> list[tuple[int, list[int]]]:
    """For each output cell its first input cell and the whole weights from there on."""
    if n_in < 1 or n_out < 1:
        raise ValueError("images have at least one cell")
    step = n_in / n_out
    wide = max(step, 1.0)
    out = []
    for i in range(n_out):
        centre = (i + 0.5) * step
        first, end = max(0, int(centre - 2 * wide + 0.5)), min(n_in, int(centre + 2 * wide + 0.5))
        raw = [cubic((j + 0.5 - centre) / wide) for j in range(first, end)]
        total = sum(raw)
        out.append((first, [math.floor(w / total * ONE + 0.5) if w >= 0 else math.ceil(w / total * ONE - 0.5) for w in raw]))
    return out


def _literal(n_in: int, n_out: int) -> Column:
    return F.array(*[F.struct(F.lit(first).alias("first"), F.array(*[F.lit(w).cast("long") for w in ws]).alias("w")) for first, ws in weights(n_in, n_out)])


def _level(total: Column) -> Column:
    """A weighted sum as a level."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.shiftright(total + ONE // 2, 22))).cast("int")


def _weighted(cells: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(cells, w, lambda c, k: c * k), F.lit(0).cast("long"), lambda s, x: s + x)


def transposed(image: Column, n: int) -> Column:
    """Columns as rows, of an image with ``n`` columns."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: F.transform(image, lambda row: F.get(row, x)))


def resized_rows(image: Column, n_in: int, n_out: int) -> Column:
    """Every row resampled from ``n_in`` to ``n_out`` cells."""
    return let(_literal(n_in, n_out), lambda table: F.transform(image, lambda row: F.transform(table, lambda t: _level(_weighted(F.slice(row, t["first"] + 1, F.size(t["w"])), t["w"])))))


def resized(image: Column, width: int, height: int, to_width: int, to_height: int) -> Column:
    """``image`` (``height`` rows of ``width`` levels) at another size."""
    wide = resized_rows(image, width, to_width)
    return let(wide, lambda rows: transposed(resized_rows(transposed(rows, to_width), height, to_height), to_height))
