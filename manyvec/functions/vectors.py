"""Column functions on vectors (array<double>) and bags of vectors (array<array<double>>).

All are higher-order SQL functions: they run in the JVM and need no row to leave its partition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATRYOSHKA_DIMS = (768, 1536, 2560)
EPS = 1e-12


def zero() -> Column:
    return F.lit(0.0)


def let(value: Column, make) -> Column:
    """``make`` of a value that is computed once, also where it stands within a lambda."""
    return F.transform(F.array(value), make)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero(), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column, eps: float = EPS) -> Column:
    """Unit length; vectors shorter than ``eps`` are divided by ``eps``, so zero stays zero."""
    return let(F.greatest(norm(v), F.lit(eps)), lambda n: F.transform(v, lambda x: x / n))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(v: Column, by: Column | float) -> Column:
    return F.transform(v, lambda x: x * by)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(EPS))


def project(v: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """Linear layer: one output for each row of ``weights``."""
    rows = [dot(v, F.array(*map(F.lit, row))) for row in weights]
    return F.array(*[r + F.lit(bias[i]) if bias else r for i, r in enumerate(rows)])


def matryoshka(v: Column, dim: int, allowed: tuple[int, ...] = MATRYOSHKA_DIMS) -> Column:
    """The leading ``dim`` components at unit length."""
    if dim not in allowed:
        raise ValueError(f"dim must be one of {allowed}, not {dim}")
    return l2_normalize(F.slice(v, 1, dim))


def mean_tokens(toks: Column) -> Column:
    """Mean vector of a bag."""
    total = F.aggregate(F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0))), toks[0], lambda s, t: add(s, t))
    return F.transform(total, lambda x: x / F.size(toks))


def pool(toks: Column, how: str = "last") -> Column:
    """``cls``, ``last`` or ``mean`` of a bag, at unit length."""
    if how == "cls":
        return l2_normalize(toks[0])
    if how == "last":
        return l2_normalize(F.element_at(toks, -1))
    if how == "mean":
        return l2_normalize(mean_tokens(toks))
    raise ValueError(f"unknown pooling {how!r}")


def is_padding(v: Column) -> Column:
    return F.forall(v, lambda x: x == 0)


def unpad(toks: Column, side: str) -> Column:
    """Drops the leading (left) or trailing (right) all-zero vectors; zeros further in stay."""
    real = F.transform(toks, lambda v: ~is_padding(v))
    first = F.array_position(real, True)
    last = F.size(toks) + 1 - F.array_position(F.reverse(real), True)
    if side == "left":
        kept = F.slice(toks, first.cast("int"), F.size(toks))
    elif side == "right":
        kept = F.slice(toks, F.lit(1), last.cast("int"))
    else:
        raise ValueError(f"side must be left or right, not {side!r}")
    return F.when(F.array_contains(real, True), kept).otherwise(F.slice(toks, 1, 0))


def repad(toks: Column, to: Column, dim: Column, side: str = "right") -> Column:
    """Zero vectors up to ``to`` entries."""
    pad = F.array_repeat(F.array_repeat(zero(), dim.cast("int")), (to - F.size(toks)).cast("int"))
    if side not in ("left", "right"):
        raise ValueError(f"side must be left or right, not {side!r}")
    return F.concat(pad, toks) if side == "left" else F.concat(toks, pad)


def log_sum_exp(xs: Column) -> Column:
    return let(xs, lambda held: let(F.array_max(held), lambda top: top + F.log(F.aggregate(held, zero(), lambda s, x: s + F.exp(x - top)))))


def softplus(z: Column) -> Column:
    return F.greatest(z, zero()) + F.log1p(F.exp(-F.abs(z)))
