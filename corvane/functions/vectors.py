"""Array functions over vectors, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v: Column | str) -> Column:
    return _c(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column | str, floor: float | None = None) -> Column:
    """Unit length. A zero vector stays, or its norm counts as ``floor`` at least."""
    v = _c(v)
    n = F.greatest(norm(v), F.lit(floor)) if floor is not None else F.when(norm(v) == 0, 1.0).otherwise(norm(v))
    return F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(n, F.size(v)).alias("n")), lambda s: s["x"] / s["n"])


def cosine(a: Column | str, b: Column | str) -> Column:
    """Similarity with 1e-8 added to norms, within [-1, 1]; null if a vector is."""
    s = dot(a, b) / ((norm(a) + 1e-8) * (norm(b) + 1e-8))
    return F.when(s.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s)))


def finite(v: Column | str) -> Column:
    return F.forall(_c(v), lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))


def mono(channels: Column | str) -> Column:
    """Mean over the channels of an array of equally long arrays."""
    c = _c(channels)
    zero = F.transform(c[0], lambda x: F.lit(0.0))
    return F.transform(F.aggregate(c, zero, lambda s, x: F.zip_with(s, x, lambda p, q: p + q)), lambda x: x / F.size(c))


def cropped(v: Column | str, length: int) -> Column:
    """The first ``length`` elements, filled up with zeros."""
    v = _c(v)
    return F.concat(F.slice(v, 1, length), F.array_repeat(F.lit(0.0), F.greatest(F.lit(length) - F.size(v), F.lit(0))))


def last_layers(layers: Column | str, n: int = 4) -> Column:
    """Mean of the last ``n`` layers of an array of layer vectors."""
    c = _c(layers)
    return mono(F.slice(c, F.greatest(F.size(c) - n + 1, F.lit(1)), n))
