"""Vector columns: arrays of numbers, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def usable(v: Column, dim: Column | int | None = None) -> Column:
    """Whether a vector is there, has dim components if that is given, and all of them are finite numbers."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    sized = F.lit(True) if dim is None else F.size(v) == dim
    return F.coalesce(v.isNotNull() & sized & finite, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    """Unit length; a zero vector stays.

    The norm is bound to a variable of a lambda: an expression inside a lambda is computed anew for each component.
    """
    once = F.array(F.struct(doubles(v).alias("v"), norm(v).alias("n")))
    return F.get(F.transform(once, lambda s: F.when(s["n"] > 0, F.transform(s["v"], lambda x: x / s["n"])).otherwise(s["v"])), F.lit(0))


def truncate(v: Column, dim: int | None) -> Column:
    """The leading dim components, renormalised; the vector itself if dim is unset or not shorter."""
    if not dim:
        return doubles(v)
    return F.when(F.size(v) > dim, normalise(F.slice(v, 1, dim))).otherwise(doubles(v))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def add_scaled(a: Column, b: Column, factor: float) -> Column:
    """a + factor * b; a null b counts as zero."""
    return F.when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + factor * y))
