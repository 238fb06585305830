"""Vectors as array<double> columns, and sums of vectors without exploding them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column) -> Column:
    """A zero vector stays zero."""
    n = norm(v)
    return F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    m = norm(a) * norm(b)
    return dot(a, b) / F.when(m == 0, 1.0).otherwise(m)


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def checked(v: Column, dim: int) -> Column:
    """The first dim elements; an error if there are fewer."""
    return F.when(F.size(v) >= dim, F.slice(v, 1, dim)).otherwise(F.raise_error(F.lit(f"vector narrower than {dim}")).cast("array<double>"))


def tiled(values: list[Column], dim: int) -> Column:
    """dim elements that repeat the values in turn."""
    return F.array(*[values[j % len(values)].cast("double") for j in range(dim)])


def vector_sum(v: Column, dim: int, weight: Column | None = None) -> Column:
    """The (weighted) sum of vectors as an aggregate: one plain sum per element, partial on the map side."""
    w = F.lit(1.0) if weight is None else weight
    return F.array(*[F.sum(F.get(v, F.lit(j)) * w) for j in range(dim)])


def long_form(df, keys: list[str], v: str = "embedding"):
    """(keys, pos, value): one row per element."""
    return df.select(*keys, F.posexplode(v).alias("pos", "value")).select(*keys, F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))
