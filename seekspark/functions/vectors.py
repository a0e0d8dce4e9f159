"""Vector functions over array<float> columns, in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; null where lengths differ."""
    return let(F.struct(doubles(a).alias("a"), doubles(b).alias("b")), lambda s: F.when(F.size(s["a"]) == F.size(s["b"]), total(F.zip_with(s["a"], s["b"], lambda x, y: x * y))))


def let(value: Column, use) -> Column:
    """use(value), with value computed once: a lambda variable is not copied into its uses."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def length(c: Column) -> Column:
    return F.sqrt(total(F.transform(c, lambda x: x * x)))


def normalised(c: Column) -> Column:
    """Divided by its length; zeros stay."""
    return let(doubles(c), lambda d: let(length(d), lambda n: F.transform(d, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


def layer_norm(c: Column, eps: float = 1e-5) -> Column:
    centred = let(doubles(c), lambda d: let(total(d) / F.size(d), lambda m: F.transform(d, lambda x: x - m)))
    return let(centred, lambda d: let(F.sqrt(total(F.transform(d, lambda x: x * x)) / F.size(d) + eps), lambda s: F.transform(d, lambda x: x / s)))


def truncated(c: Column, d: int) -> Column:
    """The first d dimensions, scaled to length one."""
    return let(F.slice(doubles(c), 1, d), lambda h: let(F.greatest(length(h), F.lit(1e-12)), lambda n: F.transform(h, lambda x: x / n)))


def polar_codes(c: Column, levels: int = 16) -> Column:
    """Pairs of dimensions as (radius, angle bin)."""
    return let(doubles(c), lambda d: _polar(d, levels))


def _polar(d: Column, levels: int) -> Column:
    pairs = F.transform(F.sequence(F.lit(0), (F.size(d) / 2 - 1).cast("int")), lambda i: F.struct(F.get(d, 2 * i).alias("x"), F.get(d, 2 * i + 1).alias("y")))
    bin_ = lambda p: F.least(F.floor((F.atan2(p["y"], p["x"]) + math.pi) / (2 * math.pi) * levels), F.lit(levels - 1)).cast("int")
    return F.transform(pairs, lambda p: F.struct(F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]).alias("r"), bin_(p).alias("i")))


def quantised_dot(codes: Column, query: list[float], levels: int = 16, centre: bool = False) -> Column:
    """Estimated inner product of polar codes with a query; an angle bin stands for its left edge, or its centre."""
    shift = 0.5 if centre else 0.0
    angles = [(j + shift) / levels * 2 * math.pi - math.pi for j in range(levels)]
    table = [[query[2 * p] * math.cos(t) + query[2 * p + 1] * math.sin(t) for t in angles] for p in range(len(query) // 2)]
    lookup = F.array(*[F.array(*map(F.lit, row)) for row in table])
    return total(F.zip_with(codes, lookup, lambda c, row: c["r"] * F.get(row, c["i"])))
