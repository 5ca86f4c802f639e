"""Numbers: similarities, medians, scales and hash distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), norm), F.lit(0.0))


def jaccard(a: Column, b: Column, empty: float | None = None) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(empty).cast("double"))


def savings(low: Column, high: Column) -> Column:
    return F.try_divide(high - low, high)


def log_position(x: Column, low: Column, high: Column) -> Column:
    """Where x lies between low and high on a log scale, from 0 to 1."""
    return F.when(high <= low, F.lit(0.5)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.ln(x) - F.ln(low), F.ln(high) - F.ln(low)))))


def hash_longs(x: Column) -> Column:
    """A 256-bit hex string as four longs."""
    word = lambda k: F.conv(F.substring(x, 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")
    as_long = lambda d: F.when(d > 2**63 - 1, (d - F.lit(str(2**64)).cast("decimal(20,0)"))).otherwise(d).cast("long")
    return F.array(*[as_long(word(k)) for k in range(4)])


def hamming_longs(a: Column, b: Column) -> Column:
    """Distance of two arrays of four longs."""
    out = F.lit(0)
    for k in range(4):
        out = out + F.bit_count(a[k].bitwiseXOR(b[k]))
    return out


def hamming(a: Column, b: Column) -> Column:
    """Distance of two 256-bit hex strings."""
    return hamming_longs(hash_longs(a), hash_longs(b))


def band(x: Column, edges: Sequence[float]) -> Column:
    """Number of the half-open band [edges[k], edges[k+1]) that holds x; the last one has no end."""
    out = F.lit(None).cast("int")
    for k, edge in enumerate(edges):
        out = F.when(x >= edge, F.lit(k)).otherwise(out)
    return out
