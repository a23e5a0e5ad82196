"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Over the prefix that both share."""
    n = F.least(F.size(a), F.size(b))
    prod = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def similarity_of_distance(d: Column) -> Column:
    return F.lit(1.0) - d


def checked(a: Column, dim: int) -> Column:
    """The vector, or an error if it hasn't dim entries."""
    return F.when(F.size(a) == dim, a).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} entries, found "), F.size(a).cast("string"))))


# FNV-1a of 64 bits, as two halves of 32 in BIGINT so that nothing overflows.

MASK = 0xFFFFFFFF


def fnv1a(text: Column) -> Column:
    """struct<hi, lo> of the text's UTF-8 bytes."""
    start = F.struct(F.lit(0xCBF29CE4).alias("hi"), F.lit(0x84222325).alias("lo"))
    raw = F.hex(F.encode(text, "UTF-8"))
    codes = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.length(raw) / 2 - 1, F.lit(0)).cast("int")), lambda i: i * 2 < F.length(raw)), lambda i: F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))

    def step(h: Column, b: Column) -> Column:
        lo = h["lo"].bitwiseXOR(b)
        t = lo * 435
        hi = (h["hi"] * 435 + F.shiftrightunsigned(t, 32) + F.shiftleft(lo.bitwiseAND(F.lit(0xFFFFFF)), 8)).bitwiseAND(F.lit(MASK))
        return F.struct(hi.alias("hi"), t.bitwiseAND(F.lit(MASK)).alias("lo"))

    return F.aggregate(codes, start, step)


def hash_index(h: Column, dim: int) -> Column:
    return ((h["hi"] % dim) * ((1 << 32) % dim) + h["lo"] % dim) % dim


def hash_sign(h: Column) -> Column:
    """-1 where the top bit is set."""
    return F.when(h["hi"] >= 1 << 31, F.lit(-1.0)).otherwise(F.lit(1.0))
