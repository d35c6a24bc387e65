"""Vector expressions: cosine, 8-bit quantisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def quantize(a: Column) -> Column:
    """(scale float, values array<int>): symmetric, half to even, within -127 to 127; scale 1 for a zero vector.
    The arithmetic is that of 32-bit floats."""
    most = F.array_max(F.transform(a, lambda x: F.abs(x.cast("float"))))
    scale = F.when(most > 0, (most.cast("double") / 127.0).cast("float")).otherwise(F.lit(1.0).cast("float"))
    ratio = lambda x: (x.cast("float").cast("double") / scale.cast("double")).cast("float").cast("double")
    values = F.transform(a, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(ratio(x)).cast("int"))))
    return F.struct(scale.alias("scale"), values.alias("values"))


def dequantize(q: Column) -> Column:
    return F.transform(q["values"], lambda v: (v.cast("float") * q["scale"]).cast("float"))
