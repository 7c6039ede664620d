"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v at length 1; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def blend(one: Column, other: Column, share: float) -> Column:
    """share of one and the rest of the other, at length 1."""
    return unit(F.zip_with(one, other, lambda x, y: F.lit(share) * x.cast("double") + F.lit(1 - share) * y.cast("double")))


def joined_spaces(head: Column, raw: Column, share: float) -> Column:
    """Both unit vectors side by side, so that a product mixes the two cosines: share of raw's."""
    part = lambda v, w: F.transform(unit(v), lambda x: x * F.lit(math.sqrt(w)))
    return F.concat(part(head, 1 - share), part(raw, share))


def with_penalty(v: Column, penalty: Column | None) -> Column:
    """One more dimension: -penalty for an item, 1 for a query (None), so the product subtracts it."""
    return F.concat(F.transform(v, lambda x: x.cast("double")), F.array(F.lit(1.0) if penalty is None else -penalty))


def half(x: Column) -> Column:
    """x rounded to half precision (11 significant bits, half to even), as a double."""
    size = F.abs(x)
    ulp = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)), F.lit(-14)) - 10)
    return F.when(size > 0, F.rint(x / ulp) * ulp).otherwise(0.0)


def first_largest(values: Column) -> Column:
    """The index (from 0) of the largest value; the first one wins a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(values: Column, temperature: float = 1.0) -> Column:
    e = F.transform(values, lambda x: F.exp((x - F.array_max(values)) / F.lit(temperature)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def corrected(logits: Column, prior: Column, tau: float) -> Column:
    """Logits less tau times the log of each class's prior."""
    return F.zip_with(logits, prior, lambda x, p: x - F.lit(tau) * F.log(p))
