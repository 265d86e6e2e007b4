"""Vector arithmetic as column expressions; see ``operators.rank`` for the blocked form."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def l2_normalise(v: Column, epsilon: float = EPSILON) -> Column:
    """Over its length, which counts as ``epsilon`` at least: a zero vector stays zero.

    The length is worked out once a vector, not once a component.
    """

    def scaled(w: Column) -> Column:
        return _bound(F.greatest(norm(w), F.lit(epsilon)), lambda n: F.transform(w, lambda x: x / n))

    return _bound(v, scaled)


def cosine(a: Column, b: Column) -> Column:
    return dot(l2_normalise(a), l2_normalise(b))


def reported(similarity: Column) -> Column:
    """A similarity to four places, rounded by its exact binary value, halves to even.

    ``round`` looks at the shortest decimal form instead and differs at apparent ties: 0.12355 is
    a little less than that, so it is 0.1235.  A double below 2 times 2^62 (below 2^-10: 2^72) is a
    whole number, and whole decimals tell exactly on which side of the half it lies.  Values of 2
    and more, which no similarity has, are left to ``round``.
    """
    size = F.abs(similarity)
    down = F.floor(size * 10_000)

    def step(power: int) -> Column:
        exact = F.floor(size * F.lit(float(2**power))).cast("decimal(20,0)") * F.lit(Decimal(10_000))
        half = (2 * down + 1).cast("decimal(6,0)") * F.lit(Decimal(2 ** (power - 1)))
        return F.when(exact > half, 1).when(exact == half, down % 2).otherwise(0)

    near = F.signum(similarity) * (down + F.when(size >= 2.0**-10, step(62)).otherwise(step(72))) / 10_000
    return F.when(size < 2, near + F.lit(0.0)).otherwise(F.round(similarity, 4))
