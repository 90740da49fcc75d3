"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null if a side is null or has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def unit(a: Column) -> Column:
    """The vector with length 1; zeros stay zeros."""
    return F.get(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))), F.lit(0))


def pooled(tokens: Column, mask: Column | None = None) -> Column:
    """Mean of a text's token vectors (array of arrays of one width) with length 1, over those that the mask (array of 0 and 1) keeps.

    Without a token to keep the result is zeros, as wide as the first token; null if the tokens are null or there are none. Entries of a shorter mask hide.
    """
    kept = tokens if mask is None else F.filter(tokens, lambda t, i: F.coalesce(F.get(mask, i), F.lit(0)) == 1)
    zeros = F.transform(tokens[0], lambda x: F.lit(0.0))
    total = F.aggregate(kept, zeros, lambda s, t: F.zip_with(s, t, lambda x, y: x + y.cast("double")))
    count = F.greatest(F.size(kept), F.lit(1))
    return F.when(F.size(tokens) > 0, unit(F.transform(total, lambda x: x / count)))


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits, halves away from zero. As elsewhere by IEEE a negative number that becomes zero keeps its sign, which F.round drops."""
    return F.round(F.abs(x), digits) * F.signum(x)


def combined(local: Column, over_all: Column, local_weight: float, global_weight: float) -> Column:
    return F.lit(local_weight) * local + F.lit(global_weight) * over_all


def softmax(score: Column, *keys: str) -> Column:
    """Softmax over all rows with the same keys, shifted by their maximum."""
    group = Window.partitionBy(*keys)
    shifted = F.exp(score - F.max(score).over(group))
    return shifted / F.sum(shifted).over(group)
