"""Repeatable random draws: a hash of (seed, tag, row id) mapped to [0, 1).

A draw depends on the row alone, never on partitioning or on row order, so a lost
task recomputes the same values.
"""

from pyspark.sql import Column, functions as F

MD5_PREFIX_RANGE = 4294967296.0


def uniform(seed, tag, *ids) -> Column:
    """Uniform draw in [0, 1) for the row identified by ``ids``."""
    key = F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(MD5_PREFIX_RANGE)


def pick(values: Column, u: Column) -> Column:
    """Uniform choice from an array; null for an empty array."""
    n = F.size(values)
    return F.when(n > 0, F.get(values, F.floor(u * n).cast("int")))


def triangular(u: Column, low, high, mode) -> Column:
    """Inverse distribution function of the triangular distribution."""
    cut = (mode - low) / (high - low)
    rising = F.lit(float(low)) + F.sqrt(u * ((high - low) * (mode - low)))
    falling = F.lit(float(high)) - F.sqrt((F.lit(1.0) - u) * ((high - low) * (high - mode)))
    return F.when(u < cut, rising).otherwise(falling)


def beta_1_3(u: Column) -> Column:
    return F.lit(1.0) - F.pow(F.lit(1.0) - u, F.lit(1.0 / 3.0))


def beta_3_1(u: Column) -> Column:
    return F.pow(u, F.lit(1.0 / 3.0))
