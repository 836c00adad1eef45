"""Counter-based random numbers: a hash of (position, stream, seed), so rows do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MANTISSA = 1 << 53


def uniform(*counters: Column | str, seed: int) -> Column:
    """A double in [0, 1) for each value of the counters."""
    return F.shiftrightunsigned(F.xxhash64(*counters, F.lit(seed)), 11) / F.lit(float(MANTISSA))


def uniform_int(n: int, *counters: Column | str, seed: int) -> Column:
    """A long in [0, n)."""
    return F.floor(uniform(*counters, seed=seed) * n).cast("long")
