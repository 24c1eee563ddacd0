"""Picks with replacement that depend on their arguments alone, not on partitions or order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hashed(seed: int, m: Column, *of: Column) -> Column:
    """A number of 1..m from a hash of ``of``."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), m.cast("long")) + 1


def linear(seed: int, m: Column, i: Column, t: Column) -> Column:
    """A number of 1..m by a linear rule that any SQL engine can repeat: (7919 i + 104729 t + seed) mod m."""
    return F.pmod(i.cast("long") * 7919 + t.cast("long") * 104729 + seed, m.cast("long")) + 1
