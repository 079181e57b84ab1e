"""Repeatable uniform draws.

A draw depends only on a seed and the row's own key, never on partitioning, so the rows picked by a
mask are the same in every attempt of a task and in every later pass over the table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# (first hex digit, number of digits): three independent draws taken from one md5
_SLOTS = ((1, 12), (13, 12), (25, 8))


def digest(seed: str, *keys: Column) -> Column:
    parts = [F.lit(seed)]
    for key in keys:
        parts += [F.lit(":"), key.cast("string")]
    return F.md5(F.concat(*parts))


def uniform(seed: str, *keys: Column, slot: int = 0) -> Column:
    """Double in [0, 1) for (seed, keys). Slots 0..2 of one seed share a single md5."""
    first, width = _SLOTS[slot]
    digits = F.substring(digest(seed, *keys), first, width)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(16 ** width))


def pick(seed: str, size: int | Column, *keys: Column, slot: int = 0) -> Column:
    """Integer in [0, size)."""
    bound = F.lit(size) if isinstance(size, int) else size
    return F.floor(uniform(seed, *keys, slot=slot) * bound).cast("bigint")
