"""Seeded hashes that make every sampler independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_hash(key, seed: int | Column = 0, method: str = "xx") -> Column:
    """Number in [0, 1) from a key and a seed.

    ``xx`` takes any key types. ``linear`` is plain 64-bit arithmetic on one
    whole-number key below 3e9, which other engines can reproduce.
    """
    keys = list(key) if isinstance(key, (list, tuple)) else [key]
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    s = seed if isinstance(seed, Column) else F.lit(int(seed))
    if method == "linear":
        k = keys[0].cast("long")
        mixed = (k * F.lit(2654435761) + s.cast("long") * F.lit(40503)) % F.lit(4294967296)
        return mixed / F.lit(4294967296.0)
    if method != "xx":
        raise ValueError(f"unknown hash method {method!r}")
    h = F.xxhash64(*keys, s)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(2 ** 53))
