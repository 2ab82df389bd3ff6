"""Experience levels as a literal threshold array."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LEVEL = 120


def step_xp(level: int) -> int:
    return math.floor((level + 300 * 2 ** (level / 7)) / 4)


def thresholds() -> list[int]:
    """Total XP at which each level 0..120 begins."""
    out = [0]
    for level in range(MAX_LEVEL):
        out.append(out[-1] + step_xp(level))
    return out


def threshold_array() -> Column:
    return F.array(*[F.lit(t).cast("long") for t in thresholds()])


def level_of(xp) -> Column:
    """Largest level whose threshold is reached; 0 below zero, at most 120."""
    xp = F.col(xp) if isinstance(xp, str) else xp
    reached = F.size(F.filter(threshold_array(), lambda t: t <= xp)) - 1
    return F.greatest(F.coalesce(reached, F.lit(0)), F.lit(0)).cast("int")


def threshold_of(level) -> Column:
    level = F.col(level) if isinstance(level, str) else level
    capped = F.least(F.greatest(level, F.lit(0)), F.lit(MAX_LEVEL))
    return F.element_at(threshold_array(), (capped + 1).cast("int"))


def xp_to_next(xp) -> Column:
    xp = F.col(xp) if isinstance(xp, str) else xp
    lvl = level_of(xp)
    return F.when(lvl >= MAX_LEVEL, F.lit(0).cast("long")).otherwise(
        F.greatest(threshold_of(lvl + 1) - xp, F.lit(0).cast("long"))
    )


def percent_to_next(xp) -> Column:
    xp = F.col(xp) if isinstance(xp, str) else xp
    lvl = level_of(xp)
    low, high = threshold_of(lvl), threshold_of(lvl + 1)
    share = (xp - low) * 100.0 / F.greatest(high - low, F.lit(1).cast("long"))
    return F.when(lvl >= MAX_LEVEL, F.lit(100.0)).otherwise(
        F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0))
    )
