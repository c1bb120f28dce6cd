"""Column expressions of the retention score S = clip(w_r R + w_f F + w_u U + w_p P) and its relatives."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hourly decay, frequency that counts as full, tier bounds (both strict) and default weights.
DECAY, FREQUENCY_CAP, RETAIN, COMPRESS = 0.005, 50.0, 0.7, 0.3
WEIGHTS = {"r": 0.3, "f": 0.2, "u": 0.3, "p": 0.2}


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def recency(last: Column, now: Column | float, decay: float = DECAY) -> Column:
    """exp(-decay x hours since `last`); a time ahead of `now` counts as now."""
    now = now if isinstance(now, Column) else F.lit(float(now))
    return F.exp(F.lit(-decay) * F.greatest(now - last, F.lit(0.0)) / F.lit(3600.0))


def frequency(n: Column, cap: float = FREQUENCY_CAP) -> Column:
    """Log-scaled frequency, 1 from `cap` on; 0 where `cap` isn't positive."""
    if cap <= 0:
        return F.lit(0.0)
    return F.least(F.log(F.lit(1.0) + n) / F.log(F.lit(1.0 + cap)), F.lit(1.0))


def utility(success: Column, failure: Column) -> Column:
    """Laplace-smoothed success rate."""
    return (success + F.lit(1.0)) / (success + failure + F.lit(2.0))


def composite(r: Column, f: Column, u: Column, p: Column, weights: Mapping[str, float] = WEIGHTS) -> Column:
    """The clamped score at six decimals."""
    total = F.lit(weights["r"]) * r + F.lit(weights["f"]) * f + F.lit(weights["u"]) * u + F.lit(weights["p"]) * p
    return F.round(clip01(total), 6)


def tier(score: Column) -> Column:
    """retain above RETAIN, compress above COMPRESS, else delete."""
    return F.when(score > RETAIN, "retain").when(score > COMPRESS, "compress").otherwise("delete")


def normalized(weights: Mapping[str, float]) -> dict[str, float]:
    """Weights scaled to sum 1."""
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    return {k: w / total for k, w in weights.items()}


def leave_one_out(weights: Mapping[str, float]) -> dict[str, dict[str, float]]:
    """Weights without each component in turn, scaled to sum 1; a component that leaves nothing is skipped."""
    out = {}
    for gone in weights:
        rest = {k: (0.0 if k == gone else w) for k, w in weights.items()}
        if sum(rest.values()) > 0:
            out[gone] = normalized(rest)
    return out


#: Tag of memories that are compressed first, whatever their age and score (fixed value).
QUEUE_TAG = "system:high_priority_distillation"


def queued(tags: Column) -> Column:
    """Whether a memory waits in the distillation queue."""
    return F.coalesce(F.array_contains(tags, QUEUE_TAG), F.lit(False))


def grace(created: Column, last: Column, now: float, hours: float) -> Column:
    """Whether a memory is too young to be touched."""
    return (F.lit(now) - created < hours * 3600.0) | (F.lit(now) - last < hours * 3600.0)


def time_to_threshold(rest: Column, weight: float, bound: float, decay: float = DECAY) -> Column:
    """Hours until weight x R + rest falls to `bound`: 0 if it has, null if it never does."""
    return (
        F.when(rest + weight <= bound, F.lit(0.0))
        .when(rest >= bound, F.lit(None).cast("double"))
        .otherwise(-F.log((F.lit(bound) - rest) / F.lit(weight)) / F.lit(decay))
    )
