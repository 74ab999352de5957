"""Learning-rate and dropout curves over a step column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def warmup_cosine(step: Column, warmup: int, total: int, base: float, floor_ratio: float = 0.0) -> Column:
    """Linear rise over the warm-up, then half a cosine down to the floor, where it stays."""
    rise = F.lit(base) * (step + 1) / max(1, warmup)
    progress = (step - warmup) / float(max(1, total - warmup))
    fall = F.lit(base) * (floor_ratio + (1 - floor_ratio) * 0.5 * (1 + F.cos(F.lit(math.pi) * progress)))
    return F.when(step < warmup, rise).when(step >= total, F.lit(base * floor_ratio)).otherwise(fall)


def saturating(step: Column, period: float = 5e4) -> Column:
    return 1 - F.exp(-step / period)
