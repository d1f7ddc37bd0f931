"""Functions of training steps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def warmup(step: Column, steps: int, start: float = 0.0) -> Column:
    return F.when(step < steps, start + (1 - start) * step / max(1, steps)).otherwise(1.0)


def multi_step(step: Column, milestones: Sequence[int], gamma: float = 0.1) -> Column:
    passed = sum((F.when(step >= m, 1).otherwise(0) for m in milestones), F.lit(0))
    return F.pow(F.lit(gamma), passed)


def cosine(step: Column, steps: int) -> Column:
    return (1 + F.cos(F.least(step / steps, F.lit(1.0)) * math.pi)) / 2


def cyclic(step: Column, length: int, low: float) -> Column:
    """Cosine from 1 to low, again in every cycle."""
    return low + (1 - low) * (1 + F.cos(F.pmod(step, F.lit(length)) / length * math.pi)) / 2


def shifted_sigma(t: Column, shift: float) -> Column:
    return shift * t / (1 + (shift - 1) * t)


def middle_weight(t: Column, shift: float, steps: int = 1000) -> Column:
    """The training weight of a timestep between 0 and steps: a bell around the middle, less its least value on the grid of
    shifted steps, and by norm 1 on average there; 0 beyond that. The two constants are sums over the grid, done once."""
    grid = [shift * s / (1 + (shift - 1) * s) * steps for s in (1 - k / steps for k in range(steps))]
    bell = lambda x: math.exp(-2 * ((x - steps / 2) / steps) ** 2)
    least = min(map(bell, grid))
    total = sum(bell(x) - least for x in grid)
    norm = steps / total if total > 1e-8 else 1.0
    return F.greatest(F.exp(-2 * F.pow((t - steps / 2) / steps, 2)) - least, F.lit(0.0)) * norm
