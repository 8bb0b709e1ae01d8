"""Column functions that algorithms share: the bodies of their vertex and edge functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contribution(score: Column, degree: Column) -> Column:
    """A vertex's score per out-edge; 0 without one."""
    return F.when(degree > 0, score / degree).otherwise(F.lit(0.0))


def damped(incoming: Column, damping: float, vertices: int) -> Column:
    return F.lit((1 - damping) / vertices) + F.lit(damping) * F.coalesce(incoming, F.lit(0.0))


def moved(now: Column, before: Column) -> Column:
    return F.abs(now - before)


def power(base: float, exponent: Column) -> Column:
    return F.pow(F.lit(base), exponent)
