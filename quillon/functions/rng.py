"""Stateless randomness: a hash of (id, seed), the same on every engine, partitioning and retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = 4294967295.0


def key(id_: Column, seed: int | str = 0) -> Column:
    """Text by which ids are put in random order."""
    return F.md5(F.concat_ws(":", id_.cast("string"), F.lit(str(seed))))


def uniform(id_: Column, seed: int | str = 0, low: float = 0.0, high: float = 1.0) -> Column:
    """In [low, high], both ends included."""
    u = F.conv(F.substring(key(id_, seed), 1, 8), 16, 10).cast("double") / MOST
    return u if (low, high) == (0.0, 1.0) else low + u * (high - low)


def integer(id_: Column, low: int, high: int, seed: int | str = 0) -> Column:
    """In low..high, both included."""
    return (F.conv(F.substring(key(id_, seed), 1, 8), 16, 10).cast("long") % (high - low + 1) + low).cast("int")


def normal(id_: Column, seed: int | str = 0, mean: float = 0.0, sd: float = 1.0) -> Column:
    """By the Box-Muller transform of two uniforms."""
    u = F.greatest(uniform(id_, f"{seed}a"), F.lit(1e-12))
    return mean + sd * F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.pi() * uniform(id_, f"{seed}b"))
