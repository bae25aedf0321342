"""Random numbers that depend on a seed and keys alone: not on partitions, tasks or the engine, so SQL can repeat them."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 2**48


def number(*keys: Column) -> Column:
    """A whole number below 2**48 from the MD5 of the keys (integers), joined by colons."""
    text = F.concat_ws(":", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def uniform(*keys: Column) -> Column:
    """Uniform inside (0, 1)."""
    return (number(*keys) + 0.5) / float(RANGE)


def uniform_of(*keys: int) -> float:
    """The number of uniform() for whole numbers, outside Spark."""
    text = ":".join(map(str, keys)).encode()
    return (int(hashlib.md5(text).hexdigest()[:12], 16) + 0.5) / RANGE


def normal(*keys: Column) -> Column:
    """Standard normal, by Box and Muller on two uniform numbers."""
    return F.sqrt(-2 * F.log(uniform(F.lit(1), *keys))) * F.cos(2 * F.pi() * uniform(F.lit(2), *keys))


def number_sql(*keys: str | int) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(str(k) for k in keys)})), 1, 12))::BIGINT"


def uniform_sql(*keys: str | int) -> str:
    return f"(({number_sql(*keys)} + 0.5::DOUBLE) / {RANGE}::DOUBLE)"


def normal_sql(*keys: str | int) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(1, *keys)})) * cos(2 * pi() * {uniform_sql(2, *keys)}))"


#: A prime below 2**31 and multipliers, so that every product fits 64 bits in any engine.
PRIME, STEPS = 2**31 - 1, ((48271, 15), (69621, 13), (16807, 16))


def mixed(seed: int, key, draw):
    """Whole numbers below PRIME of NumPy arrays of keys and draws (not negative), by rounds of multiplying and shifting; cheap enough for each pair."""
    h = (key % PRIME * 39373 + draw * 742938 + seed * 950706 + 1) % PRIME
    for factor, shift in STEPS:
        h = (h * factor + 12345) % PRIME
        h = h ^ (h >> shift)
    return h % PRIME


def mixed_sql(seed: int, key: str, draw: str) -> str:
    h = f"(({key}) % {PRIME} * 39373 + ({draw}) * 742938 + {seed} * 950706 + 1) % {PRIME}"
    for factor, shift in STEPS:
        h = f"(({h}) * {factor} + 12345) % {PRIME}"
        h = f"list_transform([{h}], lambda h: xor(h, h >> {shift}))[1]"
    return f"(({h}) % {PRIME})"
