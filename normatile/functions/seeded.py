"""Repeatable pseudo-random columns: a function of a seed and the row's key, never of task order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = 2**52


def shuffle_key(seed: int, *keys: Column) -> Column:
    """52 bits of the MD5 of seed and keys; their order is a random permutation of the keys.

    Any engine can compute it: the first 13 hex digits of ``md5(concat_ws('|', seed, key, ...))`` with
    keys as strings and NULL written as an empty string.
    """
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    digest = F.md5(F.encode(F.concat_ws("|", F.lit(str(seed)), *parts), "UTF-8"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1)."""
    return shuffle_key(seed, *keys) / F.lit(float(_SPAN))


def gaussian(seed: int, *keys: Column) -> Column:
    """A standard normal number (Box-Muller on two uniforms)."""
    u1 = F.greatest(uniform(seed, F.lit("radius"), *keys), F.lit(1.0 / _SPAN))
    u2 = uniform(seed, F.lit("angle"), *keys)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0) * F.pi() * u2)


def seeded_flag(p: float, seed: int, *keys: Column) -> Column:
    """True with probability ``p``."""
    p = float(p)
    if not 0.0 <= p <= 1.0:
        raise ValueError(f"probability must be in [0, 1], got {p}")
    return uniform(seed, *keys) < F.lit(p)


def seeded_choice(options: Column, seed: int, *keys: Column) -> Column:
    """One element of an array column, each equally likely."""
    pick = F.pmod(shuffle_key(seed, *keys), F.size(options).cast("long")).cast("int")
    return F.try_element_at(options, pick + 1)
