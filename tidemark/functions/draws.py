"""Counter-based random draws: a hash of (seed, parts…), so a draw does not depend on how the
rows are partitioned. ``md5`` can be recomputed by any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u32(seed: int, *parts: Column) -> Column:
    """Uniform integer in [0, 2^32)."""
    key = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def below(m: Column | int, seed: int, *parts: Column) -> Column:
    m = F.lit(m) if isinstance(m, int) else m
    return F.pmod(u32(seed, *parts), m)


def fast_u32(seed: int, *parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(4294967296))


def fast_below(m: Column | int, seed: int, *parts: Column) -> Column:
    """The same contract on a cheaper hash, for large draw counts."""
    m = F.lit(m) if isinstance(m, int) else m
    return F.pmod(F.xxhash64(F.lit(seed), *parts), m)
