"""Hashes that Spark and SQL engines compute alike: repeatable choices without rand()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647  # 2 ** 31 - 1: squares of remainders fit a long
FACTOR, SHIFT = 48271, 12820163
SEED = 17


def mixed(*keys: Column, seed: int = SEED) -> Column:
    """A long from 0 to 2 ** 62: two remainders, each a line over the keys squared twice, so that neighbours fall apart."""

    def half(start: int) -> Column:
        line = F.lit(start).cast("long")
        for k in keys:
            line = (line * FACTOR + F.pmod(k.cast("long"), F.lit(PRIME))) % PRIME
        once = (line * line + SHIFT) % PRIME
        return (once * once + line) % PRIME

    return half(seed) * PRIME + half(seed + 1)


def mixed_sql(*keys: str, seed: int = SEED) -> str:
    """The same of SQL expressions that are not negative."""

    def half(start: int) -> str:
        line = f"{start}::BIGINT"
        for k in keys:
            line = f"({line} * {FACTOR} + ({k})::BIGINT % {PRIME}) % {PRIME}"
        once = f"(({line}) * ({line}) + {SHIFT}) % {PRIME}"
        return f"(({once}) * ({once}) + ({line})) % {PRIME}"

    return f"(({half(seed)}) * {PRIME} + ({half(seed + 1)}))"
