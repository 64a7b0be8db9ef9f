"""Hash splits: a position in [0, 1) per id that never moves when rows are added."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 12345


def hash_position(key: Column, seed: int = SEED) -> Column:
    """The first 64 bits of sha256('seed:key') as a fraction of 2^64."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def assign_split(key: Column, val: float = 0.15, test: float = 0.15, seed: int = SEED) -> Column:
    """'test' below the test share, 'val' in the next share, else 'train'."""
    if not (0 <= val < 1 and 0 <= test < 1 and val + test < 1):
        raise ValueError("fractions must be in [0, 1) and leave something to train on")
    at = hash_position(key, seed)
    return F.when(at < test, "test").when(at < test + val, "val").otherwise("train")


def lumpy(got: Column, total: Column, share: Column) -> Column:
    """Whether a sample under 60 strays from its expected count by more than half of it and half a row."""
    want = total * share
    return (total < 60) & (F.abs(got - want) > 0.5 + 0.5 * want)
