"""splitmix64 and what is built on it: seed sampling, pass numbers, the slots of a counting Bloom filter.

64-bit wrapping arithmetic isn't to be had from Spark's checked long arithmetic, so it is done on Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The public splitmix64 generator, and the salt of seed sampling.
GAMMA, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SALT = 0x9E3779B97F4A7C15


def splitmix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) if x.dtype != np.uint64 else x
    with np.errstate(over="ignore"):
        x = x + np.uint64(GAMMA)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


def seed_hash(seeds: np.ndarray) -> np.ndarray:
    return splitmix64(seeds.astype(np.uint64) ^ np.uint64(SALT))


@F.pandas_udf(T.LongType())
def splitmix64_of(x: pd.Series) -> pd.Series:
    """splitmix64 of a long, as a signed long; null for null."""
    return pd.Series(splitmix64(x.fillna(0).to_numpy(np.int64).view(np.uint64)).view(np.int64)).where(x.notna().to_numpy()).astype("Int64")


@F.pandas_udf(T.LongType())
def seed_hash_of(x: pd.Series) -> pd.Series:
    return pd.Series(seed_hash(x.to_numpy(np.int64).view(np.uint64)).view(np.int64))


def is_sampled(hashed: Column, sample: int) -> Column:
    """Whether a seed with this hash is among one in `sample`, a power of two."""
    if sample < 1 or sample & (sample - 1):
        raise ValueError("sample must be a power of two")
    return hashed.bitwiseAND(F.lit(sample - 1)) == 0


def pass_number(hashed: Column, passes: int) -> Column:
    return F.shiftrightunsigned(hashed, 40) % passes


class Draws:
    """The sequence of a splitmix64 generator; creating it uses up one draw."""

    def __init__(self, seed: int) -> None:
        self.state = seed & (2**64 - 1)
        self.next()

    def next(self) -> int:
        out = int(splitmix64(np.array([self.state], np.uint64))[0])
        self.state = (self.state + GAMMA) & (2**64 - 1)
        return out

    def unit(self) -> float:
        """In [0, 1), from the upper 53 bits."""
        return (self.next() >> 11) / float(1 << 53)

    def below(self, n: int) -> int:
        return (self.next() * n) >> 64

    def happens(self, p: float) -> bool:
        return self.unit() < p


def bloom_seeds(k: int) -> tuple[int, int]:
    draws = Draws(Draws(k).next())
    return draws.next(), draws.next()


def bloom_slots(kmers: np.ndarray, slots: int, k: int, hashes: int = 4) -> np.ndarray:
    """The slots of each packed k-mer, one row each; a k-mer may meet a slot twice."""
    one, two = bloom_seeds(k)
    with np.errstate(over="ignore"):
        h1, h2 = splitmix64(kmers.astype(np.uint64) + np.uint64(one)), splitmix64(kmers.astype(np.uint64) + np.uint64(two))
        at = h1[:, None] + np.arange(hashes, dtype=np.uint64) * h2[:, None]
    return (at % np.uint64(slots)).astype(np.int64)


def bloom_slots_of(k: int, hashes: int = 4):
    """A function of (packed k-mer, number of slots) that gives the array of slots."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def slots(kmer: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series(list(bloom_slots(kmer.to_numpy(np.int64).view(np.uint64), int(size.iloc[0]) if len(size) else 1, k, hashes)))

    return slots
