"""Samplers of input variables, as Spark columns and as numpy draws of the same distribution."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sampler:
    """Values between min_value and max_value by scale, taken as positive, negative or mirrored with even chances."""

    scale: str
    min_value: float
    max_value: float
    uses_positive: bool = True
    uses_negative: bool = True

    def __post_init__(self):
        if self.scale not in SCALES:
            raise ValueError(f"scale must be one of {sorted(SCALES)}")
        if not (self.uses_positive or self.uses_negative):
            raise ValueError("a sampler uses positive values, negative ones or both")
        if self.scale == "log_uniform" and min(abs(self.min_value), abs(self.max_value)) <= 0:
            raise ValueError("a log-uniform sampler needs bounds other than 0")

    @property
    def bounds(self) -> tuple[float, float]:
        lo, hi = self.min_value, self.max_value
        if not self.uses_positive:
            lo, hi = sorted((abs(lo), abs(hi)))
        return lo, hi

    def column(self, seed: int) -> Column:
        """One value for each row, from Spark's generator."""
        lo, hi = self.bounds
        u, side = F.rand(seed), F.rand(seed + 7919)
        if self.scale == "log_uniform":
            a, b = math.log10(lo), math.log10(hi)
            value = F.pow(F.lit(10.0), F.lit(a) + F.lit(b - a) * u)
        else:
            value = F.lit(float(lo)) + F.lit(float(hi - lo)) * u
            if self.scale == "integer_uniform":
                value = F.least(F.floor(value), F.lit(math.ceil(hi) - 1)).cast("double")
        if self.uses_positive and self.uses_negative:
            return value * F.when(side < 0.5, F.lit(1.0)).otherwise(F.lit(-1.0))  # value once: its generator runs on with every row
        return value if self.uses_positive else -value

    def draw(self, n: int, rng: np.random.Generator) -> np.ndarray:
        lo, hi = self.bounds
        if self.scale == "log_uniform":
            value = 10 ** rng.uniform(math.log10(lo), math.log10(hi), n)
        elif self.scale == "integer_uniform":
            value = rng.integers(int(lo), int(hi), n).astype(float)
        else:
            value = rng.uniform(lo, hi, n)
        if self.uses_positive and self.uses_negative:
            return value * rng.choice([-1.0, 1.0], n)
        return value if self.uses_positive else -value

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Sampler:
        return cls(**d)


SCALES = {"uniform", "log_uniform", "integer_uniform"}


def uniform(lo: float = 0, hi: float = 1, positive: bool = True, negative: bool = True) -> Sampler:
    return Sampler("uniform", lo, hi, positive, negative)


def log_uniform(lo: float = 0.1, hi: float = 10, positive: bool = True, negative: bool = True) -> Sampler:
    return Sampler("log_uniform", lo, hi, positive, negative)


def integer_uniform(lo: int = 1, hi: int = 100, positive: bool = True, negative: bool = True) -> Sampler:
    return Sampler("integer_uniform", lo, hi, positive, negative)


def sample(spark: SparkSession, samplers: list[Sampler], n: int, seed: int = 0, columns: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """n rows (row_id and a column for each sampler), made where they are used: no data leave the driver."""
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    names = columns or [f"x{k}" for k in range(len(samplers))]
    return rows.select(F.col("id").alias("row_id"), *[s.column(seed * 1_000_003 + 31 * k).alias(c) for k, (s, c) in enumerate(zip(samplers, names, strict=True))])
