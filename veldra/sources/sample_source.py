"""A Python data source: spark.read.format("veldra_sample") gives rows drawn from samplers, partition by partition."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .samplers import Sampler


class _Slice(InputPartition):
    def __init__(self, index: int, start: int, rows: int):
        self.index, self.start, self.rows = index, start, rows


class _Reader(DataSourceReader):
    def __init__(self, samplers: list[Sampler], n: int, seed: int, slices: int):
        self.samplers, self.n, self.seed, self.slices = samplers, n, seed, slices

    def partitions(self):
        cut = [self.n * k // self.slices for k in range(self.slices + 1)]
        return [_Slice(k, a, b - a) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a] or [_Slice(0, 0, 0)]

    def read(self, part):
        """Blocks of at most 65536 rows; a block's values depend on the seed and its place alone."""
        for at in range(0, part.rows, 65536):
            n = min(65536, part.rows - at)
            rng = np.random.default_rng([self.seed, part.start + at])
            cols = [pa.array(np.arange(part.start + at, part.start + at + n))] + [pa.array(s.draw(n, rng)) for s in self.samplers]
            yield pa.RecordBatch.from_arrays(cols, names=["row_id", *(f"x{k}" for k in range(len(self.samplers)))])


class SampleSource(DataSource):
    """Options: samplers (JSON list of sampler dicts), n, seed, slices."""

    @classmethod
    def name(cls) -> str:
        return "veldra_sample"

    def _samplers(self) -> list[Sampler]:
        return [Sampler.from_dict(d) for d in json.loads(self.options["samplers"])]

    def schema(self) -> str:
        return ", ".join(["row_id long", *(f"x{k} double" for k in range(len(self._samplers())))])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._samplers(), int(self.options.get("n", "10000")), int(self.options.get("seed", "0")), int(self.options.get("slices", "8")))


def register(spark) -> None:
    spark.dataSource.register(SampleSource)


def read(spark, samplers: list[Sampler], n: int = 10_000, seed: int = 0, slices: int = 8):
    register(spark)
    return spark.read.format("veldra_sample").option("samplers", json.dumps([s.to_dict() for s in samplers])).option("n", str(n)).option("seed", str(seed)).option("slices", str(slices)).load()
