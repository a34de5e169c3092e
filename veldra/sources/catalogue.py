"""Benchmarks of known equations, and datasets drawn from them. The equations are read from a table given as a parameter."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.symbols import SymbolLibrary
from ..functions.tree import parse
from ..plans.compile import to_column
from .samplers import Sampler
from .tables import TableStore, drift_hash

#: The table of equations that comes with the repository.
EQUATIONS = os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "FIXTURES.md")
SCALE = {"U": "uniform", "L": "log_uniform", "I": "integer_uniform"}
#: Fixed values of every catalogue dataset.
MAX_EVALUATIONS, THRESHOLD, ROWS = 100_000, 1e-7, 10_000


def read_samplers(text: str) -> list[Sampler]:
    """Samplers written as in the table: 2*U+[1,5] is two positive uniform ones, +- is mirrored."""
    out = []
    for count, scale, sign, lo, hi in re.findall(r"(?:(\d+)\*)?([ULI])(\+-|\+|-)\[([^,\]]+),([^\]]+)\]", text):
        out += [Sampler(SCALE[scale], float(lo), float(hi), "+" in sign, "-" in sign)] * int(count or 1)
    return out


@dataclass
class Dataset:
    """What is known of a dataset; its rows are made or read when asked for."""

    name: str
    tokens: list[str] | None = None
    samplers: list[Sampler] = field(default_factory=list)
    num_variables: int = 0
    benchmark: str | None = None
    version: str = "1.0.0"
    ranking: str = "rmse"
    max_evaluations: int = -1
    threshold: float | None = None
    rows: int = ROWS
    seed: int | None = None
    path: str | None = None

    def __post_init__(self):
        if self.samplers:
            self.num_variables = len(self.samplers)
        if self.ranking not in ("rmse", "bed"):
            raise ValueError("ranking is rmse or bed")

    @property
    def library(self) -> SymbolLibrary:
        return SymbolLibrary.default(self.num_variables)

    @property
    def columns(self) -> list[str]:
        return [f"x{k}" for k in range(self.num_variables)]

    def sample(self, spark: SparkSession, n: int | None = None, seed: int | None = None) -> DataFrame:
        """Fresh rows: row_id, x0.., and y from the equation where the ranking needs it."""
        from .samplers import sample

        if not self.samplers:
            raise ValueError(f"{self.name} has no samplers")
        df = sample(spark, self.samplers, self.rows if n is None else n, self.seed or 0 if seed is None else seed)
        if self.ranking == "bed":
            return df
        if not self.tokens:
            raise ValueError(f"{self.name} has no equation to compute y from")
        return df.withColumn("y", to_column(self.tokens, self.columns, (), self.library))

    def load(self, spark: SparkSession, store: TableStore | None = None, force: bool = False) -> DataFrame:
        """The dataset's own rows: from its path, else from the store, which is filled on first use."""
        if self.path:
            return spark.read.parquet(self.path)
        if store is None or self.benchmark is None:
            return self.sample(spark)
        return store.resolve(spark, self.benchmark, self.version, self.name, lambda: self.sample(spark), drift_hash(self.to_dict()), force)

    def evaluator(self, spark: SparkSession, store: TableStore | None = None, seed: int | None = None, **settings):
        from ..operators.evaluator import Evaluator
        from ..operators.fit import Settings

        return Evaluator(self.load(spark, store), self.columns, None if self.ranking == "bed" else "y", library=self.library, max_evaluations=self.max_evaluations, threshold=self.threshold, ranking=self.ranking, ground_truth=self.tokens, seed=seed if seed is not None else self.seed, settings=Settings(**settings), metadata={"dataset_name": self.name, "benchmark": self.benchmark})

    def to_dict(self) -> dict:
        return {**{k: v for k, v in vars(self).items() if k != "samplers"}, "samplers": [s.to_dict() for s in self.samplers], "format_version": 2}

    @classmethod
    def from_dict(cls, d: dict) -> Dataset:
        return cls(**{k: v for k, v in d.items() if k not in ("samplers", "format_version")}, samplers=[Sampler.from_dict(s) for s in d["samplers"]])

    def save(self, spark: SparkSession, path: str, df: DataFrame | None = None) -> None:
        """An archive: the rows as Parquet and the description as a manifest beside them."""
        (self.load(spark) if df is None else df).write.mode("overwrite").parquet(f"{path}/data")
        spark.createDataFrame([(json.dumps(self.to_dict()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Dataset:
        out = cls.from_dict(json.loads(spark.read.text(f"{path}/manifest").first()[0]))
        out.path = f"{path}/data"
        return out

    def __str__(self) -> str:
        return f"{self.name}: {' '.join(self.tokens) if self.tokens else 'no equation'}; {self.num_variables} variables, ranked by {self.ranking}"


class Benchmark:
    """A named, versioned, ordered set of datasets."""

    def __init__(self, name: str, version: str = "1.0.0", datasets: list[Dataset] | None = None):
        self.name, self.version, self.datasets = name, version, {}
        for d in datasets or []:
            self.add(d)

    def add(self, d: Dataset) -> None:
        if d.name in self.datasets:
            raise ValueError(f"{d.name} is in the benchmark already")
        if d.ranking == "bed" and not d.tokens:
            raise ValueError(f"{d.name} is ranked by behaviour but has no equation")
        d.benchmark, d.version = self.name, self.version
        self.datasets[d.name] = d

    def create(self, spark: SparkSession, name: str, store: TableStore | None = None, n: int | None = None, seed: int | None = None) -> DataFrame:
        """A dataset's own rows, or a fresh draw where a number or a seed is given."""
        d = self.datasets[name]
        return d.load(spark, store) if n is None and seed is None else d.sample(spark, n, seed)

    def list(self, num_variables: int = -1) -> list[str]:
        found = (d for d in self.datasets.values() if num_variables < 0 or d.num_variables == num_variables)
        return [d.name for d in sorted(found, key=lambda d: (d.num_variables, d.name))]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.name, self.version, d.name, d.num_variables, d.tokens, json.dumps([s.to_dict() for s in d.samplers])) for d in self.datasets.values()]
        return spark.createDataFrame(rows, "benchmark string, version string, name string, num_variables int, tokens array<string>, samplers string")

    def to_dict(self) -> dict:
        return {"format_version": 2, "name": self.name, "version": self.version, "datasets": [d.to_dict() for d in self.datasets.values()]}

    @classmethod
    def from_dict(cls, d: dict) -> Benchmark:
        return cls(d["name"], d["version"], [Dataset.from_dict(x) for x in d["datasets"]])

    def save(self, spark: SparkSession, path: str) -> None:
        for d in self.datasets.values():
            d.save(spark, f"{path}/{re.sub(r'[^A-Za-z0-9]+', '_', d.name)}")
        spark.createDataFrame([(json.dumps(self.to_dict()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Benchmark:
        out = cls.from_dict(json.loads(spark.read.text(f"{path}/manifest").first()[0]))
        for d in out.datasets.values():
            d.path = f"{path}/{re.sub(r'[^A-Za-z0-9]+', '_', d.name)}/data"
        return out

    def __iter__(self) -> Iterator[Dataset]:
        return iter(self.datasets.values())

    def __len__(self) -> int:
        return len(self.datasets)


def catalogue(path: str = EQUATIONS) -> dict[str, Benchmark]:
    """The benchmarks of a Markdown table of equations: a heading for each benchmark, then rows of name, line, variables, tokens, samplers."""
    out: dict[str, Benchmark] = {}
    now = None
    with open(path, encoding="utf-8") as f:
        for line in f:
            if m := re.match(r"### (\w+) \(\d+ datasets\)", line):
                now = out.setdefault(m[1], Benchmark(m[1]))
            elif line.startswith("#"):
                now = None
            elif now is not None and (m := re.match(r"\| (.+?) \| \d+ \| (\d+) \| `(.+?)` \| (.+?) \|", line)):
                now.add(Dataset(m[1], m[3].split(), read_samplers(m[4]), int(m[2]), max_evaluations=MAX_EVALUATIONS, threshold=THRESHOLD))
    return out


def check(benchmark: Benchmark) -> list[str]:
    """Names of datasets whose equation can't be read or whose samplers don't match its variables."""
    bad = []
    for d in benchmark:
        try:
            parse(d.tokens, d.library)
        except ValueError:
            bad.append(d.name)
            continue
        if len(d.samplers) != d.num_variables:
            bad.append(d.name)
    return bad


def ground_truth_errors(spark: SparkSession, benchmark: Benchmark, n: int = 1000, seed: int = 1) -> DataFrame:
    """For each dataset the error of its own equation on freshly drawn rows: (name, error, finite rows)."""
    out = None
    for d in benchmark:
        df = d.sample(spark, n, seed)
        y = F.col("y")
        good = ~F.isnan("y") & (F.abs(y) != F.lit(float("inf")))
        value = to_column(d.tokens, d.columns, (), d.library)
        got = df.where(good).agg(F.sqrt(F.avg((value - y) * (value - y))).alias("error"), F.count("*").alias("finite")).select(F.lit(d.name).alias("name"), "error", "finite")
        out = got if out is None else out.union(got)
    return out
