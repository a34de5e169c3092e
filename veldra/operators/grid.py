"""Experiment grids: datasets x approaches x seeds as a table of jobs, minus those done; progress and results from tables."""

from __future__ import annotations

import json
import shlex
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalogue import Dataset
from ..sources.tables import slug
from .evaluator import RESULT
from .search import Approach
from .search import run as search

KEYS = ["dataset", "approach", "seed"]


def jobs(datasets: DataFrame, approaches: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every dataset with every approach and seed; the three tables are one column each, and the result is this product by definition."""
    return datasets.crossJoin(approaches).crossJoin(seeds)


def pending(all_jobs: DataFrame, done: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return all_jobs.join(done.select(*keys).distinct(), keys, "left_anti")


def progress(all_jobs: DataFrame, done: DataFrame, approaches: list[str], keys: list[str] = KEYS) -> DataFrame:
    """One row for each dataset: for each approach the jobs done, as done_<approach>, and the number of jobs, total."""
    d = done.select(*keys).distinct().withColumn("_done", F.lit(1))
    marked = all_jobs.join(d, keys, "left")
    counts = [F.sum(F.when(F.col(keys[1]) == a, F.coalesce("_done", F.lit(0))).otherwise(0)).alias(f"done_{a}") for a in approaches]
    return marked.groupBy(keys[0]).agg(*counts, F.count("*").alias("total"))


@dataclass
class Grid:
    """A grid whose results are a Parquet table under root, partitioned by dataset and approach.

    A job is done when its row is committed, so a torn write is not taken for a result.
    """

    root: str
    datasets: list[Dataset]
    approaches: list[Approach]
    num_experiments: int = 1
    initial_seed: int = 0
    top_k: int = 20
    callbacks: list = field(default_factory=list)

    def __post_init__(self):
        names = [d.name for d in self.datasets]
        if len(set(names)) < len(names):
            raise ValueError("datasets of a grid need different names")

    def jobs(self, spark: SparkSession) -> DataFrame:
        one = lambda values, kind, name: spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
        seeds = range(self.initial_seed, self.initial_seed + self.num_experiments)
        return jobs(one([d.name for d in self.datasets], "string", "dataset"), one([a.name for a in self.approaches], "string", "approach"), one(list(seeds), "int", "seed"))

    def done(self, spark: SparkSession) -> DataFrame:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/results")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.createDataFrame([], RESULT)
        return spark.read.schema(RESULT).parquet(f"{self.root}/results")

    def pending(self, spark: SparkSession) -> DataFrame:
        return pending(self.jobs(spark), self.done(spark))

    def run(self, spark: SparkSession, most: int = -1, dataset: str | None = None, approach: str | None = None, seed: int | None = None) -> int:
        """Runs what is pending, or of that the named jobs; each job's batches run in parallel tasks, so jobs go one after another."""
        datasets, approaches = {d.name: d for d in self.datasets}, {a.name: a for a in self.approaches}
        todo = self.pending(spark).orderBy(*KEYS).collect()
        todo = [j for j in todo if dataset in (None, j["dataset"]) and approach in (None, j["approach"]) and seed in (None, j["seed"])]
        todo = todo[:most] if most >= 0 else todo
        for j in todo:
            if approaches[j["approach"]].scope == "once" and (state := self.state(spark, j["dataset"], j["approach"])) is not None:
                approaches[j["approach"]].restore(state)
            r = search(datasets[j["dataset"]], spark, approaches[j["approach"]], 1, j["seed"] - 1, self.top_k, self.callbacks)[0]
            spark.createDataFrame([r.row()], RESULT).coalesce(1).write.mode("append").partitionBy("dataset", "approach").parquet(f"{self.root}/results")
        return len(todo)

    def adapt(self, spark: SparkSession) -> int:
        """Adapts approaches that do so once, for each dataset without a stored state; the states are JSON beside the results."""
        n = 0
        for d in self.datasets:
            for a in self.approaches:
                if a.scope == "once" and self.state(spark, d.name, a.name) is None:
                    a.adapt(d.load(spark), d.library)
                    spark.createDataFrame([(json.dumps(a.state()),)], "value string").coalesce(1).write.mode("overwrite").text(self._state_path(d.name, a.name))
                    n += 1
        return n

    def _state_path(self, dataset: str, approach: str) -> str:
        return f"{self.root}/states/{slug(dataset)}/{slug(approach)}"

    def state(self, spark: SparkSession, dataset: str, approach: str) -> dict | None:
        path = self._state_path(dataset, approach)
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return json.loads(spark.read.text(path).first()[0]) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None

    def commands(self, spark: SparkSession, launcher: str = "spark-submit") -> list[str]:
        """A shell line for each pending job, to be run anywhere that sees root."""
        return [f"{launcher} -m veldra run --grid {shlex.quote(self.root)} --dataset {shlex.quote(j['dataset'])} --approach {shlex.quote(j['approach'])} --seed {j['seed']}" for j in self.pending(spark).orderBy(*KEYS).collect()]

    def progress(self, spark: SparkSession) -> DataFrame:
        return progress(self.jobs(spark), self.done(spark), [a.name for a in self.approaches])

    def results(self, spark: SparkSession) -> DataFrame:
        return self.done(spark).join(self.jobs(spark), KEYS, "left_semi")

    def save(self, spark: SparkSession) -> None:
        d = {"root": self.root, "datasets": [x.to_dict() for x in self.datasets], "approaches": [a.to_dict() for a in self.approaches], "num_experiments": self.num_experiments, "initial_seed": self.initial_seed, "top_k": self.top_k}
        spark.createDataFrame([(json.dumps(d),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/grid")

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Grid:
        d = json.loads(spark.read.text(f"{root}/grid").first()[0])
        return cls(root, [Dataset.from_dict(x) for x in d["datasets"]], [Approach.from_dict(a) for a in d["approaches"]], d["num_experiments"], d["initial_seed"], d["top_k"])
