"""A store of datasets as Parquet tables by benchmark, version and name, with a check for descriptions that have changed."""

from __future__ import annotations

import hashlib
import json
import re
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def drift_hash(config: dict) -> str:
    """Sixteen hex digits of the description's origin: equation, samplers, seed and number of rows."""
    part = {k: config.get(k) for k in ("tokens", "samplers", "seed", "rows", "ranking")}
    return hashlib.sha256(json.dumps(part, sort_keys=True).encode()).hexdigest()[:16]


def slug(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", text)


def version_key(version: str) -> tuple:
    return tuple((0, int(p)) if p.isdigit() else (-1, p) for p in re.split(r"[._-]", version))


class TableStore:
    """Tables under one root folder of any file system that Spark writes to."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def path(self, benchmark: str, version: str, name: str) -> str:
        return f"{self.root}/{slug(benchmark)}/{slug(version)}/{slug(name)}"

    def _fs(self, spark: SparkSession):
        jvm = spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, root.getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, spark: SparkSession, path: str) -> bool:
        """Whether a table was written to its end."""
        jvm, fs = self._fs(spark)
        return fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/data/_SUCCESS"))

    def resolve(self, spark: SparkSession, benchmark: str, version: str, name: str, make: Callable[[], DataFrame] | None, digest: str = "", force: bool = False) -> DataFrame:
        """The table; made and written where it is missing. A table made from another description is read with a warning."""
        path = self.path(benchmark, version, name)
        if force or not self.exists(spark, path):
            if make is None:
                raise FileNotFoundError(f"{path} isn't in the store and can't be made")
            make().write.mode("overwrite").parquet(f"{path}/data")
            meta = json.dumps({"benchmark": benchmark, "version": version, "name": name, "hash": digest})
            spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        elif digest and self.meta(spark, path)["hash"] != digest:
            warnings.warn(f"{path} was made from another description; refresh it to follow the new one", stacklevel=2)
        return spark.read.parquet(f"{path}/data")

    def meta(self, spark: SparkSession, path: str) -> dict:
        return json.loads(spark.read.text(f"{path}/meta").first()[0])

    def list(self, spark: SparkSession) -> list[dict]:
        jvm, fs = self._fs(spark)
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/*/*/*/data/_SUCCESS"))
        return sorted((self.meta(spark, f.getPath().getParent().getParent().toString()) for f in found or []), key=lambda m: (m["benchmark"], version_key(m["version"]), m["name"]))

    def remove(self, spark: SparkSession, benchmark: str, version: str | None = None, name: str | None = None) -> bool:
        jvm, fs = self._fs(spark)
        parts = [slug(p) for p in (benchmark, version, name) if p is not None]
        return fs.delete(jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts])), True)

    def collect(self, spark: SparkSession, keep_latest: int = 1) -> list[tuple[str, str]]:
        """Removes all but the latest versions of each benchmark; returns what went."""
        versions: dict[str, set[str]] = {}
        for m in self.list(spark):
            versions.setdefault(m["benchmark"], set()).add(m["version"])
        gone = [(b, v) for b, vs in versions.items() for v in sorted(vs, key=version_key)[: max(0, len(vs) - keep_latest)]]
        for b, v in gone:
            self.remove(spark, b, v)
        return gone
