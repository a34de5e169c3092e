"""Shared helpers: written intermediate tables, group streaming over Arrow batches, connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this subpackage: runs of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where that is unset on one machine.

    On a cluster a local folder would spread a table over machines, so there it is an error that none is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="veldra-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Workspace:
    """Written intermediate tables of one operator run, under the shared folder.

    A written table cuts lineage: a lost executor costs the tasks it ran, never the steps before.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/veldra-{tag}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        gc.collect()
        self.spark._jvm.System.gc()  # Spark deletes the shuffle files of plans that nothing refers to any more
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def part(self, name: str) -> Workspace:
        """A workspace inside this one."""
        out = Workspace.__new__(Workspace)
        out.spark, out.root = self.spark, self.path(name)
        return out

    def _place(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, name: str) -> None:
        """Deletes a table that no later plan reads."""
        at, fs = self._place(self.path(name))
        fs.delete(at, True)

    def drop_all_but(self, *names: str) -> None:
        """Deletes what no later plan reads: everything but the named tables."""
        root, fs = self._place(self.root)
        for status in fs.listStatus(root):
            if status.getPath().getName() not in names:
                fs.delete(status.getPath(), True)


    def close(self) -> None:
        """Deletes everything of this run."""
        root, fs = self._place(self.root)
        fs.delete(root, True)

    def last(self, out: DataFrame, *done: str) -> DataFrame:
        """out, whose plan still reads tables of this run: those in done go now, all others when the session ends."""
        for name in done:
            self.drop(name)
        self._place(self.root)[1].deleteOnExit(self._place(self.root)[0])
        return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches that are sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys), strict=True))
        start = 0
        for i, key in enumerate(rows):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def texts(column: pa.Array) -> Iterator[str]:
    """The strings of a column one by one; null reads as the empty text."""
    for x in column:
        yield x.as_py() or ""


def free(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that a table has already (in any case of letters)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def kept(key: tuple, make: Callable):
    """make()'s value, kept in this Python worker between its tasks; for caches that hold no result of their own."""
    home = sys.modules.setdefault("_veldra_kept", types.ModuleType("_veldra_kept"))
    held = vars(home)
    if repr(key) not in held:
        held[repr(key)] = make()
    return held[repr(key)]


def kept_last(name: str, key: int, make: Callable):
    """Like kept(), but a new key takes the place of the name's last value."""
    home = kept(("last", name), dict)
    if key not in home:
        home.clear()
        home[key] = make()
    return home[key]


def trimmed(run: Callable) -> Callable:
    """run, which gives memory that its Python worker holds free back to the system when a task begins and ends: a worker stays between tasks, beside others and the executor's JVM."""

    def trim() -> None:
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    @functools.wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        yield from run(batches)
        gc.collect()
        trim()

    return tidy


#: A node with more than this part of a partition's mean number of edges is joined by broadcast.
HUB = 0.25


def _lowest(edges: DataFrame, rows: int) -> DataFrame:
    """edges (a, b) with m, the smallest b of each a.

    A hub has more than HUB times a partition's mean number of rows, so there are at most partitions / HUB hubs: few enough to go to every task,
    where their edges are met without a shuffle.
    """
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    least = max(16.0, HUB * rows / partitions(edges.sparkSession))
    hubs = F.broadcast(low.where(F.col("n") > least).select("a", "m"))
    rest = edges.join(F.broadcast(low.where(F.col("n") > least).select("a")), "a", "left_anti").join(low.select("a", "m"), "a")
    return edges.join(hubs, "a").select("a", "b", "m").union(rest.select("a", "b", "m"))


def components(work: Workspace, edges: DataFrame, most: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star.

    edges has the columns a and b (long, never null). Returns node and component (the smallest node reachable) for
    every node that has an edge to another. No adjacency list is ever gathered: each star takes a
    partially aggregated minimum per node and joins it back, hubs by broadcast of their minima, so no key's edges meet in one task.
    Every round is a written table; stops when a round changes nothing.
    """
    now = work.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc0")
    seen, rows = None, now.count()
    for k in range(1, most if rows else 1):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # a star's centre is the smaller of its node and that node's smallest neighbour
        large = _lowest(both, 2 * rows).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        large = work.put(large, f"large{k}")
        found = _lowest(large, rows)
        small = found.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(found.select("a", F.col("m").alias("b")))
        new = work.put(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"cc{k}")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        work.drop(f"cc{k - 1}")
        work.drop(f"large{k}")
        now, rows = new, state[0]
        if state == seen:
            break
        seen = state
    else:
        if rows:
            raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def members(work: Workspace, found: DataFrame, nodes: DataFrame, node: str, label: str) -> DataFrame:
    """nodes with the column component: the smallest label of all nodes that components() found together (else the node's own)."""
    each = nodes.join(found.withColumnRenamed("node", node), node, "left").withColumn("_root", F.coalesce("component", node)).drop("component")
    lowest = each.where(F.col("_root").isNotNull()).groupBy("_root").agg(F.min(label).alias("component"))
    return each.join(lowest, "_root").drop("_root")
