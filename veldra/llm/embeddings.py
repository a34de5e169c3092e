"""Embedding near-dedup (operator 7): Euclidean p-stable hashing in several tables, sketches in each bucket, exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, groups, members, partitions, session

LEAST = 0.95
#: Chance that all tables miss a pair right at the least cosine; closer pairs are missed less.
MISS = 1e-5
#: Width of a quantisation cell in units of the distance at the least cosine.
CELL = 4.0
#: Vectors that a bucket may hold on average, and rows that meet in one block.
BUCKET, BLOCK = 1024, 1024
SEED = 11


def same_cell(ratio: float) -> float:
    """Chance that a Gaussian projection puts two points into one cell of ratio times their distance."""
    phi = 0.5 * (1 + math.erf(-ratio / math.sqrt(2)))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def shape(n: int, least: float = LEAST, miss: float = MISS) -> tuple[int, int, float]:
    """(projections of a table, tables, cell width): projections grow with log n so that buckets keep their size, tables so that
    the chance of a miss does."""
    reach = math.sqrt(2 - 2 * least)
    near, far = same_cell(CELL), same_cell(CELL * reach / math.sqrt(2))
    k = max(2, math.ceil(math.log(max(1, n / BUCKET)) / -math.log(far)))
    return k, math.ceil(math.log(miss) / math.log(1 - near**k)), CELL * reach


#: Added to the sketches' bounds for rounding in single precision.
ROUNDING = 1e-4


def _codes(k: int, tables: int, cell: float):
    """Rows (v, vector): the cell's code in each table, the unit vector, and a sketch: its parts as 8-bit numbers, their unit and the
    length of what they leave out. Vectors that link with nothing give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            col = batch.column(1)
            flat, ends = col.flatten(), np.cumsum([0, *pa.compute.list_value_length(col).fill_null(0).to_pylist()])
            nulls = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))]) if flat.null_count else None
            parts = flat.fill_null(0).to_numpy().astype(np.float64)
            by: dict[int, list[int]] = {}
            for i, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                if hi > lo and (nulls is None or nulls[lo] == nulls[hi]):
                    by.setdefault(hi - lo, []).append(i)
            for dim, rows in by.items():
                m = parts[ends[rows][:, None] + np.arange(dim)]
                good = np.isfinite(m).all(axis=1) & m.any(axis=1)
                m, rows = m[good], np.array(rows)[good]
                if not len(rows):
                    continue
                if dim not in planes:
                    rng = np.random.default_rng([SEED, dim, k, tables])
                    planes[dim] = rng.standard_normal((dim, k * tables)), rng.uniform(0, cell, k * tables)
                a, b = planes[dim]
                m /= np.abs(m).max(axis=1, keepdims=True)
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                q = np.floor((m @ a + b) / cell).astype(np.int64).reshape(len(rows), tables, k).astype(np.uint64)
                key = np.broadcast_to((np.arange(tables, dtype=np.uint64) + np.uint64(1 + dim * 1009)) * np.uint64(0x9E3779B97F4A7C15), q.shape[:2]).copy()
                for r in range(k):
                    key = (key ^ q[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
                    key ^= key >> np.uint64(31)
                step = (np.abs(m).max(axis=1) / 127).astype(np.float32)
                sketch = np.rint(m / step[:, None].astype(np.float64)).clip(-127, 127).astype(np.int8)
                left = np.linalg.norm(m - sketch * step[:, None].astype(np.float64), axis=1).astype(np.float32)
                codes = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, tables), pa.int32()), pa.array(key.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), codes, pa.array([x.tobytes() for x in m], pa.binary()), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array(step), pa.array(left)], names=["v", "codes", "unit", "sketch", "step", "rest"])

    return run


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each of n rows by the links (x, y), by repeated minima."""
    parent = np.arange(n)
    while True:
        low = parent.copy()
        np.minimum.at(low, x, parent[y])
        np.minimum.at(low, y, parent[x])
        low = low[low]
        if (low == parent).all():
            return parent
        parent = low


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of both blocks of a group, and whether they are one block."""
    block, i, j = t["block"].to_numpy(), t["i"][0].as_py(), t["j"][0].as_py()
    left = np.flatnonzero(block == i)
    return left, left if i == j else np.flatnonzero(block == j), i == j


def _possible(least: float):
    """Rows of one cell's block: a spanning forest of the pairs whose sketches leave it open that their cosine is least or more.

    The cosine differs from that of the sketches by no more than the lengths of what both leave out and their product.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["code", "i", "j"]):
            left, right, same = _sides(t)
            if not len(left) or not len(right) or same and len(left) < 2:
                continue
            v, rest, step, sketch = t["v"].to_numpy(), t["rest"].to_numpy(), t["step"].to_numpy(), t["sketch"].combine_chunks()
            dim = pa.compute.binary_length(sketch).to_numpy()
            most = float(rest.max())
            pairs = []
            for d in np.unique(dim).tolist():  # lengths meet only where codes of theirs chance to be equal
                lo, hi = left[dim[left] == d], right[dim[right] == d]
                read = lambda rows: np.frombuffer(b"".join(sketch.take(pa.array(rows)).to_pylist()), np.int8).reshape(len(rows), -1) * step[rows][:, None]  # noqa: E731, B023
                x, y = np.nonzero(read(lo) @ read(hi).T >= np.float32(least - ROUNDING - 2 * most - most * most)) if len(lo) and len(hi) else (lo[:0], hi[:0])
                if same:
                    x, y = x[x < y], y[x < y]
                pairs.append((lo[x], hi[y]))
            x, y = (np.concatenate(c) for c in zip(*pairs, strict=True))
            if not len(x):
                continue
            parent = _forest(len(v), x, y)
            got = np.flatnonzero(parent != np.arange(len(v)))
            yield pa.RecordBatch.from_arrays([pa.array(v[got]), pa.array(v[parent[got]])], names=["a", "b"])

    return run


def _pairs(least: float):
    """Rows of one family's block: for each vector the weight of its links, and a spanning forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["code", "i", "j"]):
            left, right, same = _sides(t)
            if not len(left) or not len(right):
                continue
            v, weight, dim = t["v"].to_numpy(), t["weight"].to_numpy(), t["dim"].to_numpy()
            for d in np.unique(dim).tolist():  # lengths meet only where codes of theirs chance to be equal
                lo, hi = left[dim[left] == d], right[dim[right] == d]
                if not len(lo) or not len(hi):
                    continue
                unit = t["unit"].combine_chunks()
                read = lambda rows: np.frombuffer(b"".join(unit.take(pa.array(rows)).to_pylist()), np.float64).reshape(len(rows), -1)  # noqa: E731, B023
                close = read(lo) @ read(hi).T >= least
                x, y = np.nonzero(close)
                if same:
                    x, y = x[x < y], y[x < y]
                if not len(x):
                    continue
                x, y = lo[x], hi[y]
                count = np.bincount(x, weight[y], len(v)) + np.bincount(y, weight[x], len(v))
                parent = _forest(len(v), x, y)
                got = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(v[got]), pa.array(count[got].astype(np.int64)), pa.array(v[parent[got]])], names=["v", "n", "to"])

    return run


def _blocks(rows: DataFrame, size: str) -> DataFrame:
    """Rows (code, v, ..) dealt to pairs of blocks (i, j) of about BLOCK rows of their code, so that any two meet once."""
    many = F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(size), F.lit(1)) / BLOCK)).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("v"), many).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), many - 1)))
    return rows.withColumn("i", F.least("block", "k")).withColumn("j", F.greatest("block", "k")).drop("k", size)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, miss: float = MISS) -> DataFrame:
    """Links between vectors of cosine least or more, counted for each vector, and their components.

    Equal vectors are one node of their number of ids. Nodes are hashed to a cell of quantised Gaussian projections in each table. Into the cells
    go sketches (a byte for each part), which tell for certain that most pairs don't link; pairs left open join nodes to families, as spanning forests. In a family
    all cosines are taken in double precision. Cells and families that are too large for a block are compared block by block, so none is cut.
    What travels for a vector is tables * (dim + 24) bytes, and its own 8 * dim bytes once if it has a family of up to BLOCK; a family of s different
    vectors costs s * s / 2 cosines, as its links are counted.

    Null vectors, empty or zero ones and those with null or non-finite components link with nothing; vectors of different lengths
    don't link. A null id is carried, without links and a null component. Rows that repeat an id are one vector if they
    are equal, else vectors of their own. Ties: the component is the smallest id, of any type. Scaled copies link by their cosine. An empty table gives an empty
    result. Extra columns are ignored, whatever their names.

    Returns id_col, n_links, component_id, kept.
    """
    spark = session(vectors)
    work = Workspace(spark, "vectors")
    part = vectors.schema[vector_col].dataType.elementType.simpleString()
    src = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast(f"array<{part if part in ('float', 'double') else 'double'}>").alias("v"))
    src = work.put(src.select("id", F.col("v").alias("vector"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2")), "source")
    node = src.where("id IS NOT NULL AND vector IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.countDistinct("id").alias("weight"))
    node = work.put(node.withColumn("v", F.monotonically_increasing_id()), "groups")  # a node is a vector, numbered when it is written
    k, tables, cell = shape(node.count(), least, miss)
    own = src.join(node.select("id", "h1", "h2", "v"), ["id", "h1", "h2"]).dropDuplicates(["id", "h1", "h2"]).select("v", "vector")
    hashed = work.put(own.mapInArrow(_codes(k, tables, cell), "v long, codes array<long>, unit binary, sketch binary, step float, rest float"), "hashed")
    keys = ["code", "i", "j"]
    each = hashed.select("v", "sketch", "step", "rest", F.explode("codes").alias("code"))
    large = hashed.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    dealt = _blocks(each.join(work.put(large, "large"), "code", "left"), "size").repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "v")
    open_ = work.put(dealt.select(*keys, "v", "block", "sketch", "step", "rest").mapInArrow(_possible(least), "a long, b long").distinct(), "open")
    family = work.put(components(work.part("cc-open"), open_).select(F.col("node").alias("v"), F.col("component").alias("code")), "families")
    sizes = family.groupBy("code").agg(F.count("*").alias("size"))
    full = family.join(sizes, "code").join(hashed.select("v", "unit", F.length("unit").alias("dim")), "v").join(node.select("v", "weight"), "v")
    full = _blocks(full, "size").repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "v")
    found = work.put(full.select(*keys, "v", "block", "weight", "dim", "unit").mapInArrow(_pairs(least), "v long, n long, to long"), "found")
    counts = found.groupBy("v").agg(F.sum("n").alias("n"))
    comp = work.put(components(work.part("cc"), found.select(F.col("v").alias("a"), F.col("to").alias("b"))), "components")
    label = members(work, comp, node, "v", "id").join(counts, "v", "left").join(hashed.select("v", F.lit(True).alias("good")), "v", "left")
    n = F.when(F.col("good"), F.coalesce("n", F.lit(0)) + F.col("weight") - 1)
    out = src.select("id", "h1", "h2").join(label.select("h1", "h2", n.alias("n"), F.when(F.col("good"), F.col("component")).alias("component")), ["h1", "h2"], "left")
    mine = F.col("id").isNotNull()
    out = out.select("id", F.when(mine, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n"), F.when(mine, F.coalesce("component", "id")).alias("component"))
    out = work.put(out.select(F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")), "result")
    work.drop_all_but("result")
    return work.last(out)


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS r FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.r * b.r) >= {LEAST}),
reach(node, other) AS (SELECT a, b FROM l UNION SELECT r.node, l.b FROM reach r JOIN l ON r.other = l.a),
m AS (SELECT node, least(node, min(other)) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.node = vec_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
