"""Centroid clustering (operator 13): exact rounds over ball trees that are local to a piece of the table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, free, session

DIM, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Numbers that a tree holds (so a row of the table of trees has a bounded size), and vectors of a leaf.
TREE, LEAF = 1 << 18, 16


def largest(dim: int) -> int:
    """Components up to here, in size, have squared distances below 2^62."""
    return int((2.0**62 / dim) ** 0.5 / 2)


def whole_numbers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column with exactly dim components, none null or non-finite, and their floor(scale * x).

    A component whose product doesn't fit is an arithmetic error, as in Spark's own casts.
    """
    size = pa.compute.list_value_length(column).fill_null(0).to_numpy()
    ends = np.cumsum(size)
    flat = column.flatten()
    missing = flat.is_null().to_numpy(zero_copy_only=False)
    x = flat.fill_null(0).to_numpy().astype(np.float64)
    rows = np.flatnonzero(size == dim)
    at = (ends[rows] - dim)[:, None] + np.arange(dim)
    good = np.isfinite(x[at]).all(axis=1) & ~missing[at].any(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * x[at[good]])
    if np.abs(scaled).max(initial=0) > largest(dim):
        raise ArithmeticError(f"a component times {scale} is beyond {largest(dim)}: squared distances would not fit into 64 bits")
    return rows[good], scaled.astype(np.int64)


class Tree:
    """A ball tree: points in an order in which every node is a stretch, with the nodes' pivots, radii, counts and integer sums.

    Nodes stand in order of depth, both children of one side by side. A pivot is the rounded mean of the node's points, a radius the
    square root of the largest squared distance of a point to it, which is an integer, so both are exact.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        lo, hi, child = [0], [len(points)], []
        for k in range(1 << 62):
            if k == len(lo):
                break
            a, b = lo[k], hi[k]
            child.append(-1)
            if b - a <= leaf:
                continue
            own = points[order[a:b]]
            far = own[np.argmax(((own - own[0]) ** 2).sum(axis=1))]
            other = own[np.argmax(((own - far) ** 2).sum(axis=1))]
            if (far == other).all():
                continue  # all points are equal
            side = own.astype(np.float64) @ (far - other).astype(np.float64)
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(side, half)]
            child[k] = len(lo)
            lo += [a, a + half]
            hi += [a + half, b]
        self.order, self.points = order, points[order]
        self.lo, self.hi, self.child = (np.array(x, np.int64) for x in (lo, hi, child))
        before = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, axis=0)])
        self.sums = before[self.hi] - before[self.lo]
        self.pivot = (2 * self.sums + (self.hi - self.lo)[:, None]) // (2 * (self.hi - self.lo))[:, None]
        self.reach = np.array([((self.points[a:b] - p) ** 2).sum(axis=1).max() for a, b, p in zip(self.lo, self.hi, self.pivot, strict=True)], np.int64)

    def packed(self) -> dict[str, bytes]:
        return {k: getattr(self, k).tobytes() for k in FIELDS}

    @classmethod
    def unpacked(cls, row: dict[str, bytes], dim: int) -> Tree:
        out = cls.__new__(cls)
        for k in FIELDS:
            x = np.frombuffer(row[k], np.int64)
            setattr(out, k, x.reshape(-1, dim) if k in ("points", "sums", "pivot") else x)
        return out

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(cluster of each point, counts and integer sums of the clusters, number of points whose ball went whole).

        A centroid leaves a ball's candidates where its distance to the pivot less the radius is over that of the nearest plus the
        radius: no point of the ball can be as near to it. A ball with one candidate left goes whole, by its count and sum; the leaves
        that remain compare every point with the candidates in integers, the smaller number first on ties.
        """
        k = len(centroids)
        cluster = np.zeros(len(self.points), np.int64)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, self.points.shape[1]), np.int64)
        nodes, may, whole = np.array([0]), np.ones((1, k), bool), 0
        while len(nodes):
            far = np.sqrt(np.stack([((self.pivot[nodes] - c) ** 2).sum(axis=1) for c in centroids], axis=1).astype(np.float64))
            nearest = np.where(may, far, np.inf).min(axis=1)
            radius = np.sqrt(self.reach[nodes].astype(np.float64))
            # a margin above the rounding of the roots keeps a ball open rather than lose a tie
            may = may & (far <= (nearest + 2 * radius)[:, None] * (1 + 1e-12) + 1e-6)
            one = may.sum(axis=1) == 1
            to = may.argmax(axis=1)
            for node, c in zip(nodes[one].tolist(), to[one].tolist(), strict=True):
                cluster[self.lo[node] : self.hi[node]] = c
            np.add.at(counts, to[one], self.hi[nodes[one]] - self.lo[nodes[one]])
            np.add.at(sums, to[one], self.sums[nodes[one]])
            whole += int((self.hi[nodes[one]] - self.lo[nodes[one]]).sum())
            leaf = ~one & (self.child[nodes] < 0)
            for node, some in zip(nodes[leaf].tolist(), may[leaf], strict=True):
                a, b = self.lo[node], self.hi[node]
                left = np.flatnonzero(some)
                near = np.stack([((self.points[a:b] - centroids[c]) ** 2).sum(axis=1) for c in left], axis=1)
                got = left[near.argmin(axis=1)]
                cluster[a:b] = got
                np.add.at(counts, got, 1)
                np.add.at(sums, got, self.points[a:b])
            down = ~one & ~leaf
            nodes, may = np.stack([self.child[nodes[down]], self.child[nodes[down]] + 1], axis=1).ravel(), np.repeat(may[down], 2, axis=0)
        return cluster, counts, sums, whole


FIELDS = ("points", "lo", "hi", "child", "sums", "pivot", "reach")


def _trees(dim: int, scale: int):
    """Rows (id, vector) to trees of as many vectors as TREE numbers hold, with the ids in the tree's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, TREE // dim)
        ids: list[pa.Array] = []
        held: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            tree = Tree(np.concatenate(held))
            own = pa.concat_arrays(ids).take(pa.array(tree.order))
            packed = tree.packed()
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), *(pa.array([packed[k]], pa.binary()) for k in FIELDS)], names=["ids", *FIELDS])

        for batch in batches:
            rows, x = whole_numbers(batch.column(1), dim, scale)
            own = batch.column(0).take(pa.array(rows))
            for a in range(0, len(rows), most):
                ids.append(own[a : a + most])
                held.append(x[a : a + most])
                if sum(map(len, held)) >= most:
                    yield told()
                    ids.clear()
                    held.clear()
        if held:
            yield told()

    return run


def _unpacked(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].values, Tree.unpacked({k: batch.column(batch.schema.get_field_index(k))[i].as_py() for k in FIELDS}, dim)


def _totals(centroids: np.ndarray):
    """Counts and sums of the clusters over the trees of a task: a row for each cluster that has a point and each component; component -1 is the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        names = ["cluster", "component", "x"]

        def told() -> pa.RecordBatch:
            got = np.flatnonzero(counts)
            x = np.concatenate([counts[got, None], sums[got]], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(got, dim + 1), pa.int32()), pa.array(np.tile(np.arange(-1, dim), len(got)), pa.int32()), pa.array(x.ravel(), pa.int64())], names=names)

        for _, tree in _unpacked(batches, dim):
            _, n, s, _ = tree.assigned(centroids)
            if max(np.abs(sums).max(initial=0), np.abs(s).max(initial=0)) >= 1 << 61:
                yield told()
                counts, sums = np.zeros_like(counts), np.zeros_like(sums)
            counts, sums = counts + n, sums + s
        yield told()

    return run


def _final(centroids: np.ndarray, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _unpacked(batches, centroids.shape[1]):
            cluster = tree.assigned(centroids)[0]
            distance = ((tree.points - centroids[cluster]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids.cast(kind), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])

    return run


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of the exact means; one without vectors stays.

    The driver gets a number for each centroid and component, whatever the size of the table.
    """
    parts = trees.mapInArrow(_totals(centroids), "cluster int, component int, x long")
    rows = parts.groupBy("cluster", "component").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    found = {(r["cluster"], r["component"]): int(r["x"]) for r in rows}
    out = centroids.copy()
    for c, j in found:
        if j >= 0:
            out[c, j] = found[c, j] // found[c, -1]
    return out


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "1") -> DataFrame:
    """Assigns vectors, as integers floor(scale * x), to the nearest of k centroids after a number of exact rounds.

    The centroids start as the k vectors of smallest sha256 of `seed:id`. A round gives every vector to its nearest centroid (squared distance in integers;
    ties: the smaller number) and moves each centroid that has vectors to the floor of their mean. Each piece of the table becomes a
    ball tree once, in a written table of rows of bounded size; rounds read the trees, give whole balls to a centroid where the triangle
    inequality allows it, and send a number for each centroid and component.

    Vectors that are null, have another length than dim or hold null or non-finite components are left out; a component
    times scale beyond 2^31 / sqrt(dim) is an arithmetic error. A null id takes part, but is the last to be a seed. Repeated rows
    all count; ids that repeat with other vectors are vectors of their own, the smaller vector first among seeds. Fewer than k vectors are as many
    centroids. An empty table gives an empty result. Extra columns are ignored, whatever their names.

    Returns id_col, cluster, distance (squared), cluster_inertia, inertia (decimals of 38 digits), centroid_sha256 of its centroid's components, joined by commas.
    """
    spark = session(vectors)
    work = Workspace(spark, "clusters")
    part = vectors.schema[vector_col].dataType.elementType.simpleString()
    src = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast(f"array<{part if part in ('float', 'double') else 'double'}>").alias("v"))
    kind = src.schema["id"].dataType.simpleString()
    trees = work.put(src.mapInArrow(_trees(dim, scale), f"ids array<{kind}>, " + ", ".join(f"{c} binary" for c in FIELDS)), "trees")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * scale))
    first = src.where((F.size("v") == dim) & finite).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), whole.alias("v"))
    starts = first.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    out_names = [*free(["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"], id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not starts:
        work.close()
        none = spark.createDataFrame([], f"id {kind}, cluster int, distance long, ci decimal(38,0), i decimal(38,0), s string")
        return none.toDF(*out_names)
    centroids = np.array([r["v"] for r in starts], np.int64)
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    arrow = trees.select("ids").limit(0).toArrow().schema.field(0).type.value_type
    done = work.put(trees.mapInArrow(_final(centroids, arrow), f"id {kind}, cluster int, distance long"), "assigned")
    work.drop("trees")
    each = {r["cluster"]: int(r["d"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row for each centroid
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = spark.createDataFrame([(c, str(d), str(sum(each.values())), hashes[c]) for c, d in each.items()], "cluster int, ci string, i string, s string")
    of = of.select("cluster", F.col("ci").cast("decimal(38,0)").alias("ci"), F.col("i").cast("decimal(38,0)").alias("i"), "s")
    return work.last(done.join(F.broadcast(of), "cluster").select("id", "cluster", "distance", "ci", "i", "s").toDF(*out_names))


def _oracle(dim: int = DIM, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "1") -> str:
    """Every vector against every centroid, a few named steps for each round."""
    near = """SELECT vec_id, v, struct_extract(b, 'd') AS d, struct_extract(b, 'c') AS c FROM
  (SELECT e.vec_id, e.v, min({{'d': list_sum(list_transform(list_zip(e.v, s.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': s.c}}) AS b FROM e CROSS JOIN s{r} s GROUP BY ALL)"""
    steps = "".join(
        f"""
a{r} AS MATERIALIZED ({near.format(r=r)}),
m{r} AS (SELECT c, list(m ORDER BY i) AS v FROM (SELECT c, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c),
s{r + 1} AS MATERIALIZED (SELECT s{r}.c, coalesce(m{r}.v, s{r}.v) AS v FROM s{r} LEFT JOIN m{r} ON s{r}.c = m{r}.c),"""
        for r in range(rounds)
    )
    return f"""
WITH e AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS c, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM e ORDER BY h, v LIMIT {k})),{steps}
a AS MATERIALIZED ({near.format(r=rounds)})
SELECT vec_id, a.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(s.v, ',')) AS centroid_sha256 FROM a JOIN s{rounds} s ON a.c = s.c
"""


ORACLE = _oracle()


def query(spark, sf_dir: str) -> DataFrame:
    out = clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "cluster", "distance", F.col("cluster_inertia").cast("long").alias("cluster_inertia"), F.col("inertia").cast("long").alias("inertia"), "centroid_sha256")
