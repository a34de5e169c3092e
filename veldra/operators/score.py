"""Scores of expressions over DataFrames: error, determination, distribution distances and behaviour."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.symbols import SymbolLibrary
from ..functions.tree import Node, as_tree, constants as count_constants, key_of
from ..plans.compile import bindings, hoisted, to_column
from ..plans.shared import Graph
from ..sources.folders import written

#: Candidates that one pass over the data scores together.
BATCH = 2000


def error_column(value: Column, target: Column) -> Column:
    """Root of the mean squared difference; one NaN makes it NaN."""
    d = value - target
    return F.sqrt(F.avg(d * d))


def rmse(df: DataFrame, expr: Node | list[str], columns: Sequence[str] | dict, target: str, constants: Sequence[float] = (), library: SymbolLibrary | None = None) -> DataFrame:
    """One row: rmse. A projection and a partial mean in one code-generated stage."""
    return df.agg(error_column(to_column(expr, columns, constants, library), F.col(target).cast("double")).alias("rmse"))


def r2_column(value: Column, target: Column) -> Column:
    """max(0, 1 - residual / total sum of squares); NaN gives 0. The total comes from the variance, so one pass does."""
    d = value - target
    raw = 1 - F.try_divide(F.sum(d * d), F.var_pop(target) * F.count(target))
    return F.when(F.isnan(raw) | raw.isNull() | (raw < 0), F.lit(0.0)).otherwise(raw)


def r2(df: DataFrame, expr: Node | list[str], columns: Sequence[str] | dict, target: str, constants: Sequence[float] = (), library: SymbolLibrary | None = None) -> DataFrame:
    """One row: r2."""
    return df.agg(r2_column(to_column(expr, columns, constants, library), F.col(target).cast("double")).alias("r2"))


def score_columns(df: DataFrame, candidates: dict[str, Node | list[str]], columns: Sequence[str] | dict, target: str, library: SymbolLibrary | None = None) -> DataFrame:
    """Few fixed candidates without constants as columns of one aggregate: (expr_key, error)."""
    y = F.col(target).cast("double")
    aggs = [error_column(to_column(e, columns, (), library), y).alias(f"e{k}") for k, e in enumerate(candidates.values())]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("expr_key"), F.col(f"e{k}").alias("error")) for k, n in enumerate(candidates)]))
    return df.agg(*aggs).select(rows.alias("r")).select("r.*")


def score_constants(df: DataFrame, expr: Node | list[str], columns: Sequence[str] | dict, target: str, constants: DataFrame, library: SymbolLibrary | None = None) -> DataFrame:
    """One shape with many constant vectors (sample_id, c): (sample_id, error).

    Constant-free parts are computed before the fan-out. The constants are the small side: they are read to the driver in batches
    of BATCH and stand in the plan as a literal array that each row explodes.
    """
    out = None
    rows = [(r["sample_id"], list(r["c"])) for r in constants.select("sample_id", "c").toLocalIterator()]
    for k in range(0, len(rows), BATCH):
        part = rows[k : k + BATCH]
        table = F.array(*[F.struct(F.lit(i).alias("sample_id"), F.array(*[F.lit(float(x)) for x in c]).cast("array<double>").alias("c")) for i, c in part])
        with_parts, value = hoisted(df.withColumn("_y", F.col(target).cast("double")), expr, columns, F.col("_k.c"), library)
        got = with_parts.withColumn("_k", F.explode(table)).groupBy(F.col("_k.sample_id").alias("sample_id")).agg(error_column(value, F.col("_y")).alias("error"))
        out = got if out is None else out.union(got)
    return out if out is not None else df.sparkSession.createDataFrame([], "sample_id long, error double")


def _partial_errors(keys: list[str], graph: Graph, n_columns: int):
    """For each candidate the sum of squared differences over a partition; rows are taken batch by batch, shared parts computed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(len(keys)), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(n_columns + 1)])
            n += len(m)
            sums += graph.squared_errors(m[:, :-1], m[:, -1])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums), pa.array([n] * len(keys), pa.int64())], names=["expr_key", "sum_sq", "n"])

    return run


def score_many(df: DataFrame, candidates: list[tuple[str, Node | list[str], Sequence[float]]], columns: Sequence[str] | dict, target: str, library: SymbolLibrary | None = None) -> DataFrame:
    """Many candidates of any shape, (key, expression, constants): (expr_key, error).

    The data stay where they are: every partition runs a batch of candidates, as one graph in which equal parts are one node, over its rows
    and gives one partial sum for each, and sums of these are the result. Candidates, not data, are sent out.
    """
    library = SymbolLibrary.or_default(library)
    names = bindings(library, columns)
    used = [names[v] for v in library.variables if v in names]
    data = df.select(*[F.col(f"`{c}`").cast("double") for c in used], F.col(f"`{target}`").cast("double").alias("_y"))
    out = None
    for k in range(0, len(candidates), BATCH):
        part = candidates[k : k + BATCH]
        graph = Graph([(e, c) for _, e, c in part], library)
        got = data.mapInArrow(_partial_errors([key for key, _, _ in part], graph, len(used)), "expr_key string, sum_sq double, n long").groupBy("expr_key").agg(F.sqrt(F.sum("sum_sq") / F.sum("n")).alias("error"))
        out = got if out is None else out.union(got)
    return out if out is not None else df.sparkSession.createDataFrame([], "expr_key string, error double")


# distributions


def wasserstein(u: Column, v: Column) -> Column:
    """First Wasserstein distance of two arrays of numbers without NaN; NULL if one is empty.

    Of equal sizes: the mean difference of the sorted values. Else the area between the two distribution functions, by one
    walk over the sorted union.
    """
    a, b = F.array_sort(u), F.array_sort(v)
    even = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(u)
    step = lambda c, sign: F.transform(c, lambda x: F.struct(x.alias("x"), (F.lit(sign) / F.size(c)).alias("d")))
    union = F.array_sort(F.concat(step(u, 1.0), step(v, -1.0)))
    start = F.struct(F.lit(None).cast("double").alias("x"), F.lit(0.0).alias("gap"), F.lit(0.0).alias("area"))
    walk = F.aggregate(union, start, lambda s, p: F.struct(p["x"].alias("x"), (s["gap"] + p["d"]).alias("gap"), (s["area"] + F.coalesce(F.abs(s["gap"]) * (p["x"] - s["x"]), F.lit(0.0))).alias("area")), lambda s: s["area"])
    return F.when((F.size(u) == 0) | (F.size(v) == 0), F.lit(None).cast("double")).when(F.size(u) == F.size(v), even).otherwise(walk)


def wasserstein_arrays(u: np.ndarray, v: np.ndarray) -> float:
    """The same on numpy arrays."""
    u, v = np.sort(np.asarray(u, float)), np.sort(np.asarray(v, float))
    at = np.sort(np.concatenate([u, v]))
    gap = np.searchsorted(u, at[:-1], "right") / len(u) - np.searchsorted(v, at[:-1], "right") / len(v)
    return float(np.sum(np.abs(gap) * np.diff(at)))


def wasserstein_columns(df: DataFrame, a: Column | str, b: Column | str) -> DataFrame:
    """One row, w1: the first Wasserstein distance of two whole columns, the area between their distribution functions.

    Equal values are counted first. The distinct ones are dealt to ranges and written; a range's totals tell where its part of both
    functions begins, so that each range is summed by itself. The driver holds a row for each range. Counts are whole
    numbers up to the last division. Nulls, NaN and infinite values are left out; w1 is NULL if a column has no value left.
    """
    as_column = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    values = F.explode(F.array(F.struct(as_column(a).alias("x"), F.lit(1).alias("u"), F.lit(0).alias("v")), F.struct(as_column(b).alias("x"), F.lit(0).alias("u"), F.lit(1).alias("v"))))
    each = df.select(values.alias("e")).select("e.*").where(F.abs("x") < F.lit(math.inf))
    spark = df.sparkSession
    each = each.select((F.col("x") + 0.0).alias("x"), "u", "v").groupBy("x").agg(F.sum("u").alias("u"), F.sum("v").alias("v"))  # -0.0 is 0.0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(each.repartitionByRange(parts, "x").withColumn("part", F.spark_partition_id()), "w1")
    ranges = sorted(map(tuple, dealt.groupBy("part").agg(F.sum("u"), F.sum("v"), F.min("x")).collect()))
    n_u, n_v = sum(r[1] for r in ranges), sum(r[2] for r in ranges)
    if not n_u or not n_v:
        return spark.range(1).select(F.lit(None).cast("double").alias("w1"))
    starts, u, v = [], 0, 0
    for k, (part, du, dv, _) in enumerate(ranges):
        starts.append((part, u, v, ranges[k + 1][3] if k + 1 < len(ranges) else None))
        u, v = u + du, v + dv
    of = F.broadcast(spark.createDataFrame(starts, "part int, u0 long, v0 long, next double"))  # a row for each range
    w = Window.partitionBy("part").orderBy("x")
    exact = lambda c, n: F.col(c).cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)")
    steps = dealt.join(of, "part").select("x", F.coalesce(F.lead("x").over(w), "next").alias("to"), (F.sum("u").over(w) + F.col("u0")).alias("u"), (F.sum("v").over(w) + F.col("v0")).alias("v"))
    gap = F.abs(exact("u", n_v) - exact("v", n_u)).cast("double")
    return steps.agg((F.coalesce(F.sum(gap * (F.col("to") - F.col("x"))), F.lit(0.0)) / (float(n_u) * float(n_v))).alias("w1"))


def latin_hypercube(n: int, bounds: Sequence[tuple[float, float]], seed: int | None = None, spread: bool = False) -> np.ndarray:
    """n points, one in each of n equal slices of every dimension. spread: the best of several draws by centred discrepancy."""
    rng = np.random.default_rng(seed)
    if not bounds:
        return np.zeros((n, 0))
    lo, hi = np.array(bounds, float).T
    if (lo >= hi).any():
        raise ValueError("every lower bound must be below its upper bound")

    def draw() -> np.ndarray:
        return np.column_stack([(rng.permutation(n) + rng.random(n)) / n for _ in bounds])

    best = min((draw() for _ in range(16)), key=_discrepancy) if spread else draw()
    return lo + best * (hi - lo)


def _discrepancy(x: np.ndarray) -> float:
    """Centred L2 discrepancy (Hickernell, 1998)."""
    n, d = x.shape
    z = np.abs(x - 0.5)
    one = np.sum(np.prod(1 + 0.5 * z - 0.5 * z * z, axis=1))
    pairs = sum(np.sum(np.prod(1 + 0.5 * z[i] + 0.5 * z - 0.5 * np.abs(x[i] - x), axis=1)) for i in range(n))
    return (13 / 12) ** d - 2 / n * one + pairs / n**2


def behaviour(points: DataFrame, expr: Node | list[str], columns: Sequence[str] | dict, samples: Sequence[Sequence[float]], name: str = "values", library: SymbolLibrary | None = None) -> DataFrame:
    """points with an array of the expression's values, one for each constant vector, as one projection: no join, no shuffle.

    An expression without constants repeats its one value.
    """
    library = SymbolLibrary.or_default(library)
    tree = as_tree(expr, library)
    if not count_constants(tree, library):
        return points.withColumn(name, F.array_repeat(to_column(tree, columns, (), library), len(samples)))
    parts, value = hoisted(points, tree, columns, F.col("_c"), library)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in samples])
    # the constants of an element are its own array, so the expression is built over a lambda variable
    names = bindings(library, columns)
    given = {id(p): F.col(f"_part{k}") for k, p in enumerate(_parts(tree, library))}
    return parts.withColumn(name, F.transform(table, lambda c: to_column(tree, names, c, library, given))).select(*points.columns, name)


def _parts(tree: Node, library: SymbolLibrary) -> list[Node]:
    from ..plans.compile import hoistable

    return hoistable(tree, library)


def behaviour_distance(a: DataFrame, b: DataFrame, on: str = "point_id", values: str = "values") -> DataFrame:
    """One row, bed: the mean row-wise Wasserstein distance of two behaviours.

    inf if at some point only one side has a finite value, or if an infinite value stands beside finite ones; NaN are left out
    row by row; points without a finite value on both sides count as 0. NULL without points.
    """
    x, y = a.select(on, F.col(values).cast("array<double>").alias("u")), b.select(on, F.col(values).cast("array<double>").alias("v"))
    return _distance(x.join(y, on))


def _distance(joined: DataFrame) -> DataFrame:
    finite = lambda c: F.exists(c, lambda e: ~F.isnan(e) & (F.abs(e) != F.lit(math.inf)))
    infinite = lambda c: F.exists(c, lambda e: F.abs(e) == F.lit(math.inf))
    clean = lambda c: F.filter(c, lambda e: ~F.isnan(e))
    rows = joined.select(finite("u").alias("fu"), finite("v").alias("fv"), (infinite("u") | infinite("v")).alias("inf"), F.col("u"), F.col("v"))
    active = F.col("fu") & F.col("fv")
    rows = rows.select((F.col("fu") != F.col("fv")).alias("mismatch"), (active & F.col("inf")).alias("infinite"), F.when(active & ~F.col("inf"), wasserstein(clean("u"), clean("v"))).otherwise(0.0).alias("w"))
    return rows.agg(F.when(F.bool_or("mismatch") | F.bool_or("infinite"), F.lit(math.inf)).otherwise(F.sum("w") / F.count("*")).alias("bed"))


def behaviour_distance_of(points: DataFrame, a: Node | list[str], b: Node | list[str], columns: Sequence[str] | dict, samples_a, samples_b=None, library: SymbolLibrary | None = None) -> DataFrame:
    """behaviour_distance of two expressions at the same points: both behaviours in one projection, so nothing is joined."""
    both = behaviour(points, a, columns, samples_a, "u", library)
    both = behaviour(both, b, columns, samples_a if samples_b is None else samples_b, "v", library)
    return _distance(both.select("u", "v"))


def keyed(expr: Node | list[str], library: SymbolLibrary) -> str:
    return key_of(expr, library)
