"""Penalised change points (operator 11): PELT over many daily series at once, exact under floors and a least segment length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, partitions

LEAST, PENALTY = 7, 20_000
#: Days of all series that are segmented in one pass of array operations (a longer series is a pass of its own).
TOGETHER = 60_000
SEGMENTS = 1 << 24


def costs(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(V - 1, cost) of segments of n days with sum s and sum of squares q."""
    spread = (n * q - s * s) // (n * n)
    return spread, n * np.floor(1000 * np.log((1 + spread).astype(np.float64))).astype(np.int64)


def loss(n: np.ndarray, spread: np.ndarray, m: np.ndarray) -> np.ndarray:
    """No cut of a segment of at most m days behind its first n, whose V is 1 + spread, makes costs rise by this much.

    Without floors a cut never makes them rise. Let f1, f2 be the spreads of the parts, w = (n f1 + n2 f2) / N their mean over N = n + n2
    days, f that of the whole. ln is concave, so the parts' n ln V is at most N ln(1 + w). The variance of the whole is at least the mean of
    the parts', which is at least w, so f = floor(it) > w - 1 and f >= 0: V is at least max(1, w), and (1 + w) / V at most
    1 + min(1, 1 / w). With w >= n f1 / N the rise of N ln V is at most N ln(1 + min(1, N / (n f1))), and flooring 1000 ln V adds under N. Both
    grow with N, which is at most m. One more covers rounding.
    """
    with np.errstate(divide="ignore"):
        over = np.minimum(1.0, m / (n * spread).astype(np.float64))
    return m * (1000 * np.log1p(over) + 1) + 1


def segmented(series: list[np.ndarray], least: int = LEAST, penalty: int = PENALTY) -> list[tuple[list[int], list[int], list[int], list[int], int]]:
    """Best segments of each series of integers: starts, sums, spreads (V), costs, and the whole cost with penalties.

    Dynamic programme over ends: the best last start for an end is the smallest (cost, number of segments, start) of its candidates. A start joins
    the candidates once a segment from it has the least length. Where its cost up to an end t is over the best of t by more than
    loss(), t is strictly better for every end from t + least on, so the start leaves then: not before, as t itself is no
    candidate before, and never on a tie. All series advance by a day together, their candidates in one array, ordered by series.
    """
    size = np.array([len(x) for x in series])
    flat = np.concatenate(series) if series else np.zeros(0, np.int64)
    top = max(map(abs, (int(flat.max(initial=0)), int(flat.min(initial=0)))))
    if int(size.max(initial=0)) ** 2 * top * top >= 1 << 62:  # beyond 64 bits: Python's integers
        flat = flat.astype(object)
    first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    sums, squares = (np.concatenate([np.concatenate([np.zeros(1, flat.dtype), np.cumsum(x)]) for x in np.split(y, np.cumsum(size)[:-1])]) if len(series) else y for y in (flat, flat * flat))
    best = np.zeros(len(sums), np.int64)
    cuts = np.zeros(len(sums), np.int64)
    back = np.zeros(len(sums), np.int64)
    best[first] = -penalty
    own, start, leaves = (np.zeros(0, np.int64) for _ in range(3))
    live = np.flatnonzero(size >= 2 * least)
    for end in range(least, int(size.max(initial=0)) + 1 if len(live) else 0):
        if (size[live] < end).any():
            live = live[size[live] >= end]
        stay = (leaves > end) & (size[own] >= end)
        if not stay.all():
            own, start, leaves = own[stay], start[stay], leaves[stay]
        new = end - least
        if new == 0 or new >= least:
            at = np.searchsorted(own, live, side="right")
            own, start, leaves = np.insert(own, at, live), np.insert(start, at, new), np.insert(leaves, at, np.iinfo(np.int64).max)
        here, there = first[own] + end, first[own] + start
        n = end - start
        spread, cost = costs(n, sums[here] - sums[there], squares[here] - squares[there])
        reached = best[there] + cost
        key = (reached + penalty) * SEGMENTS + cuts[there] + 1
        edge = np.flatnonzero(np.diff(own, prepend=-1))
        least_key = np.repeat(np.minimum.reduceat(key, edge), np.diff(edge, append=len(own)))
        hit = np.flatnonzero(key == least_key)
        hit = hit[np.diff(own[hit], prepend=-1) != 0]
        to = here[hit]
        best[to], cuts[to], back[to] = reached[hit] + penalty, cuts[there[hit]] + 1, start[hit]
        over = reached - best[here]
        m = size[own] - start
        maybe = np.flatnonzero(over > m)
        if len(maybe):
            gone = maybe[over[maybe] > loss(n[maybe], spread[maybe], m[maybe])]
            leaves[gone] = np.minimum(leaves[gone], end + least)
    out = []
    for k, days in enumerate(size.tolist()):
        starts, end = [], days
        while end:
            starts.append(int(back[first[k] + end]))
            end = starts[-1]
        starts.reverse()
        edges = first[k] + np.array([*starts, days])
        s, q = np.diff(sums[edges]), np.diff(squares[edges])
        spread, cost = costs(np.diff(edges), s, q)
        out.append((starts, s.tolist(), (1 + spread).tolist(), cost.tolist(), int(cost.sum()) + penalty * (len(starts) - 1)))
    return out


def _segments(kind: pa.DataType, least: int, penalty: int):
    """Rows (key, days, totals) of whole series to their segments."""
    names = ["key", "segment_no", "first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost"]

    def told(keys: list, began: list[int], series: list[np.ndarray]) -> pa.RecordBatch:
        rows: list[list] = [[] for _ in names]
        for key, day, x, (starts, sums, spreads, cost, whole) in zip(keys, began, series, segmented(series, least, penalty), strict=True):
            n = len(starts)
            for column, values in zip(rows, ([key] * n, range(1, n + 1), [day + s for s in starts], np.diff([*starts, len(x)]).tolist(), sums, spreads, cost, [n] * n, [whole] * n), strict=True):
                column.extend(values)
        kinds = [kind, pa.int32(), *[pa.int64()] * 7]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pa.compute.list_value_length(batch.column(1)).to_numpy()).tolist()
            days, totals = (batch.column(c).flatten().to_numpy() for c in (1, 2))
            keys, held, began, series, many, lo = batch.column(0).to_pylist(), [], [], [], 0, 0
            for key, hi in zip(keys, ends, strict=True):
                day, total = days[lo:hi], totals[lo:hi]
                x = np.zeros(int(day.max()) - int(day.min()) + 1, np.int64)
                x[day - day.min()] = total
                if many and many + len(x) > TOGETHER:
                    yield told(held, began, series)
                    held, began, series, many = [], [], [], 0
                held.append(key)
                began.append(int(day.min()))
                series.append(x)
                many, lo = many + len(x), hi
            if held:
                yield told(held, began, series)

    return run


def change_points(rows: DataFrame, key_col: str, time_col: str, value_col: str, least: int = LEAST, penalty: int = PENALTY) -> DataFrame:
    """Cuts each key's daily sums of an integer column into segments of least days or more, of least cost in all.

    A series runs from the key's first to its last day with a row; days between without one count 0. The cost of n days with sum S and sum of squares Q is
    n * floor(1000 * ln(V)), V = 1 + floor((n * Q - S * S) / (n * n)); each cut adds penalty. Of equal sums of costs the one with fewest segments
    counts, then the one with the earliest starts, compared from the last segment backwards. A series under 2 * least days is one segment.

    Rows are summed by key and day before anything is gathered, so that a key's share of all rows doesn't matter; what a task then
    holds of a key is one number a day. Rows whose time or value is null are left out; repeated rows all count; rows with a null key are one series. A
    key without rows left has no segment; an empty table gives an empty result. Times lose their time of day, in the
    session's zone where they have one. Extra columns are ignored, whatever their names. A sum of a day beyond 64 bits is Spark's arithmetic error.

    Returns key_col, segment_no (from 1), first_day (since 1970), n_days, total (S), spread (V), cost, n_segments, best_cost.
    """
    src = rows.select(F.col(f"`{key_col}`").alias("key"), F.unix_date(F.col(f"`{time_col}`").cast("date")).alias("day"), F.col(f"`{value_col}`").cast("long").alias("x"))
    daily = src.where("day IS NOT NULL AND x IS NOT NULL").groupBy("key", "day").agg(F.sum("x").alias("x"))
    series = daily.repartition(partitions(rows.sparkSession), "key").groupBy("key").agg(F.collect_list(F.struct("day", "x")).alias("_s")).select("key", "_s.day", "_s.x")
    kind = src.schema["key"].dataType.simpleString()
    arrow = rows.sparkSession.createDataFrame([], src.select("key").schema).toArrow().schema.field(0).type
    shape = f"key {kind}, segment_no int, " + ", ".join(f"{c} long" for c in ("first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost"))
    out = series.mapInArrow(_segments(arrow, least, penalty), shape)
    return out.withColumnRenamed("key", free(out.columns[1:], key_col)[0])


def _oracle(least: int = LEAST, penalty: int = PENALTY) -> str:
    """The dynamic programme without pruning: a step for each end, over all starts."""
    return f"""
WITH RECURSIVE daily AS (SELECT vendor_id, shipped_at::DATE AS day, sum(quantity)::BIGINT AS x FROM sale_lines WHERE flag = 'kept' AND quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL),
span AS (SELECT vendor_id, min(day) AS lo, (max(day) - min(day) + 1)::BIGINT AS n FROM daily GROUP BY ALL),
cell AS (SELECT s.vendor_id, n, lo, k, coalesce(x, 0) AS x FROM (SELECT *, unnest(range(n)) AS k FROM span) s LEFT JOIN daily d ON d.vendor_id IS NOT DISTINCT FROM s.vendor_id AND d.day = s.lo + k::INT),
run AS (SELECT vendor_id, n, lo, k, sum(x) OVER w AS p, sum(x * x) OVER w AS r FROM cell WINDOW w AS (PARTITION BY vendor_id ORDER BY k)),
series AS MATERIALIZED (SELECT vendor_id, any_value(n) AS n, any_value(lo) AS lo, [0::HUGEINT] || list(p::HUGEINT ORDER BY k) AS p, [0::HUGEINT] || list(r::HUGEINT ORDER BY k) AS r FROM run GROUP BY vendor_id),
f(vendor_id, t, best) AS (
  SELECT vendor_id, 0::BIGINT, [[{-penalty}, 0, 0]::BIGINT[]] FROM series
  UNION ALL
  SELECT f.vendor_id, t + 1, best || [list_sort(list_transform(list_filter(range(t + 1), lambda s: s = 0 AND (t + 1 >= {least} OR t + 1 = n) OR s >= {least} AND t + 1 - s >= {least}),
    lambda s: [best[s + 1][1] + {penalty} + (t + 1 - s) * floor(1000 * ln((1 + ((t + 1 - s) * (r[t + 2] - r[s + 1]) - (p[t + 2] - p[s + 1]) * (p[t + 2] - p[s + 1])) // ((t + 1 - s) * (t + 1 - s)))::DOUBLE))::BIGINT,
      best[s + 1][2] + 1, s]::BIGINT[]))[1]]
  FROM f JOIN series s ON f.vendor_id IS NOT DISTINCT FROM s.vendor_id WHERE t < n),
whole AS (SELECT f.vendor_id, n, lo, p, r, best FROM f JOIN series s ON f.vendor_id IS NOT DISTINCT FROM s.vendor_id WHERE t = n),
cut(vendor_id, stop, start, no) AS (
  SELECT vendor_id, n, best[n + 1][3], best[n + 1][2] FROM whole
  UNION ALL
  SELECT c.vendor_id, start, best[start + 1][3], no - 1 FROM cut c JOIN whole w ON c.vendor_id IS NOT DISTINCT FROM w.vendor_id WHERE start > 0),
each AS (SELECT c.vendor_id, no, start, stop - start AS d, lo, best[n + 1] AS b, p[stop + 1] - p[start + 1] AS s, r[stop + 1] - r[start + 1] AS q FROM cut c JOIN whole w ON c.vendor_id IS NOT DISTINCT FROM w.vendor_id),
told AS (SELECT *, (1 + (d * q - s * s) // (d * d))::BIGINT AS v FROM each)
SELECT vendor_id, no::INTEGER AS segment_no, (lo - DATE '1970-01-01')::BIGINT + start AS first_day, d AS n_days, s::BIGINT AS total, v AS spread,
  d * floor(1000 * ln(v::DOUBLE))::BIGINT AS cost, b[2] AS n_segments, b[1] AS best_cost FROM told
"""


ORACLE = _oracle()


def query(spark, sf_dir: str) -> DataFrame:
    kept = spark.read.parquet(f"{sf_dir}/sale_lines.parquet").where("flag = 'kept'")
    return change_points(kept, "vendor_id", "shipped_at", "quantity")
