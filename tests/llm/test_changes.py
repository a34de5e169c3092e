import datetime
import math
import random

import duckdb
import numpy as np
import pytest

from veldra.llm import changes


def brute(x, least, penalty):
    """All candidates for every end, as tuples that compare like the contract: cost, segments, starts from the last backwards."""
    n = len(x)
    best = {0: (-penalty, 0, ())}
    for t in range(1, n + 1):
        found = []
        for s in best:
            if t - s >= least or (s == 0 and t == n):
                d, a, b = t - s, sum(x[s:t]), sum(y * y for y in x[s:t])
                cost = d * math.floor(1000 * math.log(1 + (d * b - a * a) // (d * d)))
                c, k, starts = best[s]
                found.append((c + penalty + cost, k + 1, (s, *starts)))
        if found and (t == n or t >= least):
            best[t] = min(found)
    return best[n][0], list(best[n][2][::-1])


def drawn(rng, n):
    kind, out = rng.randrange(5), []
    while len(out) < n:
        level, wide = rng.choice([0, 1, 5, 100]), rng.choice([0, 1, 1, 3, 40])
        out += [level + rng.randint(0, wide) for _ in range(rng.randint(3, 30))]
    if kind == 0:
        out = [rng.randint(0, 1) for _ in out]
    return np.array(out[:n], np.int64)


def test_segments_equal_brute_force_with_ties_and_small_spreads():
    rng = random.Random(1)
    for least, penalty in ((7, 20_000), (7, 900), (2, 300), (1, 50), (3, 0)):
        series = [drawn(rng, rng.randint(1, 60)) for _ in range(60)]
        for x, (starts, sums, _, cost, whole) in zip(series, changes.segmented(series, least, penalty), strict=True):
            want, cuts = brute(x.tolist(), least, penalty)
            assert (whole, starts) == (want, cuts)
            assert sum(sums) == x.sum() and sum(cost) + penalty * (len(cost) - 1) == whole


def test_no_cut_makes_costs_rise_by_the_bound():
    rng = np.random.default_rng(4)
    tight = 0
    for _ in range(4000):
        a, b = (rng.integers(0, rng.choice([2, 3, 30]), rng.integers(1, 40)) * rng.choice([1, 1, 7]) for _ in range(2))
        n = np.array([len(a), len(b), len(a) + len(b)])
        s = np.array([a.sum(), b.sum(), a.sum() + b.sum()])
        q = np.array([(a * a).sum(), (b * b).sum(), (a * a).sum() + (b * b).sum()])
        spread, cost = changes.costs(n, s, q)
        rise = cost[0] + cost[1] - cost[2]
        assert rise < changes.loss(n[:1], spread[:1], n[2:])[0]
        tight += rise > 0
    assert tight > 20  # floors do make costs rise, so the bound is needed


def test_sums_beyond_64_bits_are_exact():
    x = np.array([3_000_000_000_000] * 10 + [9_000_000_000_000, 1] * 10, np.int64)
    (starts, _, spreads, _, whole), = changes.segmented([x])
    assert (whole, starts) == brute(x.tolist(), 7, 20_000) and spreads[-1] > 2**60


def test_pruning_leaves_few_candidates():
    """Stable stretches of large spread lose their candidates, so that a long series doesn't take the square of its days."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(0, 10 ** rng.integers(3, 6), 100) for _ in range(20)])
    seen, plain = [], changes.costs

    def counted(n, s, q):
        seen.append(len(n))
        return plain(n, s, q)

    changes.costs = counted
    try:
        changes.segmented([x])
    finally:
        changes.costs = plain
    assert sum(seen) < len(x) ** 2 / 2 / 4


def test_edge_rows(spark):
    day = lambda d, h=0: datetime.datetime(2024, 1, 1, h) + datetime.timedelta(days=d)
    rows = [("a", day(0, 23), 5, 1), ("a", day(0), 5, 1), ("a", day(0), 5, 1), ("a", day(3), 2, 1), (None, day(1), 4, 1), ("b", None, 4, 1), ("c", day(1), None, 1)]
    rows += [("d", day(k), 7, 1) for k in range(20)] + [("d", day(k), 1000 * (k % 2), 1) for k in range(20, 40)]
    df = spark.createDataFrame(rows, "total string, at timestamp_ntz, x int, day int")
    got = sorted(map(tuple, changes.change_points(df, "total", "at", "x").collect()), key=repr)
    assert ("a", 1, 19723, 4, 17, 1 + (4 * 229 - 17 * 17) // 16, 4 * math.floor(1000 * math.log(1 + (4 * 229 - 17 * 17) // 16)), 1) == got[0][:8]
    assert [r[:5] for r in got if r[0] == "d"] == [("d", 1, 19723, 20, 140), ("d", 2, 19743, 20, 10000)]
    assert {r[0] for r in got} == {"a", "d", None}
    assert changes.change_points(df.limit(0), "total", "at", "x").count() == 0


def test_query_equals_oracle(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW sale_lines AS SELECT * FROM read_parquet('{path}/sale_lines.parquet')")
    want = con.execute(changes.ORACLE)
    names = [d[0] for d in want.description]
    got = changes.query(spark, path)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("together", [1, 10**9])
def test_batches_of_series_don_t_matter(spark, monkeypatch, together):
    monkeypatch.setattr(changes, "TOGETHER", together)
    rows = spark.read.parquet("/root/testdata/sf0.001/sale_lines.parquet").where("flag = 'kept'")
    got = changes.change_points(rows, "vendor_id", "shipped_at", "quantity").agg({"best_cost": "sum", "segment_no": "count"}).first()
    monkeypatch.undo()
    assert got == changes.query(spark, "/root/testdata/sf0.001").agg({"best_cost": "sum", "segment_no": "count"}).first()
