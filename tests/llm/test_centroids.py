import hashlib
import math

import duckdb
import numpy as np
import pytest

from veldra.llm import centroids


def brute(rows, dim, k, rounds, scale=64):
    """Python integers, every vector against every centroid."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and None not in v and all(map(math.isfinite, v))]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))
    at = [v for _, v in start[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        at = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(at)]
    found = [(i, near(v)) for i, v in kept]
    each = {}
    for _, (d, j) in found:
        each[j] = each.get(j, 0) + d
    return sorted(((i, j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for i, (d, j) in found), key=repr)


def told(df):
    return sorted(((r[0], r[1], r[2], int(r[3]), int(r[4]), r[5]) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("noise", "tree"), [(0.0, 64), (0.01, 200), (0.5, 1 << 18), (3.0, 40)])
def test_clusters_equal_brute_force(spark, monkeypatch, noise, tree):
    monkeypatch.setattr(centroids, "TREE", tree)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((7, 4))
    x = base[rng.integers(0, 7, 300)] + noise * rng.standard_normal((300, 4))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(300, None), (301, []), (302, [1.0, 2.0, 3.0]), (303, [1.0, None, 2.0, 3.0]), (304, [math.nan, 0.0, 0.0, 0.0]), (305, [math.inf] * 4), (306, [0.0] * 5), (None, rows[0][1]), (5, rows[5][1]), (6, rows[7][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cluster int")
    assert told(centroids.clusters(df, dim=4, k=9)) == brute(rows, 4, 9, 3)


def test_ties_go_to_the_smaller_number():
    points = np.array([[0, 0], [2, 0], [1, 0], [1, 5], [1, -5], *[[1, 0]] * 40])
    tree = centroids.Tree(points)
    at = np.array([[2, 0], [0, 0], [2, 0]])
    cluster, counts, sums, whole = tree.assigned(at)
    want = [min((int(((p - c) ** 2).sum()), j) for j, c in enumerate(at))[1] for p in tree.points]
    assert cluster.tolist() == want and counts.tolist() == [len(points) - 1, 1, 0]
    assert sums.tolist() == [(points.sum(axis=0) - [0, 0]).tolist(), [0, 0], [0, 0]] and whole <= len(points)


def test_whole_balls_are_given_at_once():
    rng = np.random.default_rng(1)
    base = rng.integers(-500, 500, (8, 16))
    points = base[rng.integers(0, 8, 4000)] + rng.integers(-3, 4, (4000, 16))
    tree = centroids.Tree(points)
    cluster, counts, sums, whole = tree.assigned(base)
    want = ((tree.points[:, None] - base) ** 2).sum(axis=2).argmin(axis=1)
    assert (cluster == want).all() and whole > 0.95 * len(points)  # all but leaves that hold points of two groups
    assert (counts == np.bincount(want, minlength=8)).all() and (sums == [tree.points[want == c].sum(axis=0) for c in range(8)]).all()


def test_large_components_are_exact_and_larger_ones_an_error(spark):
    big = centroids.largest(2) / 64 * 0.9
    rows = [(i, [big * (-1) ** i, i / 3]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert told(centroids.clusters(df, dim=2, k=3)) == brute(rows, 2, 3, 3)
    with pytest.raises(Exception, match="64 bits"):
        centroids.clusters(spark.createDataFrame([(1, [1e30, 0.0])], df.schema), dim=2).collect()


def test_few_rows_text_ids_and_an_empty_table(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.5, 0.0]), (None, [0.5, 0.0])], "inertia string, v array<float>")
    got = centroids.clusters(df, "inertia", "v", dim=2)
    assert sorted((r[0] or "", r[2]) for r in got.collect()) == [("", 0), ("a", 0), ("b", 0)]
    assert centroids.clusters(df.limit(0), "inertia", "v", dim=2).count() == 0
    assert centroids.clusters(df, "inertia", "v").columns == got.columns


def test_query_equals_oracle(spark):
    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet')")
    want = con.execute(centroids.ORACLE)
    names = [d[0] for d in want.description]
    got = centroids.query(spark, path)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
