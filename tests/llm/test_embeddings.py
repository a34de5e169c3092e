import math

import numpy as np

from veldra.llm import embeddings


def brute(rows, least=0.95):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and None not in v and all(map(math.isfinite, v)) and any(v):
            good[i] = np.array(v, float) / np.linalg.norm(v)
    ids = sorted(good)
    links = {i: set() for i, _ in rows}
    for a in ids:
        for b in ids:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= least:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for y in links[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        out[i] = (len(links[i]), min(seen) if i is not None else None)
    return out


def vectors(rng, clusters, most, dim=16, noise=0.06):
    rows, i = [], 0
    for _ in range(clusters):
        base = rng.standard_normal(dim)
        for _ in range(rng.integers(1, most)):
            v = (base / np.linalg.norm(base) + noise * rng.standard_normal(dim)) * rng.choice([0.1, 1, 50])
            rows.append((i, v.tolist()))
            i += 1
    return rows


def test_links_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = vectors(rng, 40, 30)
    rows += [(5000, rows[0][1]), (5001, rows[0][1]), (5002, [0.0] * 16), (5003, None), (5004, [math.nan] + [1.0] * 15), (5005, [None] + [1.0] * 15), (5006, []), (5007, [1.0, 2.0]), (5008, [2.0, 4.0]), (5009, [math.inf] * 16)]
    want = brute(rows)
    for bucket, block in ((1024, 1024), (64, 32)):
        monkeypatch.setattr(embeddings, "BUCKET", bucket)
        monkeypatch.setattr(embeddings, "BLOCK", block)
        got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
        assert got == want


def test_nulls_repeats_and_empty(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [1.0, 0.0], 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    got = sorted((repr(r.vec_id), r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect())
    assert got == [("1", 1, 1), ("1", 1, 1), ("2", 1, 1), ("None", 0, None), ("None", 0, None)]
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.query(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(rows)


def test_ids_that_repeat_with_other_vectors_lose_no_link(spark):
    v, u = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, v), (1, u), (5, u), (9, v), (6, [0.0, 1.0, 0.01])]
    got = {}
    for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id))
    assert {i: sorted(x) for i, x in got.items()} == {1: [(1, 1), (2, 1)], 5: [(2, 1)], 9: [(1, 1)], 6: [(2, 1)]}
    named = spark.createDataFrame([(f"d{i}", x) for i, x in rows], "vec_id string, embedding array<double>")
    assert {r.component_id for r in embeddings.near_vectors(named).collect()} == {"d1"}


def test_pairs_at_the_limit_are_told_exactly(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(150):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        cos = 0.95 + rng.choice([-1e-3, -1e-6, 1e-9, 1e-6, 1e-3])
        rows += [(2 * i, a.tolist()), (2 * i + 1, (cos * a + math.sqrt(1 - cos * cos) * b).tolist())]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute(rows)
