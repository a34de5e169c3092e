import random
import re

import numpy as np

from veldra.llm import mixing


def brute_targets(sizes, weights, share, most):
    out, left, open_ = [0.0] * len(sizes), share * sum(sizes), {i for i, s in enumerate(sizes) if s}
    while open_:
        total = sum(weights[i] for i in open_)
        above = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not above:
            for i in open_:
                out[i] = left * weights[i] / total
            return out
        for i in above:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ -= above
    return out


def test_targets_are_capped_and_reshared():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([0, rng.randrange(1, 10), rng.randrange(1, 10_000)]) for _ in range(rng.randrange(1, 9))]
        w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        got = mixing.targets(sizes, w, 1.5, 2)
        assert all(abs(a - b) < 1e-6 for a, b in zip(got, brute_targets(sizes, w, 1.5, 2), strict=True))
        assert abs(sum(got) - 1.5 * sum(sizes)) < 1e-6 * (1 + sum(sizes))


def test_epochs_hold_exactly_the_target():
    rng = random.Random(2)
    for k in range(200):
        s = mixing.Source("a", rng.randrange(1, 40 * mixing.BLOCK_WORDS), 1)
        s.target = rng.uniform(0, 2 * s.size)
        words = 0
        for p in mixing.epochs(k, s, 7):
            seen = set()
            for j, block in enumerate(mixing.Permutation(p["n"], 7, k, p["epoch"])(np.arange(p["slots"])).tolist()):
                assert block not in seen
                seen.add(block)
                size = min(mixing.BLOCK_WORDS, s.size - block * mixing.BLOCK_WORDS)
                words += min(size, p["cut"]) if p["cut"] and j == p["slots"] - 1 else size
        assert words == round(s.target)


def test_permutations_are_whole_have_inverses_and_look_random():
    for n in (1, 2, 3, 7, 64, 65, 1000, 4097):
        p = mixing.Permutation(n, 7, 1, 0)
        x = np.arange(n)
        y = p(x)
        assert sorted(y.tolist()) == x.tolist() and (p(y, back=True) == x).all()
        if n >= 1000:
            assert (y != mixing.Permutation(n, 7, 1, 1)(x)).mean() > 0.9
            assert len(set(np.diff(y).tolist())) > n / 3  # no stride
            assert abs(np.corrcoef(x, y)[0, 1]) < 0.1
    assert (mixing.Permutation(10**15, 1)(np.array([0, 1, 10**15 - 1])) < 10**15).all()


def test_each_document_gives_the_words_of_its_blocks(spark, monkeypatch):
    """Brute force over single words: a source's words in the order of its layout, cut into blocks, met by slots of the permutation."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 50)
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 16)
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 8)
    monkeypatch.setattr(mixing, "GROUP_BUCKETS", 3)
    rng = random.Random(4)
    docs = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 9, 130, 700]))), rng.choice(["a", "a", "b", None])) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    work = mixing.Workspace(spark, "t")
    laid, slot, sources = mixing.plan(work, df, "doc_id", "text", "source", mixing.WEIGHTS, mixing.SHARE, 7)
    places = sorted((r.k, r.start, r.size, r.id) for r in laid.collect())
    want = dict.fromkeys((i for i, *_ in docs), 0)
    for k, s in enumerate(sources):
        owner = [i for j, _, size, i in places if j == k for _ in range(size)]
        assert len(owner) == s.size and all(owner[start] == i for j, start, size, i in places if j == k and size)
        left = round(s.target)
        for epoch in (0, 1):
            for block in mixing.Permutation(s.blocks, 7, k, epoch)(np.arange(s.blocks)).tolist():
                for i in owner[50 * block : 50 * block + 50]:
                    if left:
                        want[i] += 1
                        left -= 1
    assert {r.doc_id: r.taken for r in mixing.mix(df).collect()} == want
    # every slot is in one shard, and no shard has more than it holds
    got = slot.groupBy("shard").count().collect()
    assert all(r["count"] <= 16 for r in got) and sum(r["count"] for r in got) == slot.select("k", "epoch", "j").distinct().count()


def test_shard_counts_add_up():
    quota = [10, 50_000, 3, 0, 17_000]
    total = [0] * 5
    for _, got in mixing.shard_counts(quota, 1):
        total = [a + int(b) for a, b in zip(total, got, strict=True)]
    assert total == quota


def frame(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 3, 400, 6000]))), rng.choice(["a", "a", "a", "b", None, "ü"]), 1) for i in range(300)]
    return rows + [(1000, None, "a", 1), (None, "x y z", "b", 2), (7, "p q", "b", 3), (7, "p q", "b", 3)]


def test_mix(spark):
    rows = frame(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert len(got) == len(rows)
    sizes: dict = {}
    for i, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip([sizes[s] for s in order], brute_targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2), strict=True))
    taken: dict = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        assert abs(r.target - want[r.source_size]) < 1e-6
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    for size, t in taken.items():
        assert abs(t - want[size]) <= 0.5 + 1e-6


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(df).count() == 0
