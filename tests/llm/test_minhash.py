import random
import re

from veldra.llm import minhash
from veldra.llm.common import Workspace, components


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i, _ in rows}


def edited(rng, words, share):
    return [rng.choice("qrstuvwxyz") * 3 + str(rng.randrange(99)) if rng.random() < share else w for w in words]


def test_components_equal_brute_force(spark):
    rng = random.Random(9)
    rows, i = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(5, 200))]
        for _ in range(rng.choice([1, 2, 6, 60])):
            rows.append((i, " ".join(edited(rng, base, rng.choice([0, 0.005, 0.02, 0.05])))))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n "), (i + 3, "one two"), (i + 4, "One TWO"), (i + 5, "É two"), (i + 6, "é two")]
    for width in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()}
        assert got == brute(rows, width, 80)


def test_a_fragmented_group_is_joined_whole(spark, monkeypatch):
    """Copies that are often too far from the smallest one: families must join them, over several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", 16)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(150)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0.01, 0.02, 0.03, 0.05])))) for i in range(120)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == brute(rows, 4, 80)


def test_nulls_repeats_empty_and_extra_columns(spark):
    rows = [(1, "a b c d e f", 5), (1, "a b c d e f", 5), (0, "A b c d e f", 5), (None, "z y x w", 5), (3, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((repr(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [("0", 2, 0, True), ("1", 2, 0, False), ("1", 2, 0, False), ("3", 0, 3, True), ("None", 1, None, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_ids_that_repeat_with_other_texts_lose_no_link(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (1, b), (5, b), (9, a), (12, b + " more"), (20, a + " more")]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 5: 1, 9: 1, 12: 1, 20: 1}
    named = spark.createDataFrame([(f"d{i}", t) for i, t in rows], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(named).collect()} == {"d1": "d1", "d5": "d1", "d9": "d1", "d12": "d1", "d20": "d1"}


def test_components_of_stars_chains_and_rings(spark):
    rng = random.Random(1)
    edges = [(0, k) for k in range(1, 3000)] + [(5000 + k, 5001 + k) for k in range(70)] + [(7000 + k, 7000 + (k + 1) % 40) for k in range(40)]
    edges += [(9000 + rng.randrange(300), 9000 + rng.randrange(300)) for _ in range(260)] + [(2999, 9999), (9999, 10001), (4, 4)]
    rng.shuffle(edges)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    got = {r.node: r.component for r in components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
