import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veldra.llm import classlm


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for gap in "\t\n\v\f\r":
        low = low.replace(gap, " ")
    return [w for w in low.split(" ") if w]


def base(rows, trained):
    """The contract's unigram columns: (tokens, known, training tokens, score) of each row."""
    counts = Counter()
    for (_, text), t in zip(rows, trained, strict=True):
        if t:
            counts.update([*tokens(text), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for _, text in rows:
        own = [*tokens(text), None]
        out.append((len(own), sum(w in counts for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)))
    return out


def model(rows, trained, classes, k):
    """Score of each row by the classes that the operator chose, in plain Python."""
    pairs, sizes, counts = Counter(), Counter(), Counter()
    for (_, text), t in zip(rows, trained, strict=True):
        if t:
            said = [*tokens(text), None]
            counts.update(said)
            pairs.update(zip([classes[None]] + [classes[w] for w in said[:-1]], [classes[w] for w in said], strict=True))
    for w, n in counts.items():
        sizes[classes[w]] += n
    total = sum(counts.values())
    unknown = min(0.5, max(1, sum(n == 1 for n in counts.values())) / (total + 1))

    def step(a, b):
        if b is None:
            return unknown
        after = {y: n for (x, y), n in pairs.items() if x == a}
        rate = sizes[b] / total
        return (1 - unknown) * ((after.get(b, 0) + len(after) * rate) / (sum(after.values()) + len(after)) if after else rate)

    out = []
    for _, text in rows:
        score, last = 0.0, classes[None]
        for w in [*tokens(text), None]:
            c = classes.get(w)
            score += math.log10(step(last, c)) + (math.log10(counts[w] / sizes[c]) if c is not None else 0)
            last = c
        out.append(score)
    return out


def drawn(rng, n):
    """Texts of a grammar with kinds of words, so that classes tell something; with long, rare, repeated and odd words."""
    nouns, verbs, marks = [f"n{k}" for k in range(60)], [f"V{k}" for k in range(40)], [f"é{k}" for k in range(10)]
    out = []
    for i in range(n):
        said = []
        for _ in range(rng.randint(0, 30)):
            said += [rng.choice(nouns[: rng.randint(1, 60)]), rng.choice(verbs[: rng.randint(1, 40)]), rng.choice(marks)]
            if rng.random() < 0.1:
                said += [f"rare{rng.randrange(400)}", "x" * 70]
            if rng.random() < 0.05:
                said += ["n1", "n1", "N1"]
        out.append((i, rng.choice([" ", "\n", "  \t"]).join(said)))
    return [*out, (n, None), (n + 1, ""), (None, "n1 V1 quite new"), (3, out[3][1]), (n + 2, out[3][1]), (n + 3, "  n1\x1cn2 \x85")]


def spied(monkeypatch):
    """The classes that a run of the operator gives to words."""
    found = {None: 0}
    plain, put = classlm.exchanged, classlm.Workspace.put

    def exchanged(*a, **b):
        got = plain(*a, **b)
        found["#"] = got[0]
        return got

    def tabled(self, df, name):
        out = put(self, df, name)
        if name == "seen":
            found["seen"] = {bytes(r["word"]): r["n"] for r in out.collect()}
        if name == "placed":
            found.update({bytes(r["word"]).decode(): r["class"] for r in out.collect()})
        return out

    monkeypatch.setattr(classlm, "exchanged", exchanged)
    monkeypatch.setattr(classlm.Workspace, "put", tabled)
    return found


@pytest.mark.parametrize(("head", "k", "chunk"), [(1 << 18, 4, 1 << 22), (40, 5, 50), (0, 3, 1 << 22)])
def test_scores_equal_brute_force(spark, monkeypatch, head, k, chunk):
    monkeypatch.setattr(classlm, "CHUNK", chunk)
    monkeypatch.setattr(classlm, "MERGE", chunk)
    rows = drawn(random.Random(5), 120)
    trained = [i is not None and i % 7 != 2 for i, _ in rows]
    found = spied(monkeypatch)
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, score int")
    got = classlm.language_model(df, F.col("doc_id") % 7 != 2, k=k, head=head).collect()
    seen, classes = found.pop("seen"), found.pop("#")
    placed = set(found) - {None}
    first = sorted((w.decode() for w in seen if w and w.decode() not in placed), key=lambda w: (-seen[w.encode()], w.encode()))
    assert len(first) <= head and len(placed) + len(first) + 1 == len(seen) and len(classes) == len(first) + 2
    found |= dict(zip(first, classes[1:-1].tolist(), strict=True))
    want = sorted((repr(i), *b, m) for (i, _), b, m in zip(rows, base(rows, trained), model(rows, trained, found, k), strict=True))
    assert len(got) == len(rows)
    for w, r in zip(want, sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), strict=True):
        assert w[:4] == r[:4] and r[4:] == pytest.approx(w[4:], rel=1e-7, abs=1e-6)


def test_gains_equal_changes_of_the_likelihood():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 12, 400)
    pairs = np.zeros((12, 12))
    np.add.at(pairs, (ids[:-1], ids[1:]), 1)
    of = rng.integers(0, 4, 12)

    def matrix(of):
        out = np.zeros((4, 4))
        np.add.at(out, (of[:, None].repeat(12, 1), of[None].repeat(12, 0)), pairs)
        return out

    for own in (True, False):
        for w in range(12):
            left, right = (np.bincount(of, np.where(np.arange(12) == w, 0, x), 4)[None] for x in (pairs[:, w], pairs[w]))
            got = classlm.gains(matrix(of), left, right, pairs[w, w][None], of[w][None])[0]
            want = []
            for c in range(4):
                moved = of.copy()
                moved[w] = c
                want.append(classlm.likelihood(matrix(moved)))
            assert got - got[of[w]] == pytest.approx(np.array(want) - want[of[w]], abs=1e-6)


def test_moves_hold_few_words_and_entries_at_once(monkeypatch):
    """The moves don't depend on how many words are told at once, and no call sees more."""
    rng = np.random.default_rng(4)
    n, buckets, c = 9000, 90, 6
    classes = np.concatenate([[0], 1 + rng.integers(0, c - 2, n), [c - 1]]).astype(np.uint8)
    columns: dict = {k: [] for k in ("bucket", "code", "partner", "n")}
    for b in range(buckets):
        code = np.sort(rng.integers(0, 2 * (n // buckets), 400)).astype(np.uint8)
        for k, x in zip(columns, (b, code.tobytes(), rng.integers(0, n + 2, 400).astype(np.int32).tobytes(), rng.integers(1, 9, 400).tobytes()), strict=True):
            columns[k].append(x)
    batch = pa.RecordBatch.from_pydict(columns)
    matrix = rng.integers(100, 900, (c, c)).astype(float)
    sizes, plain = [], classlm.gains
    monkeypatch.setattr(classlm, "gains", lambda m, left, *a: sizes.append(len(left)) or plain(m, left, *a))

    def moves():
        return {w: to for out in classlm._moves(classes.tobytes(), matrix, buckets, 0)(iter([batch])) for w, to in zip(*(out.column(k).to_pylist() for k in (0, 1)), strict=True)}

    want = moves()
    assert want and max(sizes) <= 4096
    monkeypatch.setattr(classlm, "TOLD", 70)
    monkeypatch.setattr(classlm, "OPENED", 3000)
    sizes.clear()
    assert moves() == want and max(sizes) <= 70


def test_neighbours_take_few_bytes_and_any_count():
    """Small counts take a byte each, also when rows meet; large ones keep their value."""
    texts = pa.RecordBatch.from_arrays([pa.array(["a b c a b", "b a", None, "c c zz c"] * 50)], names=["text"])
    rows = [b for _ in range(2) for b in classlm._pairs(b"a\nb\nc", 2)(iter([texts]))]
    assert all(len(n) == len(code) and len(p) == 4 * len(code) for b in rows for code, p, n in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True))
    near = pa.Table.from_batches(rows).sort_by("bucket").combine_chunks().to_batches()
    got = list(classlm._neighbours(iter(near)))
    assert sum(len(b.column(k)[0].as_py()) for b in got for k in (1, 2, 3)) < 7.1 * sum(len(b.column(1)[0].as_py()) for b in got)
    found = {}
    for b in got:
        for word, side, partner, n in classlm._opened(b, 2):
            found |= dict(zip(zip(word.tolist(), side.tolist(), partner.tolist(), strict=True), n.tolist(), strict=True))
    assert found[1, 1, 2] == 200 and found[2, 0, 1] == 200 and found[2, 1, 1] == 100 and found[3, 0, 3] == 100 and found[3, 1, 4] == 100 and found[3, 0, 4] == 100
    for n in (255, 256, 70_000, 1 << 33):
        row = pa.RecordBatch.from_pydict({"bucket": [1], "code": [b"\0\1"], "partner": [np.array([5, 6], np.int32).tobytes()], "n": [classlm.narrow(np.array([1, n]))]})
        assert [x.tolist() for x in next(classlm._opened(row, 2))] == [[1, 1], [0, 1], [5, 6], [1, n]]


def test_probabilities_sum_to_one_after_every_class():
    rng = np.random.default_rng(1)
    matrix = rng.integers(0, 5, (6, 6)).astype(float)
    matrix[:, -1] = matrix[-1] = matrix[2] = 0
    for counts in (rng.integers(1, 9, 6).astype(float), np.zeros(6)):
        counts[-1] = 0
        p = 10 ** classlm.tables(matrix, counts, 3, 40)
        if counts.any():
            assert p.sum(axis=1) == pytest.approx(np.ones(6))


def test_exchange_finds_the_kinds_of_words(spark, monkeypatch):
    rng = random.Random(2)
    kinds = [[f"{c}{k}" for k in range(12)] for c in "abc"]
    rows = [(i, " ".join(rng.choice(kinds[j % 3]) for j in range(30))) for i in range(150)]
    found = spied(monkeypatch)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = classlm.language_model(df, F.lit(True), k=3).agg(F.sum("score"), F.sum("base_score")).first()
    first = sorted(found["seen"], key=lambda w: (-found["seen"][w], w))
    of = dict(zip((w for w in first if w), found["#"][1:-1].tolist(), strict=True))
    assert sorted(len({of[w.encode()] for w in kind}) for kind in kinds) == [1, 1, 1] and len(set(of.values())) == 3
    assert out[0] > 0.75 * out[1]


def test_nothing_to_learn_from_and_an_empty_table(spark):
    df = spark.createDataFrame([("a", "x y"), (None, None)], "n_tokens string, text string")
    got = classlm.language_model(df, F.lit(None).cast("boolean"), "n_tokens").collect()
    assert sorted((r[0] or "", r["trained"], r[2], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got) == [("", False, 1, 0, 0, 0.0, 0.0), ("a", False, 3, 0, 0, 0.0, 0.0)]
    assert classlm.language_model(df.limit(0), F.lit(True), "n_tokens").count() == 0
    assert classlm.language_model(df.limit(1), F.lit(True), "n_tokens").first()["perplexity"] > 0


def test_query_on_the_table(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    want = {i: (h, *b) for (i, _), h, b in zip(docs, held, base(docs, [not h for h in held]), strict=True)}
    got = classlm.query(spark, path).collect()
    assert len(got) == len(docs)
    scores = np.zeros(3)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4] and r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-7)
        scores += np.array([r.score, r.base_score, r.n_tokens]) * r.held_out
    assert scores[0] > 0.95 * scores[1]  # on texts that it hasn't seen
