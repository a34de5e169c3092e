import random
import re
from collections import Counter

import pytest

from veldra.llm import substrings


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        gone = {i + j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((repr(k), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone).encode()))
    return sorted(out)


def corpus(rng, n=60):
    passage = [f"p{i}" for i in range(90)]
    rows = []
    for i in range(n):
        w = [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            s = rng.randrange(50)
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[s : s + rng.randrange(20, 60)]
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(n, rows[5][1]), (n + 1, None), (n + 2, ""), (n + 3, "x " * 200), (n + 4, "y z " * 30), (None, rows[7][1]), (None, "tail " + rows[9][1]), (5, rows[5][1]), (5, "q " + rows[11][1])]
    return rows


@pytest.mark.parametrize("bucket", [512, 1])
def test_equals_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(substrings, "BUCKET", bucket)
    for window, width, seed in ((35, 8, 1), (10, 3, 2)):
        rows = corpus(random.Random(seed))
        df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
        got = sorted((repr(r.doc_id), r.n_words, r.n_removed, bytes(r.kept)) for r in substrings.remove_repeats(df, window=window, width=width).collect())
        assert got == brute(rows, window)


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
