"""One very long text beside short ones, through every operator on documents."""

import random
import re

import pytest

from veldra.llm import bpe, idstore, minhash, mixing, quality, secrets, substrings

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = [f"w{rng.randrange(3000)}" for _ in range(60_000)]
    words[40_000:40_060] = words[100:160]
    return {1: "\n".join(" ".join(words[k : k + 50]) for k in range(0, 60_000, 50)), 2: "x" * 300_000, 3: "short one", 4: 'a password=abc123456 b "' + "é" * 50_000}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in texts.items()], SCHEMA)


def test_quality(docs, texts):
    got = {r.doc_id: r for r in quality.line_quality(docs).collect()}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen: dict = {}
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        covered = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(3)}
        assert (got[i].n_words, got[i].n_repeat_words) == (len(w), len(covered))


def test_the_others(docs, texts):
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()} == {1: 120, 2: 0, 3: 0, 4: 0}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: r.n_assign for r in secrets.secrets(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    for r in bpe.encode_column(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect():
        assert bytes(r.decoded) == texts[r.doc_id].encode()
    blocks, dictionary = idstore.write(docs, P.path("word_bpe_49k.json"))
    assert idstore.read(blocks, dictionary).count() == 4
    assert sum(r.taken for r in mixing.mix(docs).collect()) == round(1.5 * sum(len(t.split()) for t in texts.values()))
