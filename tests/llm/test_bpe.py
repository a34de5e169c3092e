import base64
import hashlib
import random

import pytest

from veldra.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hard_texts():
    rng = random.Random(3)
    yield from ["", " ", "\n\n  \t", "a", "aaaaaaaaaa" * 300, "<|endoftext|> it's we'll", "日本語テキスト", "é" * 500, "\x00￾\U0001f600", "1234567890" * 50]
    for _ in range(60):
        yield "".join(rng.choice("abcdeéßñ the ing 019.,!?\n\tＡ漢🙂") for _ in range(rng.randrange(1, 400)))
    yield "".join(rng.choice("abcdefgh") for _ in range(20_000))


def test_merger_equals_library(library):
    m = bpe.Merger(bpe.load_ranks(PATH), P.PATTERN)
    for t in hard_texts():
        raw = m.encode(t)
        ids = [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]
        assert ids == library.encode_ordinary(t)
        assert m.decode(raw) == t.encode()


def test_rank_queue_is_a_priority_queue():
    rng, q, held = random.Random(1), bpe.RankQueue(), {}
    for step in range(5000):
        if rng.random() < 0.6 or not held:
            r = rng.choice([rng.randrange(70), rng.randrange(300_000)])
            q.push(r, step)
            held.setdefault(r, []).append(step)
        else:
            r = min(held)
            assert q.pop() == (r, held.pop(r))
    while held:
        r = min(held)
        assert q.pop() == (r, held.pop(r))
    assert q.pop() is None


def test_frame_with_nulls_and_clashing_columns(spark, library):
    rows = [(1, "hello world", "x"), (2, None, "y"), (None, "again", None), (1, "hello world", "x"), (3, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(bpe.encode_column(df, PATH, P.PATTERN).collect(), key=repr)
    assert len(got) == 5
    for r in got:
        text = {1: "hello world", 2: "", 3: "", None: "again"}[r.doc_id]
        assert bytes(r.decoded) == text.encode() and r.n_tokens == len(library.encode_ordinary(text))
    d = {r.doc_id: r for r in bpe.digests(df, PATH, P.PATTERN).collect()}
    assert d[2].ids_sha256 == hashlib.sha256(b"").hexdigest() and d[2].n_tokens == 0
    assert bpe.digests(df.limit(0), PATH, P.PATTERN).count() == 0


def test_whole_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in bpe.query(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        ids = library.encode_ordinary(r.text)
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
