import random
import zlib

import numpy as np
import pytest

from veldra.llm import idstore

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("word_bpe_49k.json")


def whole(texts):
    t = tokenizers.Tokenizer.from_file(PATH)
    return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def test_words_give_the_ids_of_whole_texts():
    rng = random.Random(1)
    bits = ["a", "É", "é", "́", " ", "\n", "\t", " ", " ", "'s", "don't", "12", "<|endoftext|>", "漢", "🙂", ".", "ΑΣ", "\x1c", "İ", "ﬁ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(3000)]
    assert idstore.Encoder(PATH).encode(texts) == whole(texts)
    words = ["".join(rng.choice("abcXYZéßΣσİΩﬁ漢あकि'1.,!?;-_") for _ in range(rng.randrange(1, 12))) for _ in range(6000)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(400)]
    encoder = idstore.Encoder(PATH)
    assert encoder.encode(texts) == whole(texts) == encoder.encode(texts)


def test_blocks_round_trip():
    docs = [(5, b"\x01\0\0\0" * 9), (6, b""), (6, b"\x02\0\0\0"), (9, bytes(range(200)) * 40)]
    for dictionary in (b"", idstore.train([b for _, b in docs]), idstore.train([np.arange(k, 300 + k, dtype="<u4").tobytes() for k in range(300)])):
        b = idstore.Block(idstore.pack(docs, dictionary, 77), dictionary)
        assert [(i, b.ids(k)) for k, (i, _, _) in enumerate(b.index)] == docs and b.before == 77
        assert b.find(9) == docs[3][1] and b.find(4) is None
    with pytest.raises(ValueError):
        idstore.Block(idstore.pack(docs, b"", 0), b"other")


def test_store_of_whole_documents(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    got = sorted(idstore.query(spark, "/root/testdata/sf0.001").collect())
    at, want = 0, []
    for (i, _), raw in zip(docs, whole([t for _, t in docs]), strict=True):
        raw += b"\x02\0\0\0"
        want.append((i, at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    assert [tuple(r) for r in got] == want


def test_nulls_repeats_and_lookup(spark):
    df = spark.createDataFrame([(2, "b c", 1), (1, None, 1), (2, "b c", 1), (None, "x", 1), (-7, "", 1)], "doc_id long, text string, data int")
    blocks, dictionary = idstore.write(df, PATH)
    got = [tuple(r)[:3] for r in idstore.read(blocks, dictionary).collect()]
    assert sorted(got, key=lambda r: r[1]) == [(None, 0, 2), (-7, 2, 1), (1, 3, 1), (2, 4, 3), (2, 7, 3)]
    assert idstore.lookup(blocks, dictionary, 2) == whole(["b c"])[0] + b"\x02\0\0\0" and idstore.lookup(blocks, dictionary, 3) is None
    blocks, dictionary = idstore.write(df.limit(0), PATH)
    assert idstore.read(blocks, dictionary).count() == 0
