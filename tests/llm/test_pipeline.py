import re
from collections import Counter

import numpy as np

import corpus_pipeline
from veldra.llm import minhash, mixing, quality, secrets

from test_minhash import brute  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_mixing_stage_gives_the_words_of_the_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(5000, "a b c", "en", "src0", 5), (5000, "a b c", "en", "src0", 5), (None, "p q", None, None, 3), (5001, None, "en", "src1", None)], DOCS)
    for df in (docs, docs.unionByName(extra)):
        out = mixing.stage(spark, df, "").collect()
        got = Counter()
        text = {}
        for r in df.collect():
            text.setdefault(r.doc_id, Counter()).update(WORD.findall(r.text or ""))
        for r in out:
            words = WORD.findall(r.text)
            got[r.doc_id] += len(words)
            assert not Counter(words) - text[r.doc_id] and r.n_chars == len(r.text)
        want = Counter()
        for r in mixing.mix(df).collect():
            want[r.doc_id] += r.taken
        assert +got == +want


def test_stages_keep_columns_and_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = quality.stage(spark, docs, "")
    kept = {r.doc_id for r in quality.line_quality(docs).where("kept").collect()}
    assert a.columns == docs.columns and {r.doc_id: r for r in a.collect()} == {r.doc_id: r for r in docs.collect() if r.doc_id in kept}
    b = minhash.stage(spark, docs, "")
    kept = {r.doc_id for r in minhash.near_duplicates(docs).where("kept").collect()}
    assert {r.doc_id: r for r in b.select(docs.columns).collect()} == {r.doc_id: r for r in docs.collect() if r.doc_id in kept} and b.columns == docs.columns
    c = {r.doc_id: r for r in secrets.stage(spark, docs, "").collect()}
    for r in docs.collect():
        assert c[r.doc_id].text == secrets.redact(r.text) and c[r.doc_id].n_chars == len(c[r.doc_id].text)


def test_minhash_stage_with_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (None, "q", "en", "s", 1), (3, None, "en", "s", None)]
    got = sorted((r.doc_id or 0) for r in minhash.stage(spark, spark.createDataFrame(rows, DOCS), "").collect())
    assert got == [0, 1, 3]


def test_pipeline_equals_brute_force(spark):
    """The stages that select and change documents by plain Python over the whole small table, then the mix of what is left, then tiktoken."""
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.collect()
    fold = lambda line: " ".join("0" if re.fullmatch("[0-9][0-9.,:/-]*", w) else w for w in re.sub("[A-Z]", lambda m: m[0].lower(), " ".join(WORD.findall(line))).split(" "))
    seen, hosts = {}, {}
    for r in rows:
        hosts.setdefault(r.source, set()).add(r.text)
        for line in (r.text or "").split("\n"):
            if WORD.search(line):
                seen.setdefault((r.source, fold(line)), set()).add(r.text)
    often = {key for key, texts in seen.items() if len(texts) > 10 and len(texts) > min(1000, 0.01 * len(hosts[key[0]]))}
    clean = {}
    for r in rows:
        words = WORD.findall(r.text or "")
        at = {}
        for i in range(len(words) - 2):
            at.setdefault(tuple(words[i : i + 3]), []).append(i)
        repeated = len({i + j for x in at.values() if len(x) > 1 for i in x for j in range(3)})
        lines = (r.text or "").split("\n")
        left = [y for y in lines if (r.source, fold(y)) not in often]
        n = sum(len(WORD.findall(y)) for y in left)
        if len(words) >= 50 and 100 * repeated <= 50 * len(words) and 100 * n >= 70 * len(words):
            clean[r.doc_id] = "\n".join(left)
    first = {i: root for i, (_, root) in brute(sorted(clean.items()), 5, 80).items()}
    want = {i: secrets.redact(t) for i, t in clean.items() if first[i] == i}
    lines = [(r.doc_id, want[r.doc_id], r.lang, r.source, len(want[r.doc_id])) for r in rows if r.doc_id in want]
    mixed = mixing.stage(spark, spark.createDataFrame(lines, DOCS), d).collect()
    t = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    ids = lambda text: np.array(t.encode_ordinary(text), "<u4").tobytes()
    got = corpus_pipeline.run(spark, d).collect()
    assert len(got) > 100
    assert sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in got) == sorted((r.doc_id, len(ids(r.text)) // 4, ids(r.text)) for r in mixed)


def test_the_ids_decode_to_the_mixed_texts(spark):
    from veldra.llm import bpe

    rows = [(1, "Größe und “quotes” 東京 " * 30, "en", "s", 9), (None, "", "en", "s", 9), (2, None, "en", "s", 9), (1, "again", "en", "s", 9)]
    got = bpe.stage(spark, spark.createDataFrame(rows, DOCS), "").collect()
    m = bpe.Merger(bpe.load_ranks(bpe._public()[0]), bpe._public()[1])
    assert sorted((repr(r.doc_id), m.decode(bytes(r.ids))) for r in got) == sorted((repr(i), (t or "").encode()) for i, t, *_ in rows)


def test_mixing_stage_with_clashing_names_and_no_n_chars(spark):
    rows = [("a", "one two three", "s", 1, 2, 3), ("a", "one two three", None, 1, 2, 3), ("a", "other words here", "s", 1, 2, 3), (None, "p q", "s", 1, 2, 3), ("b", None, "s", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, size int, ranges int, k int")
    out = mixing.stage(spark, docs, "").collect()
    assert out and all((r["size"], r.ranges, r.k) == (1, 2, 3) for r in out)
    taken = Counter()
    for r in out:
        taken[r.doc_id] += len(r.text.split())
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.taken
    assert +taken == +want


def test_pipeline_runs_on_small_and_empty_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() > 0
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
