"""Substring dedup (operator 6): repeated word windows by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, groups, partitions, session, texts
from .shingles import MIX, WordHashes, mixed, rolled, split_words

WINDOW, MINIMISER = 35, 8
#: Distinct super-k-mers up to which a bucket is sorted in one piece; larger ones are counted window by window.
BUCKET = 4096
INVERSE = np.uint64(pow(int(MIX), -1, 2**64))


class Powers:
    """Powers of MIX and of its inverse modulo 2^64, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            one = np.ones(1, np.uint64)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([one, np.cumprod(np.full(2 * n, MIX, np.uint64))])
                self.down = np.concatenate([one, np.cumprod(np.full(2 * n, INVERSE, np.uint64))])
        return self.up[:n], self.down[:n]


def super_kmers(words: np.ndarray, window: int, width: int, powers: Powers) -> tuple[np.ndarray, ...] | None:
    """Runs of consecutive windows with one minimiser, from a text's word hashes: (first window, last window, position of the
    minimiser, its hash, hash of the whole run and of the minimiser's place in it). None for a text without windows.

    The minimiser is the leftmost smallest hash among the window's stretches of width words.
    """
    n = len(words) - window + 1
    if n < 1:
        return None
    g = rolled(words, width)
    at = np.lib.stride_tricks.sliding_window_view(g, window - width + 1).argmin(axis=1) + np.arange(n)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    up, down = powers.to(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * down[:-1])])
    end = last + window
    run = (sums[end] - sums[first]) * up[first]
    pos = at[first]
    run = mixed(mixed(run) ^ (((end - first).astype(np.uint64) << np.uint64(20)) + (pos - first).astype(np.uint64)) * MIX)
    return first, last, pos, g[pos], run


def _minimisers(window: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, powers = WordHashes(), Powers()
        held: list = []
        size = 0

        def flush():
            nonlocal held, size
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1].view(np.int64)), pa.array(cols[2].view(np.int64))], names=["k", "mini", "run"])

        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                found = super_kmers(cache.of(split_words(text)), window, width, powers)
                if found:
                    mini, whole = found[3:]
                    held.append((np.full(len(mini), k, np.int64), mini, whole))
                    size += len(mini)
                    if size > 50_000:
                        yield flush()
        if held:
            yield flush()

    return run


SURE, MIXED, SHOWN = 0, 1, 2


def _cut(window: int, width: int):
    """Rows (k, h, text, places): the text's super-k-mers that are told of. Of those that are shown the words go along; sure
    ones that follow each other become one row.

    They are told apart by the hash of the run, so rows that share a key may look at each other's without harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, powers = WordHashes(), Powers()
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for k, h, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), batch.column(3), strict=True):
                words = split_words(text)
                found = super_kmers(cache.of(words), window, width, powers)
                if not found:
                    continue
                runs, kinds, ns = (places.values.field(i).to_numpy() for i in range(3))
                first, last, _, mini, whole = found
                whole = whole.view(np.int64)
                mini = mini.view(np.int64)
                for kind in (SURE, MIXED, SHOWN):
                    wanted = kinds == kind
                    at = np.flatnonzero(np.isin(whole, runs[wanted]))
                    if not len(at):
                        continue
                    if kind == SHOWN:  # the first of each run stands for all
                        at = at[np.sort(np.unique(whole[at], return_index=True)[1])]
                    if kind == SURE:
                        starts = np.flatnonzero(np.diff(at, prepend=at[0] - 2) > 1)
                        ends = np.append(starts[1:], len(at)) - 1
                        f, e = first[at[starts]], last[at[ends]]
                        m = w = n = np.zeros(len(f), np.int64)
                        packed: list = [None] * len(f)
                    else:
                        f, e, m, w = first[at], last[at], mini[at], whole[at]
                        n, packed = np.ones(len(f), np.int64), [None] * len(f)
                        if kind == SHOWN:
                            number = dict(zip(runs[wanted].tolist(), ns[wanted].tolist(), strict=True))
                            n = np.array([number[x] for x in w.tolist()])
                            packed = [b" ".join(words[i : j + window]) for i, j in zip(f.tolist(), e.tolist(), strict=True)]
                            size += sum(map(len, packed))
                    same = len(f)
                    out.append((np.full(same, k), np.full(same, h), f, e - f + 1, np.full(same, kind), m, w, n, packed))
                if size > 8_000_000 or len(out) > 2000:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    return run


CUT = "k long, h long, start int, windows int, kind int, mini long, run long, n long, packed binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    cols = list(zip(*rows, strict=True))
    arrays = [pa.array(np.concatenate(c), t, safe=False) for c, t in zip(cols, kinds, strict=False)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([x for c in cols[8] for x in c], pa.binary())], names=["k", "h", "start", "windows", "kind", "mini", "run", "n", "packed"])


def _windows(packed: bytes, window: int) -> list[bytes]:
    words = packed.split(b" ")
    return [b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]


def _counted(window: int):
    """A bucket's rows: its windows are sorted, and for each super-k-mer those that occur twice or more are told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["mini"]):
            seen: dict[int, tuple[int, bytes]] = {}
            for whole, n, packed in zip(t["run"].to_pylist(), t["n"].to_pylist(), t["packed"], strict=True):
                seen.setdefault(whole, (n, packed.as_py()))
            rows = sorted((w, whole, i, n) for whole, (n, packed) in seen.items() for i, w in enumerate(_windows(packed, window)))
            runs, at = [], []
            s = 0
            while s < len(rows):
                e, total = s, 0
                while e < len(rows) and rows[e][0] == rows[s][0]:
                    total += rows[e][3]
                    e += 1
                if total > 1:
                    runs += [r[1] for r in rows[s:e]]
                    at += [r[2] for r in rows[s:e]]
                s = e
            yield pa.RecordBatch.from_arrays([pa.array([t["mini"][0].as_py()] * len(at), pa.int64()), pa.array(runs, pa.int64()), pa.array(at, pa.int32())], names=["mini", "run", "at"])

    return run


def _single(window: int):
    """The windows of super-k-mers of large buckets, one by one, as 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for mini, whole, n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                for i, w in enumerate(_windows(packed.as_py(), window)):
                    d = xxhash.xxh3_128_digest(w)
                    out.append((mini, whole, i, n, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(cols)], names=["mini", "run", "at", "n", "w1", "w2"])

    return run


def _removed(window: int):
    """Rows (id, text, spans of covered words): what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            start = size = 0
            for i, (text, spans) in enumerate(zip(texts(batch.column(1)), batch.column(2), strict=True)):
                words = split_words(text)
                stay = words
                if spans.is_valid:
                    stay, at = [], 0
                    for s, e in sorted((p["lo"], p["hi"]) for p in spans.as_py()):
                        if s > at:
                            stay += words[at:s]
                        at = max(at, e)
                    stay += words[at:]
                n.append(len(words))
                gone.append(len(words) - len(stay))
                kept.append(b" ".join(stay))
                size += len(kept[-1])
                if size > 8_000_000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(n)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=["id", "n_words", "n_removed", "kept"])
                    start, size, n, gone, kept = i + 1, 0, [], [], []

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, width: int = MINIMISER) -> DataFrame:
    """Removes every word covered by a window of words that also starts anywhere else in the corpus.

    Consecutive windows with one minimiser form a super-k-mer. First only hashes travel: a minimiser that occurs once has no
    repeated window; one whose super-k-mers are all the same sequence has only repeated ones. The super-k-mers of the
    others go, one of each sequence with its number, as packed strings to the minimiser's bucket, where sorting
    counts their windows exactly. Buckets with over BUCKET sequences (very common passages) are counted window by window
    with partial sums instead, so no bucket gathers in one task.

    Nulls: a null text has no words; a null id is carried, ids are of any type. Rows that repeat an id are documents of their own, and repeat each other's
    windows. Texts under window words lose nothing. Empty tables give empty results. Extra columns are ignored.

    Returns id_col, n_words, n_removed, kept (binary UTF-8: the words that stay, joined by one space).
    """
    spark = session(docs)
    work = Workspace(spark, "substrings")
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t")).select("id", "t", F.xxhash64("id", "t").alias("k"), F.xxhash64(F.lit(3), "t", "id").alias("h"))
    kind = src.schema["id"].dataType.simpleString()
    mini = work.put(src.select("k", "t").mapInArrow(_minimisers(window, width), "k long, mini long, run long"), "minimisers")
    often = mini.groupBy("mini").agg(F.count("*").alias("c"), F.min("run").alias("lo"), F.max("run").alias("hi")).where("c > 1").select("mini", (F.col("lo") < F.col("hi")).alias("mixed"))
    often = work.put(often, "often")  # written, so that Spark can split a skewed side of the join
    found = work.put(mini.join(often, "mini").select("k", "mini", "run", "mixed"), "repeated")
    work.drop("minimisers")
    shown = found.where("mixed").groupBy("mini", "run").agg(F.count("*").alias("n"), F.min("k").alias("k")).select("k", "run", F.lit(SHOWN).alias("kind"), "n")
    places = found.select("k", "run", F.when(F.col("mixed"), MIXED).otherwise(SURE).alias("kind"), F.lit(1).cast("long").alias("n")).union(shown)
    places = places.groupBy("k").agg(F.collect_set(F.struct("run", "kind", "n")).alias("places"))
    cut = work.put(src.join(places, "k").select("k", "h", "t", "places").mapInArrow(_cut(window, width), CUT), "cut")
    # rows that are equal in all chose the same document; of each run one row goes on
    packed = cut.where(F.col("kind") == SHOWN).groupBy("mini", "run").agg(F.first("n").alias("n"), F.first("packed").alias("packed"))
    packed = work.put(packed, "packed")
    sizes = packed.groupBy("mini").agg(F.count("*").alias("size"))
    small = packed.join(sizes.where(F.col("size") <= BUCKET).select("mini"), "mini", "left_semi")
    twice = small.repartition(partitions(spark), "mini").sortWithinPartitions("mini", "run").mapInArrow(_counted(window), "mini long, run long, at int")
    single = packed.join(sizes.where(F.col("size") > BUCKET).select("mini"), "mini", "left_semi").select("mini", "run", "n", "packed").mapInArrow(_single(window), "mini long, run long, at int, n long, w1 long, w2 long")
    single = work.put(single.dropDuplicates(["mini", "run", "at"]), "single")
    common = single.groupBy("w1", "w2").agg(F.sum("n").alias("c")).where("c > 1").select("w1", "w2")
    twice = work.put(twice.union(single.join(common, ["w1", "w2"], "left_semi").select("mini", "run", "at")), "twice")
    marks = work.put(twice.groupBy("mini", "run").agg(F.collect_list("at").alias("ats")), "marks")  # written for the same reason
    span = lambda lo, windows: F.struct(lo.cast("int").alias("lo"), (lo + windows + window - 1).cast("int").alias("hi"))
    sure = cut.where(F.col("kind") == SURE).select("k", "h", span(F.col("start"), F.col("windows")).alias("s"))
    rest = cut.where(F.col("kind") == MIXED).select("k", "h", "start", "mini", "run").join(marks, ["mini", "run"]).select("k", "h", F.explode(F.transform("ats", lambda a: span(F.col("start") + a, F.lit(1)))).alias("s"))
    spans = sure.union(rest).groupBy("k", "h").agg(F.collect_set("s").alias("spans"))
    out = src.join(spans, ["k", "h"], "left").select("id", "t", "spans").mapInArrow(_removed(window), f"id {kind}, n_words long, n_removed long, kept binary")
    return work.last(out.withColumnRenamed("id", id_col), "often", "packed", "single", "twice")


ORACLE = rf"""
WITH w AS (SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT n, i, array_to_string(ws[i:i+{WINDOW - 1}], ' ') AS g FROM (SELECT n, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
r AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY g) AS c FROM s) WHERE c > 1),
gone AS (SELECT DISTINCT n, i + j AS p FROM r, (SELECT unnest(range(0, {WINDOW})) AS j)),
each AS (SELECT n, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT n, count(*) AS c, string_agg(word, ' ' ORDER BY p) AS t FROM each WHERE (n, p) NOT IN (SELECT n, p FROM gone) GROUP BY n)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(c, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (n)
"""


def query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
