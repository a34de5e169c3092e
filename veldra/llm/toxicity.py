"""Toxicity (operator 10): nearest labelled examples by exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, kept_last, partitions, session, texts

#: Labelled rows that the index holds at most: those of smallest hash of their id.
EXAMPLES = 20_000
#: Shares of all documents between which a term's document frequency must lie: rarer terms tie a text to chance copies, commoner ones to
#: everything. These limits, the lengths of beginnings and the number of neighbours are the best of 72 settings by log loss in a five-fold
#: cross-validation inside the rows that are learnt from; the rows held out had no part in it.
LEAST_SHARE, MOST_SHARE = 0.015, 0.05
#: Part of LEAST_SHARE from which a chunk of documents tells of a term. Terms that may reach LEAST_SHARE of all documents are then
#: at most 4/3 / LEAST_SHARE times the mean number of terms of a document, whatever the number of documents.
SLACK = 0.25
NEIGHBOURS, BLOCK = 100, 256
#: Blocks that are opened before the bounds of the others are looked at.
FIRST = 1
#: Weight of the base rate beside the neighbours' votes.
PRIOR = 0.5
#: Lengths of the word beginnings that are terms beside whole words.
STEMS = (4, 5)
TOKEN = re.compile(r"\w+")
#: What stands for a byte of UTF-8: a space for signs of ASCII that are in no word, else itself.
ASCII = bytes(range(128))
PLAIN = bytes(k if k > 127 or TOKEN.match(chr(k)) else 32 for k in range(256))
#: Characters of texts whose words are told apart at once (a longer text is read alone).
SLICE = 4_000_000
FOLD = 5


def forms(word: str) -> tuple[str, ...]:
    """Terms of a word: itself, and the beginnings of a longer word, marked by a star."""
    return (word, *(word[:k] + "*" for k in STEMS if len(word) > k))


def term_counts(text: str) -> Counter:
    """Terms of a text and how often they come."""
    out: Counter = Counter()
    for w, n in Counter(TOKEN.findall(text.lower())).items():
        for f in forms(w):
            out[f] += n
    return out


def idf(n: int, found: int) -> float:
    return math.log((1 + n) / (1 + found)) + 1


def spaced(text: str) -> bytes:
    """The text in lower case with a space for each sign that is in no word of TOKEN, by a table of bytes; the few other signs of a text are looked at once each."""
    raw = text.lower().encode()
    if not raw.isascii():
        for sign in set(raw.translate(None, ASCII).decode()):
            if not TOKEN.match(sign):
                raw = raw.replace(sign.encode(), b" ")
    return raw.translate(PLAIN)


def tokens(text: str) -> list[str]:
    """The words of TOKEN in lower case."""
    return spaced(text).decode().split()


def sized(column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, int]]:
    """Some texts at once, in order: their distinct words, the number of each token's word, that of its text among them, and how many texts.

    Words are cut out of the bytes of all these texts at once, not one by one."""

    def told() -> tuple[pa.Array, np.ndarray, np.ndarray, int]:
        joined = b" ".join([b"", *held, b""])
        full = np.frombuffer(joined, np.uint8) != 32
        edges = np.flatnonzero(full[1:] != full[:-1]) + 1  # where words begin and end, in turns
        starts = edges[::2]
        offsets = np.concatenate([[0], np.cumsum(edges[1::2] - starts)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined.translate(None, b" "))])
        many = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in held)])))
        coded = words.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(), np.repeat(np.arange(len(held)), many), len(held)

    held: list[bytes] = []
    size = 0
    for text in texts(column):
        held.append(spaced(text))
        size += len(text)
        if size > SLICE:
            yield told()
            held, size = [], 0
    if held:
        yield told()


def beginnings(words: pa.Array, k: int) -> pa.Array:
    """The first k letters of longer words, marked by a star; null for others."""
    return pc.if_else(pc.greater(pc.utf8_length(words), k), pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, k), "*", ""), pa.scalar(None, pa.string()))


class Index:
    """Unit vectors of the examples, by term, in blocks of examples with the largest weight of each term in each block.

    nearest() opens the blocks of largest possible score, and then every other block that may hold one better than the k-th best so
    far, so it is exact. terms, counts: one entry for each term of each example; ends: where an example's entries end. It is sent
    as rows and counts, in the smallest types that hold them; all else is made again where it is read.
    """

    def __init__(self, terms: np.ndarray, counts: np.ndarray, ends: np.ndarray, labels: np.ndarray, idfs: np.ndarray):
        n = len(ends)
        row = np.repeat(np.arange(n), np.diff(ends, prepend=0))
        weights = (1 + np.log(counts)) * idfs[terms]
        norm = np.sqrt(np.bincount(row, weights * weights, n))
        # examples that share their heaviest terms stand together, so that few blocks can score high
        heavy = np.full((2, n), -1)
        by = np.lexsort((terms, -weights, row))
        rank = np.arange(len(by)) - np.concatenate([[0], ends[:-1]])[row[by]] if n else by
        for k in (0, 1):
            heavy[k, row[by][rank == k]] = terms[by][rank == k]
        self.order = np.lexsort((np.arange(n), heavy[1], heavy[0]))
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        by = np.lexsort((place[row], terms))
        self.row, self.count = place[row][by], counts[by]
        self.labels, self.norm, self.idfs = labels[self.order], norm[self.order], idfs
        self.ends = np.cumsum(np.bincount(terms, minlength=len(idfs)))
        self._derive()

    def __getstate__(self) -> dict:
        small = lambda x: x.astype(np.min_scalar_type(x.max(initial=0)))
        return {"row": small(self.row), "count": small(self.count), **{k: vars(self)[k] for k in ("order", "labels", "norm", "idfs", "ends")}}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self.row, self.count = self.row.astype(np.int64), self.count.astype(np.int64)
        self._derive()

    def _derive(self) -> None:
        self.n = len(self.labels)
        self.n_blocks = -(-self.n // BLOCK)
        terms = np.repeat(np.arange(len(self.idfs)), np.diff(self.ends, prepend=0))
        self.unit = (1 + np.log(self.count)) * self.idfs[terms] ** 2 / self.norm[self.row]  # the text's idf is in it too
        cell = terms * self.n_blocks + self.row // BLOCK
        self.off = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=len(self.idfs) * self.n_blocks))]).astype(np.int32)
        self.most = np.zeros(len(self.idfs) * self.n_blocks)
        np.maximum.at(self.most, cell, self.unit)
        self.most = self.most.reshape(len(self.idfs), self.n_blocks)

    def _opened(self, terms: np.ndarray, tf: np.ndarray, ones: int, blocks: np.ndarray) -> np.ndarray:
        """Products with all examples, 0 outside the blocks; the first ones terms come once in the text."""
        if 4 * len(blocks) > self.n_blocks:  # whole postings are faster than many cuts of them, and hold the same sums
            start, end = self.off[terms * self.n_blocks], self.off[(terms + 1) * self.n_blocks]
            cuts = list(map(slice, start.tolist(), end.tolist()))
            row, got, many = np.concatenate([self.row[c] for c in cuts]), np.concatenate([self.unit[c] for c in cuts]), end - start
        else:
            cell = terms[:, None] * self.n_blocks + blocks[None, :]
            start = self.off[cell]
            each = self.off[cell + 1] - start
            many, each, start = each.sum(axis=1), each.ravel(), start.ravel()
            at = np.arange(each.sum()) + np.repeat(start - np.cumsum(each) + each, each)
            row, got = self.row[at], self.unit[at]
        if ones < len(terms):
            got[int(many[:ones].sum()) :] *= np.repeat(tf[ones:], many[ones:])
        return np.bincount(row, got, self.n)

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples but skip of largest cosine (ties: first in the index) and their cosines; those of cosine 0 are left out."""
        if not self.n or not len(terms):
            return np.empty(0, np.int64), np.empty(0)
        by = np.argsort(counts > 1, kind="stable")
        terms, tf, ones = terms[by], 1 + np.log(counts[by]), int((counts == 1).sum())
        bound = tf @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        got = self._opened(terms, tf, ones, order[:FIRST])
        if skip >= 0:
            got[skip] = 0
        some = got[got > 0]
        least = np.partition(some, len(some) - k)[len(some) - k] * (1 - 1e-9) if len(some) >= k else 1e-12
        rest = order[FIRST:]
        rest = rest[bound[rest] * (1 + 1e-9) >= least]
        if len(rest):
            got = self._opened(terms, tf, ones, order[: FIRST + len(rest)])
            if skip >= 0:
                got[skip] = 0
        at = np.flatnonzero(got >= least)
        if len(at) > k:
            near = got[at]
            at = at[near >= np.partition(near, len(at) - k)[len(at) - k] * (1 - 1e-9)]
        cosines = (got[at] / np.sqrt(np.sum((tf * self.idfs[terms]) ** 2))).round(12)
        best = np.lexsort((at, -cosines))[:k]
        return at[best], cosines[best]


def vote(labels: np.ndarray, cosines: np.ndarray, base: float) -> float:
    """Log odds of label 1 by weights that fall with the distance, drawn towards the base rate (which lies inside 0 and 1)."""
    w = 1 / (0.1 + np.sqrt(np.maximum(0.0, 2 - 2 * cosines)))
    p = float((np.sum(w * labels) + PRIOR * base) / (np.sum(w) + PRIOR))
    return math.log(p / (1 - p))


def calibrated(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(a, b) of the logistic curve 1 / (1 + exp(-(a vote + b))) fitted to the votes by maximum likelihood; smoothed targets keep it
    finite. A curve that would fall is flat."""
    one = float(labels.sum())
    zero = len(labels) - one
    goal = np.where(labels > 0, (one + 1) / (one + 2), 1 / (zero + 2))
    for columns in ([0, 1], [1]):
        x = np.stack([votes, np.ones(len(votes))], axis=1)[:, columns]
        c = np.zeros(len(columns))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(len(c)), x.T @ (goal - p) - 1e-6 * c)
            c += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-10:
                break
        if len(c) == 1:
            return 0.0, float(c[0])
        if c[0] > 0:
            return float(c[0]), float(c[1])
    raise AssertionError


def _local_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms that reach SLACK * LEAST_SHARE of the documents of a chunk: their documents in it, and the chunk's."""
    seen: list[Counter] = [Counter() for _ in (0, *STEMS)]
    docs = 0

    def told():
        often = [(t, n) for counts in seen for t, n in counts.items() if n >= SLACK * LEAST_SHARE * docs]
        out = pa.RecordBatch.from_arrays([pa.array([t for t, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64()), pa.array([docs] * len(often), pa.int64())], names=["term", "found", "docs"])
        for counts in seen:
            counts.clear()
        return out

    for batch in batches:
        for words, code, row, many in sized(batch.column(0)):
            pair = np.unique(row.astype(np.int64) << 32 | code)
            row, code = pair >> 32, pair & 0xFFFFFFFF
            for counts, terms in zip(seen, [words, *(beginnings(words, k) for k in STEMS)], strict=True):
                coded = terms.dictionary_encode()
                of = coded.indices.fill_null(-1).to_numpy()[code]
                got = np.unique(row[of >= 0] << 32 | of[of >= 0]) & 0xFFFFFFFF  # a text counts once, whatever words begin alike
                counts.update(dict(zip(coded.dictionary.to_pylist(), np.bincount(got, minlength=len(coded.dictionary)).tolist(), strict=True)))
            docs += many
            if len(seen[0]) > 300_000:
                yield told()
                docs = 0
    yield told()


def _vectors(known: list[str]):
    """Rows (id, text) to the known terms of each text, in order, and how often they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = pa.array(known, pa.string())
        for batch in batches:
            sizes, terms, counts = [], [], []
            for words, code, row, many in sized(batch.column(1)):
                forms = [pc.index_in(x, value_set=space).fill_null(-1).to_numpy()[code] for x in (words, *(beginnings(words, k) for k in STEMS))]
                key, n = np.unique(np.concatenate([row[f >= 0].astype(np.int64) << 32 | f[f >= 0] for f in forms]), return_counts=True)
                sizes.append(np.bincount(key >> 32, minlength=many))
                terms.append((key & 0xFFFFFFFF).astype(np.int32))
                counts.append(n.astype(np.int32))
            ends = np.cumsum(np.concatenate([[0], *sizes])).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *x]))) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["id", "terms", "counts"])

    return run


def _inside(col_terms: pa.Array, col_counts: pa.Array, idfs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Terms and counts of each row; terms of idf 0 aren't part of the space."""
    terms, counts = col_terms.flatten().to_numpy(), col_counts.flatten().to_numpy()
    start = 0
    for end in np.cumsum(pc.list_value_length(col_terms).to_numpy()).tolist():
        t, n = terms[start:end], counts[start:end]
        at = idfs[t] > 0
        yield t[at].astype(np.int64), n[at]
        start = end


def _opened_once(packed: bytes) -> Index:
    """The index of this run, made once in a worker. Arrays travel, not the object, whose class a worker may not be able to import."""

    def made() -> Index:
        out = Index.__new__(Index)
        out.__setstate__(pickle.loads(packed))
        return out

    return kept_last("toxicity", hash(packed), made)


def _scores(packed: bytes, ids: list, base: float, curve: tuple[float, float], none: float, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _opened_once(packed)
        memo: dict[bytes, tuple[float, list]] = {}

        def scored(t: np.ndarray, n: np.ndarray) -> tuple[float, list]:
            rows, cosines = index.nearest(t, n, NEIGHBOURS)
            if not len(rows):
                return none, []
            x = curve[0] * vote(index.labels[rows], cosines, base) + curve[1]
            return 1 / (1 + math.exp(-min(30.0, max(-30.0, x)))), [ids[index.order[r]] for r in rows[:3]]

        for batch in batches:
            out = []
            for t, n in _inside(batch.column(1), batch.column(2), index.idfs):
                key = xxhash.xxh3_128_digest(t.tobytes() + n.tobytes())
                if key not in memo:
                    if len(memo) >= 50_000:
                        memo.clear()
                    memo[key] = scored(t, n)
                out.append(memo[key])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pa.list_(kind))], names=["id", "score", "evidence"])

    return run


def _left_out(packed: bytes, places: dict[int, int], base: float):
    """Rows (hash of the text, terms, counts) of examples: place in the index, and the vote of the other examples; null without a neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _opened_once(packed)
        for batch in batches:
            at, out = [places.get(h, -1) for h in batch.column(0).to_pylist()], []
            for k, (t, n) in zip(at, _inside(batch.column(1), batch.column(2), index.idfs), strict=True):
                rows, cosines = index.nearest(t, n, NEIGHBOURS, k)
                out.append(vote(index.labels[rows], cosines, base) if len(rows) and k >= 0 else None)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out, pa.float64())], names=["at", "vote"])

    return run


def space(docs: DataFrame, n: int) -> list[str]:
    """Terms whose document frequency may lie in the space's limits, and all that do; the exact frequencies tell.

    A term in LEAST_SHARE of all documents is in as many of some chunk. What chunks didn't tell counts with the most that it can be.
    """
    told = docs.select("t").mapInArrow(_local_terms, "term string, found long, docs long").groupBy("term").agg(F.sum("found").alias("found"), F.sum("docs").alias("docs"))
    most = F.col("found") + SLACK * LEAST_SHARE * (F.lit(n) - F.col("docs"))
    return sorted(r["term"] for r in told.where((most + 1e-6 >= LEAST_SHARE * n) & (F.col("found") <= MOST_SHARE * n + 1e-6)).select("term").collect())


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES) -> DataFrame:
    """Scores every whole text by its nearest labelled examples.

    Terms are words and the first letters of longer words; those in LEAST_SHARE to MOST_SHARE of all documents span the space, whatever
    the labels. Frequencies come from all documents. At most examples labelled rows (smallest hash of the id) are the index;
    equal texts are one example. The NEIGHBOURS nearest by cosine are exact, found over blocks of examples by their largest possible
    scores. They vote by distance; a logistic curve, fitted to the votes that each example gets from the others, turns votes
    into probabilities.

    Null and empty texts, and texts without a term of the space, get the rate of label 1 among such examples and have no evidence.
    Labels that are null or that have no document are left out; a null id is scored but never learnt from. Repeated rows each get a
    result; the larger of an id's labels counts. With labels of one kind only, or none, every score is their rate (none: 0). Ties of cosine go by order in the
    index, which depends on the examples alone. Empty tables give empty results. Ids are of any type. Extra columns are ignored, whatever their names. Very long
    texts are counted whole, in memory.

    Returns id_col, score (0 to 1), evidence (ids of up to three nearest examples).
    """
    spark = session(docs)
    work = Workspace(spark, "toxicity")
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    kind = src.schema["id"].dataType.simpleString()
    own = labels.select(F.col(f"`{id_col}`").cast("string").alias("key"), F.col(f"`{label_col}`").cast("int").alias("y")).where("key IS NOT NULL AND y IS NOT NULL")
    own = work.put(own.groupBy("key").agg(F.max("y").alias("y")).orderBy(F.xxhash64("key"), "key").limit(examples), "examples")  # at most examples rows of an id and a number
    # equal texts are told by a 64-bit hash, of which two of the examples share one with chance 1e-11
    train = src.select("id", F.col("id").cast("string").alias("key"), F.xxhash64("t").alias("h")).join(F.broadcast(own), "key")
    train = work.put(train.groupBy("h").agg(F.min("id").alias("id"), F.max("y").alias("y")), "train")
    n = src.count()
    known = space(src, n)
    make = _vectors(known)
    vectors = src.select(F.struct("id", F.xxhash64("t").alias("h")).alias("id"), "t").mapInArrow(make, f"id struct<id:{kind},h:bigint>, terms array<int>, counts array<int>")
    vectors = work.put(vectors.select("id.id", "id.h", "terms", "counts"), "vectors")
    idfs = np.zeros(len(known))
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():
        if LEAST_SHARE * n <= r["n"] <= MOST_SHARE * n:
            idfs[r["t"]] = idf(n, r["n"])
    rows = vectors.select("h", "terms", "counts").join(F.broadcast(train), "h").groupBy("h").agg(*(F.first(c).alias(c) for c in ("id", "y", "terms", "counts")))
    rows = work.put(rows, "rows")  # at most examples rows
    told = rows.orderBy("id", "h").toArrow()
    y = (told["y"].to_numpy() > 0).astype(np.int64) if len(told) else np.zeros(0, np.int64)
    base = float(y.mean()) if len(y) else 0.0
    if not 0 < base < 1:
        work.close()
        return src.select(F.col("id").alias(id_col), F.lit(base).alias("score"), F.array().cast(f"array<{kind}>").alias("evidence"))
    terms, counts = (pa.concat_arrays(told[c].chunks) for c in ("terms", "counts"))
    sizes = pc.list_value_length(terms).to_numpy()
    row, terms, counts = np.repeat(np.arange(len(told)), sizes), terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64)
    inside = idfs[terms] > 0
    sizes = np.bincount(row[inside], minlength=len(told))
    full = np.flatnonzero(sizes)
    index = Index(terms[inside], counts[inside], np.cumsum(sizes[full]), y[full], idfs)
    packed = pickle.dumps(index.__getstate__())
    blank = y[sizes == 0]
    none = (float(blank.sum()) + base) / (len(blank) + 1)
    curve = (1.0, 0.0)
    hashes, ids = told["h"].to_pylist(), told["id"].to_pylist()
    places = {hashes[full[i]]: at for at, i in enumerate(index.order.tolist())}
    votes = rows.select("h", "terms", "counts").repartition(partitions(spark), "h").mapInArrow(_left_out(packed, places, base), "at long, vote double").where("vote IS NOT NULL").collect()
    if votes:
        votes = sorted((r["at"], r["vote"]) for r in votes)
        curve = calibrated(np.array([v for _, v in votes]), index.labels[[at for at, _ in votes]])
    out = vectors.select("id", "terms", "counts").mapInArrow(_scores(packed, [ids[i] for i in full.tolist()], base, curve, none, told.schema.field("id").type), f"id {kind}, score double, evidence array<{kind}>")
    return work.last(out.withColumnRenamed("id", id_col), "examples", "train", "rows")


def query(spark, sf_dir: str) -> DataFrame:
    """Learns from the rows of the other folds only; every document is scored."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLD)) != 0)
    out = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLD)) == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
