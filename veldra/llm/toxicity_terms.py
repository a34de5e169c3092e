"""Toxicity (operator 10) over every term: nearest labelled examples by exact cosine of TF-IDF times what labels tell of a term, over postings of all terms of the examples."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, kept_last, partitions, session, trimmed
from .toxicity import EXAMPLES, FOLD, NEIGHBOURS, STEMS, beginnings, calibrated, sized, vote

#: Examples at the base rate that are added to those of a term, and the least that a term tells, so that none is left out. SMOOTH is the best of 0.3, 1, 5, 20 and 100
#: by log loss in a five-fold cross-validation inside the rows that are learnt from at sf0.1.
SMOOTH, LEAST = 0.3, 0.001
#: Least squared weight, for the part of the examples that have the term, of a term that has postings (or is in the matrix); others are summed for
#: candidates only, WIDE candidates at once.
TIERS, WIDE = (3.0,), 500
#: Terms of the dense matrix at most, its entries at most, and one of how many examples must have such a term; texts that are multiplied by it at once.
DENSE, ROOM, SPARSE, TEXTS = 1024, 20_480_000, 32, 128
#: Part of a product by which single precision may be wrong, over at most DENSE terms; postings of more examples than LONG are copied whole.
NEAR, LONG = 2e-4, 250
#: Kinds of texts by the terms of the matrix that they have, examples by which kinds are told, texts that are dealt to kinds at once. A term that fewer than one of
#: SELDOM texts of a product have, or a product of more than MOSTLY of all terms: it costs less to add it text by text, or to take the whole matrix.
KINDS, TOLD, DEALT, SELDOM, MOSTLY = 4, 2048, 2048, 10, 0.8
#: Terms whose frequencies travel in one row.
PART = 8192


def vocabulary(words: pa.Array) -> list[pa.Array]:
    """All terms of the words, by kind: themselves, and the beginnings of longer ones of each length."""
    return [words, *(pc.unique(beginnings(words, k)).drop_null() for k in STEMS)]


def places(words: pa.Array, values: pa.Array) -> np.ndarray:
    """Where each word stands among the values, which are distinct; -1 for none. The table to look in is made of the fewer."""
    if len(values) <= len(words):
        return pc.index_in(words, value_set=values).fill_null(-1).to_numpy()
    coded = words.dictionary_encode()
    found = pc.index_in(values, value_set=coded.dictionary)
    at = np.full(len(coded.dictionary) + 1, -1, np.int32)  # the last one for null
    at[found.drop_null().to_numpy()] = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
    return at[coded.indices.fill_null(len(coded.dictionary)).to_numpy()]


def counted(column: pa.Array, known: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Some texts at once, in order: where each one's entries end, and their known terms, ascending in each text, and how often they come."""
    first = np.cumsum([0, *map(len, known)])
    for words, code, row, many in sized(column):
        keys = []
        for values, start, k in zip(known, first, (0, *STEMS), strict=False):
            at = places(beginnings(words, k) if k else words, values)[code].astype(np.int64)
            keys.append((row[at >= 0].astype(np.int64) << 32) | (at[at >= 0] + start))
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        yield np.cumsum(np.bincount(key >> 32, minlength=many)), (key & 0xFFFFFFFF).astype(np.int32), n


def telling(found: np.ndarray, marked: np.ndarray, base: float) -> np.ndarray:
    """How far the log odds of label 1 among the examples with a term lie from those of all examples."""
    p = (marked + SMOOTH * base) / (found + SMOOTH)
    return LEAST + np.abs(np.log(p / (1 - p)) - math.log(base / (1 - base)))


def kinds(patterns: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Unit centres of KINDS groups of rows that have like patterns (spherical k-means)."""
    unit = patterns / np.maximum(np.linalg.norm(patterns, axis=1, keepdims=True), 1e-9)
    centres = unit[np.linspace(0, len(unit) - 1, KINDS).astype(np.int64)]
    for _ in range(rounds):
        of = (unit @ centres.T).argmax(axis=1)
        centres = np.stack([unit[of == g].mean(axis=0) if (of == g).any() else centres[g] for g in range(KINDS)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return centres.astype(np.float32)


def largest(x: np.ndarray, k: int) -> float:
    """The k-th largest number of x, told among those that aren't below the k-th largest of the maxima of 32 by 32."""
    wide = len(x) // 32
    if wide >= 2 * k:
        x = x[x >= np.partition(x[: 32 * wide].reshape(32, wide).max(axis=0), wide - k)[wide - k]]
    return float(np.partition(x, len(x) - k)[len(x) - k])


def small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(x.max(initial=0)))


class Postings:
    """Examples by all their terms; nearest() is exact.

    The commonest terms stand in a dense matrix, by which many texts that have like terms of it are multiplied at once, in single precision. Other terms that weigh much or are rare have
    postings. What the terms that are left can add to a product is at most the product of both norms over them. All that makes bounds; the few examples
    that may be among the nearest by them are summed term by term, in double precision.

    parts() gives examples a part at a time: places, numbers of terms (some each), terms and counts; n: examples; weights: of every term.
    """

    def __init__(self, parts: Callable[[], Iterator[tuple[np.ndarray, ...]]], n: int, weights: np.ndarray):
        self.n, self.square = n, weights**2
        found, many = np.zeros(len(weights), np.int64), np.zeros(0, np.int64)
        for _, _, terms, counts in parts():
            found += np.bincount(terms, minlength=len(weights))
            many = np.union1d(many, counts.astype(np.int64))
        logs = 1 + np.log(many)
        self.tier = np.searchsorted(-np.array(TIERS), -self.square * n / np.maximum(found, 1)).astype(np.int8)
        common = np.argsort(-found, kind="stable")[: min(DENSE, ROOM // max(1, n))]
        common = common[found[common] * SPARSE >= n]
        self.dense = np.full(len(weights), -1, np.int32)  # the term's row in the matrix
        self.dense[common] = np.arange(len(common))
        # terms that are summed for the candidates only, by numbers of their own
        self.late = np.full(len(weights), -1, np.int32)
        late = np.flatnonzero((self.tier > 0) | (self.dense >= 0))
        self.late[late] = np.arange(len(late))
        self.size_of = np.where(self.late < 0, found, 0)
        self.off = np.concatenate([[0], np.cumsum(self.size_of)])
        self.row, self.unit = np.empty(self.off[-1], np.uint16 if n < 1 << 16 else np.int32), np.empty(self.off[-1])
        self.start, self.size, self.rest = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.float32)
        self.matrix, self.seen = np.zeros((len(common), n), np.float32), np.zeros(len(late))
        self.terms, self.value = np.empty(found[late].sum(), np.uint16 if len(late) < 1 << 16 else np.int32), np.empty(found[late].sum())
        used, next_ = 0, self.off[:-1].copy()
        for places, sizes, terms, counts in parts():
            of = np.repeat(np.arange(len(sizes)), sizes)
            tf = logs[np.searchsorted(many, counts)]
            square = tf * tf * self.square[terms]
            norm = np.sqrt(np.bincount(of, square, len(sizes)))
            unit = tf * self.square[terms] / norm[of]  # the text's weight is in it too
            late, dense = self.late[terms], self.dense[terms]
            by = np.flatnonzero(late < 0)
            by = by[np.argsort(terms[by], kind="stable")]
            here = np.bincount(terms[by], minlength=len(weights))
            at = next_[terms[by]] + np.arange(len(by)) - (np.cumsum(here) - here)[terms[by]]
            self.row[at], self.unit[at] = places[of[by]], unit[by]
            next_ += here
            self.rest[places] = np.sqrt(np.bincount(of, square * ((late >= 0) & (dense < 0)), len(sizes))) / norm
            own = dense >= 0
            self.matrix[dense[own], places[of[own]]] = unit[own]
            own = late >= 0
            some = np.bincount(of[own], minlength=len(sizes))
            self.size[places], self.start[places] = some, used + np.cumsum(some) - some
            self.terms[used : used + some.sum()], self.value[used : used + some.sum()] = late[own], unit[own]
            used += int(some.sum())
        self.centres = kinds((self.matrix[:, :: max(1, -(-n // TOLD))] != 0).T.astype(np.float32)) if n and len(common) else None

    def _summed(self, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """What terms that have postings add to the products with all examples. Short postings are read by their places, long ones are copied."""
        size = self.size_of[terms]
        order = np.argsort(2 * (size > LONG) + (tf != 1), kind="stable")  # in both, terms that come once are first: they are multiplied by nothing
        size, low, tf = size[order], self.off[terms[order]], tf[order]
        k = int((size <= LONG).sum())
        ends = np.cumsum(size[:k])
        at = np.repeat(low[:k] - ends + size[:k], size[:k])
        at += np.arange(len(at))
        cuts = list(map(slice, low[k:].tolist(), (low[k:] + size[k:]).tolist()))
        weight = np.concatenate([self.unit[at], *(self.unit[c] for c in cuts)])
        for lo, hi, start, end in ((0, k, 0, len(at)), (k, len(tf), len(at), len(weight))):
            lo += int((tf[lo:hi] == 1).sum())
            weight[end - int(size[lo:hi].sum()) : end] *= np.repeat(tf[lo:hi], size[lo:hi])
        return np.bincount(np.concatenate([self.row[at], *(self.row[c] for c in cuts)]), weight, self.n)

    def _added(self, late: np.ndarray, tf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What terms without postings add to the products with some examples."""
        self.seen[late] = tf
        out = np.zeros(len(at))
        full = np.flatnonzero(self.size[at])
        for lo in range(0, len(full), max(1, WIDE)):
            mine = full[lo : lo + max(1, WIDE)]
            some = at[mine]
            many = self.size[some]
            cuts = list(map(slice, self.start[some].tolist(), (self.start[some] + many).tolist()))
            got = self.seen[np.concatenate([self.terms[c] for c in cuts])]
            got *= np.concatenate([self.value[c] for c in cuts])
            out[mine] = np.add.reduceat(got, np.cumsum(many) - many)
        self.seen[late] = 0
        return out

    def _dense(self, dense: np.ndarray, tf: np.ndarray, of: np.ndarray, many: int) -> np.ndarray:
        """What terms of the matrix add to the products of some texts with all examples, up to NEAR of it."""
        often = np.bincount(dense, minlength=len(self.matrix)) * SELDOM >= many
        texts = np.zeros((many, len(self.matrix)), np.float32)
        if often.sum() > MOSTLY * len(often):
            texts[of, dense] = tf
            return texts @ self.matrix
        own = often[dense]
        texts[of[own], dense[own]] = tf[own]
        out = texts[:, often] @ self.matrix[often]
        for j, d, x in zip(of[~own].tolist(), dense[~own].tolist(), tf[~own].astype(np.float32), strict=True):
            out[j] += x * self.matrix[d]
        return out

    def _dealt(self, of: np.ndarray, dense: np.ndarray, many: int) -> np.ndarray:
        """Some texts, those of one kind beside each other."""
        if self.centres is None or many <= TEXTS:
            return np.arange(many)
        patterns = np.zeros((many, len(self.matrix)), np.float32)
        patterns[of[dense >= 0], dense[dense >= 0]] = 1
        return np.argsort((patterns @ self.centres.T).argmax(axis=1), kind="stable")

    def nearest(self, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray, k: int, skip: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its k examples (but its skip) of largest cosine, ties by place, and the cosines; those of cosine 0 are left out."""
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        for lo in range(0, len(ends), DEALT):
            here = slice(starts[lo], ends[min(lo + DEALT, len(ends)) - 1])
            yield from self._nearest(ends[lo : lo + DEALT] - starts[lo], terms[here], counts[here], k, None if skip is None else skip[lo : lo + DEALT])

    def _nearest(self, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray, k: int, skip: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        tf, dense, late = 1 + np.log(counts.astype(np.float64)), self.dense[terms], self.late[terms]
        square = tf * tf * self.square[terms]
        sizes = np.diff(ends, prepend=0)
        of = np.repeat(np.arange(len(ends)), sizes)
        norm = np.sqrt(np.bincount(of, square, len(ends)))
        rest = np.sqrt(np.bincount(of, square * ((late >= 0) & (dense < 0)), len(ends)))
        starts, stops = (ends - sizes).tolist(), ends.tolist()
        order = self._dealt(of, dense, len(ends)).tolist()
        out: list = [None] * len(ends)
        for lo in range(0, len(order), TEXTS):
            some = order[lo : lo + TEXTS]
            cuts = [starts[j] + np.flatnonzero(dense[starts[j] : stops[j]] >= 0) for j in some]
            own = np.concatenate(cuts)
            near = self._dense(dense[own], tf[own], np.repeat(np.arange(len(some)), [len(c) for c in cuts]), len(some))
            for i, j in enumerate(some):
                here = slice(starts[j], stops[j])
                out[j] = self._best(near[i], terms[here], late[here], tf[here], norm[j], rest[j], k, -1 if skip is None else int(skip[j]))
        return out

    def _best(self, near: np.ndarray, terms: np.ndarray, late: np.ndarray, tf: np.ndarray, norm: float, rest: float, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        exact = self._summed(terms[late < 0], tf[late < 0])
        near += exact
        if skip >= 0:
            near[skip] = 0
        most = self.rest * np.float32(rest * (1 + NEAR))
        least = largest(near, k) * (1 - NEAR) if self.n > k else 0.0
        most += near * np.float32(1 + NEAR)
        at = np.flatnonzero(most >= least) if least > 0 else np.flatnonzero(most > 0)
        at = at[at != skip]
        products = exact[at] + self._added(late[late >= 0], tf[late >= 0], at)
        at, products = at[products > 0], products[products > 0]
        if not len(at):
            return at, np.empty(0)
        cosines = (products / norm).round(12)
        best = np.lexsort((at, -cosines))[:k]
        return at[best], cosines[best]


@trimmed
def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, *_ in sized(batch.column(0)):
            yield pa.RecordBatch.from_arrays([words.cast(pa.string())], names=["word"])


def _found(known: list[pa.Array]):
    """Texts to the number of them that hold each known term, in parts of the terms."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(map(len, known)), np.int64)
        for batch in batches:
            for _, terms, _ in counted(batch.column(0), known):
                total += np.bincount(terms, minlength=len(total))
        parts = [k for k in range(-(-len(total) // PART)) if total[k * PART : (k + 1) * PART].any()]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([total[k * PART : (k + 1) * PART].tobytes() for k in parts], pa.binary())], names=["part", "found"])

    return run


@trimmed
def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[part] = total.get(part, 0) + np.frombuffer(found, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "found"])


def _packed(known: list[pa.Array]):
    """Rows (hash, text) of examples to the entries of some of them at once, in few bytes."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            done = 0
            for ends, terms, counts in counted(batch.column(1), known):
                hashes = batch.column(0).slice(done, len(ends)).to_numpy()
                done += len(ends)
                step = np.diff(terms, prepend=0)
                step[ends[:-1][ends[:-1] < len(terms)]] = terms[ends[:-1][ends[:-1] < len(terms)]]  # each text begins anew
                plain = pickle.dumps((hashes, small(np.diff(ends, prepend=0)), small(step), small(counts)))
                yield pa.RecordBatch.from_arrays([pa.array([len(plain)], pa.int64()), pa.array([codec.compress(plain, asbytes=True)], pa.binary())], names=["size", "data"])

    return run


def unpacked(size: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of some examples, how many entries each has, their terms and counts."""
    hashes, sizes, step, counts = pickle.loads(pa.Codec("zstd").decompress(data, size, asbytes=True))
    sizes, total = sizes.astype(np.int64), np.cumsum(step.astype(np.int64))
    before = np.concatenate([[0], total])[np.cumsum(sizes) - sizes]
    return hashes, sizes, (total - np.repeat(before, sizes)).astype(np.int32), counts


def opened(blobs: list[tuple[int, bytes]], idfs: np.ndarray, hashes: np.ndarray, labels: np.ndarray, base: float) -> Postings:
    """The examples that have terms, by ascending hash."""

    def parts() -> Iterator[tuple[np.ndarray, ...]]:
        for size, data in blobs:
            own, sizes, terms, counts = unpacked(size, data)
            yield np.searchsorted(hashes, own[sizes > 0]), sizes[sizes > 0], terms, counts

    found, marked = np.zeros(len(idfs)), np.zeros(len(idfs))
    for places, sizes, terms, _ in parts():
        found += np.bincount(terms, minlength=len(idfs))
        marked += np.bincount(terms, np.repeat(labels[places], sizes), len(idfs))
    return Postings(parts, len(hashes), idfs * telling(found, marked, base))


def _left_out(name: str, blobs: list[tuple[int, bytes]], idfs: np.ndarray, known: list[pa.Array], hashes: np.ndarray, labels: np.ndarray, base: float):
    """Rows (hash, text) of examples: place in the index, and the vote of the other examples; none without terms or neighbours."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = kept_last("toxicity-terms", hash(name), lambda: opened(blobs, idfs, hashes, labels, base))
        for batch in batches:
            done, places, votes = 0, [], []
            for ends, terms, counts in counted(batch.column(1), known):
                own = batch.column(0).slice(done, len(ends)).to_numpy()
                done += len(ends)
                at = np.searchsorted(hashes, own)
                at = np.where(np.diff(ends, prepend=0) > 0, at, -1)
                for place, (rows, cosines) in zip(at.tolist(), index.nearest(ends, terms, counts, NEIGHBOURS, at), strict=True):
                    if len(rows):
                        places.append(place)
                        votes.append(vote(labels[rows], cosines, base))
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(votes, pa.float64())], names=["at", "vote"])

    return run


def _scores(name: str, blobs: list[tuple[int, bytes]], idfs: np.ndarray, known: list[pa.Array], hashes: np.ndarray, labels: np.ndarray, ids: list, base: float, curve: tuple[float, float], none: float, kind: pa.DataType):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = kept_last("toxicity-terms", hash(name), lambda: opened(blobs, idfs, hashes, labels, base))
        memo: dict[bytes, tuple[float, list]] = {}
        for batch in batches:
            out: list[tuple[float, list]] = []
            for ends, terms, counts in counted(batch.column(1), known):
                if len(memo) >= 50_000:
                    memo.clear()
                starts = np.concatenate([[0], ends[:-1]]).tolist()
                keys = [xxhash.xxh3_128_digest(terms[a:b].tobytes() + counts[a:b].tobytes()) for a, b in zip(starts, ends.tolist(), strict=True)]
                at = np.array(list({key: j for j, key in enumerate(keys) if key not in memo}.values()), np.int64)
                take = np.concatenate([np.arange(starts[j], ends[j]) for j in at.tolist()]) if len(at) else np.zeros(0, np.int64)
                some = np.cumsum([int(ends[j]) - starts[j] for j in at.tolist()]).astype(np.int64)
                for j, (rows, cosines) in zip(at.tolist(), index.nearest(some, terms[take], counts[take], NEIGHBOURS), strict=True):
                    if len(rows):
                        x = curve[0] * vote(labels[rows], cosines, base) + curve[1]
                        memo[keys[j]] = (1 / (1 + math.exp(-min(30.0, max(-30.0, x)))), [ids[r] for r in rows[:3].tolist()])
                    else:
                        memo[keys[j]] = (none, [])
                out += [memo[key] for key in keys]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pa.list_(kind))], names=["id", "score", "evidence"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES) -> DataFrame:
    """Scores every whole text by its nearest labelled examples, over every term.

    Terms are words and the first letters of longer words. Every term of an example spans the space, however rare or common it is; a term that no example has
    can't add to a product and is left out. A term weighs its IDF (document frequencies come from all documents) times what the examples' labels tell of it. At most examples labelled rows (smallest
    hash of the id) are the index; equal texts are one example. The NEIGHBOURS nearest by cosine are exact. They vote by distance; a
    logistic curve, fitted to the votes that each example gets from the others, turns votes into probabilities.

    Null and empty texts, and texts without a term of the space, get the rate of label 1 among such examples and have no evidence.
    Labels that are null or that have no document are left out; a null id is scored but never learnt from. Repeated rows each get a
    result; the larger of an id's labels counts. With labels of one kind only, or none, every score is their rate (none: 0). Ties of cosine go by the hash of the
    example's text. Empty tables give empty results. Ids are of any type. Extra columns are ignored, whatever their names. Very long
    texts are counted whole, in memory.

    Returns id_col, score (0 to 1), evidence (ids of up to three nearest examples).
    """
    spark = session(docs)
    work = Workspace(spark, "toxicity-terms")
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    kind = src.schema["id"].dataType.simpleString()
    own = labels.select(F.col(f"`{id_col}`").cast("string").alias("key"), F.col(f"`{label_col}`").cast("int").alias("y")).where("key IS NOT NULL AND y IS NOT NULL")
    own = work.put(own.groupBy("key").agg(F.max("y").alias("y")).orderBy(F.xxhash64("key"), "key").limit(examples), "examples")  # at most examples rows of an id and a number
    # equal texts are told by a 64-bit hash, of which two of the examples share one with chance 1e-11
    hashed = src.select("id", F.xxhash64("t").alias("h"), "t")
    train = hashed.select("id", "h", F.col("id").cast("string").alias("key")).join(F.broadcast(own), "key")
    train = work.put(train.groupBy("h").agg(F.min("id").alias("id"), F.max("y").alias("y")), "train")
    told = train.orderBy("h").toArrow()
    y = (told["y"].to_numpy() > 0).astype(np.int64) if len(told) else np.zeros(0, np.int64)
    base = float(y.mean()) if len(y) else 0.0
    if not 0 < base < 1:
        work.close()
        return src.select(F.col("id").alias(id_col), F.lit(base).alias("score"), F.array().cast(f"array<{kind}>").alias("evidence"))
    rows = work.put(hashed.join(F.broadcast(train.select("h", "id")), ["h", "id"]).groupBy("h").agg(F.first("t").alias("t")), "rows")  # at most examples texts
    words = rows.select("t").mapInArrow(_words, "word string").distinct().toArrow()["word"].combine_chunks()
    known = vocabulary(words.take(pc.sort_indices(words)))
    found = src.select("t").mapInArrow(_found(known), "part int, found binary").repartition(partitions(spark), "part").mapInArrow(_summed, "part int, found binary").collect()
    n = src.count()
    idfs = np.zeros(sum(map(len, known)))
    for r in found:
        counts = np.frombuffer(r["found"], np.int64)
        idfs[r["part"] * PART : r["part"] * PART + len(counts)] = np.log((1 + n) / (1 + counts)) + 1
    blobs = [(r["size"], bytes(r["data"])) for r in rows.select("h", "t").mapInArrow(_packed(known), "size long, data binary").collect()]
    sizes = dict.fromkeys(told["h"].to_pylist(), 0)
    codec = pa.Codec("zstd")
    for size, data in blobs:
        hashes, many, *_ = pickle.loads(codec.decompress(data, size, asbytes=True))
        sizes.update(zip(hashes.tolist(), many.tolist(), strict=True))
    sizes = np.array(list(sizes.values()), np.int64)
    full = np.flatnonzero(sizes)
    hashes, ids, mine = told["h"].to_numpy()[full], told["id"].take(pa.array(full)).to_pylist(), y[full]
    none = (float(y[sizes == 0].sum()) + base) / (int((sizes == 0).sum()) + 1)
    votes = rows.select("h", "t").repartition(partitions(spark)).mapInArrow(_left_out(work.root, blobs, idfs, known, hashes, mine, base), "at long, vote double").collect()
    curve = (1.0, 0.0)
    if votes:
        votes = sorted((r["at"], r["vote"]) for r in votes)
        curve = calibrated(np.array([v for _, v in votes]), mine[[at for at, _ in votes]])
    out = src.mapInArrow(_scores(work.root, blobs, idfs, known, hashes, mine, ids, base, curve, none, told.schema.field("id").type), f"id {kind}, score double, evidence array<{kind}>")
    work.close()
    return out.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """Learns from the rows of the other folds only; every document is scored."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLD)) != 0)
    out = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLD)) == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
