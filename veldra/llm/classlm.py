"""Class-based language model (operator 12): Brown's class bigrams, classes by exchange, scores of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, free, kept_last, partitions, session, trimmed

#: Words at most that every task knows by heart, and bytes of such a word: the bound of what is broadcast.
HEAD, LONGEST = 1 << 18, 64
#: Classes beside that of the end of a text, and half rounds of exchange (each moves every other word).
CLASSES, ROUNDS = 32, 6
#: Words whose neighbours stand in one row, tokens whose pairs a task counts together, and entries it merges together.
TOGETHER, CHUNK, MERGE = 64, 1 << 20, 1 << 20
#: Entries of the table of neighbours that are opened at once, and words whose gains are told at once: what a task holds beside its batch.
OPENED, TOLD = 1 << 19, 4096
#: Steps of an octave in which frequencies are told apart when the known words are chosen.
STEPS = 64
SALT = 32
#: Bytes of texts that are split into words at once (a longer text is read alone), and words that are counted at once.
SLICE, COUNTED = 4_000_000, 3_000_000
FOLD, HELD = 7, 2


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(n: np.ndarray) -> float:
    """What of the log likelihood of class bigram counts depends on the classes."""
    return float(xlogx(n).sum() - xlogx(n.sum(axis=0)).sum() - xlogx(n.sum(axis=1)).sum())


def gains(n: np.ndarray, left: np.ndarray, right: np.ndarray, twice: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Change of likelihood() if a word that is in no class joins each class, for each of some words.

    n: class bigram counts, of which the word's are taken first if own tells its class. left, right: counts of the classes of its neighbours other
    than itself; twice: how often it follows itself. Only cells that the word touches are looked at.
    """
    words, c = left.shape
    out = np.zeros((words, c))
    each = np.arange(words)
    for side, other, rows in ((left, right, n), (right, left, n.T.copy())):
        told = xlogx(rows)
        at, k = np.nonzero(side)
        for lo in range(0, len(at), 1 << 12):
            i, j = at[lo : lo + (1 << 12)], k[lo : lo + (1 << 12)]
            r, base, was = side[i, j], rows[j], told[j]
            if own is not None:
                o, here = own[i], np.arange(len(i))
                same = np.flatnonzero(j == o)
                base[here, o] -= r
                base[same] -= other[i[same]]
                base[same, o[same]] -= twice[i[same]]
                was[here, o] = xlogx(base[here, o])
                was[same] = xlogx(base[same])
            base += r[:, None]
            gain = np.log(np.maximum(base, 1))
            gain *= base
            gain -= was
            edge = np.flatnonzero(np.diff(i, prepend=-1))
            out[i[edge]] += np.add.reduceat(gain, edge) if len(edge) else 0
    base = np.broadcast_to(np.diag(n), (words, c)).copy()
    row, col = np.broadcast_to(n.sum(axis=1), (words, c)).copy(), np.broadcast_to(n.sum(axis=0), (words, c)).copy()
    after, before = right.sum(axis=1) + twice, left.sum(axis=1) + twice
    if own is not None:
        base[each, own] -= left[each, own] + right[each, own] + twice
        row[each, own] -= after
        col[each, own] -= before
    # both sides and the word itself meet in the diagonal cell
    out += xlogx(base + left + right + twice[:, None]) + xlogx(base) - xlogx(base + left) - xlogx(base + right)
    return out - xlogx(row + after[:, None]) + xlogx(row) - xlogx(col + before[:, None]) + xlogx(col)


class Words:
    """The known words: numbers from 1 on; all others have the next number, and the end of a text has 0."""

    def __init__(self, packed: bytes):
        self.words = pa.array(packed.split(b"\n") if packed else [], pa.binary())
        self.rest = len(self.words) + 1

    def coded(self, column: pa.Array) -> Iterator[tuple[slice, pa.Array, np.ndarray, np.ndarray]]:
        """Some texts at once: which, their words, the numbers of their words and ends, the places of the ends among them."""
        for some, words, many in split(column):
            found = pc.index_in(words, value_set=self.words).fill_null(self.rest - 1).to_numpy()
            ends = np.cumsum(many + 1) - 1
            ids = np.zeros(len(words) + len(many), np.int32)
            ids[np.arange(len(words)) + np.repeat(np.arange(len(many)), many)] = found + 1
            yield some, words, ids, ends


def split(column: pa.Array) -> Iterator[tuple[slice, pa.Array, np.ndarray]]:
    """Some texts at once: which, their words with A to Z in lower case, and how many each has."""
    sizes = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy())
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SLICE, side="right")))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(column[lo:hi].fill_null("")))
        words = lists.flatten().cast(pa.binary())
        many = pc.list_value_length(lists).to_numpy()
        full = pc.greater(pc.binary_length(words), 0)
        if not pc.all(full).as_py():  # white space around a text gives empty words
            row = np.repeat(np.arange(len(many)), many)[full.to_numpy(zero_copy_only=False)]
            words, many = words.filter(full), np.bincount(row, minlength=len(many))
        yield slice(lo, hi), words, many
        lo = hi


def _known(packed: bytes) -> Words:
    return kept_last("classlm", xxhash.xxh3_64_intdigest(packed), lambda: Words(packed))


@trimmed
def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Array] = []
    ends = many = 0

    def told() -> pa.RecordBatch:
        counts = pa.chunked_array([*held, pa.array([], pa.binary())]).value_counts()
        words, n = counts.field("values"), counts.field("counts")
        return pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([b""], pa.binary())]), pa.concat_arrays([n, pa.array([ends], pa.int64())])], names=["word", "n"])

    for batch in batches:
        for some, words, _ in split(batch.column(0)):
            held.append(words)
            many, ends = many + len(words), ends + some.stop - some.start
            if many >= COUNTED:
                yield told()
                held, ends, many = [], 0, 0
    if ends:
        yield told()


def merged(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their sums."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[edge], np.add.reduceat(n[order], edge)


def narrow(n: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest one takes."""
    return n.astype(np.min_scalar_type(int(n.max(initial=0)))).tobytes()


def entries(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, partners and counts of a row's binary columns; a count has as many bytes as there are for each code."""
    code, partner, n = (x.as_buffer() for x in row)
    code = np.frombuffer(code, np.uint8)
    return code, np.frombuffer(partner, np.int32), np.frombuffer(n, f"u{len(n) // max(1, len(code)) or 1}")


def _pairs(packed: bytes, buckets: int):
    """Neighbours of the known words in chunks of texts: a row for each bucket of words with codes (word and side), partners and counts."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(packed)
        held: list[np.ndarray] = []
        many = 0

        def told() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([np.zeros(1, np.int32), *held])
            pair, n = np.unique(ids[:-1].astype(np.int64) << 32 | ids[1:], return_counts=True)
            a, b = (pair >> 32).astype(np.int32), pair.astype(np.int32)
            for side, word, partner in ((0, b, a), (1, a, b)):
                mine = np.flatnonzero(word < known.rest)
                bucket, code = word[mine] % buckets, 2 * (word[mine] // buckets) + side
                order = np.argsort(bucket.astype(np.int64) << 32 | code, kind="stable")
                bucket, mine = bucket[order], mine[order]
                edge = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
                cuts = list(zip(edge, [*edge[1:], len(bucket)], strict=True))
                columns = ((code[order].astype(np.uint8), np.ndarray.tobytes), (partner[mine], np.ndarray.tobytes), (n[mine], narrow))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edge], pa.int32()), *(pa.array([put(x[lo:hi]) for lo, hi in cuts], pa.binary()) for x, put in columns)], names=["bucket", "code", "partner", "n"])

        for batch in batches:
            for _, _, ids, _ in known.coded(batch.column(0)):
                held.append(ids)
                many += len(ids)
                if many >= CHUNK:
                    yield from told()
                    held, many = [], 0
        if held:
            yield from told()

    return run


@trimmed
def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _pairs, sorted by bucket, to one row for each bucket. A word has at most two entries for each known word, however large the corpus."""
    names = ["bucket", "code", "partner", "n"]
    last, keys, counts, many = None, [], [], 0

    def told() -> pa.RecordBatch:
        key, n = merged(np.concatenate(keys), np.concatenate(counts))
        columns = [pa.array([x], pa.binary()) for x in ((key >> 32).astype(np.uint8).tobytes(), key.astype(np.int32).tobytes(), narrow(n))]
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), *columns], names=names)

    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)) for c in names), strict=True):
            bucket = row[0].as_py()
            if bucket != last and keys:
                yield told()
                keys, counts, many = [], [], 0
            last = bucket
            code, partner, n = entries(row[1:])
            keys.append(code.astype(np.int64) << 32 | partner)
            counts.append(n.astype(np.int64))
            many += len(n)
            if many > MERGE:
                key, n = merged(np.concatenate(keys), np.concatenate(counts))
                keys, counts, many = [key], [n], 0 if len(n) > MERGE // 2 else len(n)
    if keys:
        yield told()


def _opened(batch: pa.RecordBatch, buckets: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Words, sides, partners and counts of rows of the table of neighbours, OPENED entries together (a row is opened whole)."""
    held: list[tuple[np.ndarray, ...]] = []
    many = 0
    for row in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("bucket", "code", "partner", "n")), strict=True):
        code, partner, n = entries(row[1:])
        held.append((code.astype(np.int32) // 2 * buckets + row[0].as_py(), code % 2, partner, n.astype(np.int64)))
        many += len(n)
        if many >= OPENED:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, many = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _classes_of(classes: bytes) -> np.ndarray:
    return np.frombuffer(classes, np.uint8)


def _matrix(classes: bytes, c: int, buckets: int):
    """Class bigram counts over the table of neighbours, as rows (cell, n)."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, out = _classes_of(classes), np.zeros(c * c, np.int64)
        for batch in batches:
            for word, side, partner, n in _opened(batch, buckets):
                after = np.flatnonzero((side == 1) | (of[partner] == c - 1))  # pairs behind a known word, and those between another and a known one
                a, b = of[word[after]].astype(np.int64), of[partner[after]].astype(np.int64)
                cell = np.where(side[after] == 1, a * c + b, b * c + a)
                np.add.at(out, cell, n[after])
        got = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.int32()), pa.array(out[got], pa.int64())], names=["cell", "n"])

    return run


def _moves(classes: bytes, matrix: np.ndarray, buckets: int, turn: int):
    """Words of this half round that gain by another class, and that class."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, c = _classes_of(classes), len(matrix)
        for batch in batches:
            for word, side, partner, n in _opened(batch, buckets):
                mine = np.flatnonzero((word > 0) & (word // buckets % 2 == turn))
                word, side, partner, n = word[mine], side[mine], partner[mine], n[mine]
                names, at = np.unique(word, return_inverse=True)
                if not len(names):
                    continue
                self_, to = word == partner, of[partner].astype(np.int64)
                tell = lambda rows: np.bincount(at[rows] * c + to[rows], n[rows], len(names) * c).reshape(-1, c)  # noqa: B023, E731
                left, right = tell((side == 0) & ~self_), tell((side == 1) & ~self_)
                twice, own = np.bincount(at, n * (self_ & (side == 1)), len(names)), of[names].astype(np.int64)
                best, moved = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
                for lo in range(0, len(names), TOLD):
                    some = slice(lo, lo + TOLD)
                    gain = gains(matrix, left[some], right[some], twice[some], own[some])[:, 1 : c - 1]
                    rows = np.arange(len(gain))
                    best[some] = gain.argmax(axis=1)
                    moved[some] = gain[rows, best[some]] > gain[rows, own[some] - 1] + 1e-6
                yield pa.RecordBatch.from_arrays([pa.array(names[moved], pa.int32()), pa.array(best[moved] + 1, pa.int32())], names=["word", "to"])

    return run


def exchanged(near: DataFrame, known: int, buckets: int, k: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each number, class bigram counts): 0 is the end's, 1 to k the words', k + 1 that of all words that aren't known.

    Each half round moves the words of every other place to the class of largest likelihood, all by the same counts. As words that move together
    can lose what each would gain, the assignment of largest likelihood is kept. The driver holds a byte for each known word.
    """
    c = k + 2
    classes = np.concatenate([[0], 1 + np.arange(known) % k, [k + 1]]).astype(np.uint8)
    best: tuple = ()
    for turn in range(rounds + 1):
        cells = near.mapInArrow(_matrix(classes.tobytes(), c, buckets), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        matrix = np.zeros(c * c)
        for r in cells:
            matrix[r["cell"]] = r["n"]
        matrix = matrix.reshape(c, c)
        score = likelihood(matrix)
        if not best or score > best[0]:
            best = (score, classes, matrix)
        if turn < rounds:
            moves = near.mapInArrow(_moves(classes.tobytes(), matrix, buckets, turn % 2), "word int, to int").toArrow()
            classes = classes.copy()
            classes[moves["word"].to_numpy()] = moves["to"].to_numpy()
    return best[1], best[2]


def _rest(packed: bytes, classes: bytes, c: int):
    """Words of a text that aren't known, with the classes of their neighbours (c - 1: not known either); and pairs of two such words."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of = _known(packed), _classes_of(classes)
        keys = ["text", "word", "before", "after", "other"]
        for batch in batches:
            for some, words, ids, ends in known.coded(batch.column(2)):
                at = np.flatnonzero(ids == known.rest)
                near = of[np.concatenate([[0], ids])].astype(np.int32)  # the class before a place stands at it
                row = np.searchsorted(ends, at)
                word = words.take(pa.array(at - row))
                pair = np.flatnonzero(near[at + 2] == c - 1)
                none = np.full(len(pair), -1, np.int32)
                columns = [
                    pa.array(np.concatenate([row, row[pair]])),
                    pa.concat_arrays([word, word.take(pa.array(pair))]),
                    pa.array(np.concatenate([near[at], none])),
                    pa.array(np.concatenate([near[at + 2], none])),
                    pa.concat_arrays([pa.nulls(len(at), pa.binary()), words.take(pa.array((at - row)[pair] + 1))]),
                ]
                got = pa.table(columns, names=keys).group_by(keys).aggregate([([], "count_all")]).combine_chunks()
                own = pa.array(got["text"].to_numpy() + some.start)
                made = [batch.column(k).take(own) for k in (0, 1)]
                for table in pa.table([*made, *(got[k] for k in keys[1:]), got["count_all"]], names=["h1", "h2", *keys[1:], "n"]).to_batches(max_chunksize=50_000):
                    yield table

    return run


def _joined(matrix: np.ndarray):
    """Rows (word, neighbours) of words that aren't known to their class by exchange: the one that they would gain most by."""
    c = len(matrix)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column(1)
            fields = near.flatten()
            row = np.repeat(np.arange(len(near)), np.diff(near.offsets.to_numpy()))
            before, after, n = (fields.field(k).to_numpy() for k in range(3))
            for lo in range(0, len(near), TOLD):
                own = (row >= lo) & (row < lo + TOLD)
                size = min(TOLD, len(near) - lo)
                left, right = (np.bincount((row[own] - lo) * c + x[own], n[own], size * c).reshape(size, c) for x in (before, after))
                best = gains(matrix, left, right, np.zeros(size))[:, 1 : c - 1].argmax(axis=1) + 1
                counts = left.sum(axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + size], pa.array(counts), pa.array(best, pa.int32())], names=["word", "c", "class"])

    return run


def tables(matrix: np.ndarray, counts: np.ndarray, once: float, total: float) -> np.ndarray:
    """log10 of the class transitions, from rows of matrix: Witten and Bell's mean of the row's own rates and the classes' rates.

    The last class is that of unknown words: its share is that of words seen once among all tokens, after every class alike; the
    others share the rest. counts: tokens of each class.
    """
    c = len(matrix)
    unknown = min(0.5, max(1.0, once) / (total + 1))
    rate = counts[:-1] / max(1.0, counts[:-1].sum())
    out = np.zeros((c, c))
    kinds = (matrix[:, :-1] > 0).sum(axis=1)
    seen = matrix[:, :-1].sum(axis=1)
    out[:, :-1] = (matrix[:, :-1] + kinds[:, None] * rate) / np.maximum(1, seen + kinds)[:, None]
    out[seen == 0, :-1] = rate
    out[:, :-1] *= 1 - unknown
    out[:, -1] = unknown
    with np.errstate(divide="ignore"):
        return np.log10(out)


def _told(packed: bytes, classes: bytes, counts: np.ndarray, moves: np.ndarray, emits: np.ndarray):
    """What the known words of each text say: tokens, known ones, sum of log10(count + 1), log10 of the model's factors that need no other word."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of = _known(packed), _classes_of(classes)
        last = len(moves) - 1
        step = np.where(np.arange(last + 1) == last, 0.0, np.where(np.arange(last + 1)[:, None] == last, 0.0, moves))
        plain, seen = np.log10(counts + 1.0), counts > 0
        for batch in batches:
            out: list[list[np.ndarray]] = [[np.zeros(0)] for _ in range(4)]
            for _, _, ids, ends in known.coded(batch.column(batch.num_columns - 1)):
                near = of[ids]
                model = emits[ids] + step[np.concatenate([near[:0], np.zeros(1, np.uint8), near[:-1]]), near]
                first = np.concatenate([[0], ends[:-1] + 1])
                for column, x in zip(out, (np.diff(ends, prepend=-1), *(np.add.reduceat(x, first) for x in (seen[ids].astype(np.int64), plain[ids], model))), strict=True):
                    column.append(x)
            columns = [pa.array(np.concatenate(x).astype(t.to_pandas_dtype()), t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "tokens", "found", "plain", "model"])

    return run


def _others(moves: np.ndarray, sizes: np.ndarray):
    """Rows (h1, h2, before, after, class, other class, count, n) to what they add, as whole numbers of 1e-9 so that their order doesn't matter."""
    c = len(moves)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, after, own, other, count, n = (batch.column(k).to_numpy() for k in range(2, 8))
            alone = other < 0
            model = np.where(alone & (own < c - 1), np.log10(np.maximum(1, count)) - np.log10(sizes)[own], 0.0)
            model += np.where(alone & (before < c - 1), moves[np.maximum(0, before), own], 0.0)
            model += np.where(alone & (after < c - 1), moves[own, np.maximum(0, after)], 0.0)
            model += np.where(alone, 0.0, moves[own, np.maximum(0, other)])
            whole = lambda x: pa.array(np.rint(x * n * 1e9).astype(np.int64))  # noqa: B023, E731
            found = np.where(alone & (count > 0), n, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), whole(np.where(alone, np.log10(count + 1.0), 0.0)), whole(model)], names=["h1", "h2", "found", "plain", "model"])

    return run


def language_model(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", k: int = CLASSES, rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """Scores every whole text by a class bigram model learnt from the rows where train holds.

    Tokens are words with A to Z in lower case, and an end. A token's probability is that of its class after the class before (the end's class comes before a text)
    times its share of the class's tokens. Classes come from exchange: the commonest words, at most head of up to LONGEST bytes, over several rounds
    on all their neighbours; every other word joins the class that it gains most by, once, from its neighbours in all of the
    training texts. A word that training lacks is in a class of its own, whose probability is the share of words seen once. The probabilities of all training words and
    one unknown word sum to 1 after every class. Every count covers the whole corpus: common words are counted in tasks that know them by heart, others by shuffles.

    Null and empty texts are an end alone. Null ids are carried; so are rows where train is null, which aren't learnt from. Repeated rows
    count and are scored each; equal texts are told by two 64-bit hashes. Without training rows every score is 0. An empty table gives an empty
    result. Ids are of any type. Extra columns are ignored, whatever their names. Very long texts are read whole, in memory.

    Returns id_col, trained, n_tokens, n_known, train_tokens, base_score (unigrams, add one), score, perplexity.
    """
    spark = session(docs)
    work = Workspace(spark, "classlm")
    said = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(train, F.lit(False)).alias("t"), F.xxhash64(said).alias("h1"), F.xxhash64(F.lit(7), said).alias("h2"), said.alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    own = src.where("t").select("text")
    seen = work.put(own.mapInArrow(_unigrams, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "seen")
    step = F.floor(F.log2("n") * STEPS).cast("int")
    row = seen.agg(F.sum("n"), F.count("*"), F.sum((F.col("n") == 1).cast("long")), F.max(F.when(F.col("word") == b"", F.col("n")))).first()
    total, vocabulary, once, ends = (int(x or 0) for x in row)
    words = seen.where((F.col("word") != b"") & (F.length("word") <= LONGEST))
    least, room = 1 << 30, head
    for r in sorted(words.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["s"]):  # STEPS rows an octave
        room -= r["n"]
        if room < 0:
            break
        least = r["s"]
    known = sorted(((r["n"], r["word"]) for r in words.where(step >= least).collect()), key=lambda x: (-x[0], x[1]))  # at most head rows
    work.drop("seen")
    packed = b"\n".join(bytes(w) for _, w in known)
    counts = np.array([ends, *(n for n, _ in known), 0], np.int64)
    buckets = max(1, -(-(len(known) + 1) // TOGETHER))
    chunks = own.mapInArrow(_pairs(packed, buckets), "bucket int, code binary, partner binary, n binary")
    near = chunks.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(_neighbours, "bucket int, code binary, partner binary, n binary")
    near = work.put(near, "near")
    classes, matrix = exchanged(near, len(known), buckets, k, rounds)
    work.drop("near")
    c = k + 2
    shape = "h1 long, h2 long, word binary, before int, after int, other binary, n long"
    pick = _rest(packed, classes.tobytes(), c)
    parts = [src.where(F.col("t") == flag).select("h1", "h2", "text").mapInArrow(pick, shape).withColumn("m", F.lit(int(flag)).cast("long")) for flag in (True, False)]
    keys = ["h1", "h2", "word", "before", "after", "other", "n"]
    rest = work.put(parts[0].union(parts[1]).groupBy(*keys).agg(F.sum("m").alias("m")), "rest")  # equal texts give equal rows; m counts those learnt from
    alone, pairs = rest.where("other IS NULL"), rest.where("other IS NOT NULL")
    context = alone.where("m > 0").groupBy("word", "before", "after").agg(F.sum(F.col("n") * F.col("m")).alias("n"))
    context = context.groupBy("word").agg(F.collect_list(F.struct("before", "after", "n")).alias("near"))  # at most c * c of a word
    placed = work.put(context.mapInArrow(_joined(matrix), "word binary, c long, class int"), "placed")
    unknown = F.coalesce("class", F.lit(c - 1)).alias("class")
    first = alone.join(placed, "word", "left").select("h1", "h2", "before", "after", unknown, F.lit(-1).alias("second"), F.coalesce("c", F.lit(0)).alias("c"), "n", "m")
    second = placed.select(F.col("word").alias("other"), F.col("class").alias("second"))
    both = pairs.join(placed, "word", "left").drop("c").join(second, "other", "left")
    both = both.select("h1", "h2", "before", "after", unknown, F.coalesce("second", F.lit(c - 1)).alias("second"), F.lit(0).cast("long").alias("c"), "n", "m")
    each = work.put(first.union(both), "each")
    work.drop("rest")
    # transitions and sizes of the classes, now with the words that weren't known: rows of classes only
    full, sizes = matrix.copy(), np.bincount(classes[:-1], counts[:-1], c)
    full[:, -1] = full[-1, :] = 0
    for r in placed.groupBy("class").agg(F.sum("c").alias("n")).collect():
        sizes[r["class"]] += r["n"]
    for r in each.where("m > 0").groupBy("before", "after", "class", "second").agg(F.sum(F.col("n") * F.col("m")).alias("n")).collect():  # at most c * c * c rows
        if r["second"] >= 0:
            full[r["class"], r["second"]] += r["n"]
            continue
        if r["before"] < c - 1:
            full[r["before"], r["class"]] += r["n"]
        if r["after"] < c - 1:
            full[r["class"], r["after"]] += r["n"]
    moves = tables(full, sizes, once, total) if total else np.zeros((c, c))
    sizes = np.maximum(1.0, sizes)
    emits = np.log10(np.maximum(1, counts)) - np.log10(sizes)[classes] if total else np.zeros(len(counts))
    others = each.drop("m").mapInArrow(_others(moves, sizes), "h1 long, h2 long, found long, plain long, model long")
    others = others.groupBy("h1", "h2").agg(*(F.sum(F.col(x).cast("decimal(38,0)")).alias(f"_{x}") for x in ("found", "plain", "model")))
    others = others.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))  # a text may be that of many rows
    of = src.select("id", "t", "h1", "h2", "text").mapInArrow(_told(packed, classes.tobytes(), counts, moves, emits), f"id {kind}, t boolean, h1 long, h2 long, tokens long, found long, plain double, model double")
    of = of.withColumn("salt", F.pmod(F.xxhash64("id", "model"), F.lit(SALT)).cast("int")).join(others, ["h1", "h2", "salt"], "left")
    more = lambda x: F.coalesce(F.col(f"_{x}"), F.lit(0)).cast("double") / 1e9
    name, *_ = free(["trained", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"], id_col)
    score = F.col("model") + more("model")
    out = of.select(
        F.col("id").alias(name),
        F.col("t").alias("trained"),
        F.col("tokens").alias("n_tokens"),
        (F.col("found") + F.coalesce(F.col("_found"), F.lit(0)).cast("long")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("plain") + more("plain") - F.col("tokens") * float(np.log10(total + vocabulary + 1))).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("tokens")).alias("perplexity"),
    )
    return work.last(out, "placed")


def query(spark, sf_dir: str) -> DataFrame:
    """Learns from all rows but those of one fold; a row without an id is of no fold, and isn't learnt from."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLD))
    out = language_model(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold != HELD)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
