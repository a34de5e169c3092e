"""Byte-level BPE encoding and decoding (operator 1) with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, texts

#: Pre-tokens of at most 64 characters kept in a worker, about 200 bytes each: by the operator, and in a pipeline, whose other
#: stages use the same workers.
PRETOKEN_CACHE, STAGE_CACHE = 1_000_000, 300_000
#: Bytes of a pre-token up to which the rank queue is written out in place.
SHORT = 64
PAIR_CACHE = 2_000_000
#: Single bits, and the first neighbours of short pieces.
BIT = [1 << k for k in range(512)]
ROWS = [list(range(1, n + 1)) for n in range(SHORT + 1)]
BACK = list(range(-1, SHORT))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """A set of merge ranks as a bitmap in three levels of 64-bit words; the smallest is found by find-first-set.

    Each rank has a bucket of positions. Entries aren't removed when a merge makes them void: pop returns whole
    buckets and the caller skips the stale ones.
    """

    def __init__(self):
        self.top = 0
        self.mid: dict[int, int] = {}
        self.low: dict[int, int] = {}
        self.bucket: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        found = self.bucket.get(rank)
        if found is not None:
            found.append(at)
            return
        self.bucket[rank] = [at]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> tuple[int, list[int]] | None:
        """The smallest rank and its bucket, which leave the queue; None when it is empty."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        m = self.mid[b]
        a = b << 6 | (m & -m).bit_length() - 1
        w = self.low[a]
        rank = a << 6 | (w & -w).bit_length() - 1
        w &= w - 1
        if w:
            self.low[a] = w
        else:
            del self.low[a]
            m &= ~(1 << (a & 63))
            if m:
                self.mid[b] = m
            else:
                del self.mid[b]
                self.top &= ~(1 << b)
        return rank, self.bucket.pop(rank)


class Merger:
    """Merges of one rank file. A pair of ids that joins into a token is looked up by the joined bytes once and then by id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = PRETOKEN_CACHE):
        self.most = most
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.find = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.byte_pairs = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.reset()

    def reset(self) -> None:
        """The pair cache with nothing but the pairs of single bytes."""
        self.pairs.clear()
        for a in range(256):
            for b in range(256):
                self.pairs[self.single[a] << 32 | self.single[b]] = self.byte_pairs[a << 8 | b]

    def pair(self, left: int, right: int) -> int:
        """Rank of the two tokens joined, -1 if they don't join."""
        key = left << 32 | right
        r = self.pairs.get(key)
        if r is None:
            if len(self.pairs) >= PAIR_CACHE:
                self.reset()
            r = self.pairs[key] = self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
        return r

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: always the lowest rank joins next, of equal ranks the leftmost."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self.merge_short(piece) if len(piece) <= SHORT else self.merge_long(piece)

    def merge_short(self, piece: bytes) -> list[int]:
        """merge_long with the queue written out in place, in two levels, as calls would take most of the time of a short piece."""
        single, known, pair, bit = self.single, self.pairs.get, self.pair, BIT
        ids = [single[b] for b in piece]
        n = len(ids)
        after = ROWS[n][:]
        before = BACK[:n]
        bucket: dict[int, list[int]] = {}
        low: dict[int, int] = {}
        top = i = 0
        joins = self.byte_pairs
        left = piece[0]
        for right in piece[1:]:
            r = joins[left << 8 | right]
            if r >= 0:
                if r in bucket:
                    bucket[r].append(i)
                else:
                    bucket[r] = [i]
                    h = r >> 9
                    if h in low:
                        low[h] |= bit[r & 511]
                    else:
                        low[h] = bit[r & 511]
                        top |= bit[h]
            left = right
            i += 1
        while top:
            h = (top & -top).bit_length() - 1
            w = low[h]
            rank = h << 9 | (w & -w).bit_length() - 1
            w &= w - 1
            if w:
                low[h] = w
            else:
                del low[h]
                top &= top - 1
            places = bucket.pop(rank)
            if len(places) > 1:
                places.sort()
            for i in places:
                left = ids[i]
                if left < 0:
                    continue
                j = after[i]
                if j >= n:
                    continue
                r = known(left << 32 | ids[j])
                if (pair(left, ids[j]) if r is None else r) != rank:
                    continue  # stale
                ids[i] = rank
                ids[j] = -1
                k = after[i] = after[j]
                g = before[i]
                if k < n:
                    before[k] = i
                    right = ids[k]
                    r = known(rank << 32 | right)
                    if r is None:
                        r = pair(rank, right)
                    if r >= 0:
                        if r in bucket:
                            bucket[r].append(i)
                        else:
                            bucket[r] = [i]
                            h = r >> 9
                            if h in low:
                                low[h] |= bit[r & 511]
                            else:
                                low[h] = bit[r & 511]
                                top |= bit[h]
                if g >= 0:
                    left = ids[g]
                    r = known(left << 32 | rank)
                    if r is None:
                        r = pair(left, rank)
                    if r >= 0:
                        if r in bucket:
                            bucket[r].append(g)
                        else:
                            bucket[r] = [g]
                            h = r >> 9
                            if h in low:
                                low[h] |= bit[r & 511]
                            else:
                                low[h] = bit[r & 511]
                                top |= bit[h]
        return [x for x in ids if x >= 0]

    def merge_long(self, piece: bytes) -> list[int]:
        n = len(piece)
        ids = [self.single[b] for b in piece]
        if n == 1:
            return ids
        after = array("q", range(1, n + 1))
        before = array("q", range(-1, n - 1))
        queue = RankQueue()
        for i in range(n - 1):
            r = self.pair(ids[i], ids[i + 1])
            if r >= 0:
                queue.push(r, i)
        while (top := queue.pop()) is not None:
            rank, places = top
            places.sort()
            for i in places:
                if ids[i] < 0:
                    continue
                j = after[i]
                if j >= n or self.pair(ids[i], ids[j]) != rank:
                    continue  # stale
                ids[i], ids[j] = rank, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    r = self.pair(rank, ids[k])
                    if r >= 0:
                        queue.push(r, i)
                h = before[i]
                if h >= 0:
                    r = self.pair(ids[h], rank)
                    if r >= 0:
                        queue.push(r, h)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit words; pre-tokens seen before come from a bounded cache."""
        pieces, out = self.pieces, []
        for p in self.find(text):
            ids = pieces.get(p)
            if ids is None:
                found = self.merge(p.encode("utf-8", "replace"))
                ids = struct.pack(f"<{len(found)}I", *found)
                if len(p) <= 64:
                    if len(pieces) >= self.most:
                        pieces.clear()
                    pieces[p] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _ids(path: str, pattern: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kept(("bpe", path, pattern, most), lambda: Merger(load_ranks(path), pattern, most))
        for batch in batches:
            start, held, rows = 0, 0, []
            for i, text in enumerate(texts(batch.column(1))):
                rows.append(m.encode(text))
                held += len(rows[-1])
                if held > 16_000_000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(rows)), pa.array([len(x) // 4 for x in rows], pa.int64()), pa.array(rows, pa.binary())], names=["id", "n", "a"])
                    start, held, rows = i + 1, 0, []

    return run


def _run(path: str, pattern: str, digest: bool, most: int = PRETOKEN_CACHE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kept(("bpe", path, pattern, most), lambda: Merger(load_ranks(path), pattern, most))
        for batch in batches:
            ids = batch.column(0)
            rows: list[tuple] = []
            start, held = 0, 0
            for i, text in enumerate(texts(batch.column(1))):
                raw = m.encode(text)
                back = m.decode(raw)
                rows.append((len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()) if digest else (len(raw) // 4, raw, back))
                held += 0 if digest else len(raw) + len(back)
                if held > 16_000_000 or i == len(ids) - 1:
                    n, a, b = zip(*rows, strict=True)
                    kind = pa.string() if digest else pa.binary()
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(rows)), pa.array(n, pa.int64()), pa.array(a, kind), pa.array(b, kind)], names=["id", "n", "a", "b"])
                    start, held, rows = i + 1, 0, []

    return run


def encode_column(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids (little-endian unsigned 32-bit, as binary) and the bytes they decode to, for every whole text.

    The text is cut into matches of pattern, and each match is merged on its own: the lowest merge rank next, of equal
    ranks the leftmost, kept in buckets by rank under a bitmap. No special tokens.

    Nulls: a null text is empty (no ids); a null id is carried. Empty texts have no ids. Very long texts or pre-tokens take
    time and memory in proportion. Repeated rows each get a result; an empty table an empty one. Extra columns are ignored.
    The rank file must be at ranks_path on every machine.

    Returns id_col, n_tokens, ids, decoded.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(_run(ranks_path, pattern, False), f"id {kind}, n long, a binary, b binary").toDF(id_col, "n_tokens", "ids", "decoded")


def encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", most: int = PRETOKEN_CACHE) -> DataFrame:
    """encode_column without the decoded bytes: id_col, n_tokens, ids."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(_ids(ranks_path, pattern, most), f"id {kind}, n long, a binary").toDF(id_col, "n_tokens", "ids")


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", most: int = PRETOKEN_CACHE) -> DataFrame:
    """encode_column with SHA-256 of both outputs in their place, taken where the text is, so that no ids travel."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(_run(ranks_path, pattern, True, most), f"id {kind}, n long, a string, b string").toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")


def _public() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), *_public())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: doc_id, n_tokens and ids (little-endian unsigned 32-bit, as binary) of every row, in the order of the rows.

    Null and empty texts have no ids; a null doc_id is carried; repeated rows are each encoded, an empty table gives an empty result. Other columns
    are left out, whatever their names. decode() of the ids gives the text's bytes again.
    """
    return encoded(docs, *_public(), most=STAGE_CACHE)
