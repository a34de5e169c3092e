"""Token-id output (operator 2): each document's ids as one zstandard frame under a shared dictionary, in indexed blocks.

A store is a table of blocks, in ascending id order: shard, block, first (smallest id), docs, tokens, data. data is the
file format proper and can be cut out and kept by itself:

    4 bytes   b"VIDS"
    2 x u32   version, number of documents
    32 bytes  SHA-256 of the dictionary
    u64       tokens of the shard before this block
    n x (i64 id, u32 tokens, u32 end of its frame)      the offset index; a document is one slice of the frames
    frames    one zstandard frame for each document: its ids, little-endian unsigned 32-bit

The index finds a document without touching other frames, and the hash tells which dictionary opens them. The container is
Parquet, so that Spark's committers write it to any store and tasks of lost executors can be run again.
"""

from __future__ import annotations

import hashlib
import struct
import sys
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import Workspace, kept, partitions, session, texts

MAGIC = b"VIDS"
#: What stands in the index for a null id, which comes first in order as the smallest long does.
NO_ID = -(2**63)
HEAD = "<4sII32sQ"
HEAD_SIZE = struct.calcsize(HEAD)
#: A block is closed when it has so many bytes of frames or so many documents.
BLOCK_BYTES, BLOCK_DOCS = 4_000_000, 4096
#: The dictionary: its size, and its bounded sample (documents of smallest id hash, of them those of at most so many characters).
DICT_BYTES, DICT_DOCS, DICT_CHARS = 32_768, 400, 20_000
#: Words kept in a worker, about 200 bytes each; words of letters that are encoded together.
WORD_CACHE, TOGETHER = 1_200_000, 64
#: Marks behind a word that are pieces of their own, and the end of tokens that end a piece.
MARKS, WORD_END = ".,;:!?", "</w>"
LEVEL = 1


class Encoder:
    """Ids of texts by the tokenizers library; words seen before come from bounded caches.

    Texts are cut at single spaces and line breaks, where this kind of tokenizer (white space dropped) always parts: the ids of a text
    are those of its words in order. It parts letters from marks too, so a word of letters with marks behind is the word's ids
    and the marks', and as every piece ends in a token of the vocabulary's word ends, many words of letters are encoded as
    one text and told apart by those tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = [0] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            ends[i] = token.endswith(WORD_END)
        self.ends = np.array(ends, bool)
        self.cache: dict[str, bytes] = {"": b""}
        self.cores: dict[str, bytes] = {"": b""}

    def library(self, pieces: list[str]) -> list[bytes]:
        out = []
        for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False):
            ids = array("I", e.ids)
            if sys.byteorder == "big":
                ids.byteswap()
            out.append(ids.tobytes())
        return out

    def _letters(self, words: list[str]) -> None:
        """Caches words of letters, TOGETHER of them as one text; where their word ends don't tell them apart, one by one."""
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for group, raw in zip(groups, self.library([" ".join(g) for g in groups]), strict=True):
            at = (np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1) * 4
            if len(at) == len(group) and (not len(at) or at[-1] == len(raw)):
                cuts = [0, *at.tolist()]
                self.cores.update(zip(group, [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
            else:
                self.cores.update(zip(group, self.library(group), strict=True))

    def encode(self, found: list[str]) -> list[bytes]:
        cut = [t.replace("\n", " ").split(" ") for t in found]
        if len(self.cache) > WORD_CACHE:
            self.cache = {"": b""}
        if len(self.cores) > WORD_CACHE:
            self.cores = {"": b""}
        cache, cores = self.cache, self.cores
        parts, whole = [], []
        for w in set().union(*cut).difference(cache):
            core, tail = w, ""
            if not w.isalpha():
                core = w.rstrip(MARKS)
                tail = w[len(core) :]
            if core.isascii() and core.isalpha():
                parts.append((w, core.lower(), tail))
            elif core.isalpha() and core.lower().isalpha():  # some capitals have a mark in lower case
                parts.append((w, core, tail))
            else:
                whole.append(w)
        self._letters(list({c for _, c, _ in parts}.difference(cores)))
        tails = list({t for _, _, t in parts}.difference(cores))
        cores.update(zip(tails, self.library(tails), strict=True))
        cache.update((w, cores[c] + cores[t] if t else cores[c]) for w, c, t in parts)
        cache.update(zip(whole, self.library(whole), strict=True))
        return [b"".join(map(cache.__getitem__, words)) for words in cut]


def train(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; few or short samples serve as its content themselves, none give an empty dictionary."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICT_BYTES:]


def _dictionary(raw: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}


def pack(docs: list[tuple[int, bytes]], dictionary: bytes, before: int, compressor=None) -> bytes:
    compressor = compressor or zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **_dictionary(dictionary))
    frames = [compressor.compress(ids) for _, ids in docs]
    ends = np.cumsum([len(f) for f in frames]).tolist()
    index = b"".join(struct.pack("<qII", i, len(ids) // 4, e) for (i, ids), e in zip(docs, ends, strict=True))
    return b"".join([struct.pack(HEAD, MAGIC, 1, len(docs), hashlib.sha256(dictionary).digest(), before), index, *frames])


class Block:
    """A packed block: its index, and any document's ids."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, version, n, digest, self.before = struct.unpack_from(HEAD, data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a block of token ids")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the block was packed with another dictionary")
        self.index = list(struct.iter_unpack("<qII", data[HEAD_SIZE : HEAD_SIZE + 16 * n]))
        self.frames = memoryview(data)[HEAD_SIZE + 16 * n :]
        self.opener = zstandard.ZstdDecompressor(**_dictionary(dictionary))

    def ids(self, k: int) -> bytes:
        start = self.index[k - 1][2] if k else 0
        return self.opener.decompress(self.frames[start : self.index[k][2]])

    def find(self, doc: int) -> bytes | None:
        k = bisect_left(self.index, (doc,))  # documents are in the order of their ids
        return self.ids(k) if k < len(self.index) and self.index[k][0] == doc else None


def _packed(path: str, end: int, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, shard = kept(("ids", path), lambda: Encoder(path)), TaskContext.get().partitionId()
        compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **_dictionary(dictionary))
        last = struct.pack("<I", end)
        held: list[tuple[int, bytes]] = []
        size = tokens = block = 0

        def close():
            nonlocal held, size, tokens, block
            n = sum(len(ids) // 4 for _, ids in held)
            row = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([held[0][0]], pa.int64()), pa.array([len(held)], pa.int32()), pa.array([n], pa.int64()), pa.array([pack(held, dictionary, tokens, compressor)], pa.binary())], names=["shard", "block", "first", "docs", "tokens", "data"])
            held, size, tokens, block = [], 0, tokens + n, block + 1
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for i, ids in zip(part.column(0).to_pylist(), encoder.encode(list(texts(part.column(1)))), strict=True):
                    held.append((NO_ID if i is None else i, ids + last))
                    size += len(ids)
                    if size >= BLOCK_BYTES or len(held) >= BLOCK_DOCS:
                        yield close()
        if held:
            yield close()

    return run


def _read(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(data.as_py(), dictionary)
                at, rows = block.before, []
                for k, (i, n, _) in enumerate(block.index):
                    raw = block.ids(k)
                    if len(raw) != 4 * n:
                        raise ValueError("a frame disagrees with the index")
                    rows.append((None if i == NO_ID else i, at, n, zlib.crc32(raw)))
                    at += n
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int32()), *(pa.array(c, pa.int64()) for c in cols)], names=["shard", "doc_id", "local", "n_tokens", "ids_crc32"])

    return run


def write(docs: DataFrame, tokenizer_path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bytes]:
    """Encodes all texts, appends the end id and writes the store; returns its blocks as a table, and the dictionary.

    Documents go to shards by ranges of id and are sorted there. The dictionary is trained on the ids of at most DICT_DOCS documents.

    Nulls: a null text is empty, so it is the end id alone; rows with a null id come first, under NO_ID, and are read back with a null id. Ids are
    integers, as the format says. Rows that repeat an id are stored each, in a fixed order. An empty table gives a store without blocks. Extra
    columns are ignored. A text's ids are held whole in memory; a block is closed at BLOCK_BYTES.
    """
    spark = session(docs)
    work = Workspace(spark, "ids")
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    chosen = [r["id"] for r in src.where("id IS NOT NULL").select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(DICT_DOCS).collect()]
    sample = [r["t"] for r in src.where(F.col("id").isin(chosen) & (F.length("t") <= DICT_CHARS)).orderBy("id", F.xxhash64("t")).limit(DICT_DOCS).collect()] if chosen else []
    dictionary = train(Encoder(tokenizer_path).encode([t or "" for t in sample]))
    ordered = src.withColumn("h", F.xxhash64("t")).repartitionByRange(partitions(spark), "id", "h").sortWithinPartitions("id", "h").select("id", "t")
    blocks = ordered.mapInArrow(_packed(tokenizer_path, end, dictionary), "shard int, block int, first long, docs int, tokens long, data binary")
    return work.last(work.put(blocks, "blocks")), dictionary


def read(blocks: DataFrame, dictionary: bytes) -> DataFrame:
    """Every document of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards = blocks.groupBy("shard").agg(F.sum("tokens").alias("n"))
    first = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("first"))
    rows = blocks.select("shard", "data").mapInArrow(_read(dictionary), "shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(first), "shard").select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def lookup(blocks: DataFrame, dictionary: bytes, doc: int) -> bytes | None:
    """Ids of one document: the block that may hold it is found by the keys alone, then its data are read and the document's one frame is opened."""
    keys = blocks.select("first", "shard", "block").where(F.col("first") <= doc).orderBy(F.desc("first"), F.desc("shard"), F.desc("block")).limit(1).collect()
    if not keys:
        return None
    own = blocks.where((F.col("shard") == keys[0]["shard"]) & (F.col("block") == keys[0]["block"])).select("data").first()
    return Block(bytes(own["data"]), dictionary).find(doc)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read(*write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")))
