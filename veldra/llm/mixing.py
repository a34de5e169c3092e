"""Mixing sources to target weights (operator 3): fixed-length blocks, multinomial counts per shard, index permutations."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, Workspace, free, session

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
#: Words of a block, slots of an output shard, documents of a layout bucket.
BLOCK_WORDS, SHARD_SLOTS, BUCKET_DOCS = 2048, 65536, 512
#: Layout buckets whose starts are ordered together.
GROUP_BUCKETS = 4096
SEED = 7


@dataclass
class Source:
    """What the driver keeps of a source; one row for each, never one for each document."""

    name: str | None
    size: int
    docs: int
    target: float = 0.0

    @property
    def blocks(self) -> int:
        return -(-self.size // BLOCK_WORDS)


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Parts of share * sum(sizes) by weight; none above most times its size, the excess reshared by weight."""
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], share * sum(sizes)
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return out


class Permutation:
    """A pseudorandom permutation of range(n): a Feistel network on a grid of about sqrt(n) by sqrt(n) cells, walked on until it
    lands inside, with its inverse. Cells are numbered and found by arithmetic alone, so any slot is mapped on its own."""

    ROUNDS = 6

    def __init__(self, n: int, *seed: int):
        self.n, self.a = n, max(1, math.isqrt(max(0, n - 1)) + 1)
        self.b = -(-n // self.a) if n else 1
        self.keys = np.random.default_rng([*seed, n]).integers(0, 2**63, self.ROUNDS).astype(np.uint64)

    def _mixed(self, x: np.ndarray, k: int) -> np.ndarray:
        x = (x.astype(np.uint64) + self.keys[k]) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(31))) >> np.uint64(2)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x // self.b, x % self.b
        for k in reversed(range(self.ROUNDS)) if back else range(self.ROUNDS):
            if k % 2:
                step = (self._mixed(left, k) % np.uint64(self.b)).astype(np.int64)
                right = (right - step if back else right + step) % self.b
            else:
                step = (self._mixed(right, k) % np.uint64(self.a)).astype(np.int64)
                left = (left - step if back else left + step) % self.a
        return left * self.b + right

    def __call__(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        out = self._once(np.asarray(x, np.int64), back)
        while (far := out >= self.n).any():
            out[far] = self._once(out[far], back)
        return out


def epochs(k: int, s: Source, seed: int) -> list[dict]:
    """For each epoch of a source the number of slots, the permutation, and the words that its last slot is cut to.

    The slots of an epoch hold exactly the words it must give: whole blocks but for the last slot.
    """
    out, left, n = [], round(s.target), s.blocks
    for e in range(EPOCHS):
        want = min(left, s.size)
        if want <= 0:
            break
        short = s.size - (n - 1) * BLOCK_WORDS
        # the slot that meets the short block
        at = int(Permutation(n, seed, k, e)(np.array([n - 1]), back=True)[0])
        before = lambda j: j * BLOCK_WORDS - (BLOCK_WORDS - short if j > at else 0)  # noqa: E731, B023
        slots = min(n, want // BLOCK_WORDS)
        while slots < n and before(slots + 1) <= want:
            slots += 1
        while before(slots) > want:
            slots -= 1
        cut = want - before(slots)
        out.append({"epoch": e, "slots": slots + (cut > 0), "cut": cut, "n": n})
        left -= want
    return out


def shard_counts(quota: list[int], seed: int):
    """Multinomial source counts shard by shard, drawn by what each source still has to give; they add up to the quota.

    Yields (shard, counts), as many as there are shards.
    """
    rng = np.random.default_rng(seed)
    left = np.array(quota, np.int64)
    shard = 0
    while (total := int(left.sum())) > 0:
        n = min(SHARD_SLOTS, total)
        got = np.zeros_like(left)
        while (need := n - int(got.sum())) > 0:
            p = (left - got) / (total - int(got.sum()))
            got = np.minimum(left, got + rng.multinomial(need, p / p.sum()))
        left -= got
        yield shard, got
        shard += 1


def plan(work: Workspace, docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple, share: float, seed: int):
    """(documents with their place in their source, slots joined to blocks, sources)."""
    spark = session(docs)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = work.put(src.withColumn("key", F.xxhash64("id", "size")), "sizes")
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
    sources = [Source(r["source"], r["size"], r["docs"]) for r in sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))]
    for s, t in zip(sources, targets([s.size for s in sources], [weights[k % len(weights)] for k in range(len(sources))], share, EPOCHS), strict=True):
        s.target = t
    kinds = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("buckets", T.LongType())])
    table = spark.createDataFrame([(k, s.name, s.size, s.target, -(-s.docs // BUCKET_DOCS)) for k, s in enumerate(sources)], kinds)
    # hash buckets of a bounded number of documents, so no source is ordered in one task
    placed = sized.alias("d").join(F.broadcast(table).alias("s"), F.expr("d.source <=> s.source")).select("id", "key", "size", "k", "source_size", "target", F.expr("pmod(key, buckets)").alias("bucket"))
    sums = placed.groupBy("k", "bucket").agg(F.sum("size").alias("words"))
    # where a bucket starts: inside a group of buckets, and the group's start, so no source's buckets are ordered in one task
    sums = sums.withColumn("group", F.floor(F.col("bucket") / GROUP_BUCKETS))
    groups = sums.groupBy("k", "group").agg(F.sum("words").alias("all"))
    groups = groups.select("k", "group", (F.sum("all").over(W.partitionBy("k").orderBy("group")) - F.col("all")).alias("base"))
    sums = sums.select("k", "bucket", "group", (F.sum("words").over(W.partitionBy("k", "group").orderBy("bucket")) - F.col("words")).alias("in_group"))
    first = sums.join(groups, ["k", "group"]).select("k", "bucket", (F.col("base") + F.col("in_group")).alias("first"))
    inside = F.sum("size").over(W.partitionBy("k", "bucket").orderBy("key", "id").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    laid = placed.withColumn("inside", inside).join(first, ["k", "bucket"]).select("id", "size", "k", "source_size", "target", (F.col("first") + F.col("inside")).alias("start"))
    laid = work.put(laid, "layout")

    plans = {k: epochs(k, s, seed) for k, s in enumerate(sources)}
    quota = [sum(p["slots"] for p in plans[k]) for k in range(len(sources))]
    shards = work.path("shards")
    kinds = "shard int, k int, lo long, hi long"
    spark.createDataFrame([], kinds).write.parquet(shards)
    for rows in _runs(quota, seed):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(shards)
    slot = spark.read.schema(kinds).parquet(shards).select("shard", "k", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("j"))
    per = spark.createDataFrame([(k, p["epoch"], sum(q["slots"] for q in plans[k][: p["epoch"]]), p["slots"], p["cut"], p["n"]) for k in plans for p in plans[k]], "k int, epoch int, base long, slots long, cut long, n long")
    slot = slot.join(F.broadcast(per), "k").where("j >= base AND j < base + slots")
    last = (F.col("cut") > 0) & (F.col("j") - F.col("base") == F.col("slots") - 1)
    slot = slot.select("shard", "k", "epoch", "j", (F.col("j") - F.col("base")).alias("at"), "n", F.when(last, F.col("cut")).otherwise(F.lit(BLOCK_WORDS)).cast("long").alias("most"))
    slot = slot.mapInArrow(_blocks_of(seed), "shard int, k int, epoch int, j long, block long, most long")
    return laid, slot, sources


def _runs(quota: list[int], seed: int):
    """Rows (shard, source, from, to): the slots of a source that a shard takes, in lists of a bounded length."""
    rows, given = [], [0] * len(quota)
    for shard, got in shard_counts(quota, seed):
        for k in np.flatnonzero(got).tolist():
            rows.append((shard, k, given[k], given[k] + int(got[k])))
            given[k] += int(got[k])
        if len(rows) >= 100_000:
            yield rows
            rows = []
    if rows:
        yield rows


def _blocks_of(seed: int):
    """Rows of slots: the block that each meets, by its source's permutation of the pass."""

    def run(batches):
        made: dict[tuple[int, int], Permutation] = {}
        for batch in batches:
            k, epoch, at, n = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("k", "epoch", "at", "n"))
            block = np.zeros(len(k), np.int64)
            both = k.astype(np.int64) * EPOCHS + epoch
            for c in np.unique(both).tolist():
                here = both == c
                key = divmod(c, EPOCHS)
                if key not in made:
                    made[key] = Permutation(int(n[here][0]), seed, *key)
                block[here] = made[key](at[here])
            names = ["shard", "k", "epoch", "j", "block", "most"]
            yield pa.RecordBatch.from_arrays([pa.array(block) if c == "block" else batch.column(batch.schema.get_field_index(c)) for c in names], names=names)

    return run


def spans(laid: DataFrame, slot: DataFrame) -> DataFrame:
    """One row for each slot and each document in its block: id, epoch, shard, j, lo and hi (words of the document, hi exclusive)."""
    size = F.lit(BLOCK_WORDS)
    own = laid.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("size") - 1) / size))))
    joined = own.join(slot, ["k", "block"])
    lo = F.greatest(F.lit(0), F.col("block") * size - F.col("start"))
    hi = F.least(F.col("size"), F.col("block") * size + F.col("most") - F.col("start"))
    return joined.select("id", "k", "size", "start", "epoch", "shard", "j", lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).where("hi > lo")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """Mixes all documents to target weights by source.

    Each source's words, documents in hash order, are packed into blocks of BLOCK_WORDS. A source's slots map to its blocks by
    a pseudorandom permutation for each pass; shards of SHARD_SLOTS slots draw their source counts from a multinomial over
    what the sources still have to give, so the totals meet the targets exactly (the last slot of a pass is cut). A block is
    met at most once a pass and there are at most two passes. The same rows and seed give the same mix, whatever
    the partitions.

    Nulls: a null source is a source, last in order; a null text has size 0; null ids are laid out like others, and ids are of any type. Documents without
    words take nothing. Repeated rows are separate documents of equal place in order. An empty table gives an empty result.
    Extra columns are ignored.

    Returns id_col, size, source_size, target, taken.
    """
    work = Workspace(session(docs), "mix")
    laid, slot, _ = plan(work, docs, id_col, text_col, source_col, weights, share, seed)
    got = spans(laid, slot).groupBy("k", "start", "size").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    out = laid.join(got, ["k", "start", "size"], "left")
    return work.last(out.select(F.col("id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), "sizes")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _taken(columns: list[str], text_at: int):
    """Rows (epoch, ranges, document): the words of a document that an epoch takes. A document taken whole keeps its text."""

    def run(batches):
        for batch in batches:
            col = batch.column(text_at)
            out = []
            for text, size, ranges in zip(col, batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist(), strict=True):
                t = text.as_py()
                parts: list[list[int]] = []
                for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
                    if parts and parts[-1][1] == lo:
                        parts[-1][1] = hi
                    else:
                        parts.append([lo, hi])
                if parts == [[0, size]]:
                    out.append(t)
                    continue
                at = [m.span() for m in re.finditer(WORD, t)]
                out.append("\n".join(t[at[lo][0] : at[hi - 1][1]] for lo, hi in parts))
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays[text_at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return run


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix as documents. For each pass, a document is a row with the words taken of it.

    A document taken whole keeps its text and columns; one taken in part keeps the ranges of words in its blocks, joined by a
    line break, with n_chars (where there is one) of what is left. Documents without words, so null texts too, are never taken. A null source is a
    source, a null id is carried. Rows that repeat an id are taken apart. An empty table stays empty. Other columns pass unchanged, whatever their names.
    """
    work = Workspace(spark, "mix-stage")
    laid, slot, sources = plan(work, docs, "doc_id", "text", "source", WEIGHTS, SHARE, SEED)
    columns = docs.columns
    took = spans(laid, slot).groupBy("k", "start", "id", "size", "epoch").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    took = work.put(took.select("id", "size", "k", "start", "ranges"), "taken")
    mine = docs.select(F.struct(*(f"`{c}`" for c in columns)).alias("doc"))
    laid = laid.where("size > 0")
    if laid.groupBy("id").count().where("count > 1").isEmpty():
        joined = mine.join(took, F.col("doc.doc_id").eqNullSafe(F.col("id")))
    else:  # rows that share an id, a source and a size are told apart by their number
        number = laid.select("id", "size", "k", "start", F.row_number().over(W.partitionBy("id", "size", "k").orderBy("start")).alias("r"))
        took = took.alias("t").join(number.alias("n"), F.expr("t.id <=> n.id AND t.k = n.k AND t.start = n.start AND t.size = n.size")).select("t.id", "t.size", "t.k", "ranges", "r")
        names = spark.createDataFrame([(k, x.name) for k, x in enumerate(sources)], "own int, name string")
        mine = mine.join(F.broadcast(names), F.col("doc.source").cast("string").eqNullSafe(F.col("name"))).withColumn("words", F.regexp_count(F.col("doc.text"), F.lit(WORD)).cast("long"))
        mine = mine.withColumn("place", F.row_number().over(W.partitionBy("doc.doc_id", "words", "own").orderBy(F.xxhash64("doc.text"))))
        joined = mine.join(took, F.expr("doc.doc_id <=> id AND words = size AND own = k AND place = r"))
    more = free(columns, "size", "ranges")
    joined = joined.select(*(F.col("doc").getField(c).alias(c) for c in columns), F.col("size").alias(more[0]), F.col("ranges").alias(more[1]))
    out = work.last(joined.mapInArrow(_taken(columns, columns.index("text")), docs.schema), "sizes")
    if "n_chars" not in columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
