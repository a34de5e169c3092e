"""MinHash near-dedup (operator 5): banded universal-hash minima, signature checks, exact confirmation, large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, groups, members, partitions, session, texts
from .shingles import WordHashes, shingle_set

#: 28 bands of 4 minima: a pair at similarity 0.8 is missed with probability (1 - 0.8^4)^28 = 4e-7.
BANDS, ROWS = 28, 4
#: Rows of a bucket that meet in one block; larger buckets are compared block by block.
BLOCK = 1024
#: Rows of a family that meet in one block, with their sets.
FAMILY_BLOCK = 512
#: Share of equal minima below which a pair isn't confirmed on full sets: over six deviations under 0.8.
LEAST_SHARE = 0.55
SALTS = 1024


def _hashes() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = BANDS * ROWS
    return rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the minima of multiply-add-shift hashes (universal on the 32-bit keys), as uint32."""
    a, b = _hashes()
    keys = np.concatenate(sets) & np.uint64(0xFFFFFFFF)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), len(a)), np.uint32)
    for k in range(len(a)):
        out[:, k] = np.minimum.reduceat(((keys * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            ids, col = batch.column(0), batch.column(1)
            at = 0
            held: list[np.ndarray] = []
            size = 0
            for i, text in enumerate(texts(col)):
                held.append(shingle_set(text, width, cache))
                size += len(held[-1])
                if size > 200_000 or i == len(col) - 1:
                    yield _signed(ids.slice(at, len(held)), held)
                    at, held, size = i + 1, [], 0

    return run


def _signed(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    full = [i for i, s in enumerate(sets) if len(s)]
    bands: list = [None] * len(sets)
    low: list = [None] * len(sets)
    h1: list = [None] * len(sets)
    h2: list = [None] * len(sets)
    if full:
        m = minima([sets[i] for i in full])
        keys = m.reshape(len(full), BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), keys.shape[:2]).copy()
        for r in range(ROWS):
            key = (key ^ keys[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(31)
        short = m.astype(np.uint8)
        for j, i in enumerate(full):
            d = xxhash.xxh3_128_digest(sets[i].tobytes())
            h1[i], h2[i] = int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
            bands[i], low[i] = key[j].view(np.int64), short[j].tobytes()
    return pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())], names=["id", "n", "h1", "h2", "bands", "low"])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            rows = []
            for i, (node, text) in enumerate(zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True)):
                rows.append((node, shingle_set(text, width, cache).tobytes()))
                if rows and (sum(len(r[1]) for r in rows[-1:]) > 4_000_000 or len(rows) >= 256 or i == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["v", "shingles"])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["v", "shingles"])

    return run


def _confirm(percent: int):
    """Rows sorted by (a, salt) with the row of a itself first: yields the confirmed (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, mine = None, np.empty(0, np.uint64)
        for batch in batches:
            found_a, found_b = [], []
            for a, b, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = np.frombuffer(s.as_buffer(), np.uint64)
                if b is None:
                    lead, mine = a, own.copy()
                elif lead == a and _linked(own, mine, percent):
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return run


def _root(parent: dict[int, int], x: int) -> int:
    while (up := parent.get(x, x)) != x:
        parent[x] = x = parent.get(up, up)
    return x


def _possible(t: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row x of block i the rows at of block j in other components whose sizes and signatures allow a link, and
    their shares of equal minima."""
    ids, n, comp, block = (t[c].to_numpy() for c in ("v", "n", "component", "block"))
    low = np.frombuffer(b"".join(t["low"].to_pylist()), np.uint8).reshape(len(ids), -1)
    i, j = t["i"][0].as_py(), t["j"][0].as_py()
    for x in np.flatnonzero(block == i):
        ok = (comp != comp[x]) & (percent * np.maximum(n, n[x]) <= 100 * np.minimum(n, n[x]))
        ok &= (block == j) & (ids > ids[x]) if i == j else block == j
        at = np.flatnonzero(ok)
        if len(at):
            share = (low[at] == low[x]).mean(axis=1)
            near = share >= LEAST_SHARE
            if near.any():
                yield x, at[near], share[near]


def _families(percent: int):
    """Rows of one bucket block: a spanning forest of the possible pairs across components, no more rows than members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["code", "i", "j"]):
            ids, parent = t["v"].to_numpy(), {}
            out: list[tuple[int, int]] = []
            for x, at, _ in _possible(t, percent):
                for y in at.tolist():
                    p, q = _root(parent, int(x)), _root(parent, y)
                    if p != q:
                        parent[q] = p
                        out.append((int(ids[x]), int(ids[y])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([min(r) for r in out], pa.int64()), pa.array([max(r) for r in out], pa.int64())], names=["a", "b"])

    return run


def _settle(percent: int):
    """Rows of one family block, with their sets: links between components, confirmed on full sets from the likeliest pair on;
    pairs of components that are linked by then are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["code", "i", "j"]):
            ids, comp = t["v"].to_numpy(), t["component"].to_numpy().tolist()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["shingles"]]
            parent: dict[int, int] = {}
            out: list[tuple[int, int]] = []
            held = [(np.full(len(at), x), at, share) for x, at, share in _possible(t, percent)]
            if not held:
                continue
            xs, ys, shares = (np.concatenate(c) for c in zip(*held, strict=True))
            for k in np.argsort(-shares, kind="stable").tolist():
                x, y = int(xs[k]), int(ys[k])
                p, q = _root(parent, comp[x]), _root(parent, comp[y])
                if p != q and _linked(sets[x], sets[y], percent):
                    parent[q] = p
                    out.append((int(ids[x]), int(ids[y])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([min(r) for r in out], pa.int64()), pa.array([max(r) for r in out], pa.int64())], names=["a", "b"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if percent * len(large) > 100 * len(small):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _blocks(rows: DataFrame, size: str, block: int) -> DataFrame:
    """Rows (code, v, ..) dealt to pairs of blocks (i, j) of about block rows of their code, so that any two meet once."""
    many = F.ceil(F.col(size) / block).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("v"), many).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), many - 1)))
    return rows.withColumn("i", F.least("block", "k")).withColumn("j", F.greatest("block", "k")).drop("k", size)


def _links(work: Workspace, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity on full sets. The set of a goes once to each salt of its partners."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    own = salted.select("a", "salt").distinct().join(sets, F.col("a") == F.col("v")).select("a", F.lit(None).cast("long").alias("b"), "shingles", "salt")
    other = salted.join(sets, F.col("b") == F.col("v")).select("a", "b", "shingles", "salt")
    n = partitions(session(pairs))
    return own.unionByName(other).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).select("a", "b", "shingles").mapInArrow(_confirm(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate groups: documents whose sets of word shingles have a Jaccard similarity of percent/100 or more.

    Equal sets are one node. Minima are banded; in a bucket every node is compared with the smallest one first, on full
    sets. In the buckets that then still hold nodes of more than one component, pairs across components whose signatures allow a
    link join nodes to families (as spanning forests, never as all pairs); in a family such pairs are confirmed on full sets, in
    blocks, until their components are linked or shown apart. So components are exact but for the bands' chance to miss a pair
    (4e-7 at 0.8) and the signatures' (LEAST_SHARE), and no bucket is expanded into all its pairs.

    Nulls: a null or wordless text has the empty set and links with nothing; a null id gets a null component and is kept.
    Fewer words than width: the whole sequence is one shingle. Repeated rows each get a row; rows that share an id and differ in text
    are compared as texts of their own, and each belongs to its text's component. Ties: the component is the smallest id, of any type. Very long texts are
    hashed whole. An empty table gives an empty result. Extra columns are ignored, whatever their names.

    Returns id_col, n_shingles, component_id, kept.
    """
    spark = session(docs)
    work = Workspace(spark, "minhash")
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("ht"))
    kind = src.schema["id"].dataType.simpleString()
    sig = src.select(F.struct("id", "ht").alias("id"), "t").mapInArrow(_signatures(width), f"id struct<id:{kind},ht:bigint>, n long, h1 long, h2 long, bands array<long>, low binary")
    sig = work.put(sig.select("id.id", "id.ht", "n", "h1", "h2", "bands", "low"), "signatures")
    # a node is a set, numbered when it is written; one row of its smallest id stands for it
    first = F.min(F.struct("id", "ht")).alias("r")
    node = sig.where("h1 IS NOT NULL AND id IS NOT NULL").groupBy("h1", "h2").agg(first).select("h1", "h2", "r.id", "r.ht")
    node = work.put(node.withColumn("v", F.monotonically_increasing_id()), "nodes")
    own = ["id", "ht", "h1", "h2"]
    whole = sig.join(node, own).dropDuplicates(own)
    traits = work.put(whole.select("v", "n", "low", "bands"), "traits")
    member = traits.select("v", F.explode("bands").alias("code"))
    bucket = member.groupBy("code").agg(F.min("v").alias("a"), F.count("*").alias("size")).where("size > 1")
    in_bucket = work.put(member.join(bucket, "code").select("code", "v", "a", "size"), "buckets")
    pairs = work.put(in_bucket.where("v <> a").select("a", F.col("v").alias("b")).distinct(), "pairs")
    wanted = in_bucket.select("v").distinct().join(node.select("v", "id", "ht"), "v")
    texts_of = src.join(wanted.hint("merge"), ["id", "ht"]).dropDuplicates(["id", "ht", "v"])
    sets = work.put(texts_of.select("v", "t").mapInArrow(_sets(width), "v long, shingles binary"), "sets")
    links = work.put(_links(work, pairs, sets, percent), "links")
    comp = work.put(components(work.part("cc"), links), "components").withColumnRenamed("node", "v")
    work.drop("pairs")

    seen = in_bucket.join(comp, "v", "left").withColumn("component", F.coalesce("component", "v"))
    mixed = seen.groupBy("code").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("code")
    rest = work.put(seen.join(mixed, "code").select("code", "v", "component", "size"), "mixed")
    work.drop("buckets")
    traits = traits.select("v", "n", "low")
    keys = ["code", "i", "j"]
    dealt = _blocks(rest.join(traits, "v"), "size", BLOCK).repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "v")
    near = work.put(dealt.select(*keys, "v", "n", "component", "block", "low").mapInArrow(_families(percent), "a long, b long").distinct(), "families")
    found = links
    if not near.isEmpty():
        family = work.put(components(work.part("cc-families"), near).select(F.col("node").alias("v"), F.col("component").alias("code")), "family")
        sizes = family.groupBy("code").agg(F.count("*").alias("size"))
        full = family.join(sizes, "code").join(comp, "v", "left").withColumn("component", F.coalesce("component", "v"))
        full = _blocks(full.join(traits, "v"), "size", FAMILY_BLOCK).join(sets, "v").repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "v")
        more = full.select(*keys, "v", "n", "component", "block", "low", "shingles").mapInArrow(_settle(percent), "a long, b long")
        comp = work.put(components(work.part("cc-all"), work.put(found.union(more), "all-links")), "all-components").withColumnRenamed("node", "v")
    label = members(work, comp.withColumnRenamed("v", "node"), node.select("v", "h1", "h2", "id"), "v", "id").select("h1", "h2", "component")
    out = sig.select("id", "n", "h1", "h2").join(label, ["h1", "h2"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))
    out = work.put(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")), "result")
    work.drop_all_but("result")
    return work.last(out)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, that of the smallest id; its row is unchanged.

    Rows without an id stay. Of rows that repeat an id one stays.
    """
    work = Workspace(spark, "minhash-stage")
    kept = work.put(near_duplicates(docs).where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")), "kept")
    out = docs.join(kept.select("doc_id").hint("merge"), "doc_id", "left_semi")
    repeated = kept.where("rows > 1").select("doc_id")
    if not repeated.isEmpty():
        out = out.join(repeated, "doc_id", "left_anti").unionByName(out.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out.unionByName(docs.where("doc_id IS NULL")).select(*(f"`{c}`" for c in docs.columns))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_n FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * both_n >= 80 * (ca.n + cb.n - both_n)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(node, to_id) AS (SELECT a, b FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.to_id = e.a),
m AS (SELECT node, least(node, min(to_id)) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id, w.doc_id = coalesce(m.component_id, w.doc_id) AS kept
FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN m ON m.node = w.doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
