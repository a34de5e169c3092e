"""Corpus pipeline: quality rules, near-duplicates, secrets, source mixing and BPE ids, stage by stage."""

from __future__ import annotations

from veldra.llm import bpe, minhash, mixing, quality, secrets
from veldra.llm.common import Workspace

STAGES = [
    ("quality", quality.stage),
    ("near_duplicates", minhash.stage),
    ("secrets", secrets.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

#: The last stage's ids can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Every stage in order over documents; each stage's result is written and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.put(docs, f"{k}-{name}")
            work.drop_all_but(f"{k}-{name}")
    return work.last(docs)
