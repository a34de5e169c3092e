"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, centroids, changes, chat, classlm, embeddings, idstore, minhash, mixing, quality, secrets, substrings, toxicity_terms

QUERIES = {
    "op4_chat": chat.query,
    "op10_toxicity": toxicity_terms.query,
    "op6_substrings": substrings.query,
    "op2_idstore": idstore.query,
    "op7_embeddings": embeddings.query,
    "op9_secrets": secrets.query,
    "op1_bpe": bpe.query,
    "op3_mixing": mixing.query,
    "op5_minhash": minhash.query,
    "op8_line_quality": quality.query,
    "op11_changepoints": changes.query,
    "op12_classlm": classlm.query,
    "op13_centroids": centroids.query,
}

ORACLES = {
    "op4_chat": chat.ORACLE,
    "op6_substrings": substrings.ORACLE,
    "op7_embeddings": embeddings.ORACLE,
    "op5_minhash": minhash.ORACLE,
    "op8_line_quality": quality.ORACLE,
    "op11_changepoints": changes.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
