"""Distances between expressions: edits of tokens and of trees."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .symbols import SymbolLibrary
from .tree import Node, as_tree


def sequence_edits(a: Sequence[str], b: Sequence[str]) -> int:
    """Levenshtein distance of two token lists, a row of the table at a time."""
    codes = {t: k for k, t in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([codes[t] for t in b])
    row = np.arange(len(b) + 1)
    offsets = np.arange(len(b) + 1)
    for i, t in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (y != codes[t]))
        new = np.concatenate([[i], best])
        row = np.minimum.accumulate(new - offsets) + offsets  # insertions, left to right
    return int(row[-1])


def token_distance(a: Node | list[str], b: Node | list[str], notation: str = "postfix", library: SymbolLibrary | None = None) -> int:
    """Edits between the tokens of two expressions in one notation."""
    library = SymbolLibrary.or_default(library)
    return sequence_edits(*(as_tree(e, library).to_list(library, notation) for e in (a, b)))


def token_distance_column(a: Column, b: Column, vocabulary: list[str]) -> Column:
    """The distance of two token arrays as a built-in: each token becomes one character, then levenshtein counts. Stays in codegen.

    Tokens outside the vocabulary count as one and the same token.
    """
    names = F.array(*[F.lit(t) for t in vocabulary])
    char = lambda t: F.char(F.lit(33) + F.array_position(names, t))
    text = lambda c: F.array_join(F.transform(c, char), "")
    if len(vocabulary) > 90:
        raise ValueError("at most 90 tokens have a character")
    return F.levenshtein(text(a), text(b))


def tree_distance(a: Node | list[str], b: Node | list[str], library: SymbolLibrary | None = None) -> int:
    """Least number of insertions, deletions and renamings of nodes between two ordered trees (Zhang and Shasha, 1989)."""
    library = SymbolLibrary.or_default(library)
    x, y = (_indexed(as_tree(e, library)) for e in (a, b))
    whole = np.zeros((len(x[0]), len(y[0])), int)
    for i in x[2]:
        for j in y[2]:
            _forest(x, y, i, j, whole)
    return int(whole[-1, -1])


def _indexed(tree: Node) -> tuple[list[str], list[int], list[int]]:
    """Postorder symbols, leftmost leaf of each node, and the keyroots."""
    nodes = list(tree.postorder())
    place = {id(n): k for k, n in enumerate(nodes)}
    left: list[int] = []
    for k, n in enumerate(nodes):
        child = n.left if n.left is not None else n.right
        left.append(k if child is None else left[place[id(child)]])
    roots = sorted({leaf: k for k, leaf in enumerate(left)}.values())
    return [n.symbol for n in nodes], left, roots


def _forest(x, y, i: int, j: int, whole: np.ndarray) -> None:
    (sx, lx, _), (sy, ly, _) = x, y
    a, b = lx[i], ly[j]
    d = np.zeros((i - a + 2, j - b + 2), int)
    d[:, 0], d[0, :] = np.arange(i - a + 2), np.arange(j - b + 2)
    for p in range(a, i + 1):
        for q in range(b, j + 1):
            r, s = p - a + 1, q - b + 1
            edit = min(d[r - 1, s], d[r, s - 1]) + 1
            if lx[p] == a and ly[q] == b:
                d[r, s] = min(edit, d[r - 1, s - 1] + (sx[p] != sy[q]))
                whole[p, q] = d[r, s]
            else:
                d[r, s] = min(edit, d[lx[p] - a, ly[q] - b] + whole[p, q])


def tree_distance_udf(library: SymbolLibrary):
    """tree_distance of two columns of tokens, in Arrow batches; an unreadable expression gives null."""

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(p, q):
            try:
                return None if p is None or q is None else tree_distance(list(p), list(q), library)
            except ValueError:
                return None

        return pd.Series([one(p, q) for p, q in zip(a, b, strict=True)], dtype="Int32")

    return distance
