"""Expressions to Spark columns, DuckDB SQL and numpy programs; constant-free parts are hoisted out of the search for constants."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import SymbolLibrary
from ..functions.tree import Node, as_tree, is_number

#: Operands that a program may hold at once.
MOST_DEPTH = 128


def bindings(library: SymbolLibrary, columns: Sequence[str] | dict[str, str]) -> dict[str, str]:
    """Variable to column name: by mapping, or by order."""
    return dict(columns) if isinstance(columns, dict) else dict(zip(library.variables, columns, strict=False))


def to_column(expr: Node | list[str], columns: Sequence[str] | dict[str, str], constants: Sequence[float] | Column = (), library: SymbolLibrary | None = None, given: dict[int, Column] | None = None) -> Column:
    """The expression as one column: Catalyst folds, pushes and compiles it with the rest of the plan.

    constants are numbers, or an array column of which the i-th constant from the left reads element i. given replaces subtrees
    (by identity) by columns computed before.
    """
    library = SymbolLibrary.or_default(library)
    tree, names = as_tree(expr, library), bindings(library, columns)
    used = 0

    def make(n: Node, a: Column | None, b: Column | None) -> Column:
        nonlocal used
        if given and id(n) in given:
            return given[id(n)]
        if is_number(n.symbol) and n.symbol not in library:
            return F.lit(float(n.symbol))
        s = library.get(n.symbol)
        if s is None:
            raise ValueError(f"Invalid symbol {n.symbol}")
        if s.kind == "var":
            return F.col(f"`{names[n.symbol]}`").cast("double")
        if s.kind == "const":
            used += 1
            return F.get(constants, F.lit(used - 1)) if isinstance(constants, Column) else F.lit(float(constants[used - 1]))
        if s.column is None:
            raise ValueError(f"{n.symbol} has no meaning for columns")
        return s.column(*[x for x in (a, b) if x is not None])

    return tree._fold(make)


def to_sql(expr: Node | list[str], columns: Sequence[str] | dict[str, str], constants: Sequence[float] | str = (), library: SymbolLibrary | None = None) -> str:
    """The expression in DuckDB's SQL, which is IEEE as it stands. constants are numbers, or the name of a list column."""
    library = SymbolLibrary.or_default(library)
    tree, names = as_tree(expr, library), bindings(library, columns)
    used = 0

    def make(n: Node, a: str | None, b: str | None) -> str:
        nonlocal used
        if is_number(n.symbol) and n.symbol not in library:
            return f"'{float(n.symbol)!r}'::DOUBLE"
        s = library.get(n.symbol)
        if s.kind == "var":
            return f"{names[n.symbol]}::DOUBLE"
        if s.kind == "const":
            used += 1
            return f"{constants}[{used}]" if isinstance(constants, str) else f"'{float(constants[used - 1])!r}'::DOUBLE"
        return s.sql.format(*[x for x in (a, b) if x is not None])

    return tree._fold(make)


@dataclass
class Program:
    """A postfix program: for each step what it is (number, column, constant, given, call) and its operand."""

    steps: list[tuple[str, object]]
    constants: int
    depth: int

    def run(self, columns: np.ndarray, constants: Sequence[float] = (), given: Sequence[np.ndarray] = ()) -> np.ndarray:
        """Values over all rows of a (rows, variables) matrix, by whole columns."""
        stack: list = []
        with np.errstate(all="ignore"):
            for kind, x in self.steps:
                if kind == "column":
                    stack.append(columns[:, x])
                elif kind == "number":
                    stack.append(x)
                elif kind == "constant":
                    stack.append(constants[x])
                elif kind == "given":
                    stack.append(given[x])
                else:
                    f, arity = x
                    args = stack[len(stack) - arity :]
                    del stack[len(stack) - arity :]
                    stack.append(f(*args))
        out = np.asarray(stack[0], float)
        return np.broadcast_to(out, (len(columns),)) if out.ndim == 0 else out


def to_program(expr: Node | list[str], library: SymbolLibrary | None = None, given: dict[int, int] | None = None) -> Program:
    library = SymbolLibrary.or_default(library)
    place = {v: k for k, v in enumerate(library.variables)}
    steps: list[tuple[str, object]] = []
    used = depth = most = 0
    tree = as_tree(expr, library)
    for n in tree.postorder() if not given else _above(tree, given):
        if given and id(n) in given:
            steps.append(("given", given[id(n)]))
            depth += 1
        elif is_number(n.symbol) and n.symbol not in library:
            steps.append(("number", np.float64(n.symbol)))
            depth += 1
        else:
            s = library.get(n.symbol)
            if s is None:
                raise ValueError(f"Invalid symbol {n.symbol}")
            if s.kind == "var":
                steps.append(("column", place[n.symbol]))
            elif s.kind == "const":
                steps.append(("constant", used))
                used += 1
            elif s.array is None:
                raise ValueError(f"{n.symbol} has no meaning for arrays")
            else:
                steps.append(("call", (s.array, s.arity)))
            depth += 1 - s.arity
        most = max(most, depth)
    if most > MOST_DEPTH:
        raise ValueError(f"the expression needs {most} operands at once; at most {MOST_DEPTH} are allowed")
    return Program(steps, used, most)


def _above(tree: Node, given: dict[int, int]):
    """Postorder that doesn't enter given subtrees."""
    stack: list[tuple[Node, bool]] = [(tree, False)]
    while stack:
        n, open_ = stack.pop()
        if open_ or id(n) in given:
            yield n
            continue
        stack.append((n, True))
        for child in (n.right, n.left):
            if child is not None:
                stack.append((child, False))


def hoistable(tree: Node, library: SymbolLibrary) -> list[Node]:
    """The largest subtrees without constants that are more than a leaf; none if the whole tree has no constant."""
    free: dict[int, bool] = {}
    for n in tree.postorder():
        free[id(n)] = library.kind(n.symbol) != "const" and all(free[id(c)] for c in (n.left, n.right) if c is not None)
    if free[id(tree)]:
        return []
    out, stack = [], [tree]
    while stack:
        n = stack.pop()
        if free[id(n)]:
            if n.left is not None:
                out.append(n)
            continue
        stack += [c for c in (n.right, n.left) if c is not None]
    return out


def hoisted(df: DataFrame, expr: Node | list[str], columns: Sequence[str] | dict[str, str], constants: Column, library: SymbolLibrary | None = None):
    """(df with the constant-free parts as columns, the rest of the expression over them): evaluate the parts before a fan-out
    over constants, so that each is computed once for a row."""
    library = SymbolLibrary.or_default(library)
    tree = as_tree(expr, library)
    parts = hoistable(tree, library)
    out = df.withColumns({f"_part{k}": to_column(p, columns, (), library) for k, p in enumerate(parts)}) if parts else df
    return out, to_column(tree, columns, constants, library, {id(p): F.col(f"_part{k}") for k, p in enumerate(parts)})


class Hoisted:
    """An expression over fixed rows with its constant-free parts evaluated once; called with constants."""

    def __init__(self, expr: Node | list[str], rows: np.ndarray, library: SymbolLibrary | None = None):
        library = SymbolLibrary.or_default(library)
        tree = as_tree(expr, library)
        parts = hoistable(tree, library)
        self.rows = np.asarray(rows, float)
        self.given = [to_program(p, library).run(self.rows) for p in parts]
        self.program = to_program(tree, library, {id(p): k for k, p in enumerate(parts)} or None)

    def __call__(self, constants: Sequence[float] = ()) -> np.ndarray:
        return self.program.run(self.rows, constants, self.given)


def evaluate(expr: Node | list[str], rows: np.ndarray, constants: Sequence[float] = (), library: SymbolLibrary | None = None) -> np.ndarray:
    return to_program(expr, library).run(np.asarray(rows, float), constants)


def with_value(df: DataFrame, expr: Node | list[str], columns: Sequence[str] | dict[str, str], constants: Sequence[float] | Column = (), name: str = "value", library: SymbolLibrary | None = None) -> DataFrame:
    return df.withColumn(name, to_column(expr, columns, constants, library))
