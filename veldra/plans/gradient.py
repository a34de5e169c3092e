"""Reverse-mode differentiation of expressions: the gradient of a mean square as columns of one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import SymbolLibrary, variable
from ..functions.tree import Node, as_tree
from .compile import bindings, to_column

#: Partial derivatives of a symbol by its arguments, over A and B (the arguments) and V (its value).
PARTIALS = {
    "+": ("1", "1"),
    "-": ("1", "-1"),
    "*": ("B", "A"),
    "/": ("1 / B", "u- V / B"),
    "^": ("B * A ^ ( B - 1 )", "V * ln ( A )"),
    "u-": ("-1",),
    "sqrt": ("0.5 / V",),
    "sin": ("cos ( A )",),
    "cos": ("u- sin ( A )",),
    "tan": ("1 + V ^2",),
    "exp": ("V",),
    "arcsin": ("1 / sqrt ( 1 - A ^2 )",),
    "arccos": ("-1 / sqrt ( 1 - A ^2 )",),
    "arctan": ("1 / ( 1 + A ^2 )",),
    "sinh": ("cosh ( A )",),
    "cosh": ("sinh ( A )",),
    "tanh": ("1 - V ^2",),
    "floor": ("0",),
    "ceil": ("0",),
    "ln": ("1 / A",),
    "log": ("1 / ( A * ln ( 10 ) )",),
    "^-1": ("u- V ^2",),
    "^2": ("2 * A",),
    "^3": ("3 * A ^2",),
    "^4": ("4 * A ^3",),
    "^5": ("5 * A ^4",),
}


class NoDerivative(ValueError):
    """A symbol above a constant whose derivative isn't known."""


_RULES = SymbolLibrary([*SymbolLibrary.default(0).symbols.values(), variable("A"), variable("B"), variable("V")])


class Tape:
    """Steps that compute an expression's value, then the adjoints of its constants, each from columns of the steps before.

    Only nodes above a constant are differentiated, and every node is computed once: a step is a name, what it is made of, and the
    level of projections that it belongs to. Names start with a prefix, so that several tapes run side by side.
    """

    def __init__(self, expr: Node | list[str], columns: Sequence[str] | dict[str, str], library: SymbolLibrary | None = None, prefix: str = "_t"):
        self.library = SymbolLibrary.or_default(library)
        self.columns, self.prefix = bindings(self.library, columns), prefix
        tree = as_tree(expr, self.library)
        self.steps: list[tuple[int, str, Node | list[str] | int, dict[str, str]]] = []
        above: dict[int, bool] = {}
        for n in tree.postorder():
            above[id(n)] = self.library.kind(n.symbol) == "const" or any(above[id(c)] for c in (n.left, n.right) if c is not None)
        self.constants = 0
        self.names: dict[int, str] = {}
        self.level: dict[str, int] = {}
        order = []
        for n in tree.postorder():
            if not above[id(n)]:
                continue
            order.append(n)
            if self.library.kind(n.symbol) == "const":
                self._step(n, self.constants, {}, 0)
                self.constants += 1
                continue
            for c in (n.left, n.right):
                if c is not None and not above[id(c)]:
                    self._step(c, c, self.columns, 0)
            self._step(n, [n.symbol], {"AB"[k]: self.names[id(c)] for k, c in enumerate(c for c in (n.left, n.right) if c is not None)})
        if not above[id(tree)]:
            self._step(tree, tree, self.columns, 0)
        self.value = self.names[id(tree)]
        self.rest = f"{prefix}r"  # value less target
        self.level[self.rest] = self.level[self.value] + 1
        adjoint = {id(tree): ""}  # the value's derivative by itself, 1
        self.adjoints: list[tuple[int, str, str, list[str], dict[str, str]]] = []
        for n in reversed(order):
            if self.library.kind(n.symbol) == "const":
                continue
            if n.symbol not in PARTIALS:
                raise NoDerivative(f"{n.symbol} has no derivative")
            args = [c for c in (n.left, n.right) if c is not None]
            given = {"AB"[k]: self.names[id(c)] for k, c in enumerate(args)} | {"V": self.names[id(n)]}
            for k, c in enumerate(args):
                if above[id(c)]:
                    rule = PARTIALS[n.symbol][k].split()
                    name, upper = f"{prefix}a{len(self.adjoints)}", adjoint[id(n)]
                    self.level[name] = 1 + max([self.level[upper] if upper else 0, *(self.level[given[x]] for x in set(rule) & set(given))])
                    self.adjoints.append((self.level[name], name, upper, rule, given))
                    adjoint[id(c)] = name
        #: Columns of the value's derivatives by the constants from the left; "" is 1.
        self.gradient = [adjoint[id(n)] for n in order if self.library.kind(n.symbol) == "const"]

    def _step(self, node: Node, what: Node | list[str] | int, given: dict[str, str], level: int | None = None) -> None:
        name = f"{self.prefix}v{len(self.steps)}"
        self.names[id(node)] = name
        self.level[name] = 1 + max(self.level[x] for x in given.values()) if level is None else level
        self.steps.append((self.level[name], name, what, given))

    def _rule(self, symbol: str, given: dict[str, str]) -> list[str]:
        arity = len(given)
        return ["A", symbol, "B"] if arity == 2 else ["A", symbol] if self.library.precedence(symbol) < 0 else [symbol, "(", "A", ")"]

    def columns_by_level(self, target: Column, constants: Sequence[Column]) -> list[dict[str, Column]]:
        out: dict[int, dict[str, Column]] = {}
        own = SymbolLibrary([*self.library.symbols.values(), variable("A"), variable("B"), variable("V")])
        for level, name, what, given in self.steps:
            if isinstance(what, int):
                made = constants[what]
            elif isinstance(what, Node):
                made = to_column(what, given, (), self.library)
            else:
                made = to_column(self._rule(what[0], given), given, (), own)
            out.setdefault(level, {})[name] = made
        out.setdefault(self.level[self.rest], {})[self.rest] = F.col(self.value) - target
        for level, name, upper, rule, given in self.adjoints:
            part = to_column(rule, given, (), _RULES)
            made = part if not upper else F.col(upper) if rule == ["1"] else -F.col(upper) if rule == ["-1"] else F.col(upper) * part
            out.setdefault(level, {})[name] = made
        return [out[k] for k in sorted(out)]


def with_gradients(df: DataFrame, tapes: Sequence[Tape], target: str, constants: Sequence[Sequence[Column]]) -> DataFrame:
    """df with the steps of all tapes: projections on top of each other, in one stage."""
    levels: list[dict[str, Column]] = []
    y = F.col(f"`{target}`").cast("double")
    for tape, c in zip(tapes, constants, strict=True):
        for k, made in enumerate(tape.columns_by_level(y, c)):
            if k == len(levels):
                levels.append({})
            levels[k].update(made)
    for made in levels:
        df = df.withColumns(made)
    return df


def mean_squares(df: DataFrame, tapes: Sequence[Tape], target: str, points: Sequence[Sequence[float]], products: bool = False, also: Sequence[Column] = ()) -> list:
    """(mean square of what is left, its gradient, mean products of the value's derivatives) of each tape at its point, by one pass over df.

    The products are left out, as an empty matrix, unless asked for. Values less target in also give their mean squares behind these, in the
    same pass. NaN without rows.
    """
    full = with_gradients(df, tapes, target, [[F.lit(float(x)) for x in p] for p in points])
    told = {}
    for k, t in enumerate(tapes):
        g = [F.col(x) if x else F.lit(1.0) for x in t.gradient]
        told[f"f{k}"] = F.avg(F.col(t.rest) * F.col(t.rest))
        told |= {f"g{k}_{i}": F.avg(F.col(t.rest) * x) for i, x in enumerate(g)}
        if products:
            told |= {f"p{k}_{i}_{j}": F.avg(g[i] * g[j]) for i in range(len(g)) for j in range(i, len(g))}
    told |= {f"a{k}": F.avg(c * c) for k, c in enumerate(also)}
    row = full.agg(*[c.alias(n) for n, c in told.items()]).first()
    value = lambda n: float("nan") if row[n] is None else float(row[n])
    out = []
    for k, t in enumerate(tapes):
        n = t.constants
        gram = np.array([[value(f"p{k}_{min(i, j)}_{max(i, j)}") for j in range(n)] for i in range(n)]).reshape(n, n) if products else np.zeros((0, 0))
        out.append((value(f"f{k}"), 2 * np.array([value(f"g{k}_{i}") for i in range(n)]), gram))
    return out + [value(f"a{k}") for k in range(len(also))]
