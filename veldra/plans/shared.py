"""Many expressions over the same rows as one graph: equal parts of all of them are computed once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

from ..functions.symbols import SymbolLibrary
from ..functions.tree import Node, as_tree, is_number

#: Rows that are evaluated at once, which bounds what the open nodes hold.
SLICE = 4096


class Graph:
    """Expressions as a graph of distinct nodes, which stand behind their arguments.

    A node's key is its meaning and the numbers of its arguments, so parts that are equal get one number whatever expression they are
    in. Sums and products are equal in both orders, as they are to the last bit. Constants are equal where their values are.
    """

    def __init__(self, expressions: Iterable[tuple[Node | list[str], Sequence[float]]], library: SymbolLibrary | None = None):
        self.library = SymbolLibrary.or_default(library)
        place = {v: k for k, v in enumerate(self.library.variables)}
        numbers: dict[tuple, int] = {}
        self.nodes: list[tuple[str, object, tuple[int, ...]]] = []
        self.roots: list[int] = []
        self.written = 0
        for expr, constants in expressions:
            used = 0

            def make(n: Node, a: int | None, b: int | None) -> int:
                nonlocal used
                self.written += 1
                args = tuple(x for x in (a, b) if x is not None)
                s = self.library.get(n.symbol)
                if s is None and is_number(n.symbol):
                    key: tuple = ("number", float(n.symbol).hex())
                    made: tuple = ("number", np.float64(n.symbol), ())
                elif s is None:
                    raise ValueError(f"Invalid symbol {n.symbol}")
                elif s.kind == "var":
                    key, made = ("column", place[n.symbol]), ("column", place[n.symbol], ())
                elif s.kind == "const":
                    value = float(constants[used])
                    used += 1
                    key, made = ("number", value.hex()), ("number", np.float64(value), ())
                elif s.array is None:
                    raise ValueError(f"{n.symbol} has no meaning for arrays")
                else:
                    key = ("call", n.symbol, tuple(sorted(args)) if n.symbol in ("+", "*") else args)
                    made = ("call", s.array, args)
                if key not in numbers:
                    numbers[key] = len(self.nodes)
                    self.nodes.append(made)
                return numbers[key]

            self.roots.append(as_tree(expr, self.library)._fold(make))
        #: How often a node is an argument or an expression: once so often used, its values are let go.
        self.uses = np.bincount([x for _, _, args in self.nodes for x in args] + self.roots, minlength=len(self.nodes)).tolist()

    def __len__(self) -> int:
        return len(self.nodes)

    def run(self, columns: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(place of an expression, its values over the rows), in the order in which they are ready. Every node is computed once."""
        at: dict[int, list[int]] = {}
        for k, r in enumerate(self.roots):
            at.setdefault(r, []).append(k)
        left = list(self.uses)
        held: dict[int, object] = {}
        with np.errstate(all="ignore"):
            for k, (kind, x, args) in enumerate(self.nodes):
                held[k] = columns[:, x] if kind == "column" else x if kind == "number" else x(*[held[a] for a in args])
                for root in at.get(k, ()):
                    yield root, np.broadcast_to(np.asarray(held[k], float), len(columns))
                for a in (*args, *[k] * len(at.get(k, ()))):
                    left[a] -= 1
                    if not left[a]:
                        held.pop(a, None)

    def squared_errors(self, columns: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Sum of squared differences of each expression from the target, over slices of the rows."""
        out = np.zeros(len(self.roots))
        for lo in range(0, len(columns), SLICE):
            y = target[lo : lo + SLICE]
            for k, v in self.run(columns[lo : lo + SLICE]):
                with np.errstate(all="ignore"):
                    d = v - y
                    out[k] += d @ d
        return out
