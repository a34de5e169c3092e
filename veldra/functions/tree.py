"""Expression trees: parsing tokens, printing them in three notations and LaTeX, measuring."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

from .symbols import SymbolLibrary


def is_number(token) -> bool:
    """Whether float() takes the token, so nan, inf and exponents count."""
    if token is None:
        return False
    try:
        float(token)
    except (TypeError, ValueError):
        return False
    return True


class Node:
    """A symbol with up to two children; a function has its argument on the left."""

    __slots__ = ("symbol", "right", "left")

    def __init__(self, symbol: str, right: Node | None = None, left: Node | None = None):
        self.symbol, self.right, self.left = symbol, right, left

    def postorder(self) -> Iterator[Node]:
        """Left, right, self; without recursion, as trees may be deep."""
        stack: list[tuple[Node, bool]] = [(self, False)]
        while stack:
            node, open_ = stack.pop()
            if open_:
                yield node
                continue
            stack.append((node, True))
            if node.right is not None:
                stack.append((node.right, False))
            if node.left is not None:
                stack.append((node.left, False))

    def _fold(self, leaf_or_join):
        """leaf_or_join(node, left result, right result) for every node, bottom up."""
        out: dict[int, object] = {}
        for n in self.postorder():
            out[id(n)] = leaf_or_join(n, out[id(n.left)] if n.left is not None else None, out[id(n.right)] if n.right is not None else None)
        return out[id(self)]

    def height(self) -> int:
        return self._fold(lambda n, a, b: 1 + max(a or 0, b or 0))

    def __len__(self) -> int:
        return sum(1 for _ in self.postorder())

    def __copy__(self) -> Node:
        return self._fold(lambda n, a, b: Node(n.symbol, b, a))

    def __eq__(self, other) -> bool:
        return isinstance(other, Node) and self.to_list(notation="postfix") == other.to_list(notation="postfix") and self.to_list(notation="prefix") == other.to_list(notation="prefix")

    __hash__ = None

    def __str__(self) -> str:
        return "".join(self.to_list())

    def to_list(self, library: SymbolLibrary | None = None, notation: str = "infix") -> list[str]:
        if notation == "postfix":
            return [n.symbol for n in self.postorder()]
        if notation == "prefix":
            return self._fold(lambda n, a, b: [n.symbol, *(a or []), *(b or [])])
        if notation != "infix":
            raise ValueError("Invalid notation selected: use infix, prefix or postfix")
        if library is None:
            try:
                library = SymbolLibrary.active()
            except RuntimeError:
                warnings.warn("no symbol library is active, so the expression may have needless parentheses", stacklevel=2)
                return self._fold(_infix_plain)
        return self._fold(lambda n, a, b: _infix(n, a, b, library))

    def to_latex(self, library: SymbolLibrary | None = None) -> str:
        """The expression between dollar signs; constants are numbered from the left."""
        library = library or SymbolLibrary.active()
        count = 0

        def piece(n: Node, a: str | None, b: str | None) -> str:
            nonlocal count
            if is_number(n.symbol):
                return str(n.symbol)
            s = library.get(n.symbol)
            if s is None:
                raise ValueError(f"Invalid symbol type for symbol {n.symbol}.")
            if s.kind == "const":
                count += 1
                return s.latex.format(count - 1)
            if s.arity == 0:
                return s.latex
            if s.arity == 1:
                return s.latex.format(f"({a})" if n.left is not None and library.kind(n.left.symbol) in ("fn", "op") else a)
            parts = [f"({text})" if not is_number(child.symbol) and -1 < library.precedence(child.symbol) < s.precedence else text for child, text in ((n.left, a), (n.right, b))]
            return s.latex.format(*parts)

        return f"${self._fold(piece)}$"


def _bracket(tokens: list[str]) -> list[str]:
    return ["(", *tokens, ")"]


def _infix_plain(n: Node, a: list[str] | None, b: list[str] | None) -> list[str]:
    if a is None and b is None:
        return [n.symbol]
    if b is None:
        return [*_bracket(a), n.symbol] if n.symbol.startswith("^") else [n.symbol, *_bracket(a)]
    return [*(_bracket(a) if len(a) > 1 else a), n.symbol, *(_bracket(b) if len(b) > 1 else b)]


def _infix(n: Node, a: list[str] | None, b: list[str] | None, library: SymbolLibrary) -> list[str]:
    if is_number(n.symbol):
        return [n.symbol]
    s = library.get(n.symbol)
    if s is None:
        raise ValueError(f"Invalid symbol type for symbol {n.symbol}.")
    if s.arity == 0:
        return [n.symbol]
    if s.arity == 1:
        if s.precedence > 0:
            return [n.symbol, *_bracket(a)]
        return [*(_bracket(a) if len(a) > 1 else a), n.symbol]
    parts = [_bracket(x) if not is_number(c.symbol) and -1 < library.precedence(c.symbol) <= s.precedence else x for c, x in ((n.left, a), (n.right, b))]
    return [*parts[0], n.symbol, *parts[1]]


class _Reader:
    """Precedence climbing over tokens."""

    def __init__(self, tokens: list[str], library: SymbolLibrary):
        self.tokens, self.library, self.at = tokens, library, 0

    @property
    def next(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def fail(self, why: str):
        return ValueError(f"Error while parsing expression: {why}")

    def expression(self, least: float = float("-inf")) -> Node:
        """Operands joined by operators of at least this precedence, from the left."""
        node = self.operand()
        while self.next is not None and self.library.kind(self.next) == "op" and self.library.precedence(self.next) >= least:
            op = self.next
            self.at += 1
            node = Node(op, self.expression(self.library.precedence(op) + 0.5), node)
        return node

    def operand(self) -> Node:
        token = self.next
        if token is None:
            raise self.fail("an operand is missing")
        self.at += 1
        kind = self.library.kind(token)
        if token == "(":
            node = self.group()
        elif kind == "fn" and not token.startswith("^"):
            if self.next != "(":
                return Node(token, None, self.expression(self.library.precedence(token) + 0.5))
            self.at += 1
            node = Node(token, None, self.group())
        elif kind in ("var", "const", "lit") or not kind and is_number(token):
            node = Node(token)
        elif kind or token == ")":
            raise self.fail(f"{token} has no operand before it")
        else:
            raise ValueError(f"Invalid symbol {token}")
        while self.next is not None and self.next.startswith("^") and self.library.kind(self.next) == "fn":
            node = Node(self.next, None, node)
            self.at += 1
        return node

    def group(self) -> Node:
        node = self.expression()
        if self.next != ")":
            raise self.stray() if self.next is not None else self.fail("a parenthesis isn't closed")
        self.at += 1
        return node

    def stray(self) -> ValueError:
        known = self.next in "()" or self.next in self.library or is_number(self.next)
        return self.fail(f"{self.next} doesn't fit where it stands") if known else ValueError(f"Invalid symbol {self.next}")


def parse(tokens: list[str], library: SymbolLibrary | None = None) -> Node:
    """The tree of infix tokens. All operators, ^ too, join from the left; a function that starts with ^ applies to the operand
    before it. Unknown tokens and misplaced ones raise ValueError."""
    reader = _Reader(list(tokens), library or SymbolLibrary.active())
    node = reader.expression()
    if reader.next is not None:
        raise reader.stray()
    return node


def as_tree(expr: Node | list[str], library: SymbolLibrary) -> Node:
    return expr if isinstance(expr, Node) else parse(list(expr), library)


def key_of(expr: Node | list[str], library: SymbolLibrary) -> str:
    """The canonical text of an expression: infix tokens without blanks."""
    return "".join(expr.to_list(library) if isinstance(expr, Node) else expr)


def constants(tree: Node, library: SymbolLibrary) -> int:
    return sum(library.kind(n.symbol) == "const" for n in tree.postorder())


def latex(expr: Node | list[str], library: SymbolLibrary | None = None) -> str:
    """LaTeX of an expression; an expression that can't be read gives the empty text."""
    library = SymbolLibrary.or_default(library)
    try:
        return as_tree(expr, library).to_latex(library)
    except ValueError:
        return ""
