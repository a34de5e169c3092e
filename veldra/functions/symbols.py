"""Symbols of expressions: what each token means as a Spark column, on numpy arrays, in SQL and in LaTeX."""

from __future__ import annotations

import contextvars
import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import functions as F

from . import semantics as S

#: Precedences of additive, multiplicative and power operators, of prefix functions and leaves, of postfix functions.
ADDITIVE, MULTIPLICATIVE, POWER, PREFIX, POSTFIX = 100, 200, 300, 1000, -1000
KINDS = ("var", "const", "fn", "op", "lit")


@dataclass(frozen=True)
class Symbol:
    name: str
    kind: str
    precedence: int
    latex: str
    column: Callable | None = None
    array: Callable | None = None
    sql: str | None = None
    builtin: bool = False

    @property
    def arity(self) -> int:
        return {"op": 2, "fn": 1}.get(self.kind, 0)


def _quiet(f: Callable) -> Callable:
    def run(*a):
        with np.errstate(all="ignore"):
            return f(*a)

    return run


def _fourth(a):
    t = a * a
    return t * t


def _fifth(a):
    t = a * a
    return t * t * a


def _table() -> dict[str, Symbol]:
    """The built-in symbols, in order."""
    rows = [
        ("+", "op", ADDITIVE, "{} + {}", lambda a, b: a + b, np.add, "({} + {})"),
        ("-", "op", ADDITIVE, "{} - {}", lambda a, b: a - b, np.subtract, "({} - {})"),
        ("*", "op", MULTIPLICATIVE, r"{} \cdot {}", lambda a, b: a * b, np.multiply, "({} * {})"),
        ("/", "op", MULTIPLICATIVE, r"\frac{{{}}}{{{}}}", S.ieee_div, np.divide, "({} / {})"),
        ("^", "op", POWER, "{}^{{{}}}", S.ieee_pow, np.power, "pow({}, {})"),
        ("u-", "fn", PREFIX, "- {}", lambda a: -a, np.negative, "(-{})"),
        ("sqrt", "fn", PREFIX, r"\sqrt {{{}}}", F.sqrt, np.sqrt, "CASE WHEN {0} < 0 THEN 'NaN'::DOUBLE ELSE sqrt({0}) END"),
        ("sin", "fn", PREFIX, r"\sin {}", F.sin, np.sin, "sin({})"),
        ("cos", "fn", PREFIX, r"\cos {}", F.cos, np.cos, "cos({})"),
        ("exp", "fn", PREFIX, "e^{{{}}}", F.exp, np.exp, "exp({})"),
        ("tan", "fn", PREFIX, r"\tan {}", F.tan, np.tan, "tan({})"),
        ("arcsin", "fn", PREFIX, r"\arcsin {}", F.asin, np.arcsin, "CASE WHEN abs({0}) > 1 THEN 'NaN'::DOUBLE ELSE asin({0}) END"),
        ("arccos", "fn", PREFIX, r"\arccos {}", F.acos, np.arccos, "CASE WHEN abs({0}) > 1 THEN 'NaN'::DOUBLE ELSE acos({0}) END"),
        ("arctan", "fn", PREFIX, r"\arctan {}", F.atan, np.arctan, "atan({})"),
        ("sinh", "fn", PREFIX, r"\sinh {}", F.sinh, np.sinh, "sinh({})"),
        ("cosh", "fn", PREFIX, r"\cosh {}", F.cosh, np.cosh, "cosh({})"),
        ("tanh", "fn", PREFIX, r"\tanh {}", F.tanh, np.tanh, "tanh({})"),
        ("floor", "fn", PREFIX, r"\lfloor {} \rfloor", S.ieee_floor, np.floor, "floor({})"),
        ("ceil", "fn", PREFIX, r"\lceil {} \rceil", S.ieee_ceil, np.ceil, "ceil({})"),
        ("ln", "fn", PREFIX, r"\ln {}", S.ieee_ln, np.log, "CASE WHEN {0} = 0 THEN '-Infinity'::DOUBLE WHEN {0} < 0 THEN 'NaN'::DOUBLE ELSE ln({0}) END"),
        ("log", "fn", PREFIX, r"\log_{{10}} {}", S.ieee_log10, np.log10, "CASE WHEN {0} = 0 THEN '-Infinity'::DOUBLE WHEN {0} < 0 THEN 'NaN'::DOUBLE ELSE log10({0}) END"),
        ("^-1", "fn", POSTFIX, "{}^{{-1}}", lambda a: S.ieee_div(F.lit(1.0), a), lambda a: np.divide(1.0, a), "(1.0::DOUBLE / {})"),
        ("^2", "fn", POSTFIX, "{}^2", lambda a: a * a, np.square, "({0} * {0})"),
        ("^3", "fn", POSTFIX, "{}^3", lambda a: a * a * a, lambda a: a * a * a, "({0} * {0} * {0})"),
        ("^4", "fn", POSTFIX, "{}^4", _fourth, _fourth, "(({0} * {0}) * ({0} * {0}))"),
        ("^5", "fn", POSTFIX, "{}^5", _fifth, _fifth, "(({0} * {0}) * ({0} * {0}) * {0})"),
        ("pi", "lit", PREFIX, r"\pi", lambda: F.lit(math.pi), lambda: math.pi, "pi()"),
        ("e", "lit", PREFIX, "e", lambda: F.lit(math.e), lambda: math.e, "exp(1.0::DOUBLE)"),
        ("C", "const", PREFIX, "C_{{{}}}", None, None, None),
    ]
    return {r[0]: Symbol(*r[:5], _quiet(r[5]) if r[5] else None, r[6], True) for r in rows}


BUILTIN = _table()


def variable(name: str, position: int | None = None) -> Symbol:
    head, _, tail = name.partition("_")
    return Symbol(name, "var", PREFIX, f"{head}_{{{tail}}}" if tail else name, builtin=position is not None)


class _Scope:
    """The active library of a context and the default one. It stays on the driver: a copy that is sent out is empty."""

    def __init__(self):
        self.active: contextvars.ContextVar = contextvars.ContextVar("veldra_symbols", default=None)
        self.fallback: SymbolLibrary | None = None

    def __reduce__(self):
        return _Scope, ()


_scope = _Scope()


class SymbolLibrary:
    """An ordered set of symbols. Variables stand for columns in the order in which they were added."""

    def __init__(self, symbols: list[Symbol] | None = None):
        self.symbols: dict[str, Symbol] = {s.name: s for s in symbols or []}
        self._tokens: list = []

    # building

    @classmethod
    def default(cls, num_variables: int = 25) -> SymbolLibrary:
        return cls([*BUILTIN.values(), *(variable(f"X_{k}", k) for k in range(num_variables))])

    @classmethod
    def of(cls, names: list[str], num_variables: int = 0) -> SymbolLibrary:
        """The named built-in symbols, in the library's own order; unknown names are passed over."""
        wanted = set(names)
        return cls([*(s for n, s in BUILTIN.items() if n in wanted), *(variable(f"X_{k}", k) for k in range(num_variables))])

    def add(self, name: str, kind: str, precedence: int = PREFIX, column: Callable | None = None, array: Callable | None = None, sql: str | None = None, latex: str | None = None) -> None:
        """Adds or replaces a symbol. Its meaning is given by callables on columns and arrays; no text is ever executed."""
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        if latex is None:
            latex = {"op": "{} " + name + " {}", "fn": name + " {}" if precedence > 0 else "{}" + name}.get(kind, name)
        found = variable(name) if kind == "var" else Symbol(name, kind, precedence, latex, column, _quiet(array) if array else None, sql)
        self.symbols[name] = replace(found, precedence=precedence, latex=latex if kind != "var" or latex != name else found.latex)

    def remove(self, name: str) -> None:
        del self.symbols[name]

    # looking up

    def get(self, name: str) -> Symbol | None:
        return self.symbols.get(name)

    def kind(self, name: str) -> str:
        return s.kind if (s := self.symbols.get(name)) else ""

    def precedence(self, name: str) -> int:
        return s.precedence if (s := self.symbols.get(name)) else -1

    def latex(self, name: str) -> str:
        return s.latex if (s := self.symbols.get(name)) else ""

    def of_kind(self, kind: str) -> list[str]:
        return [n for n, s in self.symbols.items() if s.kind == kind]

    @property
    def variables(self) -> list[str]:
        return self.of_kind("var")

    def index(self) -> dict[str, int]:
        return {n: k for k, n in enumerate(self.symbols)}

    def frame(self, spark):
        """The library as a small table: symbol, type, precedence, latex."""
        return spark.createDataFrame([(s.name, s.kind, s.precedence, s.latex) for s in self.symbols.values()], "symbol string, type string, precedence int, latex string")

    # storing

    def to_dict(self) -> dict:
        """Symbols by name; custom ones must be added again after reading, as code isn't stored."""
        return {"format_version": 1, "symbols": [{"name": s.name, "kind": s.kind, "precedence": s.precedence, "latex": s.latex} for s in self.symbols.values()]}

    @classmethod
    def from_dict(cls, d: dict) -> SymbolLibrary:
        out = cls()
        for s in d["symbols"]:
            own = BUILTIN.get(s["name"]) if s["kind"] != "var" else variable(s["name"], 0)
            out.symbols[s["name"]] = replace(own or Symbol(s["name"], s["kind"], s["precedence"], s["latex"]), precedence=s["precedence"], latex=s["latex"])
        return out

    # scope: on the driver only

    def __enter__(self) -> SymbolLibrary:
        self._tokens.append(_scope.active.set(self))
        return self

    def __exit__(self, *_) -> None:
        _scope.active.reset(self._tokens.pop())

    @staticmethod
    def active() -> SymbolLibrary:
        found = _scope.active.get() or _scope.fallback
        if found is None:
            raise RuntimeError("no symbol library is active")
        return found

    @staticmethod
    def or_default(given: SymbolLibrary | None = None) -> SymbolLibrary:
        return given or _scope.active.get() or _scope.fallback or SymbolLibrary.default()

    @staticmethod
    def set_default(library: SymbolLibrary | None) -> None:
        _scope.fallback = library

    def __len__(self) -> int:
        return len(self.symbols)

    def __contains__(self, name: str) -> bool:
        return name in self.symbols

    def __str__(self) -> str:
        return ", ".join(self.symbols)

    def __copy__(self) -> SymbolLibrary:
        return SymbolLibrary(list(self.symbols.values()))

    def __getstate__(self) -> dict:
        return {"symbols": self.symbols, "_tokens": []}
