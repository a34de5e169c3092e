"""Free constants: exact when they enter linearly, else by damped Gauss-Newton steps in the box."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import SymbolLibrary
from ..functions.tree import Node, as_tree, constants as count_constants
from ..plans.compile import Hoisted, bindings, evaluate as run_expression, to_column
from .score import rmse, score_many

#: Bytes of data that may be sent to every task; beyond it the data stay distributed.
MOST_SENT = 64_000_000


@dataclass(frozen=True)
class Settings:
    """Fixed defaults of the estimation."""

    tol: float = 1e-6
    gtol: float = 1e-3  # kept for stored settings; steps end by their gain
    max_iter: int = 100
    constant_bounds: tuple[float, float] = (-5.0, 5.0)
    initialization: str = "random"
    max_constants: int = 8
    max_expr_length: int = -1
    num_points_sampled: int = 64
    num_consts_sampled: int = 32
    domain_bounds: tuple | None = None

    def but(self, **changes) -> Settings:
        return replace(self, **changes)


def linear_parts(expr: Node | list[str], library: SymbolLibrary) -> tuple[Node | None, list[Node]] | None:
    """(rest, factors) if the expression is rest + sum of constant_i * factor_i, constants from the left; None if not."""

    def join(op: str, a: Node, b: Node) -> Node:
        return Node(op, b, a)

    def make(n: Node, a, b):
        kind = library.kind(n.symbol)
        if kind == "const":
            return None, [Node("1")]
        if a is None or a == "no" or b == "no":
            return (n, []) if a is None else "no"
        if not a[1] and (b is None or not b[1]):
            return Node(n.symbol, b[0] if b else None, a[0]), []
        if n.symbol == "+" or n.symbol == "-":
            sign = (lambda x: x) if n.symbol == "+" else (lambda x: Node("*", x, Node("-1")))
            rest = a[0] if b[0] is None else sign(b[0]) if a[0] is None else join(n.symbol, a[0], b[0])
            return rest, [*a[1], *map(sign, b[1])]
        if n.symbol == "u-":
            neg = lambda x: Node("*", x, Node("-1"))
            return a[0] and neg(a[0]), [neg(x) for x in a[1]]
        if n.symbol == "*" and not (a[1] and b[1]):
            lin, other = (a, b[0]) if a[1] else (b, a[0])
            return lin[0] and join("*", lin[0], other), [join("*", x, other) for x in lin[1]]
        if n.symbol == "/" and not b[1]:
            return a[0] and join("/", a[0], b[0]), [join("/", x, b[0]) for x in a[1]]
        return "no"

    found = as_tree(expr, library)._fold(make)
    return None if found == "no" else found


def box_least_squares(gram: np.ndarray, cross: np.ndarray, lo: float | np.ndarray, hi: float | np.ndarray) -> np.ndarray:
    """argmin of c' G c - 2 c' b in a box (one pair of bounds, or one for each variable) by active sets: the variables off the bounds are solved for, those that would leave the box are
    held at the bound met first, and held ones are let go while the slope draws them inside."""
    k = len(cross)
    lo, hi = np.broadcast_to(lo, k), np.broadcast_to(hi, k)
    c = np.clip(np.linalg.lstsq(gram, cross, rcond=None)[0], lo, hi)
    free = (c > lo) & (c < hi)
    slack = 1e-9 * (1 + np.abs(cross).max(initial=0.0))
    stuck = np.zeros(k, bool)
    for _ in range(10 * k + 10):
        while free.any():
            at = np.flatnonzero(free)
            goal = np.linalg.lstsq(gram[np.ix_(at, at)], cross[at] - gram[np.ix_(at, np.flatnonzero(~free))] @ c[~free], rcond=None)[0]
            step = goal - c[at]
            with np.errstate(divide="ignore", invalid="ignore"):
                room = np.where(step > 0, (hi[at] - c[at]) / step, np.where(step < 0, (lo[at] - c[at]) / step, np.inf))
            first = int(np.argmin(room))
            if room[first] >= 1:
                if np.abs(step).max() > 0:
                    stuck[:] = False
                c[at] = goal
                break
            if room[first] > 0:
                stuck[:] = False
            c[at] += max(0.0, room[first]) * step
            c[at[first]] = (hi if step[first] > 0 else lo)[at[first]]
            free[at[first]] = False
            stuck[at[first]] = True
        slope = cross - gram @ c
        pull = np.where(free | stuck, 0.0, np.where(c <= lo, slope, np.where(c >= hi, -slope, np.abs(slope))))
        out = int(np.argmax(pull)) if k else 0
        if not k or pull[out] <= slack:
            break
        free[out] = True
    return c


def fit_linear(df: DataFrame, expr: Node | list[str], columns: Sequence[str] | dict, target: str, settings: Settings = Settings(), library: SymbolLibrary | None = None) -> tuple[float, list[float]]:
    """(rmse, constants) of an expression that is linear in its constants: one aggregate of products, then a small solve."""
    library = SymbolLibrary.or_default(library)
    parts = linear_parts(expr, library)
    if parts is None or not parts[1]:
        raise ValueError("the expression isn't linear in its constants")
    names = bindings(library, columns)
    g = [to_column(x, names, (), library) for x in parts[1]]
    y = F.col(target).cast("double") - (to_column(parts[0], names, (), library) if parts[0] is not None else F.lit(0.0))
    data = df.select(*[x.alias(f"g{i}") for i, x in enumerate(g)], y.alias("y"))
    k = len(g)
    aggs = [F.sum(F.col(f"g{i}") * F.col(f"g{j}")).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    row = data.agg(*aggs, *[F.sum(F.col(f"g{i}") * F.col("y")).alias(f"b{i}") for i in range(k)]).first()
    gram = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    cross = np.array([row[f"b{i}"] for i in range(k)], float)
    if not (np.isfinite(gram).all() and np.isfinite(cross).all()):  # nulls too: there are no rows
        return float("nan"), []
    c = box_least_squares(gram, cross, *settings.constant_bounds)
    # the residual is taken from the data: by the products it would lose its last digits, which tell whether a fit is exact
    return float(rmse(df, expr, columns, target, c.tolist(), library).first()["rmse"]), c.tolist()


#: Weights of the diagonal that are tried together in a step, from Newton's step for squares to a short one down the slope.
DAMPING = (0.0, 1e-4, 1e-2, 1.0, 1e2, 1e4)
#: Part of the mean square that a step must gain for another one to follow.
FLAT = 1e-8


def around(c: np.ndarray, lo: float, hi: float) -> tuple[np.ndarray, np.ndarray]:
    """The points beside c for central differences, inside the box: (points, their distances)."""
    h = 1e-6 * np.maximum(1.0, np.abs(c))
    up, down = np.minimum(c + h, hi), np.maximum(c - h, lo)
    eye = np.eye(len(c), dtype=bool)
    return np.concatenate([np.where(eye, up, c), np.where(eye, down, c)]), up - down


def minimise(errors: Callable[[np.ndarray], np.ndarray], products: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, lo: float, hi: float, max_iter: int = 100, tol: float = 1e-15) -> tuple[float, np.ndarray]:
    """Least squares in a box by damped Gauss-Newton steps.

    errors gives the mean squares at a matrix of points. products gives, at a point, the mean products of the derivatives with each
    other and with the residuals, so an iteration is two passes over the data. Never ends above its start.
    """
    x = np.clip(start, lo, hi)
    value = float(errors(x[None])[0])
    if not np.isfinite(value):
        return value, x
    for _ in range(max_iter):
        gram, cross = products(x)
        if not (np.isfinite(gram).all() and np.isfinite(cross).all()):
            break
        scale = np.maximum(np.diag(gram), 1e-12 * max(1e-300, np.diag(gram).max()))
        points = np.array([np.clip(x + box_least_squares(gram + w * np.diag(scale), cross, lo - x, hi - x), lo, hi) for w in DAMPING])
        values = errors(points)
        best = int(np.argmin(np.where(np.isfinite(values), values, np.inf)))
        if not values[best] < value:
            break
        gain, x, value = value - values[best], points[best], float(values[best])
        if gain <= tol or gain <= FLAT * value:
            break
    return value, x


def start_of(key: str, k: int, settings: Settings, seed: int | None) -> np.ndarray:
    """Starting constants that depend on the seed and the expression alone, whatever the order of evaluation."""
    lo, hi = settings.constant_bounds
    if settings.initialization != "random":
        return np.full(k, (lo + hi) / 2)
    digest = hashlib.sha256(f"{seed}|{key}".encode()).digest()
    return np.random.default_rng(int.from_bytes(digest[:8], "little")).uniform(lo, hi - 1e-8, k)


def refused(tree: Node, k: int, settings: Settings, library: SymbolLibrary) -> bool:
    """Whether an expression has too many constants or is too long to be fitted."""
    return 0 <= settings.max_constants < k or 0 < settings.max_expr_length < len(tree.to_list(library))


def fit_rows(expr: Node | list[str], rows: np.ndarray, target: np.ndarray, settings: Settings = Settings(), seed: int | None = None, library: SymbolLibrary | None = None, key: str | None = None) -> tuple[float, list[float]]:
    """(rmse, constants) over a matrix in memory; (NaN, []) for an expression that is too long or has too many constants."""
    library = SymbolLibrary.or_default(library)
    tree = as_tree(expr, library)
    k = count_constants(tree, library)
    if refused(tree, k, settings, library):
        return float("nan"), []
    run = Hoisted(tree, rows, library)

    def errors(points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points))
        for i, c in enumerate(points):
            d = run(c) - target
            out[i] = d @ d / len(d) if len(d) else np.nan
        return out  # squared: smooth at an exact fit

    with np.errstate(all="ignore"):
        if not k:
            return float(np.sqrt(errors(np.zeros((1, 0)))[0])), []
        lo, hi = settings.constant_bounds
        if (parts := linear_parts(tree, library)) and len(target):
            g = np.stack([np.broadcast_to(run_expression(x, rows, (), library), target.shape) for x in parts[1]])
            y = target - run_expression(parts[0], rows, (), library) if parts[0] is not None else target
            gram, cross = g @ g.T, g @ y
            if not (np.isfinite(gram).all() and np.isfinite(cross).all()):
                return float("nan"), []
            c = box_least_squares(gram, cross, lo, hi)
            return float(np.sqrt(errors(c[None])[0])), c.tolist()

        def products(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            points, width = around(c, lo, hi)
            v = np.stack([np.broadcast_to(run(p), target.shape) for p in points])
            slope = (v[:k] - v[k:]) / width[:, None]
            return slope @ slope.T / len(target), slope @ (target - run(c)) / len(target)

        value, c = minimise(errors, products, start_of(key or "".join(tree.to_list(library)), k, settings, seed), lo, hi, settings.max_iter, settings.tol * 1e-9)
        return float(np.sqrt(value)), c.tolist()


def fit_distributed(df: DataFrame, expr: Node | list[str], columns: Sequence[str] | dict, target: str, settings: Settings = Settings(), seed: int | None = None, library: SymbolLibrary | None = None) -> tuple[float, list[float]]:
    """(rmse, constants) over data of any size, from the starts and in the box of fit_rows.

    A step is one pass for the error, its exact gradient and the products of derivatives. An expression with a symbol whose derivative isn't known takes
    differences instead: a pass for their products and one that scores a step's points together.
    """
    from ..plans.gradient import NoDerivative
    from .quasi_newton import fit_together

    library = SymbolLibrary.or_default(library)
    tree = as_tree(expr, library)
    k = count_constants(tree, library)
    if refused(tree, k, settings, library):
        return float("nan"), []
    if not k:
        return float(rmse(df, tree, columns, target, (), library).first()["rmse"]), []
    if linear_parts(tree, library):
        return fit_linear(df, tree, columns, target, settings, library)
    try:
        return fit_together(df, [tree], columns, target, settings, seed, library)[0]
    except NoDerivative:
        pass

    def errors(points: np.ndarray) -> np.ndarray:
        got = {r["expr_key"]: r["error"] for r in score_many(df, [(str(i), tree, p.tolist()) for i, p in enumerate(points)], columns, target, library).collect()}
        return np.array([got.get(str(i), np.nan) for i in range(len(points))], float) ** 2

    lo, hi = settings.constant_bounds
    names = bindings(library, columns)

    def products(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points, width = around(c, lo, hi)
        v = [to_column(tree, names, p.tolist(), library) for p in points]
        own = df.select(*[((v[i] - v[k + i]) / F.lit(float(width[i]))).alias(f"g{i}") for i in range(k)], (F.col(target).cast("double") - to_column(tree, names, c.tolist(), library)).alias("r"))
        cells = [(i, j) for i in range(k) for j in range(i, k)]
        row = own.agg(*[F.avg(F.col(f"g{i}") * F.col(f"g{j}")).alias(f"a{i}_{j}") for i, j in cells], *[F.avg(F.col(f"g{i}") * F.col("r")).alias(f"b{i}") for i in range(k)]).first()
        return np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float), np.array([row[f"b{i}"] for i in range(k)], float)

    value, c = minimise(errors, products, start_of("".join(tree.to_list(library)), k, settings, seed), lo, hi, settings.max_iter, settings.tol * 1e-9)
    return float(np.sqrt(value)), c.tolist()


def fit_many(candidates: DataFrame, rows: np.ndarray, target: np.ndarray, settings: Settings = Settings(), seed: int | None = None, library: SymbolLibrary | None = None) -> DataFrame:
    """Candidates (expr_key, tokens) fitted in parallel over data that fit in a task: (expr_key, tokens, error, parameters).

    The data are broadcast, so their size is checked. Unreadable expressions have error NaN and no parameters.
    """
    library = SymbolLibrary.or_default(library)
    rows, target = np.asarray(rows, float), np.asarray(target, float)
    if rows.nbytes + target.nbytes > MOST_SENT:
        raise ValueError(f"{rows.nbytes + target.nbytes} bytes are too many to send to every task; use fit_distributed")
    sent = candidates.sparkSession.sparkContext.broadcast((rows, target))

    def run(frames):
        x, y = sent.value
        for pdf in frames:
            errors, found = [], []
            for key, tokens in zip(pdf["expr_key"], pdf["tokens"], strict=True):
                try:
                    e, c = fit_rows(list(tokens), x, y, settings, seed, library, key)
                except (ValueError, IndexError):
                    e, c = float("nan"), []
                errors.append(e)
                found.append(c)
            yield pd.DataFrame({"expr_key": pdf["expr_key"], "tokens": pdf["tokens"], "error": errors, "parameters": found})

    return candidates.select("expr_key", "tokens").mapInPandas(run, "expr_key string, tokens array<string>, error double, parameters array<double>")
