"""Bounded fits with exact gradients over data that stay distributed, many expressions in step: limited-memory BFGS and damped least squares."""

from __future__ import annotations

from collections.abc import Generator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import SymbolLibrary
from ..functions.tree import Node, as_tree, constants as count_constants, key_of
from ..plans.compile import bindings, to_column
from ..plans.gradient import Tape, mean_squares
from .fit import DAMPING, FLAT, Settings, box_least_squares, refused, start_of
from .score import score_columns

#: Steps that the curvature is told from, and expressions whose gradients are columns of one plan.
MEMORY, SIDE_BY_SIDE = 10, 16
#: Least part of the slope that a step must gain, and how often it is shortened.
ARMIJO, SHORTER = 1e-4, 20

#: A mean square from which on a fit is exact.
EXACT = 1e-18

#: Yields ("slopes", point), and is sent (value, gradient, products of derivatives) there, or ("values", points), and is sent their values;
#: returns the best (value, point).
Steps = Generator[tuple[str, np.ndarray], object, tuple[float, np.ndarray]]


def two_loops(gradient: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the inverse Hessian that the (step, change of gradient) pairs tell, times the gradient (Nocedal, 1980)."""
    q, alphas = gradient.copy(), []
    for s, y in reversed(pairs):
        a = (s @ q) / (s @ y)
        alphas.append(a)
        q -= a * y
    if pairs:
        s, y = pairs[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(pairs, reversed(alphas), strict=True):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def lbfgs(start: np.ndarray, lo: float, hi: float, max_iter: int = 100, gtol: float = 1e-9, ftol: float = 1e-12) -> Steps:
    """Minimises in a box by values and gradients.

    Constants at a bound whose slope leads outside are held; the direction comes from the curvature of the others, and steps are bent along the
    box. A step that doesn't gain is shortened to the minimum of the parabola through what is known, within limits. Ends where the
    projected slope or the relative gain is small. A start without finite value is its own end.
    """
    x = np.clip(np.asarray(start, float), lo, hi)
    f, g, _ = yield "slopes", x
    if not (np.isfinite(f) and np.isfinite(g).all()):
        return f, x
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        slope = np.clip(x - g, lo, hi) - x
        if np.abs(slope).max() <= gtol * max(1.0, np.sqrt(abs(f))):
            break
        held = ((x <= lo) & (g > 0)) | ((x >= hi) & (g < 0))
        free = np.where(held, 0.0, g)
        # pairs are told on the constants that are free now
        usable = [(s, y) for s, y in ((np.where(held, 0.0, s), np.where(held, 0.0, y)) for s, y in pairs) if s @ y > 1e-14 * np.sqrt((s @ s) * (y @ y)) > 0]
        d = np.where(held, 0.0, two_loops(free, usable))
        if not usable or d @ free >= 0:
            d = -free * min(1.0, 1.0 / np.abs(free).max())
        t = 1.0
        for _ in range(SHORTER):
            to = np.clip(x + t * d, lo, hi)
            moved = to - x
            if not moved.any():
                break
            f2, g2, _ = yield "slopes", to
            if np.isfinite(f2) and np.isfinite(g2).all() and f2 <= f + ARMIJO * (g @ moved):
                break
            bend = f2 - f - g @ moved
            t *= float(np.clip(-(g @ moved) / (2 * bend), 0.1, 0.5)) if np.isfinite(bend) and bend > 0 else 0.1
        else:
            break
        if not moved.any():
            break
        change, gain = g2 - g, f - f2
        if moved @ change > 1e-14 * np.sqrt((moved @ moved) * (change @ change)):
            pairs = [*pairs[-(MEMORY - 1) :], (moved, change)]
        x, f, g = to, f2, g2
        if gain <= ftol * max(abs(f), 1e-30) or f <= EXACT:
            break
    return f, x


def squares(start: np.ndarray, lo: float, hi: float, max_iter: int = 100) -> Steps:
    """Minimises a mean square in a box as fit.minimise() does: a round of slopes, then one of the values of steps of several damping weights."""
    x = np.clip(np.asarray(start, float), lo, hi)
    for _ in range(max_iter):
        f, g, gram = yield "slopes", x
        if not (np.isfinite(f) and np.isfinite(g).all() and np.isfinite(gram).all()) or f <= EXACT:
            return f, x
        scale = np.maximum(np.diag(gram), 1e-12 * max(1e-300, np.diag(gram).max()))
        points = np.array([np.clip(x + box_least_squares(gram + w * np.diag(scale), -g / 2, lo - x, hi - x), lo, hi) for w in DAMPING])
        values = np.array((yield "values", points), float)
        best = int(np.argmin(np.where(np.isfinite(values), values, np.inf)))
        if not values[best] < f:
            return f, x
        gain, x, f = f - values[best], points[best], float(values[best])
        if gain <= FLAT * f or f <= EXACT:
            return f, x
    return f, x


def fit_together(df: DataFrame, candidates: Sequence[Node | list[str]], columns: Sequence[str] | dict, target: str, settings: Settings = Settings(), seed: int | None = None, library: SymbolLibrary | None = None, method: str = "squares") -> list[tuple[float, list[float]]]:
    """(rmse, constants) of each expression, fitted in step: a round is one pass over the data for all expressions that still move.

    method is "squares" (damped Gauss-Newton steps, for which values of several steps are one pass) or "lbfgs" (values and gradients alone).
    A pass is an aggregate of the mean squares and their exact gradients, so its result has a row of numbers whatever the size of the data;
    SIDE_BY_SIDE expressions share a plan. Starts depend on the seed and the expression alone. Refused expressions are (NaN, []); those without
    constants are scored by one aggregate. Without rows, and where the start has no finite value, the error is NaN or infinite.
    """
    if method not in ("squares", "lbfgs"):
        raise ValueError(f"{method} is no method of fitting")
    library = SymbolLibrary.or_default(library)
    trees = [as_tree(e, library) for e in candidates]
    lo, hi = settings.constant_bounds
    out: list[tuple[float, list[float]]] = [(float("nan"), [])] * len(trees)
    plain: dict[str, Node] = {}
    runs: dict[int, Steps] = {}
    asked: dict[int, tuple[str, np.ndarray]] = {}
    tapes: dict[int, Tape] = {}
    for k, tree in enumerate(trees):
        n = count_constants(tree, library)
        if refused(tree, n, settings, library):
            continue
        if not n:
            plain[str(k)] = tree
            continue
        tapes[k] = Tape(tree, columns, library, f"_t{k}_")
        runs[k] = (squares if method == "squares" else lbfgs)(start_of(key_of(tree, library), n, settings, seed), lo, hi, settings.max_iter)
        asked[k] = next(runs[k])
    if plain:
        for r in score_columns(df, plain, columns, target, library).collect():
            out[int(r["expr_key"])] = (float("nan") if r["error"] is None else float(r["error"]), [])
    names, y = bindings(library, columns), F.col(f"`{target}`").cast("double")
    while asked:
        moving = sorted(asked)
        for some in [moving[k : k + SIDE_BY_SIDE] for k in range(0, len(moving), SIDE_BY_SIDE)]:
            sloped = [k for k in some if asked[k][0] == "slopes"]
            valued = [k for k in some if asked[k][0] == "values"]
            also = [to_column(trees[k], names, p.tolist(), library) - y for k in valued for p in asked[k][1]]
            told = mean_squares(df, [tapes[k] for k in sloped], target, [asked[k][1].tolist() for k in sloped], method == "squares", also)
            answers = dict(zip(sloped, told, strict=False))
            rest = iter(told[len(sloped) :])
            answers |= {k: [next(rest) for _ in asked[k][1]] for k in valued}
            for k, answer in answers.items():
                try:
                    asked[k] = runs[k].send(answer)
                except StopIteration as end:
                    f, x = end.value
                    out[k] = (float(np.sqrt(f)) if f >= 0 else float("nan"), x.tolist())
                    del asked[k]
    return out


def fit_lbfgs(df: DataFrame, expr: Node | list[str], columns: Sequence[str] | dict, target: str, settings: Settings = Settings(), seed: int | None = None, library: SymbolLibrary | None = None) -> tuple[float, list[float]]:
    """fit_together() of one expression, by limited-memory BFGS."""
    return fit_together(df, [expr], columns, target, settings, seed, library, "lbfgs")[0]
