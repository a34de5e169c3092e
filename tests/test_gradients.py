import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldra.functions.grammar import Grammar, generate_one, library_table
from veldra.functions.symbols import SymbolLibrary
from veldra.operators import fit as FIT
from veldra.operators import quasi_newton as Q
from veldra.operators import score as S
from veldra.plans.compile import evaluate, to_program
from veldra.plans.gradient import PARTIALS, NoDerivative, Tape, mean_squares
from veldra.plans.shared import Graph

LIB = SymbolLibrary.default(2)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.uniform(0.2, 0.9, 40), rng.uniform(0.1, 0.8, 40), rng.uniform(-1, 1, 40)])
    return x, spark.createDataFrame(x.tolist(), "x0 double, x1 double, y double").repartition(3)


#: Every symbol that has a derivative, above a constant.
FORMS = [f"{s} ( C * X_0 )" for s in PARTIALS if LIB.kind(s) == "fn" and LIB.precedence(s) > 0 and s not in ("floor", "ceil")]
FORMS += [f"( C + X_0 ) {s}" for s in PARTIALS if LIB.kind(s) == "fn" and LIB.precedence(s) < 0]
FORMS += [f"( C * X_0 + 0.5 ) {s} ( X_1 + C )" for s in PARTIALS if LIB.kind(s) == "op"]
FORMS += ["C", "C * ( C + C * X_0 ) ^2 - sin ( C * exp ( C * X_1 ) )", "( X_0 + X_1 ) * ( X_0 - X_1 )", "floor ( C * X_0 ) + C"]


def test_gradients_equal_differences(rows):
    x, df = rows
    for form in FORMS:
        tape = Tape(form.split(), ["x0", "x1"], LIB)
        c = np.linspace(0.6, 0.9, tape.constants)
        f, g, p = mean_squares(df, [tape], "y", [c.tolist()], True)[0]
        value = lambda c: np.broadcast_to(evaluate(form.split(), x[:, :2], c, LIB), len(x))  # noqa: B023, E731
        assert f == pytest.approx(np.mean((value(c) - x[:, 2]) ** 2), rel=1e-9)
        h = 1e-6 * np.eye(tape.constants)
        slopes = np.array([(value(c + d) - value(c - d)) / 2e-6 for d in h]).reshape(tape.constants, len(x))
        if not form.startswith("floor"):
            assert g == pytest.approx(2 * slopes @ (value(c) - x[:, 2]) / len(x), rel=1e-4, abs=1e-6), form
            assert p == pytest.approx(slopes @ slopes.T / len(x), rel=1e-4, abs=1e-6), form
        else:
            assert g[0] == 0


def test_many_tapes_share_a_pass_and_unknown_symbols_are_told(rows, spark):
    _, df = rows
    forms = [f.split() for f in FORMS[:12]]
    tapes = [Tape(f, ["x0", "x1"], LIB, f"_t{k}_") for k, f in enumerate(forms)]
    points = [[0.7] * t.constants for t in tapes]
    together = mean_squares(df, tapes, "y", points)
    for t, p, (f, g, _) in zip(tapes, points, together, strict=True):
        one = mean_squares(df, [t], "y", [p])[0]
        assert f == pytest.approx(one[0]) and g == pytest.approx(one[1])
    own = SymbolLibrary.default(1)
    own.add("cbrt", "fn", column=F.cbrt, array=np.cbrt)
    with pytest.raises(NoDerivative):
        Tape("cbrt ( C * X_0 )".split(), ["x0"], own)
    data = df.withColumn("y", F.cbrt(0.5 * F.col("x0")))
    error, c = FIT.fit_distributed(data, "cbrt ( C * X_0 )".split(), ["x0"], "y", FIT.Settings(), 2, own)  # by differences
    assert error < 1e-6 and c[0] == pytest.approx(0.5, rel=1e-4)
    assert math.isnan(mean_squares(df.limit(0), [tapes[0]], "y", [points[0]])[0][0])


def alone(steps, f):
    """A minimiser driven by plain functions."""
    kind, at = next(steps)
    try:
        while True:
            kind, at = steps.send(f(at) if kind == "slopes" else [f(x)[0] for x in at])
    except StopIteration as end:
        return end.value


def test_bounded_steps_find_the_best_corner_or_valley():
    def valley(c):
        r = np.array([1 - c[0], 10 * (c[1] - c[0] ** 2)])
        j = np.array([[-1, 0], [-20 * c[0], 10]])
        return float(r @ r) / 2, j.T @ r, j.T @ j / 2

    for steps in (Q.lbfgs, Q.squares):
        f, x = alone(steps(np.array([-1.2, 1.0]), -2, 2, 400), valley)
        assert f < 1e-8 and x == pytest.approx([1, 1], abs=1e-3)
        f, x = alone(steps(np.array([-1.2, 0.4]), -2, 0.5, 400), valley)
        assert x == pytest.approx([0.5, 0.25], abs=1e-3)
    rng = np.random.default_rng(2)
    for _ in range(40):
        k = rng.integers(1, 6)
        a, b = rng.standard_normal((k + 2, k)), rng.standard_normal(k + 2)
        want = FIT.box_least_squares(a.T @ a, a.T @ b, -0.3, 0.4)

        def quadratic(c, a=a, b=b):
            r = a @ c - b
            return float(r @ r), 2 * a.T @ r, a.T @ a

        for steps in (Q.lbfgs, Q.squares):
            f, x = alone(steps(rng.uniform(-0.3, 0.4, k), -0.3, 0.4, 500), quadratic)
            assert f == pytest.approx(quadratic(want)[0], rel=1e-6, abs=1e-9)
    nan = alone(Q.lbfgs(np.array([0.1]), -1, 1), lambda c: (float("nan"), np.array([1.0]), np.zeros((1, 1))))
    assert math.isnan(nan[0])


def test_fits_in_step_equal_fits_in_memory(rows):
    x, df = rows
    y = 1.5 * np.exp(-0.8 * x[:, 0]) + 0.3 * x[:, 1]
    data = df.withColumn("y", 1.5 * F.exp(-0.8 * F.col("x0")) + 0.3 * F.col("x1"))
    forms = [e.split() for e in ("C * exp ( C * X_0 ) + C * X_1", "C * X_0 + C", "X_0 + X_1", "C ^ X_0", " + ".join(["C"] * 12))]
    for method in ("squares", "lbfgs"):
        got = Q.fit_together(data, forms, ["x0", "x1"], "y", FIT.Settings(), 1, LIB, method)
        assert got[0][0] < 1e-5 and got[0][1] == pytest.approx([1.5, -0.8, 0.3], abs=1e-3)
        assert got[2] == (pytest.approx(np.sqrt(np.mean((x[:, 0] + x[:, 1] - y) ** 2))), [])
        assert math.isnan(got[4][0]) and got[4][1] == []  # too many constants
        for k in (1, 3):
            error, c = FIT.fit_rows(forms[k], x[:, :2], y, FIT.Settings(), 1, LIB)
            assert got[k][0] == pytest.approx(error, rel=1e-5) and got[k][1] == pytest.approx(c, rel=1e-3)
    with pytest.raises(ValueError):
        Q.fit_together(data, forms, ["x0", "x1"], "y", method="none")


def test_a_graph_computes_equal_parts_once(rows, spark):
    x, df = rows
    rng = np.random.default_rng(5)
    grammar = Grammar.of_library(SymbolLibrary.of(["+", "-", "*", "/", "sin", "exp", "^2", "C", "pi"], 2))
    drawn = []
    while len(drawn) < 400:
        t = generate_one(grammar, rng)
        if t and len(t) <= 30:
            drawn.append((t, rng.choice([0.5, 2.0], t.count("C")).tolist()))
    graph = Graph(drawn, LIB)
    assert len(graph) < graph.written / 2
    seen = 0
    for k, v in graph.run(x[:, :2]):
        assert np.array_equal(v, to_program(drawn[k][0], LIB).run(x[:, :2], drawn[k][1]), equal_nan=True)
        seen += 1
    assert seen == len(drawn)
    calls = []
    own = SymbolLibrary.default(2)
    own.add("probe", "fn", array=lambda a: calls.append(1) or a)
    again = Graph([(e.split(), ()) for e in ("probe ( X_0 + X_1 )", "probe ( X_1 + X_0 ) * 2", "probe ( X_0 - X_1 )", "probe ( X_1 - X_0 )", "probe ( X_0 + X_1 )")], own)
    assert len(list(again.run(x[:, :2]))) == 5 and len(calls) == 3
    errors = {r["expr_key"]: r["error"] for r in S.score_many(df, [(str(k), t, c) for k, (t, c) in enumerate(drawn)], ["x0", "x1"], "y", LIB).collect()}
    for k, (t, c) in enumerate(drawn):
        with np.errstate(all="ignore"):
            want = np.sqrt(np.mean((evaluate(t, x[:, :2], c, LIB) - x[:, 2]) ** 2))
        assert errors[str(k)] == pytest.approx(want, rel=1e-9, nan_ok=True)
    with pytest.raises(ValueError):
        Graph([("huh ( X_0 )".split(), ())], own)


def test_distance_of_columns(spark):
    rng = np.random.default_rng(6)
    for n, scale in ((200, 1.0), (500, 1e6)):
        a, b = rng.standard_normal(n) * scale, np.round(rng.uniform(-1, 2, n) * scale, 1)
        pairs = [(None if k % 7 == 0 else float(u), float("nan") if k % 5 == 0 else float(v)) for k, (u, v) in enumerate(zip(a, b, strict=True))]
        pairs += [(1.0, float("inf")), (-0.0, 0.0), (0.0, -0.0)]
        df = spark.createDataFrame(pairs, "a double, b double").repartition(5)
        left = [u for u, _ in pairs if u is not None]
        right = [v for _, v in pairs if math.isfinite(v)]
        assert S.wasserstein_columns(df, "a", "b").first()["w1"] == pytest.approx(S.wasserstein_arrays(left, right), rel=1e-9)
        assert S.wasserstein_columns(df, "a", "a").first()["w1"] == 0
    assert S.wasserstein_columns(df.limit(0), "a", "b").first()["w1"] is None
    same = spark.createDataFrame([(1.0, 3.0)] * 50, "a double, b double")
    assert S.wasserstein_columns(same, "a", "b").first()["w1"] == 2


def test_library_tables_share_out_every_chance():
    for names, variables in ((["+", "*", "^", "sin", "^2", "pi", "C"], 2), (["+"], 1), (["sin", "C"], 0), (["e"], 0), (["-", "^2"], 3)):
        lib = SymbolLibrary.of(names, variables)
        table = library_table(lib)
        for side in {row[0] for row in table}:
            assert sum(share for s, share, _ in table if s == side) == pytest.approx(1)
        grammar = Grammar.of_library(lib)
        assert {x for r in grammar.rules for x in r.rhs} - grammar.nonterminals <= set(lib.symbols) | {"(", ")"}
        assert generate_one(grammar, np.random.default_rng(1))
    named = SymbolLibrary.of(["+"], 1)
    named.add("N1", "var")
    assert "N1" not in Grammar.of_library(named).nonterminals and Grammar.of_library(named, "S").start == "S"
    with pytest.raises(ValueError):
        Grammar.of_library(named, "X_0")
