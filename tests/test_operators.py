import json
import math

import numpy as np
import pytest

from veldra.functions.symbols import SymbolLibrary
from veldra.operators import augment as A
from veldra.operators import fit as FIT
from veldra.operators import results as R
from veldra.operators import score as S
from veldra.operators.callbacks import Callback, EarlyStop, Log, Progress, Several
from veldra.operators.evaluator import Evaluator, behaviour_gap
from veldra.operators.grid import Grid
from veldra.operators.search import Evolution, GrammarSampling, LatentEvolution, run
from veldra.sources.catalogue import Dataset
from veldra.sources.samplers import uniform

LIB = SymbolLibrary.default(2)
ROWS = [(1.0, 2.0, 3.0), (8.0, 4.0, 0.0), (5.0, 4.0, 3.0), (7.0, 9.0, 11.0)]


@pytest.fixture
def four(spark):
    return spark.createDataFrame(ROWS, "x0 double, x1 double, y double")


def test_scores(four):
    x, y = np.array(ROWS)[:, :2], np.array(ROWS)[:, 2]
    e = "2 * X_1 - X_0".split()
    assert S.rmse(four, e, ["x0", "x1"], "y", (), LIB).first()[0] == 0
    assert S.r2(four, e, ["x0", "x1"], "y", (), LIB).first()[0] == 1
    assert S.r2(four, ["X_0"], ["x0", "x1"], "y", (), LIB).first()[0] == 0
    want = math.sqrt(np.mean((x[:, 0] - y) ** 2))
    got = {r.expr_key: r.error for r in S.score_many(four, [("a", ["X_0"], []), ("b", "X_0 * C".split(), [1.0]), ("c", "ln ( X_0 - 1 )".split(), [])], ["x0", "x1"], "y", LIB).collect()}
    assert abs(got["a"] - want) < 1e-12 and abs(got["b"] - want) < 1e-12 and got["c"] == math.inf
    assert S.score_many(four, [], ["x0", "x1"], "y", LIB).count() == 0


def test_fits(four, spark):
    x, y = np.array(ROWS)[:, :2], np.array(ROWS)[:, 2]
    e, c = FIT.fit_rows("C * X_1 - X_0".split(), x, y, FIT.Settings(), 1, LIB)
    assert e < 1e-6 and abs(c[0] - 2) < 1e-4
    e, c = FIT.fit_linear(four, "C * X_1 - X_0".split(), ["x0", "x1"], "y", FIT.Settings(), LIB)
    assert e < 1e-6 and abs(c[0] - 2) < 1e-9
    e, c = FIT.fit_linear(four, "C * X_1 + C".split(), ["x0", "x1"], "y", FIT.Settings(constant_bounds=(-1, 1)), LIB)
    assert all(-1 <= v <= 1 for v in c)
    d, _ = FIT.fit_rows("C * X_1 + C".split(), x, y, FIT.Settings(constant_bounds=(-1, 1)), 1, LIB)
    assert e <= d + 1e-6
    assert math.isnan(FIT.fit_rows("C * C".split(), x, y, FIT.Settings(max_constants=1), 1, LIB)[0])
    assert math.isnan(FIT.fit_rows("X_0 + X_1".split(), x, y, FIT.Settings(max_expr_length=2), 1, LIB)[0])
    e, c = FIT.fit_distributed(four, "exp ( C * X_0 ) * 0 + C * X_1 - X_0".split(), ["x0", "x1"], "y", FIT.Settings(max_iter=25), 3, LIB)
    assert e < 1e-3
    assert FIT.linear_parts("sin ( C )".split(), LIB) is None and FIT.linear_parts("C * C".split(), LIB) is None
    rest, parts = FIT.linear_parts("3 - C * X_0 / ( X_1 + 1 ) + u- C".split(), LIB)
    assert len(parts) == 2 and rest is not None
    with pytest.raises(ValueError):
        FIT.fit_many(spark.createDataFrame([], "expr_key string, tokens array<string>"), np.zeros((10**7, 1)), np.zeros(10**7))


def test_registered_fits_and_behaviours_take_every_row(spark, tmp_path):
    from veldra import queries as Q

    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(1, 50, 30).astype(float), rng.uniform(900, 9000, 30), rng.uniform(0, 0.1, 30), rng.uniform(0, 0.08, 30)])
    keys = [k for k in range(2, 60) if k % 7 and k % 50 != 1][:30]  # none of the orders that were used before
    spark.createDataFrame([(k, 1, *map(float, r)) for k, r in zip(keys, x, strict=True)], "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    y = 2 * x[:, 0] + 3 * (x[:, 2] + 0.5) ** 2
    got = {r.expr_key: r for r in Q.fit_nonlinear(spark, str(tmp_path)).collect()}
    c = x[:, 0] @ y / (x[:, 0] @ x[:, 0])
    assert abs(got["C*X_0"].error - math.sqrt(np.mean((c * x[:, 0] - y) ** 2))) < 1e-6 and got["C*X_0"].constants == 1
    for e in ("sin ( C * X_0 )", "exp ( C * X_2 ) + C"):
        assert abs(got[e.replace(" ", "")].error - FIT.fit_rows(e.split(), x, y, FIT.Settings(), 1, Q.LIB)[0]) < 1e-3
    samples = S.latin_hypercube(16, [(-5, 5)], 3)[:, 0]
    u, v = x[:, 2:3] * samples + np.sin(x[:, :1]), x[:, 2:3] * samples + np.cos(x[:, :1])
    want = np.mean(np.abs(np.sort(u) - np.sort(v)))
    assert abs(Q.behaviour_sampled_constants(spark, str(tmp_path)).first().bed - want) < 1e-9


def test_minimise_never_ends_above_its_start():
    rng = np.random.default_rng(1)
    for _ in range(30):
        q, y = rng.normal(size=(9, 3)), rng.normal(size=9)
        residuals = lambda p: y - (p @ q.T + np.sin(5 * p).sum(axis=-1)[..., None])  # noqa: B023
        errors = lambda p: (residuals(p) ** 2).mean(axis=1)  # noqa: B023

        def products(c):
            points, width = FIT.around(c, -1, 1)
            slope = (residuals(points[3:]) - residuals(points[:3])) / width[:, None]  # noqa: B023
            return slope @ slope.T / 9, slope @ residuals(c) / 9  # noqa: B023

        start = rng.uniform(-1, 1, 3)
        for iterations in (1, 100, 1000):  # curved valleys take more than the usual 100
            v, x = FIT.minimise(errors, products, start, -1, 1, iterations)
            assert (np.abs(x) <= 1).all() and v <= errors(start[None])[0] and v == pytest.approx(errors(x[None])[0])
        pull = products(x)[1]
        held = (np.abs(x) == 1) & (pull * x > 0)
        assert np.abs(pull[~held]).max(initial=0.0) < 1e-3


def test_distributions(spark):
    rng = np.random.default_rng(2)
    pairs = [(rng.normal(size=rng.integers(1, 9)).tolist(), rng.normal(size=rng.integers(1, 9)).tolist()) for _ in range(60)]
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.createDataFrame(pairs, "u array<double>, v array<double>").coalesce(1).select(S.wasserstein(F.col("u"), F.col("v"))).collect()]
    assert np.allclose(got, [S.wasserstein_arrays(u, v) for u, v in pairs])
    h = S.latin_hypercube(20, [(0, 1), (-5, 5)], 3, spread=True)
    assert sorted(np.floor(h[:, 0] * 20).astype(int)) == list(range(20)) and (np.abs(h[:, 1]) <= 5).all()
    with pytest.raises(ValueError):
        S.latin_hypercube(3, [(1, 0)])
    nan, inf = math.nan, math.inf
    assert behaviour_gap(np.array([[1, 2], [inf, inf]]), np.array([[1, 2.0], [1, 2]])) == inf
    assert behaviour_gap(np.array([[nan, nan], [inf, inf]]), np.array([[nan, nan], [nan, inf]])) == 0
    assert behaviour_gap(np.array([[1, inf, 3]]), np.array([[1.0, 2, 3]])) == inf
    assert behaviour_gap(np.array([[1, nan, 3, 4]]), np.array([[1.0, 2, 3, 4]])) >= 0
    with pytest.raises(ValueError):
        behaviour_gap(np.zeros((0, 2)), np.zeros((0, 2)))


def test_evaluator_counts_memory_and_stops(four):
    seen = []

    class Watch(Callback):
        def on_evaluated(self, event):
            seen.append((event.expr_key, event.is_cache_hit))

    e = Evaluator(four, ["x0", "x1"], "y", LIB, max_evaluations=4, threshold=-1.0, seed=1, callbacks=[Watch()])
    out = e.evaluate([["X_0"], ["X_0"], "X_1 X_0".split(), "C * X_1 - X_0".split(), ["X_1"]])
    assert out[0] == out[1] and math.isnan(out[2]) and out[3] < 1e-6 and math.isnan(out[4])
    assert e.calls == 5 and e.invalid == ["X_1X_0"] and seen == [("X_0", False), ("X_0", True), ("X_1X_0", False), ("C*X_1-X_0", False)]
    r = e.results("a", 2)
    assert r.best_expr == "C*X_1-X_0" and r.num_evaluated == 3 and r.evaluation_calls == 5 and len(r.top_models) == 2 and not r.success
    assert [m["expr_key"] for m in r.all_models] == ["X_0", "X_1X_0", "C*X_1-X_0"]
    assert e.frame().count() == 3
    with pytest.raises(ValueError):
        Evaluator(four, ["x0", "x1"], "y", LIB).results()
    s = Evaluator(four, ["x0", "x1"], "y", LIB)
    s.evaluate(["2 * X_1 - X_0 + X_0 - X_0".split()], simplified=True)
    assert s.stopped and s.results().success


def test_behaviour_ranking(four):
    e = Evaluator(four, ["x0", "x1"], None, LIB, ranking="bed", ground_truth="X_0 * C + X_1".split(), seed=4, threshold=None, settings=FIT.Settings(num_points_sampled=4))
    b, a = e.evaluate(["X_0".split(), "X_0 * C + X_1".split()])  # the second ends the search
    assert a == 0 and b > 0 and e.threshold > 0
    with pytest.raises(ValueError):
        Evaluator(four, ["x0"], None, LIB, ranking="bed")
    with pytest.warns(UserWarning):
        Evaluator(four, ["x0"], "y", LIB, ranking="other")


def test_augmenters(four):
    e = Evaluator(four, ["x0", "x1"], "y", LIB, seed=1, threshold=-1.0)
    e.evaluate(["C * X_1 - X_0".split(), "X_0 + 0".split()])
    r = e.results()
    with pytest.warns(UserWarning, match="broken"):
        A.augment(r, [A.ToLatex(LIB), A.ToLatex(LIB), A.Simplified(LIB, "all"), A.Determination(e, "best"), A.Refit(e, "top", "frozen", True), A.Custom("broken", lambda m: 1 / 0)])
    best = r.top_models[0]["augmentations"]
    assert set(best) == {"latex", "latex_1", "simplified", "r2", "frozen"} and best["r2"]["r2"] > 0.999 and best["frozen"]["error"] < 1e-6
    assert r.all_models[1]["augmentations"]["simplified"] == {"simplified_expr": "X_0"}
    with pytest.raises(ValueError):
        A.ToLatex(LIB, "some")


def dataset(n=60):
    return Dataset("line", "2 * X_0 + X_1".split(), [uniform(0, 1), uniform(1, 2)], max_evaluations=n, threshold=1e-9, rows=50, seed=1)


def test_searches(spark, tmp_path):
    log = Log(f"{tmp_path}/{{dataset}}_{{approach}}_{{seed}}.log")
    progress = Progress()
    r = run(dataset(), spark, GrammarSampling(batch=25), 2, 10, callbacks=[Several(log, progress)], max_iter=5)
    assert [x.metadata["seed"] for x in r] == [11, 12] and all(x.evaluation_calls <= 60 for x in r)
    assert (tmp_path / "line_grammar_sampling_11.log").exists() and "best" in progress.show()
    again = run(dataset(), spark, GrammarSampling(batch=25), 1, 10, max_iter=5)[0]
    assert again.best_expr == r[0].best_expr and again.num_evaluated == r[0].num_evaluated
    e = run(dataset(90), spark, Evolution(population=20, generations=3), 1, 2, max_iter=5)[0]
    assert e.num_evaluated > 0 and e.min_error < 10
    lat = LatentEvolution(population=15, generations=2, samples=60)
    z = run(dataset(60), spark, lat, 1, 2, max_iter=5)[0]
    assert z.num_evaluated > 0 and z.evaluation_calls <= 60 and lat.state()["start"]
    other = LatentEvolution(population=15, generations=2, samples=60)
    other.restore(lat.state())
    assert run(dataset(60), spark, other, 1, 2, max_iter=5)[0].best_expr == z.best_expr
    stop = EarlyStop(1e6)
    stop.on_start({"max_evaluations": 5})
    assert stop.max_evaluations == 5


def test_grid(spark, tmp_path):
    g = Grid(str(tmp_path / "grid"), [dataset(10)], [GrammarSampling(batch=10)], 2, 5)
    assert g.pending(spark).count() == 2 and g.run(spark, 1) == 1 and g.pending(spark).count() == 1
    g.save(spark)
    h = Grid.open(spark, g.root)
    assert h.run(spark) == 1 and h.run(spark) == 0
    assert g.commands(spark) == [] and g.adapt(spark) == 0
    row = h.progress(spark).first()
    assert row.done_grammar_sampling == row.total == 2
    assert sorted(r.seed for r in h.results(spark).collect()) == [5, 6]
    with pytest.raises(ValueError):
        Grid("x", [dataset(), dataset()], [])


def test_results_are_saved(four, tmp_path):
    from veldra.operators.evaluator import load_results, results_frame, save_results

    e = Evaluator(four, ["x0", "x1"], "y", LIB, seed=1, metadata={"dataset_name": "four"})
    e.evaluate([["X_0"], "C * X_1 - X_0".split()])
    r = e.results("a")
    save_results([r], str(tmp_path))
    again = load_results(str(tmp_path))
    assert again[0].best_expr == r.best_expr and again[0].top_models == r.top_models and "four" in r.show("all")
    f = Evaluator.from_dict(json.loads(json.dumps(e.to_dict())), four)
    assert f.evaluate(["X_0".split()]) == e.evaluate([["X_0"]])[:1] or e.stopped
    assert results_frame(four.sparkSession, again).first().success
    with pytest.raises(ValueError):
        save_results([r], str(tmp_path / "x.txt"))


def test_command_line(spark, tmp_path, capsys):
    from veldra.__main__ import main

    g = Grid(str(tmp_path / "g"), [dataset(5)], [GrammarSampling(batch=5)], 2, 1)
    g.save(spark)
    main(["commands", "--grid", g.root])
    assert capsys.readouterr().out.count("--seed") == 2
    main(["run", "--grid", g.root, "--seed", "1"])
    assert g.pending(spark).count() == 1


def test_result_tables(spark):
    nan = math.nan
    ev = spark.createDataFrame([("a", 1, "x", nan), ("a", 2, "y", 3.0), ("a", 3, "x", 5.0), ("a", 4, "z", 1.0), ("b", 1, "x", nan)], "experiment_id string, eval_no long, expr_key string, error double")
    best = {(r.experiment_id, r.eval_no): r.is_new_best for r in R.running_best(ev).collect()}
    assert best == {("a", 1): False, ("a", 2): True, ("a", 3): False, ("a", 4): True, ("b", 1): False}
    s = {r.experiment_id: r for r in R.summary(ev, 2.0).collect()}
    assert s["a"].best_expr == "z" and s["a"].num_evaluated == 3 and s["a"].evaluation_calls == 4 and s["a"].success and not s["b"].success
    assert [r.eval_no for r in R.leaderboard(ev, 2).where("experiment_id = 'a'").orderBy("rank").collect()] == [4, 2]
    assert R.stop_at_threshold(ev, 4.0).count() == 3 and R.stop_at_budget(ev, 1).count() == 2 and R.stop_at_budget(ev, -1).count() == 5
    assert R.first_evaluations(ev).count() == 4


def test_box_least_squares_is_the_best_of_all_faces():
    import itertools

    rng = np.random.default_rng(4)
    for trial in range(400):
        k = int(rng.integers(1, 6))
        g = rng.standard_normal((k if trial % 3 else max(1, k - 1), k)) * rng.choice([0.1, 1, 30])
        gram = g.T @ g
        cross = gram @ rng.uniform(-9, 9, k) if trial % 2 else g.T @ rng.standard_normal(len(g)) * 5
        value = lambda c: c @ gram @ c - 2 * c @ cross  # noqa: B023
        best = np.inf
        for face in itertools.product((None, -5.0, 5.0), repeat=k):
            c = np.array([0.0 if f is None else f for f in face])
            at = [i for i, f in enumerate(face) if f is None]
            if at:
                c[at] = np.linalg.lstsq(gram[np.ix_(at, at)], cross[at] - gram[np.ix_(at, range(k))] @ c, rcond=None)[0]
            if (np.abs(c) <= 5 + 1e-9).all():
                best = min(best, value(c))
        got = FIT.box_least_squares(gram, cross, -5.0, 5.0)
        assert (np.abs(got) <= 5).all() and value(got) <= best + 1e-6 * (1 + abs(best))
    many = rng.standard_normal((60, 40))
    got = FIT.box_least_squares(many.T @ many, many.T @ rng.standard_normal(60) * 20, -5.0, 5.0)
    assert (np.abs(got) <= 5).all()


def test_fits_are_alike_on_both_sides_of_the_size_limit(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0.5, 2, 200)
    y = 1.5 * x - 0.5 + 0.01 * rng.standard_normal(200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    lib = SymbolLibrary.default(1)
    for e in ("C * X_0 + C", "C * X_0", "X_0 + X_0", "exp ( C * X_0 ) + C", "C + C + C + C + C + C + C + C + C + X_0"):
        a, c = FIT.fit_rows(e.split(), x[:, None], y, FIT.Settings(), 3, lib)
        b, d = FIT.fit_distributed(df, e.split(), ["x"], "y", FIT.Settings(), 3, lib)
        assert (np.isnan(a) and np.isnan(b) and c == d == []) or (abs(a - b) < 1e-6 and np.allclose(c, d, atol=1e-4)), e
    short = FIT.Settings(max_expr_length=2)
    assert np.isnan(FIT.fit_rows("C * X_0".split(), x[:, None], y, short, 3, lib)[0]) and np.isnan(FIT.fit_distributed(df, "C * X_0".split(), ["x"], "y", short, 3, lib)[0])
