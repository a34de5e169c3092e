"""One query for each operator, with the same answer in DuckDB's SQL where SQL can say it.

Variables are bound to lineitem: X_0 quantity, X_1 price, X_2 discount, X_3 tax. Float results are rounded, as engines add in
different orders.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import grammar as G
from .functions.charts import rule_counts
from .functions.constraints import MaxDepth, MaxNodes, MaxOccurrences, NoNested
from .functions.egraph import distinct_forms
from .functions.distance import token_distance_column, tree_distance_udf
from .functions.simplify import simplify
from .functions.symbols import SymbolLibrary
from .functions.tree import latex, parse
from .operators import fit as FIT
from .operators import grid as GRID
from .operators import results as R
from .operators import score as S
from .operators.evaluator import Evaluator, results_frame
from .operators.quasi_newton import fit_lbfgs as quasi_newton, fit_together
from .plans.compile import hoisted, to_column, to_sql
from .plans.gradient import Tape, mean_squares
from .sources import catalogue, sample_source, samplers

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LIB = SymbolLibrary.default(4)
DIGITS = 9

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


# scalar families: the same trees print the columns and the oracle

FAMILIES = {
    "eval_arith": ["X_1 * ( 1 - X_2 ) + X_0 / 7", "u- X_1 / ( X_0 + 1 )", "X_1 - X_0 - X_2"],
    "eval_trig": ["sin ( X_0 ) + cos ( X_1 )", "tan ( X_2 )"],
    "eval_hyperbolic": ["sinh ( X_2 ) + cosh ( X_3 )", "tanh ( X_0 )"],
    "eval_inverse_trig": ["arcsin ( X_2 )", "arccos ( X_3 )", "arctan ( X_0 )"],
    "eval_logexp": ["ln ( X_0 )", "log ( X_1 )", "exp ( X_2 )", "sqrt ( X_1 )"],
    "eval_powers": ["X_2 ^2 + X_2 ^3", "X_3 ^4 + X_3 ^5", "X_0 ^-1", "X_0 ^ X_2"],
    "eval_rounding": ["floor ( X_1 / 3 )", "ceil ( X_1 / 3 )"],
    "eval_literals": ["pi * X_0 + e", "1e-3 * X_1 + 2.5"],
}


def rounded(c):
    """Nine significant decimals after scaling is off: plain rounding, NaN and infinities as they are."""
    return F.round(c, DIGITS)


def _family(name: str, expressions: list[str]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        values = [rounded(to_column(e.split(), COLUMNS, (), LIB)).alias(f"v{k}") for k, e in enumerate(expressions)]
        return lineitem(spark, sf).select("l_orderkey", "l_linenumber", *values)

    QUERIES[name] = run
    ORACLES[name] = "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({to_sql(e.split(), COLUMNS, (), LIB)}, {DIGITS}) AS v{k}" for k, e in enumerate(expressions)) + " FROM lineitem"


for _name, _expressions in FAMILIES.items():
    _family(_name, _expressions)

EDGES = ["X_2 / ( X_3 - X_3 )", "( X_3 - X_3 ) / ( X_3 - X_3 )", "ln ( X_2 )", "log ( u- X_0 )", "sqrt ( u- X_0 )", "( X_2 - X_2 ) ^-1", "exp ( X_1 )", "arcsin ( X_0 + 1 )"]


def kind_of(c):
    inf = F.lit(float("inf"))
    return F.when(F.isnan(c), "nan").when(c == inf, "inf").when(c == -inf, "-inf").otherwise("finite")


@query("SELECT " + ", ".join(f"CASE WHEN isnan(v) THEN 'nan' WHEN v = 'Infinity'::DOUBLE THEN 'inf' WHEN v = '-Infinity'::DOUBLE THEN '-inf' ELSE 'finite' END AS k{k}".replace("v ", f"v{k} ").replace("(v)", f"(v{k})") for k in range(len(EDGES))) + ", count(*) AS n FROM (SELECT " + ", ".join(f"{to_sql(e.split(), COLUMNS, (), LIB)} AS v{k}" for k, e in enumerate(EDGES)) + " FROM lineitem) GROUP BY ALL")
def eval_ieee_edges(spark, sf):
    """Division and logarithms at zero and below: what comes of each, counted."""
    kinds = [kind_of(to_column(e.split(), COLUMNS, (), LIB)).alias(f"k{k}") for k, e in enumerate(EDGES)]
    return lineitem(spark, sf).select(*kinds).groupBy(*[f"k{k}" for k in range(len(EDGES))]).agg(F.count("*").alias("n"))


CONSTANTS = [[0.5, 1.0], [-1.0, 2.0], [2.0, 0.0]]
HOIST = "C * sin ( X_0 ) ^2 + exp ( X_2 ) * C".split()


@query("WITH c AS (SELECT * FROM (VALUES (0, [0.5::DOUBLE, 1.0::DOUBLE]), (1, [-1.0::DOUBLE, 2.0::DOUBLE]), (2, [2.0::DOUBLE, 0.0::DOUBLE])) AS t(sample_id, c)) SELECT l_orderkey, l_linenumber, sample_id, round(" + to_sql(HOIST, COLUMNS, "c", LIB) + f", {DIGITS}) AS value FROM lineitem, c")
def eval_hoisted_constants(spark, sf):
    """Parts without constants once for a row, then the fan-out over constant vectors."""
    with_parts, value = hoisted(lineitem(spark, sf), HOIST, COLUMNS, F.col("k.c"), LIB)
    rows = F.array(*[F.struct(F.lit(i).alias("sample_id"), F.array(*[F.lit(x) for x in c]).alias("c")) for i, c in enumerate(CONSTANTS)])
    return with_parts.withColumn("k", F.explode(rows)).select("l_orderkey", "l_linenumber", "k.sample_id", rounded(value).alias("value"))


# scores

CANDIDATE = "X_1 * ( 1 - X_2 )".split()
TARGET = "X_1 * ( 1 - X_2 ) * ( 1 + X_3 )".split()


def with_target(spark, sf) -> DataFrame:
    return lineitem(spark, sf).select(*COLUMNS, to_column(TARGET, COLUMNS, (), LIB).alias("y"))


Y = f"(SELECT *, {to_sql(TARGET, COLUMNS, (), LIB)} AS y FROM lineitem)"
MANY = {"a": "X_1 * ( 1 - X_2 )", "b": "X_1", "c": "X_1 * ( 1 + X_3 )", "d": "X_0 * X_1", "e": "sqrt ( X_1 )", "f": "X_1 * ( 1 - X_2 ) * ( 1 + X_3 )"}


def rmse_sql(e: str) -> str:
    return f"round(sqrt(avg(pow({to_sql(e.split(), COLUMNS, (), LIB)} - y, 2))), 4)"


@query(f"SELECT {rmse_sql(' '.join(CANDIDATE))} AS rmse FROM {Y}")
def rmse_candidate(spark, sf):
    return S.rmse(with_target(spark, sf), CANDIDATE, COLUMNS, "y", (), LIB).select(F.round("rmse", 4).alias("rmse"))


MANY_SQL = " UNION ALL ".join(f"SELECT '{k}' AS expr_key, {rmse_sql(e)} AS error FROM {Y}" for k, e in MANY.items())


@query(MANY_SQL)
def rmse_many_candidates(spark, sf):
    """Few fixed candidates: columns of one aggregate."""
    return S.score_columns(with_target(spark, sf), {k: e.split() for k, e in MANY.items()}, COLUMNS, "y", LIB).withColumn("error", F.round("error", 4))


@query(MANY_SQL)
def rmse_partial_final(spark, sf):
    """Many shapes: programs run over each partition, partial sums are added up."""
    return S.score_many(with_target(spark, sf), [(k, e.split(), []) for k, e in MANY.items()], COLUMNS, "y", LIB).withColumn("error", F.round("error", 4))


GRID_C = [(k, 0.5 + 0.1 * k) for k in range(12)]


@query("SELECT sample_id, round(sqrt(avg(pow(l_extendedprice * c - y, 2))), 4) AS error FROM " + Y + ", (VALUES " + ", ".join(f"({k}::BIGINT, {c!r}::DOUBLE)" for k, c in GRID_C) + ") AS t(sample_id, c) GROUP BY sample_id")
def rmse_constant_sweep(spark, sf):
    """One shape, many constants: a fan-out inside the stage and one group-by."""
    table_ = spark.createDataFrame([(k, [c]) for k, c in GRID_C], "sample_id long, c array<double>")
    return S.score_constants(with_target(spark, sf), "X_1 * C".split(), COLUMNS, "y", table_, LIB).withColumn("error", F.round("error", 4))


@query("SELECT " + ", ".join(f"round(greatest(0, 1 - sum(pow({to_sql(e.split(), COLUMNS, (), LIB)} - y, 2)) / (var_pop(y) * count(y))), 6) AS {k}" for k, e in list(MANY.items())[:4]) + f" FROM {Y}")
def r2_clamped(spark, sf):
    """Several at once: one aggregate of columns."""
    y = F.col("y").cast("double")
    return with_target(spark, sf).agg(*[F.round(S.r2_column(to_column(e.split(), COLUMNS, (), LIB), y), 6).alias(k) for k, e in list(MANY.items())[:4]])


# fits


def fitted(spark, e, c, digits=6):
    return spark.createDataFrame([(round(e, 4), *[round(float(x), digits) for x in c])], "rmse double, " + ", ".join(f"c{k} double" for k in range(len(c))))


@query(f"WITH s AS (SELECT sum(l_extendedprice * y) AS b, sum(l_extendedprice * l_extendedprice) AS a, sum(y * y) AS yy, count(*) AS n FROM {Y}), f AS (SELECT *, least(5, greatest(-5, b / a)) AS c FROM s) SELECT round(sqrt((c * c * a - 2 * c * b + yy) / n), 4) AS rmse, round(c, 6) AS c0 FROM f")
def fit_linear_one_constant(spark, sf):
    return fitted(spark, *FIT.fit_linear(with_target(spark, sf), "C * X_1".split(), COLUMNS, "y", FIT.Settings(), LIB))


@query("WITH s AS (SELECT sum(l_quantity * l_extendedprice) AS b, sum(l_quantity * l_quantity) AS a, sum(l_extendedprice * l_extendedprice) AS yy, count(*) AS n FROM lineitem), f AS (SELECT *, least(5, greatest(-5, b / a)) AS c FROM s) SELECT round(sqrt((c * c * a - 2 * c * b + yy) / n), 4) AS rmse, round(c, 6) AS c0 FROM f")
def fit_linear_at_bound(spark, sf):
    """The best constant lies outside the box, so the bound is the answer."""
    return fitted(spark, *FIT.fit_linear(lineitem(spark, sf), "C * X_0".split(), COLUMNS, "l_extendedprice", FIT.Settings(), LIB))


@query(f"WITH s AS (SELECT sum(p * p) AS a, sum(p * q) AS h, sum(q * q) AS d, sum(p * y) AS u, sum(q * y) AS v FROM (SELECT l_extendedprice AS p, l_extendedprice * l_discount AS q, y FROM {Y})) SELECT round((u * d - v * h) / (a * d - h * h), 6) AS c0, round((v * a - u * h) / (a * d - h * h), 6) AS c1 FROM s")
def fit_linear_two_constants(spark, sf):
    return fitted(spark, *FIT.fit_linear(with_target(spark, sf), "C * X_1 + C * X_1 * X_2".split(), COLUMNS, "y", FIT.Settings(), LIB)).drop("rmse")


@query()
def fit_nonlinear(spark, sf):
    """Constants inside functions, fitted over the whole table: the data stay distributed, candidates take their steps in the same passes."""
    df = lineitem(spark, sf).select(*COLUMNS, to_column("2 * X_0 + 3 * ( X_2 + 0.5 ) ^2".split(), COLUMNS, (), LIB).alias("y"))
    todo = ["C * X_0 + C * ( X_2 + C ) ^2", "C * X_0", "sin ( C * X_0 )", "exp ( C * X_2 ) + C"]
    found = fit_together(df, [e.split() for e in todo], COLUMNS, "y", FIT.Settings(), 1, LIB)
    return spark.createDataFrame([(e.replace(" ", ""), error, len(c)) for e, (error, c) in zip(todo, found, strict=True)], "expr_key string, error double, constants int")


SLOPED, AT = "C * X_0 + C * ( X_2 + C ) ^2 + sin ( C * X_3 ) / ( X_0 + C )", (0.5, 2.0, 1.5, 3.0, 0.25)
#: Value and derivatives of SLOPED by its constants at AT, by hand.
BY_HAND = ["0.5 * x0 + 2 * pow(x2 + 1.5, 2) + sin(3 * x3) / (x0 + 0.25)", "x0", "pow(x2 + 1.5, 2)", "4 * (x2 + 1.5)", "cos(3 * x3) * x3 / (x0 + 0.25)", "-sin(3 * x3) / pow(x0 + 0.25, 2)"]


@query("SELECT round(avg(pow(v - y, 2)), 3) AS mean_square, " + ", ".join(f"round(avg(2 * (v - y) * d{k}), 3) AS slope{k}" for k in range(5)) + " FROM (SELECT y, " + ", ".join(f"{e} AS {n}" for e, n in zip(BY_HAND, ["v", *(f"d{k}" for k in range(5))])) + f" FROM (SELECT l_quantity::DOUBLE AS x0, l_discount::DOUBLE AS x2, l_tax::DOUBLE AS x3, l_extendedprice / 1000 AS y FROM lineitem))")
def fit_gradient(spark, sf):
    """The mean square and its exact gradient at given constants, by one aggregate."""
    df = lineitem(spark, sf).select(*COLUMNS, (F.col("l_extendedprice") / 1000).alias("y"))
    f, g, _ = mean_squares(df, [Tape(SLOPED.split(), COLUMNS, LIB)], "y", [AT])[0]
    return spark.createDataFrame([(round(f, 3), *(round(float(x), 3) for x in g))], "mean_square double, " + ", ".join(f"slope{k} double" for k in range(5)))


def bisected(y: str) -> str:
    """Where the slope of the mean square of exp(c * l_discount) is zero in the box, or the bound that it points to, by halving."""
    m = "((lo + hi) / 2)"
    return f"""(WITH RECURSIVE d AS (SELECT l_discount::DOUBLE AS x, {y} AS y FROM lineitem), b(k, lo, hi) AS (SELECT 0, -5.0::DOUBLE, 5.0::DOUBLE UNION ALL
  SELECT k + 1, CASE WHEN s < 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN s < 0 THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT k, lo, hi, sum((exp({m} * x) - y) * x * exp({m} * x)) AS s FROM b, d WHERE k < 45 GROUP BY k, lo, hi))
  SELECT round(sqrt(avg(pow(exp(lo * x) - y, 2))), 6) AS rmse, round(any_value(lo), 4) AS c FROM b, d WHERE k = 45)"""


CURVES = {"inside": ("exp ( 0.7 * X_2 ) + X_3", "exp(0.7 * l_discount) + l_tax"), "at the bound": ("exp ( 7 * X_2 )", "exp(7 * l_discount)")}


@query(" UNION ALL ".join(f"SELECT '{k}' AS curve, rmse, c FROM {bisected(y)}" for k, (_, y) in CURVES.items()))
def fit_lbfgs(spark, sf):
    """A constant inside a function by limited-memory BFGS, inside the box and at its bound; SQL halves the box instead."""
    out = []
    for k, (e, _) in CURVES.items():
        df = lineitem(spark, sf).select(*COLUMNS, to_column(e.split(), COLUMNS, (), LIB).alias("y"))
        error, c = quasi_newton(df, "exp ( C * X_2 )".split(), COLUMNS, "y", FIT.Settings(), 1, LIB)
        out.append((k, round(error, 6), round(c[0], 4)))
    return spark.createDataFrame(out, "curve string, rmse double, c double")


#: Candidates that share most of their parts: every outer form of every product of two inner ones.
INNER = ["X_0", "X_1", "( 1 - X_2 )", "( 1 + X_3 )", "sqrt ( X_1 )", "ln ( X_0 )", "( X_2 + X_3 ) ^2"]
OUTER = ["{}", "{} + X_0", "{} - X_1", "u- {}", "{} * ( 1 - X_2 )", "2 * {}"]
FAMILY = {f"{i}-{j}-{k}": o.format(f"( {a} * {b} )") for i, a in enumerate(INNER) for j, b in enumerate(INNER) for k, o in enumerate(OUTER)}


@query("SELECT r.k AS expr_key, round(r.e, 3) AS error FROM (SELECT unnest([" + ", ".join(f"{{'k': '{k}', 'e': sqrt(avg(pow({to_sql(e.split(), COLUMNS, (), LIB)} - y, 2)))}}" for k, e in FAMILY.items()) + f"]) AS r FROM {Y})")
def rmse_shared_parts(spark, sf):
    """Hundreds of candidates as one graph: parts that several of them have are computed once for a row."""
    out = S.score_many(with_target(spark, sf), [(k, e.split(), []) for k, e in FAMILY.items()], COLUMNS, "y", LIB)
    return out.withColumn("error", F.round("error", 3))


# results: events are the evaluations, user_id the experiment


def evaluations(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("experiment_id"), F.col("event_id").alias("eval_no"), F.col("event_type").alias("expr_key"), F.col("value").alias("error"))


EV = "(SELECT user_id AS experiment_id, event_id AS eval_no, event_type AS expr_key, value AS error FROM events)"


@query(f"SELECT experiment_id, eval_no, error, row_number() OVER (PARTITION BY experiment_id ORDER BY error, eval_no)::INTEGER AS rank FROM {EV} QUALIFY rank <= 5")
def leaderboard_topk(spark, sf):
    return R.leaderboard(evaluations(spark, sf), 5).select("experiment_id", "eval_no", "error", "rank")


@query(f"SELECT experiment_id, min(error) AS min_error, arg_min(expr_key, (error, eval_no)) AS best_expr, count(DISTINCT expr_key) AS num_evaluated, count(*) AS evaluation_calls, min(error) < 1.0 AS success FROM {EV} GROUP BY experiment_id")
def top1_min_by(spark, sf):
    """The best model, the counts and the success flag of each experiment."""
    return R.summary(evaluations(spark, sf), 1.0)


@query(f"SELECT experiment_id, min(error) < 0.5 AS success FROM {EV} GROUP BY experiment_id")
def success_flag(spark, sf):
    return R.summary(evaluations(spark, sf), 0.5).select("experiment_id", "success")


RUNNING = f"SELECT experiment_id, eval_no, error, min(error) OVER w AS best_before, error < coalesce(min(error) OVER w, 'Infinity'::DOUBLE) AS is_new_best FROM {EV} WINDOW w AS (PARTITION BY experiment_id ORDER BY eval_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(RUNNING)
def running_best(spark, sf):
    return R.running_best(evaluations(spark, sf)).select("experiment_id", "eval_no", "error", "best_before", "is_new_best")


@query(f"SELECT experiment_id, eval_no, row_number() OVER (PARTITION BY experiment_id ORDER BY eval_no)::INTEGER AS n FROM {EV}")
def evaluation_number(spark, sf):
    return R.numbered(evaluations(spark, sf)).select("experiment_id", "eval_no", "n")


@query(f"SELECT experiment_id, eval_no FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY eval_no) AS n FROM {EV}) WHERE n <= 3")
def early_stop_budget(spark, sf):
    return R.stop_at_budget(evaluations(spark, sf), 3).select("experiment_id", "eval_no")


@query(f"SELECT experiment_id, eval_no, error FROM (SELECT *, min(CASE WHEN error < 5 THEN eval_no END) OVER (PARTITION BY experiment_id) AS stop FROM {EV}) WHERE stop IS NULL OR eval_no <= stop")
def early_stop_threshold(spark, sf):
    return R.stop_at_threshold(evaluations(spark, sf), 5.0).select("experiment_id", "eval_no", "error")


@query(f"SELECT experiment_id, expr_key, eval_no, error FROM {EV} QUALIFY row_number() OVER (PARTITION BY experiment_id, expr_key ORDER BY eval_no) = 1")
def dedupe_first_evaluation(spark, sf):
    return R.first_evaluations(evaluations(spark, sf)).select("experiment_id", "expr_key", "eval_no", "error")


@query(f"SELECT experiment_id, count(*) AS n FROM (SELECT * FROM {EV} UNION ALL SELECT * FROM {EV} WHERE error > 10) GROUP BY experiment_id")
def union_results(spark, sf):
    ev = evaluations(spark, sf)
    return R.union_results(ev, ev.where("error > 10")).groupBy("experiment_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, CASE WHEN k = 0 THEN event_type ELSE event_type || '_' || k END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS k FROM events)")
def augment_name_suffix(spark, sf):
    return R.suffixed_names(table(spark, sf, "events"), "user_id", "event_type", "event_id").select("event_id", "user_id", "unique_name")


def odd_results(spark, sf) -> DataFrame:
    """Evaluations whose errors are also NaN, infinite and minus zero, with arrays of them."""
    at, v = F.col("event_id") % 5, F.col("value")
    error = F.when(at == 0, F.lit(float("nan"))).when(at == 1, F.lit(float("inf"))).when(at == 2, F.lit(-float("inf"))).when(at == 3, F.lit(-0.0)).otherwise(v)
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("expr"), error.alias("error"), F.array(v, error, F.lit(None).cast("double")).alias("parameters"))


@query("""SELECT event_id, event_type AS expr, CASE event_id % 5 WHEN 0 THEN 'nan' WHEN 1 THEN 'inf' WHEN 2 THEN '-inf' ELSE 'finite' END AS kind, CASE event_id % 5 WHEN 3 THEN '-inf' ELSE 'other' END AS side,
value AS first, 3 AS n FROM events""")
def results_as_variants(spark, sf):
    """Results with numbers that JSON lacks, written as VARIANT values and read back."""
    from .sources.folders import written
    from .sources.variants import packed, unpacked

    df = odd_results(spark, sf)
    back = unpacked(written(packed(df, "event_id"), "variants"), [f for f in df.schema.fields if f.name != "event_id"])
    second = F.get("parameters", F.lit(1))
    side = F.when((second == 0) & (F.pow(second, F.lit(-1.0)) < 0), "-inf").otherwise("other")  # one divided by minus zero
    return back.select("event_id", "expr", kind_of(F.col("error")).alias("kind"), side.alias("side"), F.get("parameters", F.lit(0)).alias("first"), F.size("parameters").alias("n"))


# grids: nations are datasets, regions approaches


def grid_tables(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("dataset"))
    r = table(spark, sf, "region").select(F.col("r_name").alias("approach"))
    seeds = spark.range(0, 4).select(F.col("id").cast("int").alias("seed"))
    return n, r, seeds


def finished(jobs: DataFrame) -> DataFrame:
    return jobs.where((F.length("dataset") + F.length("approach") + F.col("seed")) % 3 == 0)


JOBS = "(SELECT n_name AS dataset, r_name AS approach, seed::INTEGER AS seed FROM nation, region, (SELECT unnest(range(4)) AS seed))"
DONE = "(length(dataset) + length(approach) + seed) % 3 = 0"


@query(f"SELECT * FROM {JOBS}")
def grid_jobs(spark, sf):
    return GRID.jobs(*grid_tables(spark, sf))


@query(f"SELECT * FROM {JOBS} WHERE NOT ({DONE})")
def grid_pending_antijoin(spark, sf):
    jobs = GRID.jobs(*grid_tables(spark, sf))
    return GRID.pending(jobs, finished(jobs))


@query(f"SELECT dataset, {', '.join(f'''sum(CASE WHEN approach = '{a}' AND {DONE} THEN 1 ELSE 0 END)::BIGINT AS done_{a.lower()}''' for a in ('ASIA', 'EUROPE'))}, count(*) AS total FROM {JOBS} GROUP BY dataset")
def grid_progress_pivot(spark, sf):
    jobs = GRID.jobs(*grid_tables(spark, sf))
    out = GRID.progress(jobs, finished(jobs), ["ASIA", "EUROPE"])
    return out.withColumnsRenamed({"done_ASIA": "done_asia", "done_EUROPE": "done_europe"})


@query(f"SELECT approach, count(*) AS n FROM (SELECT * FROM {JOBS} WHERE {DONE}) GROUP BY approach")
def grid_results_semijoin(spark, sf):
    """Results that belong to the grid's jobs."""
    jobs = GRID.jobs(*grid_tables(spark, sf))
    return finished(jobs).join(jobs, GRID.KEYS, "left_semi").groupBy("approach").agg(F.count("*").alias("n"))


# behaviours


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))


@query("WITH v AS (SELECT vec_id, list_sort(embedding::DOUBLE[]) AS e FROM embeddings) SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: abs(a.e[i] - b.e[i]))) / len(a.e), 6) AS w1 FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def wasserstein_rows(spark, sf):
    """First Wasserstein distance of each vector to the next one."""
    v = vectors(spark, sf)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(S.wasserstein(F.col("e"), F.col("f")), 6).alias("w1"))


@query("WITH p AS (SELECT vec_id, e[1:40] AS u, e[41:64] AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)), x AS (SELECT vec_id, unnest(u) AS x, 1.0::DOUBLE / len(u) AS d FROM p UNION ALL SELECT vec_id, unnest(v), -1.0::DOUBLE / len(v) FROM p), g AS (SELECT vec_id, x, abs(sum(d) OVER (PARTITION BY vec_id ORDER BY x RANGE UNBOUNDED PRECEDING)) AS gap, lead(x) OVER (PARTITION BY vec_id ORDER BY x) - x AS step FROM x) SELECT vec_id, round(sum(gap * coalesce(step, 0)), 6) AS w1 FROM g GROUP BY vec_id")
def wasserstein_unequal(spark, sf):
    """Distributions of different sizes: the area between their distribution functions."""
    return vectors(spark, sf).select("vec_id", F.round(S.wasserstein(F.slice("e", 1, 40), F.slice("e", 41, 24)), 6).alias("w1"))


PAIRS = {"tax and discount": ("l_tax", "l_discount"), "price and quantity": ("l_extendedprice / 1000", "l_quantity"), "repeats": ("l_linenumber", "l_quantity")}


def area_sql(a: str, b: str) -> str:
    return f"""(WITH n AS (SELECT count({a}) AS u, count({b}) AS v FROM lineitem), x AS (SELECT ({a})::DOUBLE AS x, 1.0::DOUBLE / u AS d FROM lineitem, n UNION ALL SELECT ({b})::DOUBLE, -1.0::DOUBLE / v FROM lineitem, n),
  g AS (SELECT x, sum(d) AS d FROM x GROUP BY x), s AS (SELECT abs(sum(d) OVER (ORDER BY x)) AS gap, lead(x) OVER (ORDER BY x) - x AS wide FROM g) SELECT round(sum(gap * wide), 6) AS w1 FROM s)"""


@query(" UNION ALL ".join(f"SELECT '{k}' AS pair, w1 FROM {area_sql(a, b)}" for k, (a, b) in PAIRS.items()))
def wasserstein_columns(spark, sf):
    """The distance of whole columns: ranges of values are summed by themselves, from where the ranges before end."""
    out = None
    for k, (a, b) in PAIRS.items():
        one = S.wasserstein_columns(lineitem(spark, sf), F.expr(a), F.expr(b)).select(F.lit(k).alias("pair"), F.round("w1", 6).alias("w1"))
        out = one if out is None else out.union(one)
    return out


POINTS = "(SELECT l_orderkey * 10 + l_linenumber AS point_id, * FROM lineitem)"
SAMPLES = [[-2.0], [0.5], [1.5], [3.0]]
BEHAVES = "X_2 * C + sin ( X_0 )".split()
OTHER = "X_2 * C + cos ( X_0 )".split()


def points(spark, sf) -> DataFrame:
    return lineitem(spark, sf).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), *COLUMNS)


def values_sql(e) -> str:
    return "[" + ", ".join(to_sql(e, COLUMNS, c, LIB) for c in SAMPLES) + "]"


@query("SELECT point_id, " + ", ".join(f"round({to_sql(BEHAVES, COLUMNS, c, LIB)}, {DIGITS}) AS v{k}" for k, c in enumerate(SAMPLES)) + f" FROM {POINTS}")
def behavior_matrix(spark, sf):
    b = S.behaviour(points(spark, sf), BEHAVES, COLUMNS, SAMPLES, "values", LIB)
    return b.select("point_id", *[F.round(F.get("values", F.lit(k)), DIGITS).alias(f"v{k}") for k in range(len(SAMPLES))])


@query(f"WITH b AS (SELECT list_sort({values_sql(BEHAVES)}) AS u, list_sort({values_sql(OTHER)}) AS v FROM {POINTS}) SELECT round(sum(list_sum(list_transform(range(1, 5), lambda i: abs(u[i] - v[i]))) / 4) / count(*), 6) AS bed FROM b")
def bed_pair(spark, sf):
    return S.behaviour_distance_of(points(spark, sf), BEHAVES, OTHER, COLUMNS, SAMPLES, None, LIB).select(F.round("bed", 6).alias("bed"))


GUARDED = {"mismatch": ("ln ( X_2 )", "X_2"), "same": ("X_2 * C", "X_2 * C"), "infinite": ("X_0 / ( X_1 * C )", "X_0"), "nowhere": ("ln ( u- X_1 ) * C", "sqrt ( u- X_1 )")}


@query("""SELECT 'mismatch' AS which, CASE WHEN bool_or(l_discount = 0) THEN 'inf' END AS bed FROM lineitem UNION ALL SELECT 'same', round(avg(abs(l_discount - l_discount)), 6)::VARCHAR FROM lineitem
UNION ALL SELECT 'infinite', CASE WHEN bool_and(l_quantity > 0 AND l_extendedprice > 0) THEN 'inf' END FROM lineitem UNION ALL SELECT 'nowhere', CASE WHEN bool_and(l_extendedprice > 0) THEN '0.0' END FROM lineitem""")
def bed_nonfinite_guard(spark, sf):
    """Behaviours with NaN and infinities: finite on one side only, equal, infinite beside finite, finite nowhere."""
    out = None
    for name, (a, b) in GUARDED.items():
        one = S.behaviour_distance_of(points(spark, sf), a.split(), b.split(), COLUMNS, [[0.0], [1.0]], None, LIB)
        one = one.select(F.lit(name).alias("which"), F.round("bed", 6).cast("string").alias("bed"))
        out = one if out is None else out.union(one)
    return out.withColumn("bed", F.when(F.col("bed") == "Infinity", "inf").otherwise(F.col("bed")))


# expressions as data

def formulas(spark, sf) -> DataFrame:
    """An expression for each part, of four forms, with the part's size as a number."""
    form = F.pmod("p_partkey", F.lit(4))
    size = F.col("p_size").cast("string")
    text = F.when(form == 0, F.concat(F.lit("X_0 + "), size)).when(form == 1, F.concat(size, F.lit(" * X_1"))).when(form == 2, F.concat(F.lit("sin ( X_0 * "), size, F.lit(" )"))).otherwise(F.concat(F.lit("( X_0 + "), size, F.lit(" ) ^2")))
    return table(spark, sf, "part").select("p_partkey", "p_size", F.split(text, " ").alias("tokens"))


def on_tokens(f, kind: str):
    """A function of one expression's tokens as a column function, a batch at a time."""

    @F.pandas_udf(kind)
    def run(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: f(list(t)))

    return run


KINDS = ("click", "error", "purchase", "signup", "view")


@query(f"""WITH d AS (SELECT user_id, ts::DATE AS day, string_agg(CASE event_type {' '.join(f"WHEN '{k}' THEN '{chr(97 + i)}'" for i, k in enumerate(KINDS))} END, '' ORDER BY event_id) AS s FROM events GROUP BY ALL)
SELECT a.user_id, a.day::VARCHAR AS day, levenshtein(a.s, b.s)::INTEGER AS distance FROM d a JOIN d b ON a.user_id = b.user_id AND b.day = a.day + 1""")
def token_edit_distance(spark, sf):
    """Edits between what a user does on a day and on the next, by a built-in function over token arrays."""
    each = table(spark, sf, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).getField("event_type").alias("u"))
    after = each.select("user_id", F.date_sub("day", 1).alias("day"), F.col("u").alias("v"))
    return each.join(after, ["user_id", "day"]).select("user_id", F.col("day").cast("string").alias("day"), token_distance_column(F.col("u"), F.col("v"), list(KINDS)).alias("distance"))


@query("SELECT a.p_partkey, ((a.p_size % 2 <> b.p_size % 2)::INTEGER + (a.p_size <> b.p_size)::INTEGER)::INTEGER AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def tree_edit_distance(spark, sf):
    """A sum or product of each part's size and that of the next part: an operator and a leaf may differ."""
    tokens = F.array(F.lit("X_0"), F.when(F.col("p_size") % 2 == 0, "+").otherwise("*"), F.col("p_size").cast("string"))
    each = table(spark, sf, "part").select("p_partkey", tokens.alias("u"))
    after = each.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("u").alias("v"))
    return each.join(after, "p_partkey").select("p_partkey", tree_distance_udf(LIB)("u", "v").alias("distance"))


@query(r"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '$X_{0} + ' || p_size || '$' WHEN 1 THEN '$' || p_size || ' \cdot X_{1}$' WHEN 2 THEN '$\sin (X_{0} \cdot ' || p_size || ')$' ELSE '$(X_{0} + ' || p_size || ')^2$' END AS latex FROM part")
def latex_render(spark, sf):
    return formulas(spark, sf).select("p_partkey", on_tokens(lambda t: latex(t, LIB), "string")("tokens").alias("latex"))


@query("SELECT p_partkey, (p_size + 1) || '*X_0' AS simple FROM part")
def simplify_tokens(spark, sf):
    """Like terms of each part's formula are gathered."""
    size = F.col("p_size").cast("string")
    tokens = F.split(F.concat(F.lit("X_0 * X_1 / X_1 + "), size, F.lit(" * X_0")), " ")
    return table(spark, sf, "part").select("p_partkey", on_tokens(lambda t: "".join(simplify(t, LIB)), "string")(tokens).alias("simple"))


#: Forms of two columns, several of which are equal.
TWO = ("{0} + {1}", "{1} + {0} * 1", "{0} * {1} + {0}", "{0} * ( 1 + {1} )", "{0} - ( u- {1} )", "( {0} * 2 ) * ( {1} * 0.5 )")
PAIRED = {f"{i}{j}{k}": form.format(f"X_{i}", f"X_{j}") for i in range(4) for j in range(4) for k, form in enumerate(TWO)}


@query("SELECT error, count(*) AS candidates FROM (SELECT unnest([" + ", ".join(f"round(sqrt(avg(pow({to_sql(e.split(), COLUMNS, (), LIB)} - y, 2))), 4)" for e in PAIRED.values()) + f"]) AS error FROM {Y}) GROUP BY error")
def distinct_candidates(spark, sf):
    """Candidates from all pairs of columns: those that identities show to be equal are scored once; SQL scores them all."""
    table_ = spark.createDataFrame([(k, e.split()) for k, e in PAIRED.items()], "expr_key string, tokens array<string>")
    forms = distinct_forms(table_, LIB).groupBy("form").agg(F.count("*").alias("n"))
    counts = {r["form"]: r["n"] for r in forms.collect()}  # a row for each candidate at most
    errors = S.score_many(with_target(spark, sf), [(form, form.split(), []) for form in sorted(counts)], COLUMNS, "y", LIB)
    return errors.join(F.broadcast(spark.createDataFrame(list(counts.items()), "expr_key string, n long")), "expr_key").groupBy(F.round("error", 4).alias("error")).agg(F.sum("n").alias("candidates"))


@query("SELECT count(*) AS n, count(*) AS same FROM part")
def parse_roundtrip(spark, sf):
    """Formulas that read back from what they print as: all of them."""
    same = on_tokens(lambda t: parse(parse(t, LIB).to_list(LIB), LIB) == parse(t, LIB), "boolean")
    return formulas(spark, sf).agg(F.count("*").alias("n"), F.sum(same("tokens").cast("long")).alias("same"))


# grammars


@query("SELECT 'S' AS lhs, chr(39) || event_type || chr(39) AS rhs, round(count(*) / sum(count(*)) OVER (), 12) AS chance FROM events GROUP BY event_type")
def pcfg_normalised_weights(spark, sf):
    """A grammar whose weights are how often each kind of event comes."""
    from pyspark.sql import Window as W

    counts = table(spark, sf, "events").groupBy("event_type").count().collect()  # a row for each kind
    g = G.Grammar.read("S -> " + " | ".join(f"'{r['event_type']}' [{r['count']}]" for r in counts))
    shown = F.array_join(F.transform("rhs", lambda s: F.concat(F.lit("'"), s, F.lit("'"))), " ")
    return g.frame(spark).select("lhs", shown.alias("rhs"), F.round(F.col("weight") / F.sum("weight").over(W.partitionBy("lhs")), 12).alias("chance"))


DAYS = "S -> S E [0.5] | E [0.5]\nE -> " + " | ".join(f"'{k}' [1]" for k in KINDS)


@query("WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL) SELECT 'S -> S E' AS rule, sum(n - 1)::DOUBLE AS n FROM d UNION ALL SELECT 'S -> E', count(*)::DOUBLE FROM d UNION ALL SELECT 'E -> ' || event_type, count(*)::DOUBLE FROM events GROUP BY event_type")
def grammar_rule_counts(spark, sf):
    """What users do in a day, parsed by a grammar: how often each rule is applied."""
    each = table(spark, sf, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).getField("event_type").alias("t"))
    g = G.Grammar.read(DAYS)
    names = F.array(*[F.lit(f"{r.lhs} -> {' '.join(r.rhs)}") for r in g.rules])
    return rule_counts(each, "t", g).select(F.get(names, "rule_id").alias("rule"), F.round("n", 6).alias("n"))


def part_keys(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("sample_id"))


@query()
def grammar_sample(spark, sf):
    """An expression from the library's own grammar for each part, made in parallel."""
    return G.generate(spark, LIB, part_keys(spark, sf), 7).select("sample_id", "expr_key", F.size("tokens").alias("length"))


@query()
def grammar_distinct(spark, sf):
    """As many different expressions as there are suppliers."""
    return G.generate_distinct(spark, LIB, table(spark, sf, "supplier").count(), 7).select("expr_key", F.size("tokens").alias("length"))


@query("SELECT count(*) AS n, true AS within FROM part")
def grammar_constraint_check(spark, sf):
    """Constrained samples, one for each part: none is too deep, too large, has too many sines or nests them."""
    g = G.Grammar.of_library(SymbolLibrary.of(["+", "*", "sin", "cos", "C"], 2), None)
    for c in (MaxDepth(12), MaxNodes(60), MaxOccurrences("sin", 2), NoNested(["sin", "cos"])):
        g.constrain(c)
    sines = lambda t: F.size(F.filter(t, lambda x: x == "sin"))
    nested = F.col("text").rlike(r"(sin|cos) \( [^()]*(sin|cos)")
    return G.generate(spark, g, part_keys(spark, sf), 3).withColumn("text", F.array_join("tokens", " ")).agg(F.count("*").alias("n"), F.bool_and((sines(F.col("tokens")) <= 2) & ~nested).alias("within"))


# sources


@query("SELECT " + ", ".join(f"true AS {c}_inside, count(*) AS {c}_n" for c in ("uniform", "log_uniform", "integer_uniform")) + " FROM lineitem")
def sampler_ranges(spark, sf):
    """Whether all drawn values lie inside their sampler's bounds, and reach near both ends."""
    kinds = {"uniform": samplers.uniform(1, 5), "log_uniform": samplers.log_uniform(0.1, 10, True, False), "integer_uniform": samplers.integer_uniform(1, 10, False, True)}
    df = samplers.sample(spark, list(kinds.values()), lineitem(spark, sf).count(), 5, list(kinds))
    ends = {"uniform": (-5, -4.99, 4.99, 5), "log_uniform": (0.1, 0.11, 9.9, 10), "integer_uniform": (-9, -9, -1, -1)}

    def inside(k):
        a, b, c, d = ends[k]
        return (F.min(k) >= a) & (F.min(k) <= b) & (F.max(k) >= c) & (F.max(k) <= d)

    return df.agg(*[x for k in kinds for x in (inside(k).alias(f"{k}_inside"), F.count(k).alias(f"{k}_n"))])


@query("SELECT count(*) AS n, true AS inside FROM lineitem")
def sample_source_read(spark, sf):
    """As many drawn rows as there are line items, from the Python data source."""
    found = sample_source.read(spark, [samplers.uniform(0, 1, True, False), samplers.log_uniform(1, 100)], lineitem(spark, sf).count(), 3)
    return found.agg(F.count("*").alias("n"), F.bool_and(F.col("x0").between(0, 1) & F.abs("x1").between(1, 100)).alias("inside"))


#: Equations of the catalogue with up to two variables, which are bound to two columns.
BOUND, AIM = ["l_discount", "l_tax"], "l_quantity"
TOLD = {b.name: [d for d in b if d.num_variables <= 2] for b in catalogue.catalogue().values()}


def equation_sql(d) -> str:
    return f"sqrt(avg(pow({to_sql(d.tokens, BOUND, (), d.library)} - {AIM}, 2)))"


def scored(spark, sf, datasets) -> DataFrame:
    return S.score_many(lineitem(spark, sf), [(d.name, d.tokens, []) for d in datasets], BOUND, AIM, SymbolLibrary.default(2))


@query(" UNION ALL ".join(f"SELECT '{b}' AS benchmark, count(*)::INTEGER AS datasets, count(*) FILTER (isfinite(e))::INTEGER AS finite, round(min(e) FILTER (isfinite(e)), 6) AS least FROM (SELECT unnest([{', '.join(map(equation_sql, found))}]) AS e FROM lineitem)" for b, found in TOLD.items()))
def catalog_counts(spark, sf):
    """Each benchmark's equations of up to two variables over two columns: how many, how many give finite errors, the least error."""
    out = None
    finite = F.abs("error") < F.lit(float("inf"))
    for b, found in TOLD.items():
        one = scored(spark, sf, found).agg(F.lit(b).alias("benchmark"), F.count("*").cast("int").alias("datasets"), F.sum(finite.cast("int")).cast("int").alias("finite"), F.round(F.min(F.when(finite, F.col("error"))), 6).alias("least"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT row_number() OVER (ORDER BY error, name)::INTEGER AS place, name FROM (" + " UNION ALL ".join(f"SELECT '{d.name}' AS name, round({equation_sql(d)}, 6) AS error FROM lineitem" for d in TOLD["Nguyen"] if d.num_variables == 1) + ")")
def catalog_filter_sort(spark, sf):
    """Equations of one variable in the order of their error over a column."""
    from pyspark.sql import Window as W

    b = catalogue.catalogue()["Nguyen"]
    found = scored(spark, sf, [b.datasets[n] for n in b.list(1)]).withColumn("error", F.round("error", 6))
    return found.select(F.row_number().over(W.orderBy("error", "expr_key")).alias("place"), F.col("expr_key").alias("name"))  # a row for each equation


@query(" UNION ALL ".join(f"SELECT '{d.name}' AS name, round(avg({to_sql(d.tokens, BOUND, (), d.library)}), 9) AS mean, count(*) AS n FROM lineitem" for d in TOLD["Nguyen"]))
def catalog_ground_truth(spark, sf):
    """What every equation of a benchmark gives over two columns, on average."""
    found = TOLD["Nguyen"]
    values_ = [F.struct(F.lit(d.name).alias("name"), F.round(F.avg(to_column(d.tokens, BOUND, (), d.library)), 9).alias("mean"), F.count("*").alias("n")) for d in found]
    return lineitem(spark, sf).agg(F.array(*values_).alias("r")).select(F.explode("r").alias("r")).select("r.*")


# evaluation as a whole


@query(MANY_SQL)
def evaluator_batch(spark, sf):
    """A batch of expressions through the evaluator: read, scored in parallel, remembered."""
    e = Evaluator(with_target(spark, sf), COLUMNS, "y", LIB, threshold=0.0)
    e.evaluate([x.split() for x in MANY.values()] * 2)
    names = {x.replace(" ", ""): k for k, x in MANY.items()}
    rows = [(names[m["expr_key"]], round(float(m["error"]), 4)) for m in e.results("", -1).all_models]
    return spark.createDataFrame(rows, "expr_key string, error double")


def searched(spark, sf, most: int):
    """A dataset of two columns of lineitem and what they make."""
    d = catalogue.Dataset("lineitem", num_variables=2, max_evaluations=most)
    df = lineitem(spark, sf).select(F.col("l_discount").alias("x0"), F.col("l_tax").alias("x1"), ((1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("y"))
    d.load = lambda *_, **__: df
    return d


@query()
def search_sampling(spark, sf):
    """A search by grammar sampling with a budget."""
    from .operators.search import GrammarSampling, run

    d = searched(spark, sf, 60)
    r = run(d, spark, GrammarSampling(batch=30), 1, 5, max_iter=20)[0]
    return results_frame(spark, [r])


@query()
def search_evolution(spark, sf):
    """Evolution of trees with a budget."""
    from .operators.search import Evolution, run

    d = searched(spark, sf, 60)
    r = run(d, spark, Evolution(population=20, generations=3), 1, 5, max_iter=10)[0]
    return results_frame(spark, [r])


@query()
def search_latent(spark, sf):
    """Evolution of vectors that the grammar decodes."""
    from .operators.search import LatentEvolution, run

    d = searched(spark, sf, 40)
    r = run(d, spark, LatentEvolution(population=20, generations=2, samples=60), 1, 5, max_iter=10)[0]
    return results_frame(spark, [r])


@query()
def grammar_statistics(spark, sf):
    """Single tries, one for each part."""
    return G.statistics(spark, LIB, part_keys(spark, sf), 3)


@query()
def behaviour_sampled_constants(spark, sf):
    """Behaviour distance with constants from a Latin hypercube."""
    c = S.latin_hypercube(16, [(-5, 5)], 3).tolist()
    return S.behaviour_distance_of(lineitem(spark, sf).select(*COLUMNS), BEHAVES, OTHER, COLUMNS, c, None, LIB)


@query("SELECT type, sum(n)::BIGINT AS n FROM (SELECT unnest([{'type': 'var', 'n': count(*)}, {'type': 'op', 'n': count(*)}, {'type': 'fn', 'n': count(*) FILTER (p_partkey % 4 >= 2)}], recursive := true) FROM part) GROUP BY type")
def symbol_table(spark, sf):
    """How often each type of symbol comes in the parts' formulas: their tokens joined with the library's table."""
    tokens = formulas(spark, sf).select(F.explode("tokens").alias("symbol"))
    return tokens.join(F.broadcast(LIB.frame(spark)), "symbol").groupBy("type").agg(F.count("*").alias("n"))  # a row for each symbol of the library


@query(RUNNING)
def stream_running_best(spark, sf):
    """The running best as a stream with state: the batch answer."""
    import uuid

    from .sources.folders import shared_folder
    from .streaming.events import follow, table_of

    at = f"{shared_folder(spark)}/running_{uuid.uuid4().hex}"
    src = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    ev = src.select(F.col("user_id").alias("experiment_id"), F.col("event_id").alias("eval_no"), F.col("value").alias("error"))
    return table_of(follow(ev), f"{at}/table", f"{at}/checkpoint").select("experiment_id", "eval_no", "error", "best_before", "is_new_best")


@query(f"SELECT experiment_id, eval_no, error FROM ({RUNNING}) WHERE is_new_best")
def stream_log_of_bests(spark, sf):
    """New bests of a stream as a log: a batch that comes again replaces its own rows."""
    import uuid

    from .sources.folders import shared_folder
    from .streaming.events import follow, log_bests, read_log

    at = f"{shared_folder(spark)}/bests_{uuid.uuid4().hex}"
    src = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    ev = src.select(F.col("user_id").alias("experiment_id"), F.col("event_id").alias("eval_no"), F.col("value").alias("error"))
    log_bests(follow(ev), f"{at}/log", f"{at}/checkpoint").awaitTermination()
    return read_log(spark, f"{at}/log").select("experiment_id", "eval_no", "error")


def describe() -> str:
    return json.dumps({k: (f.__doc__ or "").strip() for k, f in QUERIES.items()}, indent=1)
