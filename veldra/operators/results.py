"""Tables of evaluations: leaderboards, running best, stops, first evaluations, unions. All windows are keyed by the experiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def _ordered(experiment: str, order: str):
    return W.partitionBy(experiment).orderBy(order)


def _finite_or_last(error: Column) -> Column:
    return F.when(F.isnan(error), F.lit(None)).otherwise(error)


def running_best(evals: DataFrame, experiment: str = "experiment_id", order: str = "eval_no", error: str = "error") -> DataFrame:
    """Adds best_before (the least error before the row, NULL at first) and is_new_best (strictly below it; NaN never is)."""
    before = F.min(_finite_or_last(F.col(error))).over(_ordered(experiment, order).rowsBetween(W.unboundedPreceding, -1))
    out = evals.withColumn("best_before", before)
    return out.withColumn("is_new_best", F.coalesce(~F.isnan(error) & (F.col("best_before").isNull() | (F.col(error) < F.col("best_before"))), F.lit(False)))


def numbered(evals: DataFrame, experiment: str = "experiment_id", order: str = "eval_no", name: str = "n") -> DataFrame:
    """Adds the 1-based number of the evaluation in its experiment."""
    return evals.withColumn(name, F.row_number().over(_ordered(experiment, order)))


def stop_at_budget(evals: DataFrame, most: int, experiment: str = "experiment_id", order: str = "eval_no") -> DataFrame:
    """The evaluations up to the budget; a negative budget has no end."""
    return evals if most < 0 else numbered(evals, experiment, order, "_n").where(F.col("_n") <= most).drop("_n")


def stop_at_threshold(evals: DataFrame, threshold: float, experiment: str = "experiment_id", order: str = "eval_no", error: str = "error") -> DataFrame:
    """The evaluations up to the first error strictly below the threshold, which is kept: its number is one window minimum."""
    hit = F.when(F.col(error) < threshold, F.col(order))
    out = evals.withColumn("_stop", F.min(hit).over(W.partitionBy(experiment)))
    return out.where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))).drop("_stop")


def first_evaluations(evals: DataFrame, experiment: str = "experiment_id", key: str = "expr_key", order: str = "eval_no") -> DataFrame:
    """One row for each expression of an experiment, its first evaluation: a partial minimum, no window over all rows."""
    rest = [c for c in evals.columns if c not in (experiment, key)]
    return evals.groupBy(experiment, key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(experiment, key, "_r.*")


def leaderboard(models: DataFrame, k: int, experiment: str = "experiment_id", error: str = "error", order: str = "eval_no") -> DataFrame:
    """The k best models of each experiment with their rank; NaN and NULL come last, ties by first evaluation. k < 0: all."""
    place = F.row_number().over(W.partitionBy(experiment).orderBy(F.col(error).asc_nulls_last(), F.col(order).asc()))
    out = models.withColumn("rank", place)
    return out if k < 0 else out.where(F.col("rank") <= k)


def summary(evals: DataFrame, threshold: float | None = None, experiment: str = "experiment_id", key: str = "expr_key", error: str = "error", order: str = "eval_no") -> DataFrame:
    """One row for each experiment: min_error, best_expr, num_evaluated (distinct expressions), evaluation_calls, success."""
    rank = F.struct(F.coalesce(F.isnan(error), F.lit(True)).alias("bad"), F.col(error), F.col(order))
    out = evals.groupBy(experiment).agg(F.min_by(F.struct(F.col(error).alias("e"), F.col(key).alias("k")), rank).alias("b"), F.count_distinct(key).alias("num_evaluated"), F.count("*").alias("evaluation_calls"))
    success = F.lit(False) if threshold is None else F.coalesce(~F.isnan("b.e") & (F.col("b.e") < threshold), F.lit(False))
    return out.select(experiment, F.col("b.e").alias("min_error"), F.col("b.k").alias("best_expr"), "num_evaluated", "evaluation_calls", success.alias("success"))


def union_results(*tables: DataFrame) -> DataFrame:
    """All rows, repeated ones too; columns by name, missing ones NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def suffixed_names(rows: DataFrame, group: str, name: str, order: str, out: str = "unique_name") -> DataFrame:
    """Repeated names of a group in order: name, name_1, name_2, .."""
    k = F.row_number().over(W.partitionBy(group, name).orderBy(order)) - 1
    return rows.withColumn("_k", k).withColumn(out, F.when(F.col("_k") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), F.col("_k").cast("string")))).drop("_k")
