"""Streams of evaluations: running best and stops with state for each experiment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "experiment_id long, eval_no long, error double"
OUT = "experiment_id long, eval_no long, error double, best_before double, is_new_best boolean, stopped boolean"


def _follow(threshold: float | None, most: int):
    """For each experiment: the best so far, the number of events and whether it has stopped travel as state from batch to batch."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, n, stopped = state.get if state.exists else (float("inf"), 0, False)
        rows = pd.concat(list(frames)).sort_values("eval_no", kind="stable")
        errors = rows["error"].to_numpy(float)
        clean = np.where(np.isnan(errors), np.inf, errors)
        before = np.minimum.accumulate(np.concatenate([[best], clean]))[:-1]
        new = clean < before
        hit = new & (clean < (threshold if threshold is not None else -np.inf))
        count = n + 1 + np.arange(len(rows))
        hit |= (count >= most) if most >= 0 else False
        after = stopped | np.concatenate([[False], np.maximum.accumulate(hit)[:-1]]) if len(rows) else np.zeros(0, bool)
        state.update((float(min(best, clean.min(initial=np.inf))), int(n + len(rows)), bool(stopped or hit.any())))
        yield pd.DataFrame({"experiment_id": key[0], "eval_no": rows["eval_no"].to_numpy(), "error": errors, "best_before": np.where(np.isinf(before), np.nan, before), "is_new_best": new, "stopped": after})

    return run


def follow(events: DataFrame, threshold: float | None = None, most: int = -1) -> DataFrame:
    """A stream of (experiment_id, eval_no, error) with best_before (NaN at first), is_new_best, and stopped: whether an earlier
    event of the experiment was below the threshold as a new best, or the budget of most events was used up."""
    return events.select("experiment_id", "eval_no", "error").groupBy("experiment_id").applyInPandasWithState(_follow(threshold, most), OUT, "best double, n long, stopped boolean", "append", GroupStateTimeout.NoTimeout)


def best_so_far(events: DataFrame) -> DataFrame:
    """The least error and the number of events for each experiment, as a built-in streaming aggregate (update mode)."""
    return events.groupBy("experiment_id").agg(F.min(F.when(F.isnan("error"), None).otherwise(F.col("error"))).alias("best"), F.count("*").alias("n"))


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drives a stream over what is there now into a table in memory, for tests and one-off runs."""
    spark = df.sparkSession
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def table_of(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drives a stream over what is there now into a table of files under a path, whose rows never meet in the driver; it goes when the session ends."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)  # a stream without a row may write no file
    fs.deleteOnExit(at)
    df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


LOG = "experiment_id long, eval_no long, error double, best_before double"


def append_bests(path: str):
    """A writer of one batch's new bests. A batch has a folder of its own, which it replaces, so one that comes again after a failure is in the log once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        found = batch.where("is_new_best AND NOT stopped").select("experiment_id", "eval_no", "error", "best_before")
        found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def log_bests(followed: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that logs the new bests of follow()'s stream under a path, batch by batch; over what is there now unless a trigger is given."""
    return followed.writeStream.foreachBatch(append_bests(path)).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as a table, with the batch of each row."""
    return spark.read.schema(f"{LOG}, batch long").option("basePath", path).parquet(path)
