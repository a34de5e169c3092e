import math

from veldra import queries as Q
from veldra.operators import results as R
from veldra.streaming.events import EVENTS, append_bests, best_so_far, follow, log_bests, read_log, run_to_end, table_of


def test_state_is_kept_between_batches(spark, tmp_path):
    rows = [(k % 3, k, math.nan if k % 7 == 0 else float((k * 37) % 50)) for k in range(60)]
    src = str(tmp_path / "in")
    for k in range(0, 60, 20):
        spark.createDataFrame(rows[k : k + 20], EVENTS).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(src)
    got = run_to_end(follow(stream, 3.0, 15), "follow_test", str(tmp_path / "c1")).collect()
    want = {(r.experiment_id, r.eval_no): (r.best_before, r.is_new_best) for r in R.running_best(spark.createDataFrame(rows, EVENTS)).collect()}
    assert {(r.experiment_id, r.eval_no): (r.best_before, r.is_new_best) for r in got} == want
    for x in range(3):
        mine = sorted((r.eval_no, r) for r in got if r.experiment_id == x)
        stop = next((k for k, (_, r) in enumerate(mine, 1) if r.is_new_best and r.error < 3 or k >= 15), len(mine))
        assert [r.stopped for _, r in mine] == [k > stop for k in range(1, len(mine) + 1)]


def test_streaming_aggregate(spark, tmp_path):
    rows = [(1, 1, 4.0), (1, 2, math.nan), (2, 3, 2.0), (1, 4, 3.0)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, EVENTS).write.parquet(src)
    got = run_to_end(best_so_far(spark.readStream.schema(EVENTS).parquet(src)), "best_test", str(tmp_path / "c2"), "complete").collect()
    assert {(r.experiment_id, r.best, r.n) for r in got} == {(1, 3.0, 3), (2, 2.0, 1)}


def test_a_log_holds_each_new_best_once(spark, tmp_path):
    """Two runs over growing input, a stop between them, and a batch that is written again."""
    rows = [(k % 4, k, math.nan if k % 7 == 0 else float((k * 37) % 50)) for k in range(80)]
    src, log, checkpoint = (str(tmp_path / x) for x in ("in", "log", "c"))
    want = sorted((r.experiment_id, r.eval_no, r.error) for r in R.running_best(spark.createDataFrame(rows, EVENTS)).where("is_new_best").collect())
    for k in (0, 40):
        for at in (k, k + 20):
            spark.createDataFrame(rows[at : at + 20], EVENTS).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(src)
        log_bests(follow(stream), log, checkpoint).awaitTermination()
    told = read_log(spark, log)
    assert sorted((r.experiment_id, r.eval_no, r.error) for r in told.collect()) == want and told.select("batch").distinct().count() > 2
    last = told.agg({"batch": "max"}).first()[0]
    again = told.where(f"batch = {last}").selectExpr("experiment_id", "eval_no", "error", "best_before", "true AS is_new_best", "false AS stopped")
    again = spark.createDataFrame(again.collect(), again.schema)
    append_bests(log)(again, last)
    assert sorted((r.experiment_id, r.eval_no, r.error) for r in read_log(spark, log).collect()) == want
    append_bests(log)(again.limit(0), last + 1)  # a batch without a new best
    assert read_log(spark, log).count() == len(want)


def test_the_running_best_is_a_table_of_files(spark, tmp_path):
    """Rows go from the tasks to files; a sink in memory would gather them in the driver."""
    before = {t.name for t in spark.catalog.listTables()}
    got = Q.stream_running_best(spark, "/root/testdata/sf0.001")
    assert {t.name for t in spark.catalog.listTables()} == before and got.inputFiles()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, Q.running_best(spark, "/root/testdata/sf0.001").collect()))
    spark.createDataFrame([], EVENTS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    assert table_of(follow(stream), str(tmp_path / "out"), str(tmp_path / "c")).count() == 0
