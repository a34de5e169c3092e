import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
from veldra.llm import queries

spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def probe(batches):
    try:
        import veldra
    except ImportError:
        yield from batches

assert spark.range(3).mapInArrow(probe, "id long").count() == 3, "workers can import the package, so this shows nothing"
for name in [*sorted(queries.QUERIES), "pipeline"]:
    rows = entry.queries()[name](spark, "/root/testdata/sf0.001").count()
    print(name, rows)
    assert rows
print("all ran")
"""


def test_every_corpus_query_runs_where_workers_lack_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME", "PYSPARK_SUBMIT_ARGS", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    got = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in got.stdout, got.stdout[-2000:] + got.stderr[-3000:]
