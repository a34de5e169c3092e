"""The rest stands without the corpus subpackage and its pipeline."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_it(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e, veldra.queries as q; assert set(e.queries()) == set(q.QUERIES) and set(e.oracle_sql()) == set(q.ORACLES); print('fine')"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert run.stdout.strip() == "fine", run.stderr


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(os.path.join(ROOT, "veldra")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, f), encoding="utf-8").read(), f
