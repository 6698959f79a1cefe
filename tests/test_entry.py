"""The entry point without the ``llm`` folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

from conftest import SF

REPO = Path(__file__).resolve().parents[1]
RUN = f"""
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
names = e.queries()
assert "pipeline" not in names and not any(n.startswith("op") for n in names), sorted(names)
assert set(e.oracle_sql()) <= set(names)
print("FOUND", len(names), *(names[n](spark, {SF!r}).count() for n in ("time_guard", "segment_summary")))
"""


def test_without_llm(tmp_path):
    for name in ("waymesh", "__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / name).is_dir():
            shutil.copytree(REPO / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (REPO / name).exists() and name != "corpus_pipeline.py":
            shutil.copy(REPO / name, tmp_path)
    for there in (False, True):  # the pipeline's file may stay behind
        if there and (REPO / "corpus_pipeline.py").exists():
            shutil.copy(REPO / "corpus_pipeline.py", tmp_path)
        done = subprocess.run([sys.executable, "-c", RUN], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
        assert "FOUND 5" in done.stdout, done.stderr[-2000:]
