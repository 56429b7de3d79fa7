"""Workers find the package when the driver runs somewhere else."""

import os
import subprocess
import sys
from pathlib import Path

from conftest import SF

REPO = Path(__file__).resolve().parent.parent
CODE = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", {str(REPO / "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate())
print("rows", entry.queries()["w19_smoothed_probability"](spark, {SF!r}).count())
"""


def test_query_from_a_foreign_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1000" in done.stdout, done.stderr[-2000:]
