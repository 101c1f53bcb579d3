"""The package reaches the executors wherever the driver was started."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).config("spark.sql.shuffle.partitions", "4").getOrCreate()
for name in ("alerts_throttled", "stream_alerts"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_python_code_runs_from_a_foreign_folder(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    command = [sys.executable, "-c", SCRIPT, str(REPO), str(tmp_path / "shared")]
    done = subprocess.run(command, cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=600)
    counts = dict(line.split() for line in done.stdout.splitlines() if line.split()[:1] in (["alerts_throttled"], ["stream_alerts"]))
    assert done.returncode == 0, done.stderr[-2000:]
    assert counts["alerts_throttled"] == counts["stream_alerts"] != "0"


def test_entry_points_without_the_text_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "*.json"))
    script = "import __spark_entry__ as e; n = e.queries(); print(len(n), 'pipeline' in n, any(k.startswith('op1') for k in n))"
    done = subprocess.run([sys.executable, "-c", script], cwd=copy, capture_output=True, text=True, timeout=120)
    count, *found = done.stdout.split()
    assert done.returncode == 0 and int(count) >= 129 and found == ["False", "False"], done.stderr[-2000:]
