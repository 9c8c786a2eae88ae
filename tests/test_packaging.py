"""Python-worker operators must run when the package is not importable by
the workers (driver started from another directory, nothing installed)."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from trellis.operators.metrics import gaussian_kde
df = spark.range(200).selectExpr("cast(id % 17 as double) as e")
print("ROWS", gaussian_kde(df, "e", 20).count())
"""


def test_worker_side_code_without_installed_package():
    env = dict(os.environ)
    # keep whatever finds pyspark, drop anything that would find this repo
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep)
             if p and os.path.abspath(p) != REPO]
    env["PYTHONPATH"] = os.pathsep.join(paths)
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tempfile.gettempdir(), env=env,
                         capture_output=True, text=True, timeout=600)
    assert "ROWS 20" in out.stdout, out.stderr[-2000:]
