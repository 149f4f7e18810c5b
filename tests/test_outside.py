"""Python tasks run when the package is only on the driver's path."""

import os
import subprocess
import sys

from conftest import ROOT

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pipewatch.session import local_session
from pipewatch.operators import isolation as iso
from pipewatch.streaming import limits
from pyspark.sql import functions as F
spark = local_session("outside", 2)
calls = spark.range(20).select(F.lit("c").alias("client"), (F.col("id") * 1000000).alias("at_micros"), F.col("id").alias("seq"))
assert limits.limit_table(calls, 2, 5).filter("accepted").count() == 8
rows = spark.range(50).select("id", (F.col("id") % 7).cast("double").alias("x"))
forest = iso.fit_isolation_forest(rows, ["x"], [F.col("id")], n_trees=4)
assert iso.scaled_scores(rows, forest).count() == 50
spark.stop()
"""


def test_tasks_need_no_installed_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT)],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300,
    )
    assert done.returncode == 0, done.stderr[-3000:]
