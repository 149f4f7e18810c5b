"""Where intermediate tables, checkpoints and test landings are written."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


FALLBACK = "pipewatch.scratchDir"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine; anywhere
    else executors could not reach it.
    """
    root = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getCheckpointDir()
        or spark.conf.get(FALLBACK, None)
    )
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="/tmp/run-")
    # Ours alone, so it goes with this process.
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set(FALLBACK, root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nothing has been written to yet."""
    return f"{scratch_root(spark)}/pipewatch/{label}-{uuid.uuid4().hex}"


def checkpointed(df):
    """Cut lineage reliably; the blocks survive the loss of any executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_root(df.sparkSession))
    return df.checkpoint()
