"""Where a job keeps the tables that cut its lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a ``local`` master may do without the setting: there a fresh temporary folder is
    taken. On a cluster a machine-local folder would be lost with its executor, so the job
    stops with an error instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if root:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(root)  # MLlib's own checkpoints belong there too
        return root
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_ROOTS:
        root = tempfile.mkdtemp(prefix="sharewise-")
        context.setCheckpointDir(root)
        _LOCAL_ROOTS[context.applicationId] = root
    return _LOCAL_ROOTS[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the checkpoint folder; never one that exists."""
    return f"{checkpoint_root(spark)}/sharewise/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` but stays columnar, so later passes still prune
    columns and push fold filters into the scan. Survives the loss of any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
