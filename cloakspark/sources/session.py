"""Session settings: the shared checkpoint folder, and the package on the Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where the session names none, one of our own in local mode, and elsewhere an error, as hosts must share it."""
    context = spark.sparkContext
    if not (folder := context.getCheckpointDir()):
        if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all hosts share")
            folder = tempfile.mkdtemp(prefix="cloakspark-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df`, computed once into a table in the shared folder.

    For rounds that read their own results: a checkpoint keeps the estimated size of its plan, and estimates multiply
    with every join, whereas that of a table is its true one.
    """
    folder = f"{checkpoint_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def with_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; on a cluster without a shared folder ship it with --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
