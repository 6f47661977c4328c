"""What the workers of Spark need: the package, and a folder that all of them share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it; an installed package is found anyway."""
    environment, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if here not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([here, *paths])


def shared_path(spark: SparkSession, suffix: str = "") -> str:
    """A new path in the folder that the session names in ``spark.checkpoint.dir``; a local session may name none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{folder or tempfile.mkdtemp()}/{uuid.uuid4().hex}{suffix}"
