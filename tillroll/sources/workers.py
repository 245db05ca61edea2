"""What the Python workers of a session need."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def deploy(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    That is for machines that see the driver's folders; elsewhere the package is installed, or given by
    --py-files, and this changes nothing.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
