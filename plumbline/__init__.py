"""Plumbline: retrieval, ranking and evaluation of conversational product search as Spark DataFrame jobs."""

from __future__ import annotations

import os
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it (elsewhere, ship it with --py-files)."""
    env = spark.sparkContext.environment
    if ROOT not in (known := env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, known)))
    return spark
