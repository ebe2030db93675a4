"""Session set-up that Python workers need."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parents[1])


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, if it isn't on their path anyway."""
    environment = spark.sparkContext.environment
    path = environment.get("PYTHONPATH", "")
    if _ROOT not in path.split(":"):
        environment["PYTHONPATH"] = f"{_ROOT}:{path}" if path else _ROOT
    return spark
