"""Where Python workers find this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> SparkSession:
    """Lets workers import the package from where the driver has it, whatever folder they start in.

    On a cluster whose machines lack that folder, ship the package with ``--py-files``; then this changes nothing.
    """
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *environment.get("PYTHONPATH", "").split(os.pathsep)]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, environment.get("PYTHONPATH", "").split(os.pathsep))])
    return spark
