"""tessera: a Spark-first engine for leakage-safe multi-label datasets."""

import os
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])


def on_workers(spark) -> None:
    """Let Python workers import this package from where the driver did. (A cluster without a
    shared folder for code needs it installed, or shipped with addPyFile.)"""
    env = spark.sparkContext.environment
    known = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if ROOT not in known and ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *known])
