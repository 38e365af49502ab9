"""Makes this package importable in Python workers."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once per application, unless their PYTHONPATH has it."""
    app = spark.sparkContext.applicationId
    if app in _done or str(_ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    where = tempfile.mkdtemp(prefix="dotfield-")
    kept = Path(where) / "tree"
    shutil.copytree(_ROOT / "dotfield", kept / "dotfield", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(where, "dotfield"), "zip", kept))
    _done.add(app)


def shipped(query):
    """query(spark, sf_dir) with the package sent first."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run
