"""Makes this package importable on the executors, wherever the driver imported it from."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the context's Python files, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_tapewright_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="spark-ship-")) / "tapewright.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(target))  # the driver's file server hands it to every executor
    sc._tapewright_shipped = True


def shipped(f: Callable) -> Callable:
    """f(spark, ...) with the package shipped first."""

    def run(spark: SparkSession, *args):
        ship(spark)
        return f(spark, *args)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run
