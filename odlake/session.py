"""What a session needs before its executors can run this package's Python code."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package's modules to the executors, once an application: they may have no copy of their own."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="odlake-"), "odlake.zip")  # read by the driver, which serves it
    with zipfile.ZipFile(path, "w") as z:
        for module in sorted(package.rglob("*.py")):
            z.write(module, module.relative_to(package.parent))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
