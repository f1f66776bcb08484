"""Makes this package importable for Python workers, wherever the driver found it."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends the package's modules to the executors, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = pathlib.Path(__file__).resolve().parents[1]
    path = pathlib.Path(tempfile.mkdtemp(prefix="marlwork-")) / f"{top.name}_modules.zip"
    with zipfile.ZipFile(path, "w") as out:
        for module in sorted(top.rglob("*.py")):
            out.write(module, module.relative_to(top.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
