"""Send the package to workers that cannot import it by themselves."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add this package, as a zip file, to the Python path of the workers; once per application.

    Functions that run in Python tasks are found there by name, so a cluster needs neither an
    installed package nor a folder that all machines share.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    # The driver serves this file to the executors as long as the application lives.
    path = Path(tempfile.mkdtemp(prefix="shipped-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as file:
        for source in sorted(package.rglob("*.py")):
            file.write(source, source.relative_to(package.parent))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)
