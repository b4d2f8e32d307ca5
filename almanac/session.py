"""Session set-up."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once per application.

    Operators with a Python step call it themselves, so that the workers need no installation.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    # Only the driver reads this folder; Spark serves the archive to the workers.
    folder = tempfile.mkdtemp(prefix="almanac-package-")
    archive = shutil.make_archive(
        os.path.join(folder, "almanac"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
