"""Puts the package on the executors' Python path, as --py-files would."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors of this application, once; later calls do nothing."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(top)
    out = os.path.join(tempfile.mkdtemp(prefix="folio-"), "folio.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(d, name), os.path.relpath(os.path.join(d, name), root))
    context.addPyFile(out)
    _shipped.add(context.applicationId)
