"""What a cluster needs besides the plan: the package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once a session, from wherever the driver has imported it."""
    sc = spark.sparkContext
    if getattr(sc, "_emberframe_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="emberframe-"), "emberframe.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("emberframe", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._emberframe_shipped = True
