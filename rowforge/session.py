"""Sessions: building one, and shipping this package to executors that lack it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, as it is here; once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        path = os.path.join(tempfile.mkdtemp(prefix="rowforge-ship-"), "rowforge.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(PACKAGE):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("rowforge", os.path.relpath(full, PACKAGE)))
        sc.addPyFile(path)
    return spark


def build(app: str = "rowforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; conf keys use __ for dots."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return ship(b.getOrCreate())
