"""Spark sessions set up for the engine."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: What every session gets. Sizes of joins and shuffles are left to adaptive execution:
#: partitions are coalesced or split at run time, and a side is broadcast only if its
#: measured size is below Spark's threshold.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`DEFAULTS`; ``conf`` takes precedence."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def read_properties(path: str) -> dict[str, str]:
    """The ``key = value`` lines of a properties file, as configuration for a session."""
    found = {}
    with open(path) as f:
        for line in f:
            key, sign, value = line.strip().partition("=")
            if sign and not key.startswith(("#", "!")):
                found[key.strip()] = value.strip()
    return found


def ship(spark: SparkSession) -> SparkSession:
    """Have the workers of a session import this package, wherever they run.

    Sends its source files once per application; without effect where they have it.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_quern_shipped", False):
        package = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="quern-"), "quern.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("quern", os.path.relpath(full, package)))
        sc.addPyFile(path)
        sc._quern_shipped = True
    return spark
