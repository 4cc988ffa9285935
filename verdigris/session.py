"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings its own."""
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    } | extra
    builder = SparkSession.builder.master(f"local[{cores}]").appName("verdigris")
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once per application.

    The archive goes through the driver's file server, so no shared folder is assumed.
    """
    context = spark.sparkContext
    if getattr(context, "_verdigris_shipped", False):
        return
    sources = sorted(p for p in PACKAGE.rglob("*.py"))
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in sources)).hexdigest()[:12]
    folder = tempfile.mkdtemp(prefix="verdigris-")
    archive = os.path.join(folder, f"verdigris-{digest}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sources:
            z.write(p, str(Path(PACKAGE.name) / p.relative_to(PACKAGE)))
    context.addPyFile(archive)
    context._verdigris_shipped = True
