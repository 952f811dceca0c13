"""Session helpers: a local session with the engine's defaults, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED = "_vellum_shipped"


def local_session(cpus: int | str = "*", name: str = "vellum", **conf: str) -> SparkSession:
    """A session on this machine; a cluster's own session works as well with every function of the package."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, so that functions can be sent to them by name.  Once per context."""
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    root = Path(__file__).parent
    fd, path = tempfile.mkstemp(prefix="vellum-", suffix=".zip")
    with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
    setattr(sc, _SHIPPED, True)
