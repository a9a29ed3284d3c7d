"""Session set-up for tests and scripts, and shipping the package to workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cpus: int = 8, name: str = "tidemark", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested with."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, unless PYTHONPATH names it already."""
    app = spark.sparkContext.applicationId
    if app in _shipped or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="spark-package-")) / "tidemark_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(ROOT.glob("tidemark/**/*.py")) + sorted(ROOT.glob("corpus_pipeline.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
