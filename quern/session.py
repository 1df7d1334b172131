"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, where neither PYTHONPATH nor the working directory has it."""
    home = str(_ROOT.parent)
    seen = {os.path.realpath(p or ".") for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}
    application = spark.sparkContext.applicationId
    if home in seen or application in _SHIPPED:
        return
    path = os.path.join(tempfile.mkdtemp(), f"{_ROOT.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_ROOT.rglob("*")):
            if p.suffix in (".py", ".json") and "__pycache__" not in p.parts:
                z.write(p, p.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(application)


def session(app: str = "quern", **conf: str) -> SparkSession:
    """A session with the settings this package is written for: UTC, adaptive plans, Arrow."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
