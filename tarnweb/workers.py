"""Python workers: getting this package to them."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: unless PYTHONPATH names its root,
    Spark sends it to the executors, once an application."""
    root = Path(__file__).resolve().parents[1]
    if str(root) in os.environ.get("PYTHONPATH", "").split(":") or _SHIPPED.get("app") == spark.sparkContext.applicationId:
        return
    at = Path(tempfile.mkdtemp()) / "tarnweb_package.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in (root / "tarnweb").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(at))
    _SHIPPED["app"] = spark.sparkContext.applicationId


_SHIPPED: dict[str, str] = {}
