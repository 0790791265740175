"""Parquet table access, and the package shipped to the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in every Python worker of the session's application, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    if (package / "__init__.py").is_file():
        handle, name = tempfile.mkstemp(prefix=f"{package.name}-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as out:
            for source in package.rglob("*.py"):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(name)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (a file or a folder of part files)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
