"""Give the workers this package, wherever the driver was started from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: the package as a zip that Spark sends to its executors."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="flightwatch-")) / "flightwatch.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(home.rglob("*.py")):
            out.write(f, f.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
