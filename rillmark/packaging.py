"""Making this package importable by Python workers, wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def send(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application: functions
    that run there are pickled by their module's name."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="rillmark-")) / "rillmark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("rillmark") / p.relative_to(root))
    context.addPyFile(str(archive))
