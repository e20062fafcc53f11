"""What a Spark session needs before Python workers can run this package."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each SparkContext."""
    if spark.conf.get(BATCH) == "10000":  # the default is for short rows; ours hold whole texts and files
        spark.conf.set(BATCH, "2000")
    sc = spark.sparkContext
    if getattr(sc, "_pagelake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    out = Path(tempfile.mkdtemp(prefix="pagelake-")) / "pagelake_src.zip"
    out.write_bytes(buffer.getvalue())
    sc.addPyFile(str(out))
    sc._pagelake_shipped = True
