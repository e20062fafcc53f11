"""Extension: documents that arrive in a folder, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.functions.limits import Limits
from pagelake.sources.files import decode


def read_landing(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """New files (path, modificationTime, length, content) as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.{xdw,XDW,xbd,XBD}").option("maxFilesPerTrigger", files_per_trigger).load(path)


def decode_stream(files: DataFrame, table: str = "objects", limits: Limits = Limits()) -> DataFrame:
    """Decoding keeps no state between files, so it is the same as in a batch."""
    return decode(files, table, limits)


def arrivals(files: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Files and bytes by window of arrival; late files count until the watermark has passed."""
    return files.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", window)).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes")).select("window.start", "window.end", "n", "bytes")


def latest_versions(events: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last version of each document: what counts is the last save."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("s"), F.max(order).alias(order)).select(key, order, "s.*")
