"""Text streams: every function of the package is a Column or a stateless map, so it runs on a stream as on a table.

State is needed only for counts over time; these carry a watermark, which bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kobza.operators.spans import SPAN


def line_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A row for each line of the text files that arrive in a folder: line, and arrived (the file's time)."""
    read = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return read.select(F.col("value").alias("line"), F.col("_metadata.file_modification_time").alias("arrived"))


def span_counts(stream: DataFrame, spans: str, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Spans by time window, category and severity. spans: an array column of spans; rows later than late are dropped."""
    if not stream.schema[spans].dataType.simpleString().startswith("array<struct<"):
        raise TypeError(f"{spans} must be {SPAN} in an array")
    rows = stream.withWatermark(time, late).select(time, F.explode(spans).alias("_s"))
    counted = rows.groupBy(F.window(time, width).alias("_w"), F.col("_s.category").alias("category"), F.col("_s.severity").alias("severity")).count()
    return counted.select(F.col("_w.start").alias("window_start"), "category", "severity", "count")
