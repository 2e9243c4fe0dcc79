"""The stateless stages over a stream of new SVG files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import svg


def path_stream(spark: SparkSession, folder: str, min_area: float = 2.0) -> DataFrame:
    """Paths of the documents that arrive in a folder; each file is read once."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    docs = files.select(F.xxhash64("_metadata.file_path").alias("image_id"), F.col("value").alias("svg"))
    return svg.derived(svg.projected(svg.parse_elements(docs)), min_area)
