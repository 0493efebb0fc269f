"""Run files as they arrive in a folder: the readers of scans and search results as streams.

The records of a file are split as in batch reads, so a stream yields the same rows. A file counts
once it is whole (moved into the folder); each is read once, also after a restart from a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.sources import readers


def arriving_scans(spark: SparkSession, folder: str, layout: str = "ft", files_at_once: int = 100) -> DataFrame:
    """As ``readers.scans``, with the time of the file."""
    raw = spark.readStream.schema("value string").option("lineSep", "\nS\t").option("maxFilesPerTrigger", files_at_once).text(folder)
    return readers.scan_rows(raw.select("value", F.col("_metadata.file_path").alias("file")), layout)


def arriving_results(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """As ``readers.spe2pep``, with the time at which the file arrived."""
    raw = spark.readStream.schema("value string").option("lineSep", "\n+\t").option("maxFilesPerTrigger", files_at_once).text(folder)
    return readers.spe2pep_rows(raw).withColumn("arrived", F.current_timestamp())


def best_so_far(results: DataFrame, score: str = "wdp") -> DataFrame:
    """The best match of each spectrum over all files up to now (complete or update mode): its state is one
    row for each spectrum."""
    keys = ["filename", "scan", "charge"]
    rest = [c for c in results.columns if c not in keys]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), F.col("identified"))).alias("best")).select(*keys, "best.*")


def matches_per_window(results: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Matches by search and time of arrival, with a watermark, so that old windows leave the state."""
    return results.withWatermark("arrived", late).groupBy(F.window("arrived", width), "search_name").agg(F.count("*").alias("matches"), F.max("wdp").alias("best_wdp"))
