"""Whole-file document source (S1): one row per ``.txt`` / ``.md`` file in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def extension_glob(extensions: tuple[str, ...]) -> str:
    exts = [e.lstrip(".") for e in extensions if e]
    return "*." + exts[0] if len(exts) == 1 else "*.{" + ",".join(exts) + "}"


def _project(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("_metadata.file_name").alias("title"),
        F.col("value").alias("content"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    )


def read_documents(spark: SparkSession, path: str, extensions: tuple[str, ...] = (".txt", ".md"),
                   recursive: bool = True) -> DataFrame:
    """``(title, content, path, modified_at)``: title is the file name, content the whole text."""
    df = (spark.read.format("text").option("wholetext", True)
          .option("pathGlobFilter", extension_glob(extensions))
          .option("recursiveFileLookup", recursive).load(path))
    return _project(df)


def stream_documents(spark: SparkSession, path: str, extensions: tuple[str, ...] = (".txt", ".md"),
                     max_files_per_trigger: int | None = None, recursive: bool = True) -> DataFrame:
    """Streaming form of ``read_documents``: each new file is read once (the
    checkpoint of the consuming query records which files were ingested)."""
    reader = (spark.readStream.format("text").option("wholetext", True)
              .option("pathGlobFilter", extension_glob(extensions))
              .option("recursiveFileLookup", recursive))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _project(reader.load(path))
