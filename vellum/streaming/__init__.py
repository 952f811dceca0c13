"""Documents that arrive in a folder, extracted and chunked as they come.

Extraction and chunking look at one document at a time, so the stream needs no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources import documents as D

_FILES = "path string, modificationTime timestamp, length long, content binary"


def chunk_stream(spark: SparkSession, path: str, profile: str = "chunking") -> DataFrame:
    """(filename, chunk_index, text) of the files that appear under a path, as a stream."""
    files = spark.readStream.format("binaryFile").schema(_FILES).load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    return D.chunk(D.extract(files, profile=profile), profile).select("filename", F.posexplode("chunks").alias("chunk_index", "text"))
