"""Incremental ingestion: new files of a folder into the page cache, once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scrivane.functions.keys import cache_key, content_hash
from scrivane.functions.media import media_type
from scrivane.operators.cache import CacheTable

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def new_files(spark: SparkSession, path: str, glob: str = "*", per_trigger: int = 100) -> DataFrame:
    """A stream of a folder's files with their hash and media type."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(path)
    return stream.withColumns({"file_hash": content_hash(F.col("content")), "media_type": media_type(F.col("path"))})


def ingest(files: DataFrame, cache: CacheTable, process: Callable[[DataFrame], DataFrame], prompt: str, checkpoint: str) -> StreamingQuery:
    """Process each batch's files that the cache lacks, and store (cache_key, value) as ``process`` returns them.

    ``process`` gets the files' columns but their content, which it reads with
    with_content() where it needs it, so files are hashed as they are scanned and
    never shuffled. A batch that is run again after a failure finds its entries
    stored and calls nothing twice.
    """

    def batch(df: DataFrame, _: int) -> None:
        # Kept while the batch runs: every further look at it would read and hash the files again.
        keyed = df.drop("content").withColumn("cache_key", cache_key(F.col("file_hash"), F.lit(prompt))).dropDuplicates(["cache_key"]).persist()
        try:
            cache.write(process(keyed.join(cache.read(keyed).select("cache_key"), "cache_key", "left_anti")))
        finally:
            keyed.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
