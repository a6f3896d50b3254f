"""Stored page images: one file for each page, found through an index instead of a listing.

    <base>/<first two of the file's hash>/<file_hash>/<page_hash>.png
    <base>/_index                       a versioned table of file_hash, page_hash and length

A lookup asks the index for the pages' files, whose buckets and filters keep it from
opening what it does not need, then looks at those files only: their length and last
bytes tell whether they are whole. A page whose file is missing, cut or changed is
made again. Images travel as paths; a task reads the ones that it shows to a model.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.functions.pixels import PNG_START
from scrivane.operators.cache import upsert
from scrivane.operators.snapshots import Folder, VersionedTable
from scrivane.sources.content import Loader, Reader, fetch, opened, store_of

KEYS = ["file_hash", "page_hash"]
#: A whole PNG ends with this mark and four bytes of checksum.
END, END_SIZE = b"IEND", 8
Probe = Callable[[str], tuple[int, bytes, bytes]]


def probe(path: str) -> tuple[int, bytes, bytes]:
    """Length, first and last eight bytes of a file."""
    with opened(path) as f:
        length = f.size()
        first = f.read(END_SIZE)
        f.seek(max(0, length - END_SIZE))
        return length, first, f.read(END_SIZE)


def stored_image_loader(reader: Reader = fetch) -> Callable[[], Loader]:
    """For map_model: a stored image's path to its bytes."""
    return lambda: Loader(lambda content: [content], reader)


class PageStore:
    """The page images below ``base``; file and page hashes are letters, digits, ``_`` and ``-``."""

    def __init__(self, spark: SparkSession, base: str, probe: Probe = probe):
        self.spark, self.base, self.probe = spark, base.rstrip("/"), probe
        self.table = VersionedTable(spark, f"{self.base}/_index", "file_hash string, page_hash string, length long, updated_at timestamp", "file_hash")

    def path_of(self, file_hash: Column, page_hash: Column) -> Column:
        return F.concat(F.lit(f"{self.base}/"), F.substring(file_hash, 1, 2), F.lit("/"), file_hash, F.lit("/"), page_hash, F.lit(".png"))

    def index(self, files: DataFrame | None = None) -> DataFrame:
        """file_hash, page_hash, length and path of the stored pages; with ``files`` (file_hash) of theirs only."""
        wanted = None if files is None else files.where("file_hash is not null").select("file_hash").distinct()
        last = upsert(self.table.rows(self.table.snapshot(), wanted), KEYS, ["version", "updated_at"]).where("length is not null")
        return last.select(*KEYS, "length", self.path_of(F.col("file_hash"), F.col("page_hash")).alias("path"))

    def lookup(self, pages: DataFrame) -> DataFrame:
        """file_hash, page_hash and path of those of ``pages`` whose stored image is whole."""
        look, names = self.probe, [*KEYS, "path"]

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                whole = []
                for path, length in zip(part["path"], part["length"], strict=True):
                    try:
                        size, first, last = look(path)
                        whole.append(size == length and first == PNG_START and last.startswith(END))
                    except OSError:
                        whole.append(False)
                yield part[whole][names]

        wanted = pages.select(*KEYS).distinct()
        return self.index(wanted).join(wanted, KEYS, "left_semi").mapInPandas(run, "file_hash string, page_hash string, path string")

    def add(self, images: DataFrame) -> None:
        """Store images (file_hash, page_hash, image; null ones are skipped), each file in one step, then index them all at once."""
        base = self.base

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for h, p, image in zip(part["file_hash"], part["page_hash"], part["image"], strict=True):
                    if not re.fullmatch(r"[\w-]+", h) or not re.fullmatch(r"[\w-]+", p):
                        raise ValueError(f"not a hash: {h}, {p}")
                    store, at = store_of(f"{base}/{h[:2]}/{h}")
                    store.create_dir(at, recursive=True)
                    made = f"{at}/.{p}.{uuid.uuid4().hex}"
                    with store.open_output_stream(made) as f:
                        f.write(bytes(image))
                    store.move(made, f"{at}/{p}.png")
                yield part[KEYS].assign(length=part["image"].map(len))

        made = images.where("image is not null").select(*KEYS, "image").mapInPandas(run, "file_hash string, page_hash string, length long")
        self.table.append(made.withColumn("updated_at", F.current_timestamp()))

    def with_paths(self, pages: DataFrame, raster: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``pages`` (file_hash, page_hash, ...) with ``image_path``, null where there is none.

        ``raster`` makes file_hash, page_hash and image of the pages that it gets, those
        without a whole stored image; what it makes is stored and indexed before it is
        read, so each page is rastered once.
        """
        wanted = pages.select(*KEYS).where("file_hash is not null and page_hash is not null").distinct()
        self.add(raster(wanted.join(self.lookup(wanted), KEYS, "left_anti")))
        return pages.join(self.lookup(wanted).withColumnRenamed("path", "image_path"), KEYS, "left")

    def complete(self, expected: DataFrame) -> DataFrame:
        """file_hash and ``complete``: whether at least ``expected`` pages of a file are stored, by the index alone."""
        counts = self.index(expected).groupBy("file_hash").agg(F.count(F.lit(1)).alias("_n"))
        return expected.join(counts, "file_hash", "left").select("file_hash", (F.coalesce("_n", F.lit(0)) >= F.col("expected")).alias("complete"))

    def clear(self, file_hash: str) -> bool:
        """Drop the images of one file; False where there were none. Its pages leave the index first, so no lookup names a missing file for long."""
        if not re.fullmatch(r"[\w-]+", file_hash):
            raise ValueError("a file hash has letters, digits, _ and - only")
        one = self.spark.createDataFrame([(file_hash,)], "file_hash string")
        gone = self.index(one).select(*KEYS, F.lit(None).cast("long").alias("length"), F.current_timestamp().alias("updated_at"))
        self.table.append(gone)
        return Folder(self.spark, self.base).delete(f"{file_hash[:2]}/{file_hash}")

    def reindex(self) -> None:
        """Index the files that are there (for a store without an index, or with files of other writers), by their names and lengths only."""
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", "true").load(self.base)
        named = found.select(F.regexp_extract("path", r"/([^/]+)/[^/]+\.png$", 1).alias("file_hash"), F.regexp_extract("path", r"/([^/]+)\.png$", 1).alias("page_hash"), "length", F.current_timestamp().alias("updated_at"))
        self.table.append(named.where("page_hash not like '.%'"))
