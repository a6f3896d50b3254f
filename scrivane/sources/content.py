"""Late bytes: plans carry keys and paths, and content is read in the task that needs it.

A shuffle, a sort or a cache join of rows that hold files moves whole files. The
functions here read them after the last exchange instead: with_content() as a
column of the same stage, loaders inside a model call.
"""

from __future__ import annotations

import os
import re
import threading
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Reader = Callable[[str], bytes]
#: Bytes of content from which a batch of rows is passed on.
BATCH_BYTES = 32 << 20


def store_of(path: str) -> tuple[Any, str]:
    """The Arrow file system of a path as Spark writes it, and the path in it."""
    from pyarrow import fs

    if re.match(r"file:/|/", path) or "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(re.sub(r"^file:/+", "/", path))
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def opened(path: str):
    """A file of any store that the Arrow file systems reach, for reading at any place."""
    store, at = store_of(path)
    return store.open_input_file(at)


def fetch(path: str) -> bytes:
    with opened(path) as f:
        return f.read()


def with_content(rows: DataFrame, *, path: str = "path", reader: Reader = fetch) -> DataFrame:
    """``rows`` with ``content`` and ``content_error``: each row's file as its task reads it, or why it could not.

    Null paths have neither. Use it after the last join or aggregation of ``rows``.
    """
    kept = [c for c in rows.columns if c not in ("content", "content_error")]
    kinds = dict(rows.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            from_, held, content, errors = 0, 0, [], []
            for i, at in enumerate(part[path]):
                try:
                    content.append(None if at is None else reader(at))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  the row carries it
                    content.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
                held += len(content[-1] or b"")
                if held >= BATCH_BYTES or i + 1 == len(part):
                    yield part.iloc[from_ : i + 1].assign(content=content, content_error=errors)
                    from_, held, content, errors = i + 1, 0, [], []

    return rows.select(*kept).mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "content binary", "content_error string"]))


class Loader:
    """Images of a request from a row's values, one file in memory at a time.

    The threads of a task share it: a file is read once for the rows next to each
    other that need it, and a second one only when the first is done with.
    """

    def __init__(self, take: Callable[..., Sequence[bytes]], reader: Reader = fetch):
        self.take, self.reader, self.lock = take, reader, threading.Lock()
        self.path: str | None = None
        self.content = b""

    def __call__(self, path: str | None, *more) -> list[bytes]:
        if path is None:
            return []
        with self.lock:
            if path != self.path:
                self.path, self.content = None, b""
                self.content = self.reader(path)
                self.path = path
            return list(self.take(self.content, *more))


def work_folder(spark: SparkSession, name: str) -> str:
    """A folder below the session's ``spark.checkpoint.dir``; only a local session without that setting gets one in its warehouse."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir")
    return f"{where.rstrip('/')}/{name}"


def distinct_files(files: DataFrame, key: str, path: str = "path") -> DataFrame:
    """One path for each key (the smallest); rows without a key are left out. Nothing but the two columns is shuffled."""
    return files.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(path).alias(path))
