"""Objects of a store as Spark data sources: a listing dealt to tasks, and a sink with commit and abort.

``object_listing`` reads the names of a folder. The driver looks at its first levels
only, until there are enough folders to deal; tasks list what is below them.

``object_sink`` writes a row (key, content) as one object. Tasks write below
``<path>/.staging/<job>/<attempt>/``; when all have ended, the driver names the
attempts that count in ``<job>.json``, or deletes the job's folder. publish() then
moves the objects to their places, in tasks. A move that was made already is
no error, so publishing can be repeated after a crash, and a job that failed leaves
no object behind. Nothing of the rows passes through the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from scrivane.sources.content import store_of

LISTING, SINK, STAGING = "object_listing", "object_sink", ".staging"
#: Folders that a listing is dealt to, about, and levels that the driver looks at for them.
FOLDERS, LEVELS, ROWS = 64, 3, 4096


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool


def _names(path: str, deep: bool) -> Iterator:
    from pyarrow import fs

    store, at = store_of(path)
    for info in store.get_file_info(fs.FileSelector(at, allow_not_found=True, recursive=deep)):
        yield info, info.path[len(at.rstrip("/")) + 1 :]


class ListingReader(DataSourceReader):
    def __init__(self, path: str, folders: int):
        self.path, self.folders = path.rstrip("/"), folders

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        flat, open_ = [], [self.path]
        for _ in range(LEVELS):
            if len(open_) >= self.folders:
                break
            flat += [Folder(p, False) for p in open_]
            open_ = [f"{p}/{name}" for p in open_ for info, name in _names(p, False) if info.type == fs.FileType.Directory and not name.startswith(".")]
        return [*flat, *(Folder(p, True) for p in open_)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        rows: list[tuple] = []
        made = lambda: pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.timestamp("us", "UTC"))], names=["key", "size", "modified"])
        for info, name in _names(partition.path, partition.deep):
            if info.type == fs.FileType.File and not any(p.startswith(".") for p in name.split("/")):
                rows.append((f"{partition.path}/{name}", info.size, info.mtime))
                if len(rows) >= ROWS:
                    yield made()
                    rows = []
        if rows:
            yield made()


class ObjectListing(DataSource):
    """All files below ``path`` but hidden ones: key, size, modified. Option ``folders``: how many folders to deal."""

    @classmethod
    def name(cls) -> str:
        return LISTING

    def schema(self) -> str:
        return "key string, size long, modified timestamp"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options["path"], int(self.options.get("folders", FOLDERS)))


@dataclass
class Attempt(WriterCommitMessage):
    name: str


class SinkWriter(DataSourceArrowWriter):
    def __init__(self, path: str, job: str):
        self.path, self.job = path.rstrip("/"), job

    def _at(self, name: str):
        return store_of(f"{self.path}/{STAGING}/{self.job}{name}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        attempt = uuid.uuid4().hex
        store, at = self._at(f"/{attempt}")
        store.create_dir(at, recursive=True)
        for batch in iterator:
            for key, content in zip(batch.column("key").to_pylist(), batch.column("content"), strict=True):
                parts = (key or "").split("/")
                if not all(parts) or {".", ".."} & {*parts}:
                    raise ValueError(f"not a key: {key}")
                if len(parts) > 1:
                    store.create_dir(f"{at}/{'/'.join(parts[:-1])}", recursive=True)
                with store.open_output_stream(f"{at}/{key}") as f:
                    f.write(content.as_py() or b"")
        return Attempt(attempt)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, at = self._at("")
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(f"{at}.tmp") as f:
            f.write(json.dumps([m.name for m in messages if m is not None]).encode())
        store.move(f"{at}.tmp", f"{at}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, at = self._at("")
        store.create_dir(at, recursive=True)
        store.delete_dir(at)


class ObjectSink(DataSource):
    """Rows (key string, content binary) as objects below ``path``; option ``job`` names the write. publish() makes them visible."""

    @classmethod
    def name(cls) -> str:
        return SINK

    def schema(self) -> str:
        return "key string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return SinkWriter(self.options["path"], self.options["job"])


def list_store(spark: SparkSession, path: str, folders: int = FOLDERS) -> DataFrame:
    """key, size and modified of all files below a path, hidden ones left out; a missing path has none."""
    spark.dataSource.register(ObjectListing)
    return spark.read.format(LISTING).option("folders", folders).load(path)


def publish(spark: SparkSession, path: str, job: str) -> DataFrame:
    """Move a committed job's objects that are still staged to their places; key, path and error of each, stored in the job's folder."""
    base = path.rstrip("/")
    staged = f"{base}/{STAGING}/{job}"
    store, at = store_of(f"{staged}.json")
    with store.open_input_stream(at) as f:
        attempts = json.loads(f.read())

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for info, key in _names(f"{staged}/{folder}", True):
                    if info.type != fs.FileType.File:
                        continue
                    store, to = store_of(f"{base}/{key}")
                    try:
                        store.create_dir(to.rsplit("/", 1)[0], recursive=True)
                        store.move(info.path, to)
                        rows.append((key, f"{base}/{key}", None))
                    except FileNotFoundError:  # moved by an attempt that was lost
                        rows.append((key, f"{base}/{key}", None))
                    except Exception as e:  # noqa: BLE001  the row carries it
                        rows.append((key, None, f"{type(e).__name__}: {e}"))
                for i in range(0, len(rows), ROWS):
                    yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows[i : i + ROWS], strict=True)], names=["key", "path", "error"])

    schema = "key string, path string, error string"
    dealt = spark.createDataFrame([(a,) for a in attempts], "attempt string").repartition(max(1, len(attempts)), "attempt")
    dealt.mapInArrow(move, schema).write.mode("append").parquet(f"{staged}/moved")
    return spark.read.schema(schema).parquet(f"{staged}/moved")


def write_objects(objects: DataFrame, path: str) -> DataFrame:
    """Write rows (key, content; a text is stored as UTF-8) as objects below ``path`` and tell where each went.

    Keys are relative paths without empty or dotted parts and must differ; one that
    is no key fails the write, which then leaves nothing. Null content is an empty
    object. An object of the same key is replaced. Returns key, path and error.
    """
    spark, job = objects.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(ObjectSink)
    objects.select("key", F.col("content").cast("binary").alias("content")).write.format(SINK).option("job", job).mode("append").save(path)
    return publish(spark, path, job)
