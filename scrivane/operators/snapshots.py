"""Versioned tables: immutable segments, manifests that name a snapshot, and one atomic create that publishes it.

    <path>/segments/<name>/bucket=<b>/*.parquet    rows, dealt to BUCKETS buckets by a hash of the key
    <path>/filters/<name>/*.parquet                Bloom filters of the segment's buckets
    <path>/manifests/<version>.json                the snapshot: its segments, and the buckets that each has

A write makes a segment and its filters under a new name, then publishes a manifest
with the next number. Publishing is one exclusive step: if another writer took the
number, the manifest is made again on top of that writer's. Nothing that a manifest
names is ever changed, so a reader, or a job that runs over a lost executor again,
sees one snapshot, and a writer that dies at any step leaves the last one standing;
vacuum() clears what it left behind.

A read by keys tests them against the filters of their buckets first, and only
(segment, bucket) folders with a possible hit are given to the scan; the exact
join with the keys follows. Filters have no false negatives.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
#: Keys of a filter at most, bits for each, and hashes; keys times segments up to which a read tests filters.
FILTER_KEYS, FILTER_BITS, FILTER_HASHES, MOST_TESTED = 1 << 20, 12, 8, 10_000_000


class Conflict(Exception):
    """Another writer took rows away that this one wanted to replace."""


@dataclass(frozen=True)
class Segment:
    name: str
    rows: int
    parts: int
    buckets: tuple[str, ...]


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    segments: tuple[Segment, ...] = field(default=())


class Folder:
    """The few file operations that snapshots need, on any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        at = self.hadoop.Path(self.path)
        self.files = at.getFileSystem(self.conf)
        whole = self.files.makeQualified(at).toUri()
        self.local = whole.getPath() if whole.getScheme() == "file" else None

    def _at(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}")

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(f.getPath().getName() for f in self.files.listStatus(at)) if self.files.exists(at) else []

    def modified(self, name: str) -> float:
        return self.files.getFileStatus(self._at(name)).getModificationTime() / 1000

    def read(self, name: str) -> str:
        stream = self.files.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        if self.local is not None:
            os.makedirs(os.path.dirname(f"{self.local}/{name}"), exist_ok=True)
            with open(f"{self.local}/{name}", "w", encoding="utf-8") as f:
                f.write(text)
            return
        stream = self.files.create(self._at(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, made: str, name: str) -> bool:
        """Give ``made`` its final name in one step; False where something has that name already."""
        if self.local is not None:
            try:
                os.link(f"{self.local}/{made}", f"{self.local}/{name}")
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{self.local}/{made}")
            return True
        return self.renamed(made, name)

    def renamed(self, made: str, name: str) -> bool:
        """publish() by the store's own rename, which does not overwrite."""
        store = self.hadoop.FileContext.getFileContext(self._at(name).toUri(), self.conf)
        kind = self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        none = self.spark._jvm.java.lang.reflect.Array.newInstance(kind, 0)
        try:
            store.rename(self.files.makeQualified(self._at(made)), self.files.makeQualified(self._at(name)), none)
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            self.delete(made)
            return False
        return True

    def delete(self, name: str) -> bool:
        """False where there was nothing of that name."""
        return bool(self.files.delete(self._at(name), True))


def bucket_of(key: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(key), F.lit(BUCKETS)))), 2, "0")


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit("one"), key).alias("h1"), F.xxhash64(F.lit("two"), key).alias("h2")]


def _part(parts: Column) -> Column:
    """The filter of a bucket that a key is in."""
    return F.pmod(F.col("h1"), parts).cast("int")


def _places(t: pa.Table, bits: int) -> Iterator[np.ndarray]:
    h1, h2 = (t[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
    for i in range(FILTER_HASHES):
        yield (h1 + np.uint64(i) * (h2 | np.uint64(1))) % np.uint64(bits)


def _filter(t: pa.Table) -> pa.Table:
    bits = -(-max(len(t) * FILTER_BITS, 64) // 64) * 64
    on = np.zeros(bits, bool)
    for at in _places(t, bits):
        on[at] = True
    return pa.table({"bucket": t["bucket"][:1], "part": t["part"][:1], "bits": pa.array([np.packbits(on).tobytes()], pa.binary())})


def _possible(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """The segment and bucket of a group, where any of its keys may be in its filter."""
    if not len(keys) or not len(filters):
        return keys.select(["segment", "bucket"])[:0]
    raw = np.frombuffer(filters["bits"][0].as_py(), np.uint8)
    hit = np.ones(len(keys), bool)
    for at in _places(keys, 8 * len(raw)):
        hit &= (raw[at >> np.uint64(3)] >> (7 - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    return keys.select(["segment", "bucket"])[: int(hit.any())]


class VersionedTable:
    """Rows of ``schema`` with a ``key`` column, and a column ``version`` that grows with every write."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema, self.folder = f"{schema}, version long", Folder(spark, path)

    def versions(self) -> list[int]:
        """Published snapshots that are still there, oldest first."""
        return [int(n.removesuffix(".json")) for n in self.folder.names("manifests") if n.endswith(".json") and n[0].isdigit()]

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A published snapshot, by default the last one; an empty one where nothing was written yet."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Snapshot()
        made = json.loads(self.folder.read(f"manifests/{version:020d}.json"))
        return Snapshot(version, tuple(Segment(s["name"], s["rows"], s["parts"], tuple(s["buckets"])) for s in made["segments"]))

    def _publish(self, at: Snapshot) -> bool:
        made = f"manifests/.{uuid.uuid4().hex}"
        segments = [{"name": s.name, "rows": s.rows, "parts": s.parts, "buckets": list(s.buckets)} for s in at.segments]
        self.folder.write(made, json.dumps({"version": at.version, "segments": segments}))
        return self.folder.publish(made, f"manifests/{at.version:020d}.json")

    def _segment(self, rows: DataFrame) -> Segment | None:
        """Write rows (with their version) and filters under a new name; None where there are no rows."""
        name = uuid.uuid4().hex
        data, filters = f"{self.path}/segments/{name}", f"{self.path}/filters/{name}"
        # A rebalance splits a bucket that is too much for one file and puts small ones into one task.
        rows.withColumn("bucket", bucket_of(F.col(self.key))).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(data)
        buckets = tuple(n.removeprefix("bucket=") for n in self.folder.names(f"segments/{name}") if n.startswith("bucket="))
        if not buckets:
            self.folder.delete(f"segments/{name}")
            return None
        keys = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(data).select(self.key)
        n = keys.count()
        parts = -(-n // (BUCKETS * FILTER_KEYS))
        dealt = keys.select(bucket_of(F.col(self.key)).alias("bucket"), *_hashes(F.col(self.key))).withColumn("part", _part(F.lit(parts)))
        dealt.groupBy("bucket", "part").applyInArrow(_filter, "bucket string, part int, bits binary").write.parquet(filters)
        return Segment(name, n, parts, buckets)

    def append(self, rows: DataFrame) -> Snapshot:
        """Add rows, whose key is not null; returns the snapshot that has them."""
        segment = self._segment(rows.withColumn("version", F.lit(self.snapshot().version + 1).cast("long")))
        while True:
            base = self.snapshot()
            if segment is None:
                return base
            made = Snapshot(base.version + 1, (*base.segments, segment))
            if self._publish(made):
                return made

    def replace(self, rows: DataFrame | None, base: Snapshot) -> Snapshot:
        """Put ``rows`` (with their versions; None: none) in the place of the segments of ``base``; what was appended since stays.

        Where any of those segments is gone by now, it is a Conflict and nothing happens.
        """
        segment = None if rows is None else self._segment(rows)
        while True:
            now = self.snapshot()
            if not {*base.segments} <= {*now.segments}:
                raise Conflict(f"version {now.version} replaced segments of version {base.version}")
            kept = tuple(s for s in now.segments if s not in base.segments)
            made = Snapshot(now.version + 1, (*([segment] if segment else []), *kept))
            if self._publish(made):
                return made

    def rows(self, at: Snapshot, keys: DataFrame | None = None) -> DataFrame:
        """Rows of a snapshot; with ``keys`` (a column of the table's key, no nulls, distinct) only theirs, from folders with a possible hit only."""
        found = [f"{self.path}/segments/{s.name}" for s in at.segments]
        if keys is not None:
            found = self._with_hits(at, keys)
        if not found:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*found)
        return rows if keys is None else rows.join(keys.select(self.key), self.key, "left_semi")

    def _with_hits(self, at: Snapshot, keys: DataFrame) -> list[str]:
        whole = [f"{self.path}/segments/{s.name}" for s in at.segments]
        if not at.segments or keys.limit(MOST_TESTED // len(at.segments) + 1).count() * len(at.segments) > MOST_TESTED:
            return whole
        parts = F.create_map(*(F.lit(x) for s in at.segments for x in (s.name, s.parts)))
        asked = keys.select(bucket_of(F.col(self.key)).alias("bucket"), *_hashes(F.col(self.key)), F.explode(F.array(*(F.lit(s.name) for s in at.segments))).alias("segment"))
        asked = asked.withColumn("part", _part(parts[F.col("segment")]))
        read = self.spark.read.schema("bucket string, part int, bits binary").parquet(*(f"{self.path}/filters/{s.name}" for s in at.segments))
        filters = read.withColumn("segment", F.regexp_extract(F.col("_metadata.file_path"), r"/filters/([^/]+)/", 1))
        group = ["segment", "bucket", "part"]
        hits = asked.groupBy(*group).cogroup(filters.groupBy(*group)).applyInArrow(_possible, "segment string, bucket string").distinct().collect()
        return [f"{self.path}/segments/{r['segment']}/bucket={r['bucket']}" for r in hits]

    def vacuum(self, keep: int = 1, older_than: float = 3600.0) -> list[str]:
        """Delete manifests but the last ``keep``, and what none of those names and is older than so many seconds; returns what went.

        The age guards segments of writers that have not published yet and readers of older snapshots.
        """
        last = self.versions()[-max(keep, 1) :]
        needed = {s.name for v in last for s in self.snapshot(v).segments}
        old = [f"manifests/{v:020d}.json" for v in self.versions() if v not in last] + [f"manifests/{n}" for n in self.folder.names("manifests") if n.startswith(".") and not n.endswith(".crc")]
        # Manifests go first: a snapshot is never named without its segments.
        gone = [n for n in old if time.time() - self.folder.modified(n) >= older_than]
        for n in gone:
            self.folder.delete(n)
        named = needed | {s.name for v in self.versions() for s in self.snapshot(v).segments}
        for n in (f"{kind}/{n}" for kind in ("segments", "filters") for n in self.folder.names(kind) if n not in named):
            if time.time() - self.folder.modified(n) >= older_than:
                self.folder.delete(n)
                gone.append(n)
        return gone
