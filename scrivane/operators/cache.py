"""Result cache, partial results and their joins, over tables instead of files."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.operators.snapshots import Conflict, VersionedTable

#: Lookup order of tiers: the object store before local files.
TIERS = ("s3", "file")


def hits_and_misses(work: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """Work with its cached value, and work without one. An entry that is no JSON or is empty counts as missing.

    Of several entries of a key the last one counts (by ``updated_at`` where there is one, then by value).
    """
    when = [F.col("updated_at")] if "updated_at" in cache.columns else []
    good = cache.where(F.try_parse_json("value").isNotNull() & ~F.col("value").isin("", "{}", "[]", "null")).groupBy(key).agg(F.max_by("value", F.struct(*when, "value")).alias("value"))
    return work.join(good, key), work.join(good, key, "left_anti")


def lookup(requests: DataFrame, cache: DataFrame, *, request: str = "request_id", keys: str = "keys", bypass: str | None = None) -> DataFrame:
    """Tiered lookup with fallback keys.

    ``requests``: request id and an array of keys, primary first. ``cache``:
    cache_key, tier (of TIERS), value. The first key with an entry wins, and for
    a key the object store wins over files. Returns (request, value, key, tier),
    null without a hit; where ``bypass`` is true nothing is looked up.
    """
    asked = requests.select(request, F.posexplode(keys).alias("_p", "cache_key"), *([bypass] if bypass else []))
    if bypass:
        asked = asked.where(~F.coalesce(F.col(bypass), F.lit(False)))
    tier = reduce(lambda c, t: c.when(F.col("tier") == t[1], t[0]), enumerate(TIERS), F.when(F.lit(False), 0)).otherwise(len(TIERS))
    found = asked.join(cache.where(F.length("value") > 0), "cache_key").withColumn("_rank", F.col("_p") * 10 + tier)
    best = found.groupBy(request).agg(F.min_by(F.struct("value", "cache_key", "tier"), "_rank").alias("_b"))
    return requests.select(request).join(best, request, "left").select(request, F.col("_b.value").alias("value"), F.col("_b.cache_key").alias("hit_key"), F.col("_b.tier").alias("hit_tier"))


def backfill(found: DataFrame, cache: DataFrame) -> DataFrame:
    """Entries that the file tier lacks although the object store answered."""
    return found.where("hit_tier = 's3'").select(F.col("hit_key").alias("cache_key"), F.lit("file").alias("tier"), "value").distinct().join(cache.where("tier = 'file'").select("cache_key"), "cache_key", "left_anti")


def upsert(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; one aggregation, no window."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *(F.col("_r")[c].alias(c) for c in rest))


def resume(pages: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """Pages still to be processed; saved rows of the same keys are left out."""
    return pages.join(saved.select(*keys).distinct(), keys, "left_anti")


def with_saved(new: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """New and saved rows together; a key comes once, the new row first."""
    return new.unionByName(saved.join(new.select(*keys).distinct(), keys, "left_anti"))


def partial_json(pages: DataFrame, key: str = "cache_key") -> DataFrame:
    """Partial results as one JSON object by page number for each key."""
    entry = F.struct(F.col("page_number").cast("string"), F.struct("page_number", "page_content", "page_hash"))
    return pages.groupBy(key).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))


def from_partial_json(stored: DataFrame, key: str = "cache_key") -> DataFrame:
    """Pages of stored partial results; an entry that is no JSON has none."""
    page = "struct<page_number:int,page_content:string,page_hash:string>"
    return stored.select(key, F.explode(F.from_json("value", f"map<string,{page}>")).alias("_n", "_p")).select(key, F.col("_n").cast("int").alias("page_number"), "_p.page_content", "_p.page_hash")


def images_complete(images: DataFrame, expected: DataFrame, key: str = "file_hash") -> DataFrame:
    """Whether a file has at least the expected number of stored page images."""
    counts = images.where(F.lower("name").endswith(".png")).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return expected.join(counts, key, "left").select(key, (F.coalesce("_n", F.lit(0)) >= F.col("expected")).alias("complete"))


class CacheTable:
    """A cache as a versioned table of cache_key, tier, value and updated_at; later entries of a key and tier win.

    Every write publishes a snapshot in one step (see VersionedTable), so a job that
    dies while it writes or compacts leaves the cache as it was.
    """

    SCHEMA = "cache_key string, tier string, value string, updated_at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.table = spark, path, VersionedTable(spark, path, self.SCHEMA, "cache_key")

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        return upsert(rows, ["cache_key", "tier"], ["version", "updated_at", "value"])

    def read(self, keys: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """Entries by key and tier of the last snapshot or of ``version``; with ``keys`` only theirs, and folders that cannot hold any are not opened. Removed entries (null values) are left out."""
        wanted = None if keys is None else keys.where("cache_key is not null").select("cache_key").distinct()
        rows = self.table.rows(self.table.snapshot(version), wanted)
        return self._last(rows).where("value is not null").select("cache_key", "tier", "value", "updated_at")

    def write(self, entries: DataFrame, tier: str = "file") -> None:
        """Append entries (cache_key, value); null keys are skipped."""
        self.table.append(entries.where("cache_key is not null").select("cache_key", F.lit(tier).alias("tier"), "value", F.current_timestamp().alias("updated_at")))

    def invalidate(self, keys: DataFrame, tier: str = "file") -> None:
        self.write(keys.select("cache_key").distinct().withColumn("value", F.lit(None).cast("string")), tier)

    def clear(self) -> None:
        """Publish a snapshot without entries; older ones stay readable until vacuum()."""
        while (now := self.table.snapshot()).segments:
            try:
                self.table.replace(None, now)
            except Conflict:
                continue

    def compact(self) -> None:
        """Put one segment with the last entry of each key and tier in the place of all; entries written meanwhile stay. Where the entries were cleared or compacted meanwhile, nothing is done."""
        base = self.table.snapshot()
        if base.segments:
            last = self._last(self.table.rows(base)).where("value is not null")
            try:
                self.table.replace(last.select("cache_key", "tier", "value", "updated_at", "version"), base)
            except Conflict:
                return

    def vacuum(self, keep: int = 1, older_than: float = 3600.0) -> list[str]:
        return self.table.vacuum(keep, older_than)


class TieredCache:
    """Two tables in a row: the object store's (may be missing) and the files'."""

    def __init__(self, files: CacheTable, store: CacheTable | None = None):
        self.tiers = [(t, table) for t, table in (("s3", store), ("file", files)) if table is not None]

    def get(self, requests: DataFrame, *, request: str = "request_id", keys: str = "keys", bypass: str | None = None) -> DataFrame:
        """As lookup() over both tables; what only the object store had is written to the files."""
        asked = requests.select(F.explode(keys).alias("cache_key")).distinct()
        held = reduce(DataFrame.unionByName, (table.read(asked).select("cache_key", F.lit(t).alias("tier"), "value") for t, table in self.tiers))
        found = lookup(requests, held, request=request, keys=keys, bypass=bypass)
        if len(self.tiers) > 1:
            self.tiers[-1][1].write(backfill(found, held).select("cache_key", "value"))
        return found

    def set(self, entries: DataFrame) -> None:
        """Store entries (cache_key, value) in the files first, then in the object store."""
        for t, table in reversed(self.tiers):
            table.write(entries, t)

    def invalidate(self, keys: DataFrame) -> None:
        for t, table in reversed(self.tiers):
            table.invalidate(keys, t)

    def clear(self) -> None:
        for _, table in reversed(self.tiers):
            table.clear()


def get_or_compute(work: DataFrame, cache: CacheTable, compute: Callable[[DataFrame], DataFrame], *, bypass: bool = False) -> DataFrame:
    """``work`` (with a cache_key) and the ``value`` of each row's key: the stored one, else what ``compute`` makes.

    ``compute`` gets the rows without an entry (all, with ``bypass``) and returns
    cache_key and value. Its values are stored before anything reads them, so each
    is made once; a null value is a failure, which is not stored and stays null.
    Rows without a key are not computed.
    """
    keyed = work.where("cache_key is not null")
    one = keyed.dropDuplicates(["cache_key"])
    misses = one if bypass else one.join(cache.read(keyed).select("cache_key"), "cache_key", "left_anti")
    cache.write(compute(misses).where("value is not null").select("cache_key", "value"))
    return work.join(cache.read(keyed).select("cache_key", "value"), "cache_key", "left")
