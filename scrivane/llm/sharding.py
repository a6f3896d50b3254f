"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are ranked in a seeded shuffle within each source, all rows are put in
order of their fractional rank ``(rank + 1/2) / rows of the source``, and that
order is cut into shards of equal counts, so each shard holds every source in
the proportion of the whole table. The law is ``rows``: shard counts differ by
one at most.

Neither ranking sorts a source or the table in one task. Both count rows in
narrow buckets of the order, take running sums over the bucket counts, and
number rows inside a bucket only: a bucket of the shuffle is a range of the
hash, a bucket of the interleaving a range of the fraction, so both are even
whatever the sources' shares.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivane.llm._kit import saved, table

#: Rows a bucket holds on average.
BUCKET_ROWS = 4096
#: Sources up to which their counts are broadcast, and parts of each source in a join beyond.
MOST_BROADCAST, SALTS = 100_000, 64


def _running(counts: DataFrame, part: list[str], bucket: str) -> DataFrame:
    """Rows before each bucket, from a table of bucket counts.

    Two levels, so that no task holds the buckets of a whole source: groups of
    1024 neighbouring buckets, then the groups.
    """
    wide = counts.withColumn("_g", F.floor(F.col(bucket) / 1024))
    inner = Window.partitionBy(*part, "_g").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    groups = wide.groupBy(*part, "_g").agg(F.sum("_c").alias("_gc"))
    outer = Window.partitionBy(*(part or [F.lit(0)])).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_gb", F.coalesce(F.sum("_gc").over(outer), F.lit(0))).drop("_gc")
    return wide.withColumn("_ib", F.coalesce(F.sum("_c").over(inner), F.lit(0))).join(groups, [*part, "_g"]).withColumn("_before", F.col("_gb") + F.col("_ib")).drop("_g", "_gb", "_ib", "_c")


def interleave_shards(docs: DataFrame, n_shards: int, *, id_col: str = "doc_id", source_col: str = "source", seed: int = 17, law: str = "rows") -> DataFrame:
    """Give every row of ``docs`` a shard from 0 to n_shards - 1 and a slot in it.

    Returns the rows with ``law`` ('rows'), ``shard`` int, ``slot`` long (gapless
    from 0 in each shard) and ``grown_shard`` int (null under this law). Input
    columns with one of these names are replaced. A null source is a source of
    its own; null or repeated ids are allowed: rows with equal ids are ordered by
    a hash of their other columns, and rows equal in everything are
    interchangeable. An empty table gives an empty result. Fewer rows than
    shards leave some shards empty. Texts are only carried along; project them
    away first where they are not needed.
    """
    if law != "rows":
        raise ValueError("this interleaving keeps the law 'rows'")
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    base = docs.drop("law", "shard", "slot", "grown_shard")
    order = F.xxhash64(F.lit(seed), F.col(id_col), *(F.col(c) for c in base.columns if c not in (id_col, source_col)))
    # The row travels as one column, so its names meet none of those below.
    rows = base.select(F.struct(*base.columns).alias("_doc"), F.col(id_col).alias("_id"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("_s"), order.alias("_h"))
    # Counts decide the buckets, so hot sources get more of them.
    sizes = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    total = docs.count()
    # A shuffle by source would put a hot source in one task, so few sources are broadcast and many are salted.
    if sizes.count() <= MOST_BROADCAST:
        rows = rows.join(F.broadcast(sizes), "_s")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        rows = rows.withColumn("_salt", F.pmod("_h", F.lit(SALTS)).cast("int")).join(sizes.withColumn("_salt", salts), ["_s", "_salt"]).drop("_salt")
    # A bucket is a range of the top 32 bits of the hash.
    top = F.shiftrightunsigned(F.col("_h"), 32)
    rows = rows.withColumn("_b", F.floor(top * F.ceil(F.col("_n") / BUCKET_ROWS) / F.lit(1 << 32)))
    counts = rows.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_c"))
    inside = Window.partitionBy("_s", "_b").orderBy(F.shiftrightunsigned(F.col("_h"), 32), "_h", "_id")
    ranked = rows.withColumn("_r", F.row_number().over(inside)).join(_running(counts, ["_s"], "_b"), ["_s", "_b"])
    # Equal fractions of different sources go by source; within a source no two are equal.
    ranked = ranked.withColumn("_f", (F.col("_before") + F.col("_r") - F.lit(0.5)) / F.col("_n")).drop("_before", "_r", "_b", "_n", "_h")
    n_buckets = max(1, math.ceil(total / BUCKET_ROWS))
    ranked = ranked.withColumn("_b", F.floor(F.col("_f") * n_buckets))
    counts = ranked.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    inside = Window.partitionBy("_b").orderBy("_f", "_s")
    placed = ranked.withColumn("_r", F.row_number().over(inside)).join(_running(counts, [], "_b"), "_b")
    pos = (F.col("_before") + F.col("_r") - F.lit(1)).cast("long")
    placed = placed.withColumn("_p", pos)
    shard = F.expr(f"(_p * {n_shards}L) div {max(total, 1)}L")
    placed = placed.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(cast(shard as long) * {total}L + {n_shards - 1}L) div {n_shards}L")
    return placed.select(*(F.col("_doc")[c].alias(c) for c in base.columns), F.lit("rows").alias("law"), "shard", (F.col("_p") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write a result of interleave_shards as one folder a shard, rows in slot order."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_interleaved_shards(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = interleave_shards(saved(rows), 24)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
