"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark removes a plan's shuffle files after an action if this was set when its DataFrame was made.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _releasing(spark: SparkSession) -> Iterator[None]:
    """Sets _CLEANUP for a while; the setting of the session stays as it is."""
    was = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, was)


def released(df: DataFrame) -> DataFrame:
    """``df`` so that its own shuffle files go as soon as an action on it ends."""
    with _releasing(df.sparkSession):
        return df.select("*")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, made from its ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, a laptop) gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir", "")
        if not where:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="scrivane-")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the cluster's shared checkpoint folder, and let go of the shuffle files behind it."""
    shared_folder(df.sparkSession)
    return released(df).checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    with _releasing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete the checkpoints of ``frames``, results of saved() that nothing reads any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        at = df._jdf.logicalPlan().rdd().getCheckpointFile()
        if at.isDefined():
            path = sc._jvm.org.apache.hadoop.fs.Path(at.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch between Spark and its Python workers, by default and in the pipeline.
_BATCH, DEFAULT_BATCH, LEAN_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 8 << 20


def lean_batches(spark: SparkSession) -> None:
    """Let batches of long texts stay small in this session, unless it has a size of its own: a worker holds some batches at once, and so does the JVM."""
    if spark.conf.get(_BATCH).rstrip("b") == str(DEFAULT_BATCH):
        spark.conf.set(_BATCH, str(LEAN_BATCH))


def spread(df: DataFrame) -> int:
    """Number of shuffle partitions of the session, as an int."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(id_col: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod`` (null ids count as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def gathered(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> pa.Table:
    """A task's batches as one table, whether Spark calls their columns nullable or not."""
    held = list(batches)
    return pa.Table.from_batches(held) if held else schema.empty_table()


#: Bytes of a text up to which it is learned from, and of a class's texts that one fit gets, about.
LONGEST_FITTED, FITTED_BYTES = 4 << 20, 64 << 20


def bounded_rows(rows: DataFrame, group: str, id_col: str, text_col: str, most: int | dict[int, int], most_bytes: int = FITTED_BYTES, longest: int = LONGEST_FITTED) -> DataFrame:
    """``rows`` of picked ids so that one task can hold them, with ``_f``, how many rows each stands for.

    Rows that repeat an id and a text count once, and texts above ``longest`` bytes
    are left out. Of what is left, each value of ``group`` keeps its rows where they
    are a quarter more than ``most`` at most and have ``most_bytes`` at most, else as
    many by a hash of id and text, so an id that repeats with many texts is thinned
    and not gathered. Sizes are counted in a pass of their own, by hashes and lengths;
    only kept texts are shuffled.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    marked = rows.withColumns({"_h": F.xxhash64(F.lit("row"), id_col, text_col), "_b": size}).where(F.col("_b") <= longest)
    sizes = marked.select(group, id_col, "_h", "_b").distinct().groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"), F.sum("_b").alias("_s"))
    limit = F.lit(most) if isinstance(most, int) else F.create_map(*(F.lit(x) for pair in most.items() for x in pair))[F.col("_g")]
    chance = F.least(F.lit(1.0), (limit * 1.25 + 50) / F.col("_n"), F.lit(float(most_bytes)) / F.greatest(F.col("_s"), F.lit(1)))
    chances = sizes.select("_g", chance.alias("_c"))
    drawn = F.pmod(F.xxhash64(F.lit("bounded"), "_h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    kept = marked.join(F.broadcast(chances), F.col(group).eqNullSafe(F.col("_g"))).where(drawn < F.col("_c"))
    return kept.dropDuplicates([group, id_col, "_h"]).select(*rows.columns, (1 / F.col("_c")).alias("_f"))


def thinned(ids: DataFrame, group: str, id_col: str, most: int) -> DataFrame:
    """Keep about ``most`` rows of each value of ``group``, chosen by a hash of the id.

    Every row has the same chance within its group and reruns agree. Groups of
    fewer rows stay whole. Group counts are the only thing gathered first.
    """
    counts = ids.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    chance = F.least(F.lit(1.0), F.lit(float(most)) / F.col("_n"))
    draw = F.pmod(F.xxhash64(F.lit("thinned"), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return ids.join(counts, F.col(group).eqNullSafe(F.col("_g"))).where(draw < chance).select(*ids.columns)
