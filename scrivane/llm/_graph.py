"""Connected components over link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm._kit import dropped, saved

#: Parts that the members of a class are dealt to where they meet a row of their class.
SALTS = 16


def with_class(members: DataFrame, per_class: DataFrame, node: str = "node", comp: str = "comp") -> DataFrame:
    """``members`` left-joined with ``per_class`` (a row for each ``comp``); the members of one class are spread over SALTS parts."""
    salted = members.withColumn("_salt", F.pmod(F.xxhash64(node), F.lit(SALTS)).cast("int"))
    copies = per_class.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [comp, "_salt"], "left").drop("_salt")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every node of a link: comp is the smallest node that links reach.

    Smallest labels travel over links and are then followed once (pointer
    jumping), so rounds grow with the logarithm of a chain's length. Each round
    is cut at a checkpoint; counts alone reach the driver. A node's many links
    meet its label in a plain join, whose skewed keys Spark can split; the many
    members of a class meet the class's label in salted parts, and only labels
    that changed are copied to them.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a)))
    both = saved(both.where("u <> v").distinct())
    labels = saved(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("comp")))
    checkpoint = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("comp").alias("c")), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("c"))
        low = saved(labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "c").alias("comp")))
        moved = low.select("comp").distinct().join(low.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp").where("to <> comp")
        after = saved(with_class(low, moved).select("node", "was", F.coalesce("to", "comp").alias("comp")))
        dropped(checkpoint, low)
        checkpoint, labels = after, after.select("node", "comp")
        if after.where("comp <> was").isEmpty():
            dropped(both)
            return labels


def lowest_of_class(labels: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """(node, low): for each node of ``labels`` the smallest ``value`` of its class; ``values`` has one row for each node."""
    known = labels.join(values.select("node", value), "node")
    low = known.groupBy("comp").agg(F.min(value).alias("low"))
    return with_class(known.select("node", "comp"), low).select("node", "comp", "low")
