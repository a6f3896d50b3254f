"""Mixing sources to target weights.

Targets. Sources in order of their code points, null last, weigh 1, 2, 3,
repeating, and share the words of the whole table; a target stops at CAP times
its source's size and the excess is shared again by weight.

Blocks. The words of a source, its documents in a fixed order, are packed into
blocks of BLOCK words. A source's target is a number of slots, each taking one
block (the last one takes what is still missing).

Shards. Slots are dealt to output shards by multinomial draws: the shards are
halved again and again, and a half draws its counts by source with probabilities
in proportion to the slots that remain, never beyond them, so every shard
resembles the mixture and the totals are the targets. A draw's seed is its place
in the halving, so a task draws for its own shards only. A slot's number within its source is mapped through the
source's pseudorandom permutation of block numbers (a Feistel network with cycle
walking), once through all blocks before any comes again, and blocks are joined
to slots by number.

Scale. Word counts, block numbers and the join are distributed; running sums are
taken in two levels, so a hot source is spread; slots are drawn and permuted by
tasks of TASK_SHARDS shards. Only one row for each source reaches the driver
(more than MOST_SOURCES are an error).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivane.llm._kit import saved, table

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 256
CAP = 3
#: Slots of a shard, about, and shards whose slots one task draws.
SHARD_SLOTS, TASK_SHARDS = 4096, 16
MOST_SOURCES = 100_000
#: Documents whose running sums are taken in one task, about.
BUCKET_ROWS = 4096


def weights_of(n: int) -> list[int]:
    return [1 + i % 3 for i in range(n)]


def fill_targets(sizes: list[int], cap: float = CAP) -> list[float]:
    """Targets of sources in order: shares of the total by weight, at most cap times each size."""
    weight, total = weights_of(len(sizes)), float(sum(sizes))
    target, full = [0.0] * len(sizes), [False] * len(sizes)
    while total:
        rest = total - sum(cap * s for s, f in zip(sizes, full, strict=True) if f)
        share = sum(w for w, f in zip(weight, full, strict=True) if not f)
        target = [cap * s if f else rest * w / share for s, w, f in zip(sizes, weight, full, strict=True)]
        over = [i for i, (t, s) in enumerate(zip(target, sizes, strict=True)) if not full[i] and t > cap * s]
        if not over:
            break
        for i in over:
            full[i] = True
    return target


def _round_keys(source: str | None, epoch: int, seed: int) -> np.ndarray:
    d = hashlib.blake2b(f"{seed}/{epoch}/{'' if source is None else '=' + source}".encode(), digest_size=32).digest()
    return np.frombuffer(d, "<u8").astype(np.uint64)


def permuted(i: np.ndarray, n: int, keys: np.ndarray, back: bool = False) -> np.ndarray:
    """A permutation of range(n) by a four-round Feistel network with cycle walking; ``back`` inverts it."""
    half = np.uint64(max(1, math.ceil(math.log2(max(n, 2)) / 2)))
    mask = np.uint64((1 << int(half)) - 1)
    x = i.astype(np.uint64).copy()
    todo = np.ones(len(x), bool)
    rounds = keys[::-1] if back else keys
    while todo.any():
        left, right = x[todo] >> half, x[todo] & mask
        for k in rounds:
            at = left if back else right
            f = (at ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = ((f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
            left, right = (right ^ (f & mask), left) if back else (right, left ^ (f & mask))
        x[todo] = left << half | right
        todo = x >= n
    return x.astype(np.int64)


def _plan(sources: list[tuple[str | None, int]], block: int, cap: float, seed: int) -> list[dict]:
    """For each source: target, blocks, slots, and the words of its last slot."""
    out = []
    for (source, size), target in zip(sources, fill_targets([s for _, s in sources], cap), strict=True):
        want = min(int(round(target)), int(cap * size))
        blocks = -(-size // block)
        epoch, rest = divmod(want, size) if size else (0, 0)
        slots, last = epoch * blocks, block
        if rest:
            # The short last block of the source comes at this place of the epoch.
            tail = size - (blocks - 1) * block
            place = int(permuted(np.array([blocks - 1]), blocks, _round_keys(source, epoch, seed), back=True)[0])
            n = -(-rest // block)
            words = lambda m: m * block - (block - tail if place < m else 0)
            n += words(n) < rest
            slots, last = slots + n, rest - words(n - 1)
        out.append({"source": source, "size": size, "target": target, "blocks": blocks, "slots": slots, "last": last})
    return out


def shards_for(slots: list[int], shard_slots: int | None = None) -> int:
    return max(1, -(-sum(slots) // (shard_slots or SHARD_SLOTS)))


def draw_counts(slots: list[int], shards: int, from_: int, to: int, seed: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For the shards from ``from_`` up to ``to``: the shard, and of each source its first slot and number of slots there."""

    def walk(a: int, b: int, left: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if b - a == 1:
            yield a, first, left
            return
        mid, rng = (a + b) // 2, np.random.default_rng([seed, a, b])
        need, got, rest = int(left.sum()) * (mid - a) // (b - a), np.zeros_like(left), left.copy()
        while need:
            more = np.minimum(rng.multinomial(need, rest / rest.sum()), rest)
            got, rest, need = got + more, rest - more, need - int(more.sum())
        if from_ < mid:
            yield from walk(a, mid, got, first)
        if to > mid:
            yield from walk(mid, b, rest, first + got)

    yield from walk(0, shards, np.array(slots, np.int64), np.zeros(len(slots), np.int64))


def _slots(spark, plan: list[dict], block: int, seed: int) -> DataFrame:
    """shard, _s, slot, _block and room (words that it takes of the block) of every slot."""
    names = ["" if p["source"] is None else "=" + p["source"] for p in plan]
    slots = [p["slots"] for p in plan]
    shards = shards_for(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            for shard, first, n in draw_counts(slots, shards, int(ids[0]), int(ids[-1]) + 1, seed):
                for i in np.flatnonzero(n).tolist():
                    p = plan[i]
                    for lo in range(int(first[i]), int(first[i] + n[i]), 65536):
                        slot = np.arange(lo, min(lo + 65536, int(first[i] + n[i])))
                        at = np.zeros(len(slot), np.int64)
                        for epoch in range(int(slot[0]) // p["blocks"], int(slot[-1]) // p["blocks"] + 1):
                            mine = slot // p["blocks"] == epoch
                            at[mine] = permuted(slot[mine] % p["blocks"], p["blocks"], _round_keys(p["source"], epoch, seed))
                        room = np.where(slot == p["slots"] - 1, p["last"], block)
                        yield pa.record_batch([pa.array(np.full(len(slot), shard, np.int64)), pa.array([names[i]] * len(slot), pa.string()), *map(pa.array, (slot, at, room))], names=["shard", "_s", "slot", "_block", "room"])

    return spark.range(0, shards if plan else 0, 1, max(1, -(-shards // TASK_SHARDS))).mapInArrow(run, "shard long, _s string, slot long, _block long, room long")


def _pieces(docs: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their first word's place in their source, and sizes by source.

    ``docs`` has _row (unique), _s (source, never null), size and _h (order).
    """
    sizes = saved(docs.groupBy("_s").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n")))
    if sizes.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    top = F.shiftrightunsigned("_h", 32)
    rows = docs.join(F.broadcast(sizes), "_s").withColumn("_b", F.floor(top * F.ceil(F.col("_n") / BUCKET_ROWS) / F.lit(1 << 32)))
    sums = rows.groupBy("_s", "_b").agg(F.sum("size").alias("_w")).withColumn("_g", F.floor(F.col("_b") / 1024))
    before = Window.unboundedPreceding, -1
    inner = sums.withColumn("_ib", F.coalesce(F.sum("_w").over(Window.partitionBy("_s", "_g").orderBy("_b").rowsBetween(*before)), F.lit(0)))
    groups = sums.groupBy("_s", "_g").agg(F.sum("_w").alias("_gw"))
    groups = groups.withColumn("_gb", F.coalesce(F.sum("_gw").over(Window.partitionBy("_s").orderBy("_g").rowsBetween(*before)), F.lit(0))).select("_s", "_g", "_gb")
    starts = inner.join(groups, ["_s", "_g"]).select("_s", "_b", (F.col("_gb") + F.col("_ib")).alias("_base"))
    own = Window.partitionBy("_s", "_b").orderBy(top, "_h", "_row").rowsBetween(*before)
    placed = rows.withColumn("_in", F.coalesce(F.sum("size").over(own), F.lit(0))).join(starts, ["_s", "_b"])
    return placed.select("_row", "_s", "size", (F.col("_base") + F.col("_in")).alias("_at")), sizes


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, cap: float = CAP, seed: int = 5, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Mix all documents to the target weights.

    Returns two tables. ``taken``: one row for each document with the id, size
    (words; null text 0), source_size, target (both of its source), taken (words
    the mix takes, repeats counted), the columns of ``carry`` and ``_row``.
    ``runs``: what the mix takes, one row for each run of a document's words in a
    slot, with _row, shard, source, slot, from_word and words (both of the
    document). A null source is a source of its own, last in order. Documents
    without words take part with nothing. Rows that repeat an id are documents of
    their own. Other columns are not read. An empty table gives empty results.
    """
    spark = docs.sparkSession
    source = F.col(source_col).cast("string")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    thin = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("_s"), size.alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_h"), *carry)
    thin = saved(thin.withColumn("_row", F.monotonically_increasing_id()))
    placed, sizes = _pieces(thin.select("_row", "_s", "size", "_h"), block)
    placed = saved(placed)
    by = {r["_s"]: r["source_size"] for r in sizes.collect()}
    known = [(s[1:], by[s]) for s in sorted(by) if s] + ([(None, by[""])] if "" in by else [])
    plan = _plan(known, block, cap, seed)
    slots = _slots(spark, plan, block, seed)
    # Slots grow with the table although the plan sees the small table that they come from, so they must not be broadcast.
    # A document lies in the blocks from its first word's to its last word's.
    end = F.col("_at") + F.col("size")
    spans = placed.where("size > 0").select("_row", "_s", "_at", "size", F.explode(F.sequence(F.floor(F.col("_at") / block), F.floor((end - 1) / block))).alias("_block"))
    begin = F.greatest(F.col("_at"), F.col("_block") * block)
    joined = spans.withColumn("_begin", begin).join(slots.hint("merge"), ["_s", "_block"])
    stop = F.least(end, F.col("_block") * block + F.col("room"))
    runs = joined.select("_row", "shard", F.when(F.col("_s") == "", None).otherwise(F.substr("_s", F.lit(2))).alias("source"), "slot", (F.col("_begin") - F.col("_at")).alias("from_word"), (stop - F.col("_begin")).alias("words")).where("words > 0")
    runs = saved(runs)
    words = runs.groupBy("_row").agg(F.sum("words").alias("taken"))
    targets = spark.createDataFrame([("" if p["source"] is None else "=" + p["source"], p["size"], float(p["target"])) for p in plan], "_s string, source_size long, target double")
    taken = thin.join(F.broadcast(targets), "_s").join(words, "_row", "left")
    return taken.select(F.col("_id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *carry, "_row"), runs


def _cut(text: str, runs: list[tuple[int, int]]) -> list[str]:
    """The text of each run of words (first, number), with the white space between its words."""
    at = [m.span() for m in re.finditer(WORD, text)]
    return [text[at[f][0] : at[f + n - 1][1]] for f, n in runs]


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", block: int = BLOCK, cap: float = CAP, seed: int = 5) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a row for each run of neighbouring words of a document that one pass takes.

    A pass goes once through a source's blocks; a document that a pass takes
    whole comes with its own text, else with the words of the run. The column
    ``chars_col``, where there is one, is counted anew. Rows that no block takes
    are gone.
    """
    cols = docs.columns
    taken, runs = mix_sources(docs.select(F.struct(*cols).alias("_doc"), F.col(id_col).alias("_i"), F.col(text_col).alias("_t"), F.col(source_col).alias("_src")), id_col="_i", text_col="_t", source_col="_src", block=block, cap=cap, seed=seed, carry=("_doc",))
    places = runs.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("from_word", "words"))).alias("_runs"))
    whole = taken.join(places, "_row").select("_doc", "size", "_runs")

    @F.pandas_udf("array<string>")
    def texts(text: pd.Series, size: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for t, n, got in zip(text, size, runs, strict=True):
            # How often each word is taken; pass p takes the words that are taken more than p times.
            often = np.zeros(n + 1, np.int64)
            for r in got:
                often[r["from_word"]] += 1
                often[r["from_word"] + r["words"]] -= 1
            often = np.cumsum(often)[:n]
            made = []
            for p in range(int(often.max(initial=0))):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], (often > p).astype(np.int8), [0]])))
                spans = [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
                made += [t] if spans == [(0, n)] else _cut(t, spans)
            out.append(made)
        return pd.Series(out)

    parts = whole.withColumn("_text", F.explode(texts(F.col("_doc")[text_col], "size", "_runs")))
    fresh = {text_col: F.col("_text"), chars_col: F.length("_text").cast("long")}
    return parts.select(*(fresh[c].alias(c) if c in fresh else F.col("_doc")[c].alias(c) for c in cols))


def op1_mixture(spark, sf_dir: str) -> DataFrame:
    taken, _ = mix_sources(table(spark, sf_dir, "documents"))
    return taken.drop("_row")
