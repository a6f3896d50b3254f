"""Hard negatives by a pivot table.

Vectors x are augmented with ``sqrt(R**2 - |x|**2)``, R the largest norm, and an
anchor q with 0; then ``|q' - x'|**2 = |q|**2 + R**2 - 2 q.x``, so a larger inner
product is a smaller distance. The distances of every vector to PIVOTS pivots
are computed once and stored. By the triangle inequality

    |d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p)        for every pivot p,

which brackets a score without looking at the vector. Rows whose bracket misses
what is asked for are done; the survivors' scores are computed exactly, and only
those decide, so results are exact whatever the pivots are. Pivots are chosen
farthest-first from the SAMPLE vectors of smallest hash; the table covers every row.

Work goes by units: a block of anchors against a block of rows. Positives meet
within their label, in two top-k steps (in the unit, then over units); negatives
meet all rows, with the windows of their anchor's positives. Blocks are dealt by a
hash, so neither a label nor a repeated vector makes a large one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivane.llm._kit import dropped, saved, spread, table

PIVOTS, SAMPLE = 16, 1024
#: Anchors of a block; rows of a block at most, and at least where the table is small; anchors whose brackets are made at once.
ANCHORS, MOST_ROWS, LEAST_ROWS, AT_ONCE = 16384, 65536, 2048, 32
#: Part of a block's rows that survive from which scores are computed for the whole block.
DENSE = 1 / 8
#: Groups (label and dimension) up to which their sizes are broadcast.
MOST_BROADCAST = 100_000


def _prepared(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, anchor: Column, scale: float) -> DataFrame:
    """_row (a number), id, label, anchor, dim, v (floor of the scaled components as doubles, in bytes) and norm2, of the rows that take part."""
    chosen = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vec_col).alias("raw")).where("label is not null and raw is not null")
    kind = dict(chosen.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                length = pc.list_value_length(batch.column(3)).to_numpy()
                flat = batch.column(3).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                with np.errstate(over="ignore", invalid="ignore"):
                    flat = np.floor(flat * scale)
                begin = np.cumsum(length) - length
                keep, data, norm = np.zeros(len(length), bool), [], []
                for i, (b, n) in enumerate(zip(begin.tolist(), length.tolist(), strict=True)):
                    v = flat[b : b + n]
                    if n and np.isfinite(v).all():
                        keep[i] = True
                        data.append(v.tobytes())
                        norm.append(float(v @ v))
                part = batch.filter(pa.array(keep))
                made = [pa.array(np.arange(row, row + len(data))), *(part.column(i) for i in range(3)), pa.array(length[keep].astype(np.int32)), pa.array(data, pa.binary()), pa.array(norm, pa.float64())]
                row += len(data)
                yield pa.record_batch(made, names=["_row", "id", "label", "anchor", "dim", "v", "norm2"])

    return chosen.mapInArrow(run, f"_row long, id {kind['id']}, label {kind['label']}, anchor boolean, dim int, v binary, norm2 double")


def _matrix(values: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), dim)


def farthest_first(sample: np.ndarray, lift: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``sample`` (with ``lift``, the added component) of which each is the farthest from those before it."""
    points = np.concatenate([sample, lift[:, None]], 1)
    chosen = [int(np.argmax(((points - points.mean(0)) ** 2).sum(1)))]
    gap = ((points - points[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(points)) and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


def _pivot_table(rows: DataFrame, pivots: int) -> tuple[DataFrame, float]:
    """``rows`` with ``d``, their distances to the pivots, and ``da``, an anchor's own (its added component is 0), in bytes; and R**2. Dimensions without a pivot have none."""
    radius2 = rows.agg(F.max("norm2")).first()[0] or 0.0
    sample = [] if not np.isfinite(radius2) else rows.select("dim", "v", "norm2").orderBy(F.xxhash64("_row"), "_row").limit(SAMPLE).collect()
    made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r["dim"] for r in sample}:
        own = [r for r in sample if r["dim"] == dim]
        v, lift = _matrix([bytes(r["v"]) for r in own], dim), np.sqrt(np.maximum(radius2 - np.array([r["norm2"] for r in own]), 0))
        best = farthest_first(v, lift, pivots)
        made[dim] = (v[best], lift[best])
    kind = dict(rows.dtypes)
    names = [*kind, "d", "da"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                dims, norm, d = batch.column("dim").to_numpy(), batch.column("norm2").to_numpy(), [b""] * batch.num_rows
                asks, da = batch.column("anchor").to_pylist(), [b""] * batch.num_rows
                for dim in set(dims.tolist()) & set(made):
                    at_dim = np.flatnonzero(dims == dim)
                    v, lift = _matrix(batch.column("v").take(pa.array(at_dim)).to_pylist(), dim), np.sqrt(np.maximum(radius2 - norm[at_dim], 0))
                    p, p_lift = made[dim]
                    square = norm[at_dim][:, None] + (p * p).sum(1) - 2 * v @ p.T
                    both = np.sqrt(np.maximum(square + (lift[:, None] - p_lift) ** 2, 0)), np.sqrt(np.maximum(square + p_lift**2, 0))
                    for i, of_row, of_anchor in zip(at_dim.tolist(), *both, strict=True):
                        d[i], da[i] = of_row.tobytes(), of_anchor.tobytes() if asks[i] else b""
                yield pa.record_batch([*batch.columns, pa.array(d, pa.binary()), pa.array(da, pa.binary())], names=names)

    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kind.items()) + ", d binary, da binary"), radius2


class _Rows:
    """A block's rows in the order that breaks ties: by id, null ids last, then by place; ``d`` names their pivot distances."""

    def __init__(self, t: pa.Table, d: str):
        t = t.sort_by([("id", "ascending"), ("_row", "ascending")])
        self.row, self.label, self.n = t["_row"].to_numpy(), t["label"].combine_chunks(), len(t)
        dim = t["dim"][0].as_py()
        self.v, self.norm2 = _matrix(t["v"].to_pylist(), dim), t["norm2"].to_numpy()
        self.d = np.frombuffer(b"".join(t[d].to_pylist()), np.float64).reshape(self.n, -1)


def brackets(q: _Rows, at: slice, x: _Rows, radius2: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of some anchors with a block's rows."""
    whole = q.norm2[at][:, None] + radius2
    low, high = np.full((len(whole), x.n), -np.inf), np.full((len(whole), x.n), np.inf)
    for p in range(q.d.shape[1]):
        a, b = q.d[at, p][:, None], x.d[:, p]
        np.minimum(high, (whole - (a - b) ** 2) / 2, out=high)
        np.maximum(low, (whole - (a + b) ** 2) / 2, out=low)
    slack = 1 + 1e-9 * whole
    return low - slack, high + slack


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products; where doubles could round them they are made of Python's integers and cut to 64 bits."""
    if not q.size or not x.size or np.abs(q).max() * np.abs(x).max() * x.shape[1] < 2.0**53:
        return (q @ x.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(q) @ exact(x).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _survivors(q: _Rows, at: slice, x: _Rows, need: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each anchor the rows that ``need`` names and their exact scores."""
    if need.mean() > DENSE:
        made = scores(q.v[at], x.v)
        return [(rows := np.flatnonzero(n), s[rows]) for n, s in zip(need, made, strict=True)]
    found = [np.flatnonzero(n) for n in need]
    return [(rows, scores(v[None], x.v[rows])[0]) for rows, v in zip(found, q.v[at], strict=True)]


def _blocked(rows: DataFrame, anchors: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``i`` and ``j``, numbers of an anchors' and a rows' block within ``by``; each row in every unit that it is part of."""
    total = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).join(anchors.groupBy(*by).agg(F.count(F.lit(1)).alias("_a")), by)
    blocks = F.greatest(F.ceil(F.col("_n") / MOST_ROWS), F.least(F.lit(2 * spread(rows)), F.ceil(F.col("_n") / LEAST_ROWS)))
    sizes = saved(total.select(*by, F.ceil(F.col("_a") / ANCHORS).alias("_ni"), blocks.alias("_nj")))
    few = sizes.count() <= MOST_BROADCAST
    met = F.broadcast(sizes) if few else sizes.hint("merge")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        placed = side.join(met, by).withColumn(own, F.pmod(F.xxhash64(F.lit(own), F.col("_row")), F.col(f"_n{own}")))
        made = placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_n{other}") - 1))).drop("_ni", "_nj")
        return made.toDF(*made.columns)  # columns of its own: both sides may come from one table

    return dealt(anchors, "i", "j"), dealt(rows, "j", "i")


def _positives(table_: DataFrame, anchors: DataFrame, radius2: float, k: int) -> DataFrame:
    """(anchor, positive, score, place): the first k other rows of the anchor's label, by row number."""
    a, r = _blocked(table_, anchors, ["label", "dim"])

    def top(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            q, x = _Rows(left, "da"), _Rows(right, "d")
            for from_ in range(0, q.n, AT_ONCE):
                at = slice(from_, min(from_ + AT_ONCE, q.n))
                low, high = brackets(q, at, x, radius2)
                self_ = q.row[at][:, None] == x.row
                low[self_], high[self_] = -np.inf, -np.inf
                # The k-th largest lower bound is reached by k rows.
                if x.n > k:
                    need = high >= np.partition(low, x.n - k, axis=1)[:, x.n - k][:, None]
                else:
                    need = np.ones_like(self_)
                need &= ~self_
                for anchor, (rows, s) in zip(q.row[at], _survivors(q, at, x, need), strict=True):
                    best = np.argsort(-s, kind="stable")[:k] if len(s) and s.min() > -(1 << 63) else np.lexsort((np.arange(len(s)), s.astype(object) * -1))[:k]
                    out += [(anchor, x.row[j], v) for j, v in zip(rows[best], s[best], strict=True)]
        return pa.table({c: pa.array([o[n] for o in out], pa.int64()) for n, c in enumerate(("anchor", "positive", "score"))})

    units = ["label", "dim", "i", "j"]
    found = a.groupBy(*units).cogroup(r.groupBy(*units)).applyInArrow(top, "anchor long, positive long, score long")
    named = found.join(table_.select(F.col("_row").alias("positive"), F.col("id").alias("positive_id")), "positive")
    best = Window.partitionBy("anchor").orderBy(F.col("score").desc(), F.col("positive_id").asc_nulls_last(), "positive")
    return named.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: float = 256.0, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, pivots: int = PIVOTS) -> DataFrame:
    """Hard negatives of every row for which ``anchor`` is true.

    Components are multiplied by ``scale`` and floored; a score is the inner product
    with the anchor; higher scores come first, ties by smaller id (null ids last),
    then by place in the table. An anchor's positives are its first ``positives``
    other rows of the same label. For each anchor and positive the first
    ``negatives`` rows of other labels with ``low * positive_score <= 100 *
    negative_score <= high * positive_score`` are returned: anchor_id, positive_id,
    rank (from 1), negative_id, positive_score, negative_score.

    Rows with a null label or vector, an empty vector, or a null or non-finite
    component (scaled ones too) take no part. Vectors of different dimensions never
    meet. Rows that repeat an id or a vector are rows of their own; an anchor that
    repeats is mined each time. Scores beyond 64 bits are cut to them. A window that
    no row falls in gives nothing, and so do an empty table and one without anchors.
    Other columns are not read.
    """
    rows = saved(_prepared(vectors, id_col, vec_col, label_col, anchor, scale))
    tabled, radius2 = _pivot_table(rows, pivots)
    stored = saved(tabled)
    dropped(rows)
    anchors = stored.where("anchor")
    found = saved(_positives(stored, anchors, radius2, positives).select("anchor", "positive", "positive_id", "score", "place"))
    windows = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("w"))
    asked = anchors.join(windows.select(F.col("anchor").alias("_row"), F.col("w.place").alias("places"), F.col("w.score").alias("wanted")), "_row")
    a, r = _blocked(stored, asked, ["dim"])

    def mine(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            left = left.sort_by([("id", "ascending"), ("_row", "ascending")])
            q, x = _Rows(left, "da"), _Rows(right, "d")
            both = pa.chunked_array([q.label, x.label]).combine_chunks().dictionary_encode().indices.to_numpy()
            q_label, x_label = both[: q.n], both[q.n :]
            places, wanted = left["places"].to_pylist(), left["wanted"].to_pylist()
            # Least and largest score of each window, in whole numbers.
            windows_ = [[(p, -(-low * s // 100), high * s // 100) for p, s in zip(ps, ss, strict=True) if -(-low * s // 100) <= high * s // 100] for ps, ss in zip(places, wanted, strict=True)]
            for from_ in range(0, q.n, AT_ONCE):
                at = slice(from_, min(from_ + AT_ONCE, q.n))
                lower, upper = brackets(q, at, x, radius2)
                need = q_label[at][:, None] != x_label
                for i, ws in enumerate(windows_[at]):
                    need[i] &= (upper[i] >= min((w[1] for w in ws), default=np.inf)) & (lower[i] <= max((w[2] for w in ws), default=-np.inf))
                for anchor_, ws, (rows_, s) in zip(q.row[at], windows_[at], _survivors(q, at, x, need), strict=True):
                    order = np.argsort(s, kind="stable")
                    rising = s[order]
                    for place, least, most in ws:
                        first, end = np.searchsorted(rising, least), np.searchsorted(rising, most, "right")
                        if end > first:
                            # Those that tie with the last one taken are all looked at, for the smallest ids.
                            cut = np.searchsorted(rising, rising[max(first, end - negatives)])
                            some = order[max(first, cut) : end]
                            some = some[np.lexsort((some, -s[some]))][:negatives]
                            out += [(anchor_, place, x.row[j], v) for j, v in zip(rows_[some], s[some], strict=True)]
        return pa.table({c: pa.array([o[n] for o in out], pa.int64()) for n, c in enumerate(("anchor", "place", "negative", "negative_score"))})

    units = ["dim", "i", "j"]
    met = a.groupBy(*units).cogroup(r.groupBy(*units)).applyInArrow(mine, "anchor long, place long, negative long, negative_score long")
    named = met.join(stored.select(F.col("_row").alias("negative"), F.col("id").alias("negative_id")), "negative")
    best = Window.partitionBy("anchor", "place").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last(), "negative")
    ranked = named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    told = found.join(anchors.select(F.col("_row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return told.join(ranked, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


SQL = {
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, list_inner_product(a.x, b.x)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score
            FROM s WHERE label = anchor_label
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
            s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
        QUALIFY rank <= 10
    """,
}
