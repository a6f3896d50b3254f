"""Embedding near-duplicates with randomised-rotation binary codes and stored factors.

Every vector is normalised and turned by a random rotation. Once for each vector
are stored: the signs of the turned vector, which are a binary code (a vector of
length one as well); the correction factor, the inner product of the two; and
the turned vector rounded at random to four bits for each component, with its
step. For vectors x and y the quotient ``<code of x, rounded y> / factor of x`` is
an unbiased estimate of the cosine. Its error stays below SIGMAS times
``sqrt((1 - factor**2) / factor**2 / (dim - 1) + (step / (2 factor))**2)`` with
high probability. Pairs whose upper bound stays below the threshold are done.

Candidates are pairs that share the first ``bits`` signs under one of several
further rotations (tables). The number of tables follows from the bits so that a
pair at the threshold itself is met with probability MET, and closer pairs more
surely. Equal vectors are one node from the start. Work goes in two passes over
units, which are buckets or pairs of a large bucket's blocks: the first one gets
codes and factors only and names the vectors that are in an undecided pair; the
second one gets those whole, computes undecided pairs exactly in double
precision, and only that decides a link.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm._graph import components, lowest_of_class
from scrivane.llm._kit import dropped, saved, spread, table
from scrivane.llm.jaccard import _runs, _starts

THRESHOLD = 0.95
SIGMAS = 4.0
MET = 0.985
#: Rows that unrelated vectors leave in a bucket, and rows of a bucket that one unit of work compares with as many others, about.
BUCKET, BLOCK = 512, 1024
#: Large buckets up to which their sizes are broadcast; beyond, they are joined.
MOST_BROADCAST = 100_000


def plan_tables(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Sign bits of a bucket's key, and tables, for n vectors."""
    bits = max(4, math.ceil(math.log2(max(n, 1) / BUCKET + 1)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - MET) / math.log(1 - same))


@lru_cache(maxsize=256)
def rotation(dim: int, number: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([dim, number + 1, 1913]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit_vectors(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors of length one in double precision) by dimension; unusable rows are in none."""
    length = pc.fill_null(pc.list_value_length(col), 0).to_numpy()
    flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    begin = np.cumsum(length) - length
    for dim in np.unique(length[length > 0]).tolist():
        rows = np.flatnonzero(length == dim)
        v = flat[begin[rows][:, None] + np.arange(dim)]
        size = np.abs(v).max(1)
        ok = np.isfinite(v).all(1) & (size > 0)
        rows, v = rows[ok], v[ok] / size[ok][:, None]
        yield rows, v / np.linalg.norm(v, axis=1, keepdims=True)


def _nodes(table_: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """_id, node (16 bytes of a hash of the unit vector; null where nothing can link) and the raw vector."""
    kind = dict(table_.select(id_col, vec_col).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = [None] * batch.num_rows
            for rows, units in unit_vectors(batch.column(1)):
                for i, u in zip(rows.tolist(), units, strict=True):
                    node[i] = hashlib.blake2b(u.tobytes(), digest_size=16).digest()
            yield pa.record_batch([batch.column(0), pa.array(node, pa.binary()), batch.column(1)], names=["_id", "node", "raw"])

    return table_.select(F.col(id_col).alias("_id"), vec_col).mapInArrow(run, f"_id {kind[id_col]}, node binary, raw {kind[vec_col]}")


def encoded(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, correction factor, packed four-bit components and their step, of unit vectors of one dimension."""
    dim = units.shape[1]
    turned = units @ rotation(dim, -1)
    signs = turned > 0
    factor = np.abs(turned).sum(1) / math.sqrt(dim)
    step = np.abs(turned).max(1) / 7
    dither = np.random.default_rng([dim, 515]).random(dim)
    levels = (np.clip(np.floor(turned / step[:, None] + dither), -8, 7) + 8).astype(np.uint8)
    if dim % 2:
        levels = np.concatenate([levels, np.zeros((len(levels), 1), np.uint8)], 1)
    return np.packbits(signs, axis=1), factor, levels[:, ::2] << 4 | levels[:, 1::2], step


def undecided(x: tuple, y: tuple, dim: int, threshold: float) -> np.ndarray:
    """Which pairs of x and y, as encoded() gives them, may reach the threshold."""
    code, factor = np.unpackbits(x[0], axis=1, count=dim).astype(np.float32), x[1]
    code = (2 * code - 1) / np.float32(math.sqrt(dim))
    whole = np.stack([y[2] >> 4, y[2] & 15], 2).reshape(len(y[2]), -1)[:, :dim].astype(np.float32) - 8
    estimate = (code @ whole.T) * y[3].astype(np.float32) / factor[:, None].astype(np.float32)
    spread_ = np.maximum(1 - factor**2, 0) / factor**2 / max(dim - 1, 1)
    slack = np.sqrt(spread_[:, None] + (y[3] / 2) ** 2 / factor[:, None] ** 2) if dim > 1 else np.float64(1)
    return estimate + SIGMAS * slack >= threshold - 1e-5


def _keyed(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """Adds what is stored for each vector: code, factor, levels, step, and ``keys``, its bucket in each table; the dimension is part of it."""
    kind = dict(nodes.dtypes)["raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for from_ in range(0, whole.num_rows, 2048):
                batch = whole.slice(from_, 2048)
                n = batch.num_rows
                keys, code, levels = np.zeros((n, tables), np.int64), [b""] * n, [b""] * n
                factor, step, dims = np.zeros(n), np.zeros(n), np.zeros(n, np.int32)
                for rows, units in unit_vectors(batch.column("raw")):
                    dim = units.shape[1]
                    dims[rows] = dim
                    c, factor[rows], v, step[rows] = encoded(units)
                    for i, p, q in zip(rows.tolist(), c, v, strict=True):
                        code[i], levels[i] = p.tobytes(), q.tobytes()
                    for t in range(tables):
                        # More bits than dimensions come from further rotations.
                        key = np.full(len(rows), dim, np.int64)
                        for at in range(0, bits, dim):
                            turned = units @ rotation(dim, t + 1000 * (at // dim))[:, : min(dim, bits - at)]
                            key = (key << turned.shape[1]) | ((turned > 0) @ (1 << np.arange(turned.shape[1], dtype=np.int64)))
                        keys[rows, t] = key
                made = [pa.array(dims), pa.array(code, pa.binary()), pa.array(factor), pa.array(levels, pa.binary()), pa.array(step), pa.array(list(keys), pa.list_(pa.int64()))]
                yield pa.record_batch([batch.column("node"), batch.column("copies"), batch.column("raw"), *made], names=["node", "copies", "raw", "dim", "code", "factor", "levels", "step", "keys"])

    return nodes.select("node", "copies", "raw").mapInArrow(run, f"node binary, copies long, raw {kind}, dim int, code binary, factor double, levels binary, step double, keys array<long>")


def _units(keyed: DataFrame) -> DataFrame:
    """t, key, u, v, i and the codes of each vector in each unit of work that it is part of, not yet dealt."""
    stored = ["node", "dim", "code", "factor", "levels", "step"]
    large = saved(keyed.select(F.posexplode("keys").alias("t", "key")).groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).where(f"size > {BLOCK}"))
    few = large.count() <= MOST_BROADCAST
    met = keyed.select(*stored, "keys", F.posexplode("keys").alias("t", "key")).withColumn("keys", F.slice("keys", F.lit(1), F.col("t"))).join(F.broadcast(large) if few else large.hint("merge"), ["t", "key"], "left")
    blocks = met.withColumn("nb", F.ceil(F.coalesce("size", F.lit(1)) / BLOCK)).withColumn("i", F.pmod(F.xxhash64("node"), F.col("nb")))
    units = blocks.select("t", "key", "i", *stored, "keys", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("j"))
    return units.select("t", "key", F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), "i", *stored, "keys")


def _sides(u: int, v: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a unit's two blocks, the same where it is one block."""
    rows = np.arange(len(i))
    return (rows[i == u], rows[i == v]) if u != v else (rows, rows)


def _codes(cols: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    code, factor, levels, step = cols
    pack = lambda x: np.frombuffer(b"".join(x[rows]), np.uint8).reshape(len(rows), -1)
    return pack(code), factor[rows], pack(levels), step[rows]


def _pieces(a: np.ndarray, b: np.ndarray, cols: list[np.ndarray], keys: np.ndarray, dim: int, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (of a, of b) of the undecided pairs that no earlier table (``keys``) meets, a few at a time."""
    y = _codes(cols, b)
    for at in range(0, len(a), 256):
        p = a[at : at + 256]
        need = undecided(_codes(cols, p), y, dim, threshold)
        if same:
            need &= p[:, None] < b
        i, j = np.nonzero(need)
        for s in range(0, len(i), 65536):
            x, z = p[i[s : s + 65536]], b[j[s : s + 65536]]
            fresh = ~(keys[x] == keys[z]).any(1)
            yield x[fresh], z[fresh]


def _links(keyed: DataFrame, threshold: float) -> DataFrame:
    """(node, n, to): linked vectors of each node and one node of its group, by unit of work.

    A pair that several tables meet counts in the first of them only.
    """
    kind = dict(keyed.dtypes)["raw"]
    unit = ["t", "key", "u", "v"]
    first = _units(keyed).repartition(spread(keyed), *unit).sortWithinPartitions(*unit)

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _runs(batches, 4):
            starts = _starts(cols[:4])
            for lo, hi in zip(starts, [*starts[1:], len(cols[0])], strict=True):
                if hi - lo < 2:
                    continue
                t, key, u, v, i, node, dim, *stored, keys = (c[lo:hi] for c in cols)
                a, b = _sides(u[0], v[0], i)
                hit = np.zeros(hi - lo, bool)
                if len(a) and len(b):
                    for p, q in _pieces(a, b, stored, np.stack(keys), int(dim[0]), threshold, u[0] == v[0]):
                        hit[p] = hit[q] = True
                if hit.any():
                    yield pa.record_batch([pa.array(x[hit]) for x in (t, key, u, v, i)] + [pa.array(node[hit], pa.binary())], names=[*unit, "i", "node"])

    some = saved(first.mapInArrow(flag, "t int, key long, u long, v long, i long, node binary"))
    second = some.join(keyed, "node").select(*unit, "i", "node", "dim", "code", "factor", "levels", "step", "copies", "keys", "raw")
    second = second.repartition(spread(keyed), *unit).sortWithinPartitions(*unit, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _runs(batches, 4):
            starts = _starts(cols[:4])
            for lo, hi in zip(starts, [*starts[1:], len(cols[0])], strict=True):
                t, _, u, v, i, node, dim, *stored, copies, keys, raw = (c[lo:hi] for c in cols)
                a, b = _sides(u[0], v[0], i)
                if hi - lo < 2 or not len(a) or not len(b):
                    continue
                ((_, x),) = unit_vectors(pa.array(list(np.stack(raw).astype(np.float64)), pa.list_(pa.float64())))
                n, to, hit = np.zeros(hi - lo), np.arange(hi - lo), np.zeros(hi - lo, bool)
                for p, q in _pieces(a, b, stored, np.stack(keys)[:, : t[0]], int(dim[0]), threshold, u[0] == v[0]):
                    near = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
                    p, q = p[near], q[near]
                    n += np.bincount(p, copies[q], hi - lo) + np.bincount(q, copies[p], hi - lo)
                    hit[p] = hit[q] = True
                    while True:
                        low = to.copy()
                        np.minimum.at(low, p, to[q])
                        np.minimum.at(low, q, to[p])
                        low = low[low]
                        if (low == to).all():
                            break
                        to = low
                if hit.any():
                    yield pa.record_batch([pa.array(node[hit], pa.binary()), pa.array(n[hit].astype(np.int64)), pa.array(node[to[hit]], pa.binary())], names=["node", "n", "to"])

    return second.mapInArrow(run, "node binary, n long, to binary")


def embedding_classes(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Near-duplicate links and classes of every vector by cosine of ``threshold`` or more.

    Returns the id, n_links (other vectors linked directly), component_id (the
    smallest id reachable by links, itself included) and kept (whether that is
    the vector's own id). A vector that is null, empty, zero, or holds a null or
    non-finite component links with nothing; vectors of different dimensions do
    not link. Every row gives one row; rows that repeat an id are vectors of
    their own. Other columns are not read. An empty table gives an empty result.
    No link below the threshold is returned; see the module for the probability
    of meeting one above it.
    """
    found_rows = _nodes(vectors, id_col, vec_col)
    all_rows = saved(found_rows.select("_id", "node"))
    first = saved(all_rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("copies")))
    bits, tables = plan_tables(first.count(), threshold)
    nodes = found_rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.first("raw").alias("raw"), F.count(F.lit(1)).alias("copies"))
    keyed = saved(_keyed(nodes, bits, tables))
    found = saved(_links(keyed, threshold))
    dropped(keyed)
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    labels = components(found.select("node", "to").distinct(), "node", "to")
    by_node = first.join(lowest_of_class(labels, first, "_first"), "node", "left").join(links, "node", "left")
    # Saved, so that the join below has a plain shuffle on both sides and Spark can split the rows of one node.
    by_node = saved(by_node.select("node", F.coalesce("low", "_first").alias("low"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = all_rows.join(by_node, "node", "left")
    own = F.coalesce("low", "_id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("_id").eqNullSafe(own).alias("kept"))


def op6_embedding_classes(spark, sf_dir: str) -> DataFrame:
    return embedding_classes(table(spark, sf_dir, "embeddings"))
