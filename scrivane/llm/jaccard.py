"""N-gram Jaccard join by T-occurrence search over inverted lists, after DivideSkip.

A document is its set of word shingles. Two sets of n and m shingles link when
they share at least T = ceil(4 (n + m) / 9) of them (a Jaccard similarity of
0.8; other thresholds likewise). All shingles have one global order, rare before
frequent. Of a set's n inverted lists, the frequent ones are the long lists and
are not merged: with the first ``n - ceil(0.8 n) + depth`` lists in the order as
short ones, a partner must occur in T - ceil(0.8 n) + depth of them. Short lists
are heap-merged for each query set, and the sets that occur often enough are
probed in the long lists by binary search, which gives the exact overlap.

Order. Counts of all shingles of all documents are summed in 2**20 hashed
buckets; a bucket far above the noise marks its shingles as frequent, by powers
of two. The order decides only how long the merged lists are: any order gives
the same links.

Classes. Equal sets are one node from the start. Before pairs of a list are
compared one by one, a first round compares each longer list's members with one hub
only, the node whose lists are longest together, which in a group of copies is
the original or close to it. Members that links already connect are not compared
again, so a group of near copies costs its size rather than its square. Pairs of
different texts whose connection is still open are all compared; none is dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivane.llm import _text as X
from scrivane.llm._graph import SALTS, components, lowest_of_class, with_class
from scrivane.llm._kit import dropped, lean_batches, released, saved, spread, table

SHINGLE = 5
#: The similarity as a fraction.
NUM, DEN = 4, 5
COUNT_BITS, CHUNK_BITS = 20, 16
#: Rows of a list that one task holds, about.
BLOCK = 4096
#: Shingles for which a set asks for one more occurrence in its short lists.
DEPTH_STEP = 50
#: Members of a hub that are probed in one group.
PROBES = 256
#: Members from which a list takes part in the star round; the few pairs of shorter ones are left to the merge.
STAR_LEAST = 8
#: Pairs that a worker looks at at once, about, and members up to which lists are compared together.
CELLS, SMALL = 1 << 18, 8
SHORT = X.U(0xA0761D6478BD642F)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: k words each, or all words where there are fewer."""
    for _, _, b, offs in X.slices(texts):
        w = X.Words(b, offs)
        h = X.span_hashes(X.prefix_sums(b, X.BYTE_VALUE_LOWER), w.start, w.end)
        run = X.windows(h, k)
        for d in range(len(offs) - 1):
            lo, hi = w.first[d], w.first[d + 1]
            if hi - lo >= k:
                yield np.unique(run[lo : hi - k + 1])
            elif hi > lo:
                yield X.windows(h[lo:hi], hi - lo) ^ SHORT
            else:
                yield np.zeros(0, np.uint64)


def node_of(s: np.ndarray) -> int:
    """A set's identity: 64 bits of its shingles and size, as a signed number."""
    return int((X.mixed((X.mixed(s) * X.U(0xFF51AFD7ED558CCD)).sum(keepdims=True) + X.U(len(s)))).view(np.int64)[0])


def depth(n: np.ndarray | int) -> np.ndarray | int:
    """Occurrences in the short lists that are asked for."""
    return 1 + n // DEPTH_STEP


def least_overlap(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | int:
    """Shared shingles that sets of n and m need: NUM / DEN of the union."""
    return -((-NUM * (n + m)) // (NUM + DEN))


def frequency_levels(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """A level for each bucket of the top COUNT_BITS bits: 0, or 1 and up for shingles of many documents."""
    chunks = 1 << (COUNT_BITS - CHUNK_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for s in shingle_sets(batch.column(0), k):
                np.add.at(total, (s >> X.U(64 - COUNT_BITS)).astype(np.int64), 1)
        part = TaskContext.get().partitionId() % 64
        yield pa.record_batch([pa.array(range(chunks), pa.int32()), pa.array([part] * chunks, pa.int32()), pa.array([c.astype("<u8").tobytes() for c in total.reshape(chunks, -1)], pa.binary())], names=["chunk", "part", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(1 << CHUNK_BITS, "<u8")
        for c in t["counts"]:
            total += np.frombuffer(c.as_py(), "<u8")
        return pa.table({"chunk": t["chunk"][:1], "part": t["part"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk int, part int, counts binary"
    parts = docs.select(text_col).mapInArrow(count, schema).groupBy("chunk", "part").applyInArrow(add, schema)
    rows = sorted(released(parts.groupBy("chunk").applyInArrow(add, schema)).collect(), key=lambda r: r["chunk"])
    total = np.concatenate([np.frombuffer(bytes(r["counts"]), "<u8") for r in rows]).astype(np.float64) if rows else np.zeros(1 << COUNT_BITS)
    noise = np.median(total)
    bar = 32 + noise + 8 * np.sqrt(noise + 1)
    return np.where(total > bar, 1 + np.floor(np.log2(np.maximum(total - noise, 1) / (bar - noise) + 1)), 0).astype(np.uint8)


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """64 bits of a row's id and text, nulls told from all values: which row it is, also where ids are null or repeated.

    Rows of the same id and text share it; they are of one class.
    """
    i, t = docs[id_col], docs[text_col]
    return F.xxhash64(i.isNull(), i, t.isNull(), t)


def _sketches(docs: DataFrame, id_col: str, text_col: str, k: int, levels: np.ndarray) -> DataFrame:
    """id, key, node, n and the short lists' shingles in order, for each document."""
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, short = [], [], []
            for s in shingle_sets(batch.column(1), k):
                n = len(s)
                node.append(node_of(s) if n else None)
                size.append(n)
                keep = min(n, n + (-NUM * n) // DEN + depth(n)) if n else 0
                level = levels[(s >> X.U(64 - COUNT_BITS)).astype(np.int64)]
                # s is sorted by hash, so a stable sort by level gives the order (level, hash).
                short.append(s[np.argsort(level, kind="stable")[:keep]].tobytes())
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(short, pa.binary())], names=["_id", "_key", "node", "n", "short"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col), row_key(docs, id_col, text_col).alias("_key")).mapInArrow(run, f"_id {kind}, _key long, node long, n long, short binary")


def _postings(nodes: DataFrame, levels: np.ndarray) -> DataFrame:
    """token, part, node, n, pos of each short list entry; lists of frequent shingles come in parts of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                node, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                lists = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(2)]
                size = np.array([len(x) for x in lists])
                token = np.concatenate(lists)
                who = np.repeat(np.arange(len(lists)), size)
                pos = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
                level = levels[(token >> X.U(64 - COUNT_BITS)).astype(np.int64)].astype(np.int64)
                parts = np.left_shift(1, np.maximum(level - 7, 0))
                part = (X.mixed(node.view(np.uint64)[who]) >> X.U(8)).astype(np.int64) % parts
                yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(part), pa.array(node[who]), pa.array(n[who]), pa.array(pos)], names=["token", "part", "node", "n", "pos"])

    return nodes.select("node", "n", "short").mapInArrow(run, "token long, part long, node long, n long, pos long")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Column arrays of each batch of whole runs of equal leading ``keys`` columns; input is sorted by them."""
    kept: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if kept is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(kept, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = np.ones(len(cols[0]), bool)
        for c in cols[:keys]:
            last &= c == c[-1]
        at = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        if at:
            yield [c[:at] for c in cols]
        kept = [c[at:] for c in cols]
    if kept is not None:
        yield kept


def _starts(cols: list[np.ndarray]) -> np.ndarray:
    change = np.zeros(len(cols[0]), bool)
    change[0] = True
    for c in cols:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _shared_lists(postings: DataFrame, levels: np.ndarray) -> DataFrame:
    """The postings of lists with two nodes or more (or of lists in parts), and whether there are ``many`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _runs(batches, 2):
            starts = _starts(cols[:2])
            size = np.diff(np.append(starts, len(cols[0])))
            level = levels[(cols[0][starts].view(np.uint64) >> X.U(64 - COUNT_BITS)).astype(np.int64)]
            keep = np.repeat((size > 1) | (level > 7), size)
            many = np.repeat((size >= STAR_LEAST) | (level > 7), size)
            if keep.any():
                yield pa.record_batch([*(pa.array(cols[i][keep]) for i in (0, 2, 3, 4)), pa.array(many[keep])], names=["token", "node", "n", "pos", "many"])

    dealt = postings.repartition(spread(postings), "token", "part").sortWithinPartitions("token", "part")
    return dealt.mapInArrow(run, "token long, node long, n long, pos long, many boolean")


def _fits(nx, px, ny, py):
    """Whether a list entry can be one of those that a linking pair shares: with all before and after it there are enough."""
    big = np.maximum(nx, ny)
    return (NUM * big <= DEN * np.minimum(nx, ny)) & (np.minimum(px, py) + np.minimum(nx - px, ny - py) >= least_overlap(nx, ny))


def long_lists(n: int) -> int:
    return -((-NUM * n) // DEN) - depth(n)


def least_hits(n: int, m: int) -> int:
    """Short lists that linking sets of n and m shingles share at least.

    A shared shingle is in short lists of both, unless it comes after the short
    lists of the set whose short lists end first; that set has only its long
    lists there.
    """
    return least_overlap(n, m) - max(long_lists(n), long_lists(m))


def _by_list(rows: DataFrame, per_list: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``per_list`` by token; both have ``many``, and the members of such lists are spread over SALTS parts."""
    salted = rows.withColumn("_salt", F.when(F.col("many"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    copies = per_list.withColumn("_salt", F.explode(F.when(F.col("many"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("many")
    return salted.join(copies, ["token", "_salt"], how).drop("_salt")


def _weighted(lists: DataFrame) -> DataFrame:
    """The lists with ``w``: how many entries the lists of a node hold together; the original of a group of copies has most."""
    sizes = lists.groupBy("token", "many").agg(F.count(F.lit(1)).alias("size"))
    weights = _by_list(lists, sizes).groupBy("node").agg(F.sum("size").alias("w"))
    return lists.join(weights, "node")


def _star_pairs(lists: DataFrame) -> DataFrame:
    """(x, y) of a list's hub, its node of the largest weight, and its members of other classes that may link."""
    hub = lists.groupBy("token", "many").agg(F.max(F.struct("w", F.col("node").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("pos").alias("px"))).alias("hub")).select("token", "many", "hub.x", "hub.cx", "hub.nx", "hub.px")
    big, total = "greatest(n, nx)", f"ceil({NUM} * (n + nx) / {NUM + DEN})"
    near = _by_list(lists, hub).where("comp <> cx").where(f"{NUM} * {big} <= {DEN} * least(n, nx)").where(f"least(px, pos) + least(nx - px, n - pos) >= {total}")
    hits = near.groupBy("x", F.col("node").alias("y"), "n", "nx").agg(F.count(F.lit(1)).alias("hits"))
    # Hubs of other lists can hide some of a pair's entries, so half of least_hits is asked for; the rest is for the merge.
    return hits.where(f"2 * hits >= {total} - ceil({NUM} * {big} / {DEN}) + 1 + {big} div {DEPTH_STEP}").select("x", "y")


def _merged_pairs(lists: DataFrame) -> DataFrame:
    """(x, y) of all nodes of different classes that share enough short lists.

    Lists come in blocks of BLOCK members; each pair of blocks of a list is one
    unit of work. A unit gives, for each query x, the sorted run of its partners
    in that list; runs of one x are heap-merged.
    """
    sizes = lists.groupBy("token", "many").agg(F.count(F.lit(1)).alias("size"))
    blocks = _by_list(lists, sizes.where(F.col("size") > 1)).withColumn("nb", F.ceil(F.col("size") / BLOCK)).withColumn("i", F.pmod(F.xxhash64("node"), F.col("nb")))
    units = blocks.select("token", "i", "node", "n", "pos", "comp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("j"))
    units = units.select("token", F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), "i", "node", "n", "pos", "comp")
    units = units.repartition(spread(lists), "token", "u", "v").sortWithinPartitions("token", "u", "v", "node")

    def runs_of(p: np.ndarray, s: np.ndarray, unit: np.ndarray, node: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """The pairs of rows p and s as sorted runs of partners by unit and query, which is the larger set."""
        swap = (n[p] < n[s]) | (n[p] == n[s]) & (node[p] < node[s])
        p, s = np.where(swap, s, p), np.where(swap, p, s)
        order = np.lexsort((node[s], p, unit))
        p, s, unit = p[order], s[order], unit[order]
        first = _starts([unit, p])
        ends = pa.array(np.append(first, len(p)).astype(np.int32))
        lists = (pa.ListArray.from_arrays(ends, pa.array(c[s])) for c in (node, n))
        return pa.record_batch([pa.array(node[p[first]]), pa.array(n[p[first]]), *lists], names=["x", "nx", "ys", "ns"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, u, v, i, node, n, pos, comp in _runs(batches, 3):
            starts = _starts([token, u, v])
            size = np.diff(np.append(starts, len(u)))
            unit = np.repeat(np.arange(len(starts)), size)
            # Small lists all at once: rows some places apart in one list.
            small = np.repeat((size <= SMALL) & (u[starts] == v[starts]), size)
            found = [(a := np.flatnonzero((unit[d:] == unit[:-d]) & small[d:]), a + d) for d in range(1, min(SMALL, len(u)))]
            p, q = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
            ok = (comp[p] != comp[q]) & _fits(n[p], pos[p], n[q], pos[q])
            if ok.any():
                yield runs_of(p[ok], q[ok], unit[p[ok]], node, n)
            for at in np.flatnonzero(~small[starts] & (size > 1)).tolist():
                rows = np.arange(starts[at], starts[at] + size[at])
                one = u[rows[0]] == v[rows[0]]
                a, b = (rows, rows) if one else (rows[i[rows] == u[rows[0]]], rows[i[rows] == v[rows[0]]])
                step = max(1, CELLS // max(1, len(b)))
                for from_ in range(0, len(a), step):
                    q = a[from_ : from_ + step]
                    ok = (comp[q][:, None] != comp[b]) & _fits(n[q][:, None], pos[q][:, None], n[b], pos[b])
                    if one:
                        ok &= q[:, None] < b
                    r, c = np.nonzero(ok)
                    if len(r):
                        yield runs_of(q[r], b[c], np.zeros(len(r), np.int64), node, n)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _runs(batches, 1):
            starts = _starts(cols[:1])
            xs, ys = [], []
            for lo, hi in zip(starts, [*starts[1:], len(cols[0])], strict=True):
                n, m = int(cols[1][lo]), {}
                for ys_, ns in zip(cols[2][lo:hi], cols[3][lo:hi], strict=True):
                    m.update(zip(ys_.tolist(), ns.tolist(), strict=True))
                merged = heapq.merge(*(r.tolist() for r in cols[2][lo:hi]))
                found = [y for y, hits in groupby(merged) if sum(1 for _ in hits) >= least_hits(n, m[y])]
                xs += [cols[0][lo]] * len(found)
                ys += found
            if xs:
                yield pa.record_batch([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    runs = units.mapInArrow(pairs, "x long, nx long, ys array<long>, ns array<long>")
    return runs.repartition(spread(lists), "x").sortWithinPartitions("x").mapInArrow(merge, "x long, y long")


def _linked(pairs: DataFrame, docs: DataFrame, first: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """The pairs (x, y) whose sets overlap enough, with their overlap; y is probed in x by binary search.

    Sets are made anew from the texts of the pairs' documents. A hub's members
    come in groups of about PROBES, each with a copy of the hub's set.
    """
    hot = pairs.groupBy("x").agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") > PROBES).select(F.col("x").alias("comp"), F.ceil(F.col("_d") / PROBES).alias("_parts"))
    dealt = with_class(pairs.withColumnRenamed("x", "comp"), hot, "y").select(F.col("comp").alias("x"), "y", F.pmod(F.xxhash64("y"), F.coalesce("_parts", F.lit(1))).alias("part"))
    dealt = saved(dealt)
    wanted = dealt.select(F.col("x").alias("node")).union(dealt.select("y")).distinct()
    where = first.join(wanted, "node").select("_first._key", "node")
    texts = docs.select(row_key(docs, id_col, text_col).alias("_key"), F.col(text_col).alias("_t")).join(where, "_key").select("node", "_t")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = list(shingle_sets(batch.column(1), k))
                ok = [i for i, (s, node) in enumerate(zip(sets, batch.column(0).to_pylist(), strict=True)) if node_of(s) == node]
                yield pa.record_batch([batch.column(0).take(pa.array(ok, pa.int32())), pa.array([sets[i].tobytes() for i in ok], pa.binary())], names=["node", "shingles"])

    sets = saved(texts.mapInArrow(make, "node long, shingles binary").dropDuplicates(["node"]))
    hubs = dealt.select("x", "part").distinct().join(sets.withColumnRenamed("node", "x"), "x").select("x", "part", F.lit(None).cast("long").alias("y"), "shingles")
    members = dealt.join(sets.withColumnRenamed("node", "y"), "y").select("x", "part", "y", "shingles")
    rows = hubs.unionByName(members).repartition(spread(docs), "x", "part").sortWithinPartitions("x", "part", F.col("y").asc_nulls_first())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for batch in batches:
            xs, ys, shared = [], [], []
            for x, y, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                mine = np.frombuffer(s.as_py(), np.uint64)
                if y is None:
                    hub = mine
                    continue
                at = np.searchsorted(hub, mine)
                overlap = int((hub[np.minimum(at, len(hub) - 1)] == mine).sum())
                if overlap >= least_overlap(len(hub), len(mine)):
                    xs.append(x)
                    ys.append(y)
                    shared.append(overlap)
            yield pa.record_batch([pa.array(xs, pa.int64()), pa.array(ys, pa.int64()), pa.array(shared, pa.int64())], names=["x", "y", "shared"])

    found = saved(rows.mapInArrow(probe, "x long, y long, shared long"))
    dropped(dealt, sets)
    return found


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The sketches, and for each node its copies, its first row and ``low``, its class's first row: the smallest by id (nulls last) and key."""
    levels = frequency_levels(docs, text_col, shingle)
    sketches = saved(_sketches(docs, id_col, text_col, shingle, levels))
    per_node = sketches.where("n > 0").groupBy("node")
    first = saved(per_node.agg(F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_key")).alias("_first"), F.count(F.lit(1)).alias("copies")))
    nodes = sketches.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("short").alias("short"))
    lists = saved(_shared_lists(_postings(nodes, levels), levels))
    stars = _linked(_star_pairs(_weighted(lists.where("many")).withColumn("comp", F.col("node"))), docs, first, id_col, text_col, shingle)
    labels = components(stars, "x", "y")
    # Lists within one class are done.
    now = lists.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = now.groupBy("token", "many").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select("token", "many")
    open_ = saved(_by_list(now, mixed, "left_semi"))
    dropped(lists)
    merged = _linked(_merged_pairs(open_), docs, first, id_col, text_col, shingle)
    labels = components(stars.unionByName(merged), "x", "y")
    dropped(open_, stars, merged)
    return sketches, first.join(lowest_of_class(labels, first, "_first"), "node", "left").withColumn("low", F.coalesce("low", "_first"))


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Class of every document under links of Jaccard similarity 0.8 or more of its word shingles.

    A-Z are lower-cased; words are runs of bytes other than x09-x0D and x20. A
    text of fewer than ``shingle`` words is one shingle of all its words; a null,
    empty or blank text has no shingle and links with nothing. Returns the id,
    n_shingles, component_id (the smallest id that links reach, itself included)
    and copies (documents of the same set, itself included). Every row gives one
    row; rows that repeat an id are documents of their own. Other columns are
    not read. An empty table gives an empty result. Ids must be comparable; the
    component of rows without an id is the smallest id among their partners.
    """
    sketches, classes = _classes(docs, id_col, text_col, shingle)
    # Saved, so that the join below has a plain shuffle on both sides and Spark can split the rows of one node.
    by_node = saved(classes.select("node", F.col("low._id").alias("component_id"), "copies"))
    out = sketches.select("_id", "node", "n").join(by_node, "node", "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with its own columns; blank texts stay, each of them.

    The row is that of the smallest id, nulls last. Where its id repeats with
    other texts of the class, one of these texts is taken by a hash; rows of the
    same id and text are one, any of them. A row without an id stays if its class
    has no row with one.
    """
    sketches, classes = _classes(docs, id_col, text_col, SHINGLE)
    lowest = classes.where("_first._key = low._key").select("low._key")
    rows = saved(sketches.where("n > 0").join(lowest, "_key", "left_semi").groupBy(F.col("_key").alias("_kept")).agg(F.count(F.lit(1)).alias("_rows")))
    blank = sketches.where("n = 0").select("_key").distinct()
    single = rows.where("_rows = 1").select("_kept").union(blank)
    once = docs.join(single, row_key(docs, id_col, text_col) == single["_kept"], "left_semi")
    if rows.where("_rows > 1").isEmpty():
        return once
    more = rows.where("_rows > 1").select("_kept")
    return once.union(docs.join(more, row_key(docs, id_col, text_col) == more["_kept"], "left_semi").dropDuplicates([id_col, text_col]))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    lean_batches(spark)
    return jaccard_classes(table(spark, sf_dir, "documents")).drop("copies")
