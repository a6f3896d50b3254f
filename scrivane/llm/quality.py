"""Quality rules: exact text statistics and a calibrated hashed n-gram logistic regression.

The statistics are counted over each whole text. The model averages one learned
weight per hashed word, one per hashed pair of neighbouring words and one per
hashed run of CHAR_N code points over the text, is trained on labelled rows,
calibrated by Platt scaling on rows it was not trained on, and compared with a
fixed threshold. Scoring runs over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm import _text as X
from scrivane.llm._kit import bounded_rows, gathered, table, thinned

#: Weights of words, of pairs of neighbouring words and of runs of CHAR_N code points: 2**DIM_BITS of each part.
PARTS, DIM_BITS, CHAR_N = 3, 16, 4
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
THRESHOLD = 0.5
#: Labelled rows of each class that the model is fitted on, about.
SAMPLE_PER_CLASS = 3000
#: Features that the fit works on at once, about.
CELLS = 1 << 19

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    s = keys[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        twin = s[1:] == s[:-1]
        same[1:] = twin
        same[:-1] |= twin
    out = np.empty(len(s), bool)
    out[order] = same
    return out


def text_stats(b: np.ndarray, offs: np.ndarray, w: X.Words, sums: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The five statistics of STATS for each document of a slice; see score_quality."""
    docs = len(offs) - 1
    inside = np.zeros(len(b) + 1, np.int64)
    np.cumsum((b & 0xC0) != 0x80, out=inside[1:])
    chars = np.zeros(len(w.start) + 1, np.int64)
    np.cumsum(inside[w.end] - inside[w.start], out=chars[1:])
    salt = X.mixed(np.arange(1, docs + 1, dtype=np.uint64))
    # Lines: from each document's begin or a newline to the next newline or the document's end.
    breaks = np.flatnonzero(b == 10)
    begins = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    stops = np.sort(np.concatenate([offs[1:], breaks]), kind="stable")
    line_doc = np.repeat(np.arange(docs), 1 + np.searchsorted(breaks, offs[1:]) - np.searchsorted(breaks, offs[:-1]))
    has_word = np.searchsorted(w.start, begins) < np.searchsorted(w.start, stops)
    begins, stops, line_doc = begins[has_word], stops[has_word], line_doc[has_word]
    keys = X.span_hashes(sums, begins, stops) + salt[line_doc]
    _, at = np.unique(keys, return_index=True)
    dup = np.bincount(line_doc, minlength=docs) - np.bincount(line_doc[at], minlength=docs)
    # Three-word windows that occur twice or more in a document; the words that they cover.
    n = len(hashes)
    covered = np.zeros(n, bool)
    ok = np.flatnonzero(X.in_one_doc(w.first, n, 3))
    if len(ok):
        doc_of = np.searchsorted(w.first, ok, "right") - 1
        hot = ok[_repeats(X.windows(hashes, 3)[ok] + salt[doc_of])]
        for j in range(3):
            covered[hot + j] = True
    return {"n_words": w.count.astype(np.int64), "word_chars": chars[w.first[1:]] - chars[w.first[:-1]], "n_symbols": _per_doc(SYMBOLS[b], offs), "n_dup_lines": dup.astype(np.int64), "n_repeat_words": _per_doc(covered, w.first)}


def _features(b: np.ndarray, offs: np.ndarray, w: X.Words, sums: np.ndarray, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words, word pairs and runs of CHAR_N code points: their weights' indices, and where each document's begin and end."""
    mask = X.U((1 << DIM_BITS) - 1)
    index = lambda h, part: ((h >> X.U(20)) & mask).astype(np.int64) + (part << DIM_BITS)
    chars = np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))
    first = np.searchsorted(chars[:-1], offs)
    runs = X.span_hashes(sums, chars[:-CHAR_N], chars[CHAR_N:]) if len(chars) > CHAR_N else np.zeros(0, np.uint64)
    stop = lambda at, n: np.maximum(at[:-1], at[1:] - n + 1)
    return [(index(hashes, 0), w.first[:-1], w.first[1:]), (index(X.windows(hashes, 2), 1), w.first[:-1], stop(w.first, 2)), (index(runs, 2), first[:-1], stop(first, CHAR_N))]


def _mean_weight(weights: np.ndarray, b: np.ndarray, offs: np.ndarray, w: X.Words, sums: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offs) - 1)
    for at, begin, end in _features(b, offs, w, sums, hashes):
        total = np.zeros(len(at) + 1)
        np.cumsum(weights[at], out=total[1:])
        # A document too short for a run has none, and its place can be beyond the last run.
        begin, end = np.minimum(begin, len(at)), np.minimum(end, len(at))
        out += (total[end] - total[begin]) / np.maximum(end - begin, 1)
    return out


def _counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse mean-frequency features: how many each text has, and all their indices and values, in few bytes."""
    sizes, index, value = [], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for _, _, b, offs in X.slices(texts):
        w = X.Words(b, offs)
        sums = X.prefix_sums(b)
        found = _features(b, offs, w, sums, X.span_hashes(sums, w.start, w.end))
        for d in range(len(offs) - 1):
            size = 0
            for at, begin, end in found:
                i, n = np.unique(at[begin[d] : end[d]], return_counts=True)
                index.append(i.astype(np.int32))
                value.append((n / max(end[d] - begin[d], 1)).astype(np.float32))
                size += len(i)
            sizes.append(size)
    return np.array(sizes, np.int64), np.concatenate(index), np.concatenate(value)


def _blocks(sizes: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Rows, their features, and each feature's row within the block; about CELLS features at once."""
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        before = int(ends[lo] - sizes[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, before + CELLS, "right")))
        yield slice(lo, hi), slice(before, int(ends[hi - 1])), np.repeat(np.arange(hi - lo), sizes[lo:hi])
        lo = hi


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(texts: pa.Array, labels: np.ndarray, weight: np.ndarray, order: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float, float]:
    """Weights, and slope and intercept of the calibration.

    ``weight``: how many rows of the corpus a sampled row stands for, so that the
    calibrated probabilities keep the corpus's share of each class. Every fifth
    row, by ``order``, is held out of the weights and used for the calibration.
    """
    y = labels.astype(np.float64)
    if not len(y) or y.min() == y.max():
        return np.zeros(PARTS << DIM_BITS, np.float32), 0.0, 12.0 if not len(y) or y[0] else -12.0
    sizes, idx, val = _counts(texts)
    held = order % 5 == 0
    # The hashed weights are learned with both classes at equal weight.
    balance = np.where(y > 0, 0.5 / max(1, (y[~held] > 0).sum()), 0.5 / max(1, (y[~held] == 0).sum())) * ~held
    w, grad2, bias, bias2 = np.zeros(PARTS << DIM_BITS), np.full(PARTS << DIM_BITS, 1e-8), 0.0, 1e-8
    z = np.zeros(len(y))
    for round_ in range(rounds + 1):
        d, total = 1e-7 * w, 0.0
        for rows, at, row in _blocks(sizes):
            z[rows] = np.bincount(row, val[at] * w[idx[at]], rows.stop - rows.start) + bias
            if round_ < rounds:
                g = (_sigmoid(z[rows]) - y[rows]) * balance[rows]
                d += np.bincount(idx[at], val[at] * g[row], len(w))
                total += g.sum()
        if round_ < rounds:
            grad2 += d * d
            w -= 2.0 * d / np.sqrt(grad2)
            bias2 += total**2
            bias -= 0.3 * total / np.sqrt(bias2)
    use = held if len(np.unique(y[held])) == 2 else np.ones(len(y), bool)
    z, y, k = z[use], y[use], weight[use] / weight[use].sum()
    # Platt's targets keep the slope finite when the classes are separable.
    n1, n0 = (y > 0).sum(), (y == 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = z.std() or 1.0
    a, c = 1.0 / scale, -float((z * k).sum()) / scale
    for _ in range(60):  # Newton's method on two parameters
        p = _sigmoid(a * z + c)
        r, h = (p - target) * k, p * (1 - p) * k + 1e-12
        g = np.array([(r * z).sum() + 1e-6 * a, r.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 5.0 / (abs(step[0]) * scale + abs(step[1]) + 1e-12))
        a, c = a - step[0], c - step[1]
        if abs(step).max() < 1e-9:
            break
    return w.astype(np.float32), float(a), float(c)


def train_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> tuple[np.ndarray, float, float]:
    """Fit the model on about ``per_class`` labelled rows of each class, chosen by a hash of their id.

    The sample is fitted in one executor task, which holds its texts; bounded_rows()
    keeps them to that many and to bounded bytes where ids repeat. Only the weights (PARTS * 2**DIM_BITS floats) reach the driver. Repeated labels of an id
    count once, the smaller label; ids that match no document and null labels
    are left out. Without labels of both classes the model is a constant.
    """
    rated = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.min(label_col) > 0).cast("int").alias("_y"))
    counts = rated.groupBy("_y").agg(F.count(F.lit(1)).alias("_n"))
    ids = thinned(rated, "_y", id_col, per_class).join(F.broadcast(counts), "_y").select(F.col(id_col).alias("_id"), "_y", (F.col("_n") / F.least(F.col("_n"), F.lit(per_class))).alias("_k"))
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(ids), "_id")
    sample = bounded_rows(sample, "_y", "_id", "_t", per_class).select("_t", "_y", (F.col("_k") * F.col("_f")).alias("_k"), F.pmod(F.xxhash64(F.lit("fold"), "_id"), F.lit(1 << 20)).alias("_o"))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gathered(batches, pa.schema([("_t", pa.string()), ("_y", pa.int32()), ("_k", pa.float64()), ("_o", pa.int64())]))
        t = t.sort_by([("_o", "ascending"), ("_y", "ascending")])
        w, a, c = fit(t["_t"].cast(pa.large_string()).combine_chunks(), t["_y"].to_numpy(), t["_k"].to_numpy(), t["_o"].to_numpy())
        yield pa.record_batch([pa.array([w.tobytes()], pa.binary()), pa.array([a]), pa.array([c])], names=["w", "a", "c"])

    rows = sample.repartition(1).mapInArrow(one, "w binary, a double, c double").collect()
    if not rows:  # an empty sample may run no task
        return fit(pa.array([], pa.large_string()), *(np.zeros(0) for _ in range(3)))
    return np.frombuffer(bytes(rows[0]["w"]), np.float32), rows[0]["a"], rows[0]["c"]


def judged(texts: pa.Array, model: tuple[np.ndarray, float, float], threshold: float = THRESHOLD) -> dict[str, np.ndarray]:
    """The columns of score_quality, but for the id."""
    weights, slope, shift = model
    parts = []
    for _, _, b, offs in X.slices(texts):
        w = X.Words(b, offs)
        sums = X.prefix_sums(b)
        hashes = X.span_hashes(sums, w.start, w.end)
        s = text_stats(b, offs, w, sums, hashes)
        s["quality"] = _sigmoid(slope * _mean_weight(weights, b, offs, w, sums, hashes) + shift)
        parts.append(s)
    s = {k: np.concatenate([np.zeros(0, np.float64 if k == "quality" else np.int64), *(p[k] for p in parts)]) for k in (*STATS, "quality")}
    s = {k: v if k == "quality" else v.astype(np.int64) for k, v in s.items()}
    s["base_failed"] = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
    return s | {"kept": ~s["base_failed"] & (s["quality"] >= threshold)}


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float, float], *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Statistics, base rule, probability and verdict of every whole text.

    Words are runs of bytes other than x09-x0D and x20. Returns the id, n_words,
    word_chars (code points in words), n_symbols (``#*$%&|<>``), n_dup_lines
    (lines with a word that equal an earlier line of the text), n_repeat_words
    (words in three-word windows that occur twice or more in the text),
    base_failed (n_words < 50 or more than half the words repeat), quality (the
    calibrated probability) and kept. A null or empty text has no words, fails the
    base rule and is scored as empty. Other columns are not read; equal rows get
    equal results; no row is dropped.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = judged(batch.column(1), model, threshold)
            yield pa.record_batch([batch.column(0), *(pa.array(s[k]) for k in names[1:])], names=names)

    names = [id_col, *STATS, "base_failed", "quality", "kept"]
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{k} long" for k in STATS) + ", base_failed boolean, quality double, kept boolean"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score_quality keeps, with their own columns; rows and their order of columns stay as they are.

    Null and empty texts and those of fewer than 50 words go; equal rows share
    their fate, ids may be null or repeated, columns may have any name, and an
    empty table stays empty. Only texts travel to the Python workers.
    """
    model = train_quality(docs, labels, id_col=id_col, text_col=text_col)

    @F.arrow_udf("boolean")
    def passes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield pa.array(judged(t, model, threshold)["kept"])

    return docs.where(passes(F.col(text_col)))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model)
