"""Language ID by multilingual mixture inference.

Each language has a smoothed model of hashed byte trigrams, counted over a
bounded sample of labelled documents. A document is a mixture of languages: its
words have n-gram likelihoods under every language, expectation-maximisation
estimates the document's proportions, and the language set is the one of the
best log-likelihood less a penalty for each language beyond the first. Sets are
the k likeliest languages, for every k up to all learned languages that a bound
on the likelihood leaves open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm import _text as X
from scrivane.llm._kit import bounded_rows, crc_of_id, gathered, table, thinned

BITS = 16
#: Documents of each language that its model is counted on, about.
SAMPLE_PER_LANGUAGE = 1000
MOST_LANGUAGES = 400
#: Bytes of a language's texts that the models are counted on, about.
BYTES_PER_LANGUAGE = 8 << 20
SMOOTHING = 0.3
ROUNDS = 8
#: Log-likelihood that a further language must gain, times the log of the number of words.
PENALTY = 3.0
UNKNOWN = "und"
#: Bytes times languages of likelihoods that are made at once.
CELLS = 1 << 21

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True

Model = tuple[list[str], np.ndarray]


def _grams(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram at each byte (the text padded with blanks), and which of them hold a letter."""
    c = np.full(len(b) + 2, 0x20, np.uint8)
    c[:-2] = _LETTER[b]
    # Capitals of Latin-1 in UTF-8: C3 80-9E, but for the multiplication sign.
    tail = c[1:]
    tail[(c[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 0x20
    v = c.astype(np.uint32)
    g = (v[:-2] * np.uint32(0x9E3779B1)) ^ (v[1:-1] * np.uint32(0x85EBCA6B)) ^ (v[2:] * np.uint32(0xC2B2AE35))
    g ^= g >> np.uint32(15)
    solid = c != 0x20
    return ((g * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)).astype(np.int64), solid[:-2] | solid[1:-1] | solid[2:]


def _whole(ok: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Drop trigrams that would reach into the next document of a slice."""
    for back in (1, 2):
        at = offs[1:-1] - back
        ok[at[at >= 0]] = False
    return ok


def fit(texts: pa.Array, langs: list[str]) -> Model:
    names = sorted(set(langs))
    of = {n: i for i, n in enumerate(names)}
    counts = np.zeros((len(names), 1 << BITS))
    row = np.array([of[x] for x in langs], np.int64)
    for lo, _, b, offs in X.slices(texts):
        g, ok = _grams(b)
        ok = _whole(ok, offs)
        at = np.repeat(row[lo : lo + len(offs) - 1], np.diff(offs))
        counts += np.bincount((at[ok] << BITS) | g[ok], minlength=counts.size).reshape(counts.shape)
    shared = (counts.sum(0) + 1) / (counts.sum() + counts.shape[1])
    smooth = SMOOTHING * (1 << BITS) * shared
    return names, np.ascontiguousarray(np.log((counts + smooth) / (counts.sum(1, keepdims=True) + smooth.sum())).T.astype(np.float32))


def train_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Count the models on about ``per_language`` documents of each language, chosen by a hash of their id.

    ``docs`` are the rows to learn from; null languages, ids and texts are left
    out. The sample is counted in one executor task (bounded_rows() keeps it to that
    many rows and to BYTES_PER_LANGUAGE where ids repeat) and only the tables reach
    the driver. Without a usable row there are no languages.
    """
    ids = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_l"))
    names = ids.select("_l").distinct().limit(MOST_LANGUAGES + 1).count()
    if names > MOST_LANGUAGES:  # also bounds the picked ids
        raise ValueError(f"more than {MOST_LANGUAGES} languages; merge rare values of {lang_col} first")
    picked = thinned(ids, "_l", "_id", per_language).distinct()
    sample = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_l"), F.col(text_col).alias("_t")).join(F.broadcast(picked), ["_id", "_l"], "left_semi")
    sample = bounded_rows(sample, "_l", "_id", "_t", per_language, BYTES_PER_LANGUAGE).select("_t", "_l")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gathered(batches, pa.schema([("_t", pa.string()), ("_l", pa.string())]))
        names, logs = fit(t["_t"].cast(pa.large_string()).combine_chunks(), t["_l"].to_pylist())
        for i, name in enumerate(names):
            yield pa.record_batch([pa.array([name]), pa.array([logs[:, i].tobytes()], pa.binary())], names=["name", "logs"])

    rows = sorted(sample.repartition(1).mapInArrow(one, "name string, logs binary").collect())
    return [r["name"] for r in rows], np.ascontiguousarray(np.stack([np.frombuffer(bytes(r["logs"]), np.float32) for r in rows], 1)) if rows else np.zeros((1 << BITS, 0), np.float32)


Chunks = Callable[[], Iterable[tuple[int, int, np.ndarray]]]


def _sums(x: np.ndarray, doc: np.ndarray, out: np.ndarray) -> None:
    """Adds the rows of x to those of out that ``doc`` names, which ascends."""
    at = np.flatnonzero(np.diff(doc, prepend=-1))
    out[doc[at]] += np.add.reduceat(x, at, axis=0)


def _em(chunks: Chunks, doc: np.ndarray, n: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages of each document, and the log-likelihood less that of the scaling.

    chunks: (from, to, likelihoods) of runs of words; doc: each word's document, or
    -1 where it takes no part; n: words of each document.
    """
    pi = allowed / allowed.sum(1, keepdims=True)
    for round_ in range(ROUNDS + 1):
        sums, ll = np.zeros_like(pi), np.zeros(len(n))
        for lo, hi, p in chunks():
            of = doc[lo:hi]
            if (of < 0).any():
                p, of = p[of >= 0], of[of >= 0]
            if len(of):
                r = p * pi[of]
                s = r.sum(1)
                if round_ < ROUNDS:
                    _sums(r / s[:, None], of, sums)
                else:
                    _sums(np.log(s), of, ll)
        if round_ < ROUNDS:
            pi = sums / n[:, None]
    return pi, ll


def mixtures(b: np.ndarray, offs: np.ndarray, w: X.Words, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document of a slice: proportions of its languages under the best language set (0 for others), and under all.

    Likelihoods are made for CELLS bytes times languages at once. A slice that
    needs several such chunks (a long text, or many languages) makes them again in
    every round, so memory does not grow with them.
    """
    docs, langs = len(w.count), logs.shape[1]
    best, full = np.zeros((docs, langs)), np.zeros((docs, langs))
    some = np.flatnonzero(w.count)
    if not len(some) or not langs:
        return best, full
    g, ok = _grams(b)
    ok = _whole(ok, offs)
    n = w.count[some]
    doc = np.repeat(np.arange(len(some)), n)
    stop = np.append(w.start[1:], len(b))
    stop[w.first[1:][some] - 1] = offs[1:][some]
    edges = np.unique(np.append(np.searchsorted(w.start, np.arange(0, len(b), max(1, CELLS // langs))), len(w.start)))

    def made() -> Iterator[tuple[int, int, np.ndarray]]:
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            from_, to = w.start[lo], stop[hi - 1]
            ll = np.zeros((to - from_ + 1, langs), np.float32)
            ll[:-1] = np.where(ok[from_:to, None], logs[g[from_:to]], np.float32(0))
            unit = np.add.reduceat(ll, np.stack([w.start[lo:hi] - from_, stop[lo:hi] - from_], 1).ravel(), axis=0)[::2].astype(np.float64)
            yield lo, hi, np.maximum(np.exp(unit - unit.max(1, keepdims=True)), 1e-12)

    whole = list(made()) if len(edges) == 2 else None
    chunks: Chunks = made if whole is None else lambda: whole
    single = np.zeros((len(some), langs))
    for lo, hi, p in chunks():
        _sums(np.log(p), doc[lo:hi], single)
    pi, whole_ll = _em(chunks, doc, n, np.ones((len(some), langs)))
    order = np.argsort(-pi, axis=1, kind="stable")
    chosen = np.eye(langs)[single.argmax(1)]
    score = single.max(1)
    n_log = PENALTY * np.log(n + 2.0)
    # Log-likelihoods are concave in the proportions, so the gradient at pi bounds those of all sets from above.
    slope = np.zeros((len(some), langs))
    for lo, hi, p in chunks():
        _sums(p / (p * pi[doc[lo:hi]]).sum(1, keepdims=True), doc[lo:hi], slope)
    most = whole_ll + slope.max(1) - n + 1e-6 * (1 + np.abs(whole_ll))
    for k in range(2, langs + 1):
        # Where even the bound is no gain, neither this size nor a larger one is.
        open_ = most - n_log * (k - 1) > score
        if not open_.any():
            break
        if k == langs:
            part, fit_ll = pi[open_], whole_ll[open_]
        else:
            allowed = np.zeros((int(open_.sum()), langs))
            np.put_along_axis(allowed, order[open_, :k], 1.0, axis=1)
            number = np.where(open_, np.cumsum(open_) - 1, -1)
            part, fit_ll = _em(chunks, number[doc], n[open_], allowed)
        gain = fit_ll - n_log[open_] * (k - 1)
        better = gain > score[open_]
        at = np.flatnonzero(open_)[better]
        score[at], chosen[at] = gain[better], part[better]
    best[some], full[some] = chosen, pi
    return best, full


def has_letter(b: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which documents of a slice hold a letter of any script."""
    seen = np.zeros(len(b) + 1, np.int64)
    np.cumsum(_ASCII_LETTER[b], out=seen[1:])
    out = seen[offs[1:]] > seen[offs[:-1]]
    for d in np.flatnonzero(~out):
        out[d] = any(c.isalpha() for c in b[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "ignore"))
    return out


def predicted(texts: pa.Array, model: Model) -> tuple[list[str], list[float], list[str], list[str]]:
    """lang_pred, score, langs and shares of each text; see identify_language."""
    names, logs = model
    pred, score, sets, shares = [], [], [], []
    for _, _, b, offs in X.slices(texts):
        w = X.Words(b, offs)
        best, full = mixtures(b, offs, w, logs)
        for d, ok in enumerate(has_letter(b, offs) & bool(names)):
            order = [i for i in np.argsort(-best[d], kind="stable") if best[d][i] >= 0.005] if ok else []
            pred.append(names[order[0]] if order else UNKNOWN)
            score.append(float(min(1.0, full[d][order[0]])) if order else 0.0)
            sets.append(",".join(names[i] for i in order))
            shares.append(",".join(f"{best[d][i]:.3f}" for i in order))
    return pred, score, sets, shares


def identify_language(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict the language of every whole text.

    Returns the id, lang_pred (the language of the largest proportion in the
    best language set; ``und`` for a null text, one without a letter, or a model
    without languages), score (its proportion under all languages, 0 to 1; 0 for
    ``und``), langs (the set, largest first, as text with commas) and shares
    (their proportions, likewise). Ties go to the language that sorts first.
    Equal rows get equal results; no row is dropped; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, sets, shares = predicted(batch.column(1), model)
            yield pa.record_batch([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string()), pa.array(shares, pa.string())], names=[id_col, "lang_pred", "score", "langs", "shares"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, langs string, shares string")


def keep_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The documents whose language is known with a proportion of ``least`` or more, with their own columns.

    The languages are those of ``lang_col``. Null texts and those without a letter
    go; equal rows share their fate, ids may be null or repeated, columns may have
    any name, and an empty table stays empty. Only texts travel to the Python
    workers. A corpus with letters from which no language is learned (no row has
    a language, an id and a text) is an error, because every document of it would
    be dropped.
    """
    model = train_language(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    if not model[0] and not docs.where(F.col(text_col).rlike(r"\p{L}")).isEmpty():
        raise ValueError(f"no language can be learned: no row has {lang_col}, {id_col} and {text_col}")

    @F.arrow_udf("boolean")
    def known(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            pred, score, _, _ = predicted(t, model)
            yield pa.array([p != UNKNOWN and s >= least for p, s in zip(pred, score, strict=True)], pa.bool_())

    return docs.where(known(F.col(text_col)))


def op3_language_mixture(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_of_id("doc_id", 3) == 1
    model = train_language(docs.where(~held))
    return identify_language(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "langs", "shares")
