"""Toxicity by a weighted finite-state pattern grammar.

Terminals. Words map to the classes insult, threat, intent, target, negation and
report; quotation marks are a class of their own. Insult terminals are word
beginnings (or whole short words) that labelled toxic documents hold
significantly more often than others, in several texts that are no copies of each
other, weighted by their log-odds. The other classes are the fixed word lists
below; a threat's weight is its log-odds on the labelled rows, drawn towards
THREAT_WEIGHT where they show few of it. Contractions are negations (don't, n'est).

Grammar. One small transducer for each class is run over a clause: insult emits
its word's weight; threat emits its weight, and BARE of it without an intent
before it; negation marks what follows within NEGATION_REACH words; report marks
what follows in the clause, also after a colon; quotation marks mark what they
hold within a line; target marks the clause. Their composition is one table. It
turns a clause into weights of kinds such as "insult aimed at somebody" or
"reported insult"; a clause without an insult or threat gives nothing, and what a
word counts for depends on its clause.

A document's score is a logistic function of its sums of each kind, fitted on
the labelled rows. What all kinds have in common is fitted by one weight of the
kinds in the ratios of PRIOR, and a kind of its own departs from these as far as
the rows show, so kinds that the rows lack keep their ratio.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm import _text as X
from scrivane.llm._kit import bounded_rows, crc_of_id, gathered, table, thinned
from scrivane.llm.jaccard import DEN, NUM, least_overlap, node_of, shingle_sets

OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, QUOTE, END = range(9)
KINDS = ("insult", "aimed insult", "negated insult", "reported insult", "threat", "aimed threat", "negated threat", "reported threat")
#: What a weight of each kind counts for where the labelled rows do not show it.
PRIOR = np.array([1.0, 1.25, 0.3, 0.3, 1.0, 1.25, 0.3, 0.3])
NEGATION_REACH = 3
THREAT_WEIGHT, BARE = 3.0, 0.25
#: Labelled documents that the terminals and weights are fitted on, about.
SAMPLE = {1: 2000, 0: 6000}
SHORTEST, LONGEST_STEM = 4, 8
#: Least log-odds of a terminal; its G statistic must also exceed what chance gives the best of all candidates.
LEAST_ODDS = 2.5

#: Fixed word lists.
WORDS = {
    THREAT: "kill hurt destroy beat burn shoot stab strangle töten umbringen schlagen vernichten verbrennen tuer frapper détruire brûler matar golpear destruir quemar",
    INTENT: "will shall gonna going must werde werden wird wirst soll vais va vas allons voy vamos",
    TARGET: "you your yours yourself u they them those people du dich dir dein deine ihr euch euer sie leute tu te toi ton ta vous votre vos ils gens tú usted ustedes tuyo vosotros ellos gente",
    NEGATION: "not no never none nobody nicht kein keine nie niemals ne pas jamais aucun aucune nunca jamás ningún ninguna",
    REPORT: "said says say wrote writes quoted quotes reported claims claimed called sagte sagt schrieb behauptet zitierte nannte dit disait écrit affirme cité appelé dijo dice escribió afirma citó llamó",
}

_LETTERS = np.ones(256, bool)
_LETTERS[0x61:0x7B] = False
_LETTERS[0x80:] = False
_BREAK = np.zeros(256, bool)
_BREAK[list(b".!?;\n")] = True
_APOSTROPHE, _QUOTATION = ord("'"), ord('"')
#: Typographic marks, by their bytes.
_MARKS = ((b"\xe2\x80\x99", _APOSTROPHE), (b"\xe2\x80\x9c", _QUOTATION), (b"\xe2\x80\x9d", _QUOTATION), (b"\xe2\x80\x9e", _QUOTATION), (b"\xc2\xab", _QUOTATION), (b"\xc2\xbb", _QUOTATION))
_WORD = re.compile(rb"[a-z\x80-\xff]+")

Step = Callable[[int, int], tuple[int, tuple[str, ...]]]


def _insult(state: int, s: int) -> tuple[int, tuple[str, ...]]:
    return 0, ("insult",) if s == INSULT else ()


def _threat(state: int, s: int) -> tuple[int, tuple[str, ...]]:
    return int(state or s == INTENT), () if s != THREAT else ("threat",) if state else ("threat", "bare")


def _quote(state: int, s: int) -> tuple[int, tuple[str, ...]]:
    return int(state != (s == QUOTE)), ("reported",) if state and s in (INSULT, THREAT) else ()


def _negation(state: int, s: int) -> tuple[int, tuple[str, ...]]:
    if s == NEGATION:
        return NEGATION_REACH, ()
    if s == QUOTE:
        return state, ()
    return max(0, state - 1), ("negated",) if state and s in (INSULT, THREAT) else ()


def _report(state: int, s: int) -> tuple[int, tuple[str, ...]]:
    return int(state or s == REPORT), ("reported",) if state and s in (INSULT, THREAT) else ()


def _target(state: int, s: int) -> tuple[int, tuple[str, ...]]:
    return int(state or s == TARGET), ("aimed",) if state and s == END else ()


def compose(machines: list[Step]) -> dict[tuple[int, int], tuple[int, frozenset[str]]]:
    """The product transducer: (state, symbol) to (state, marks), state 0 first."""
    number = {(0,) * len(machines): 0}
    todo, out = list(number), {}
    for state in todo:
        for s in range(END + 1):
            steps = [m(q, s) for m, q in zip(machines, state, strict=True)]
            to = tuple(q for q, _ in steps)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            out[number[state], s] = number[to], frozenset(x for _, marks in steps for x in marks)
    return out


GRAMMAR = compose([_insult, _threat, _negation, _report, _quote, _target])


def clause_weights(symbols: list[int], weights: list[float], gaps: list[int]) -> np.ndarray:
    """Weights by KINDS of one clause; gaps: other words before each symbol."""
    out, state = np.zeros(len(KINDS)), 0
    for s, w, gap in zip(symbols, weights, gaps, strict=True):
        for _ in range(min(gap, NEGATION_REACH)):
            state, _ = GRAMMAR[state, OTHER]
        state, marks = GRAMMAR[state, s]
        if s in (INSULT, THREAT):
            at = 0 if "insult" in marks else 4
            w = w * BARE if "bare" in marks else w
            out[at + (3 if "reported" in marks else 2 if "negated" in marks else 0)] += w
    if "aimed" in GRAMMAR[state, END][1]:
        out[[1, 5]] += out[[0, 4]]
        out[[0, 4]] = 0
    return out


class Lexicon:
    """Terminals as sorted hash tables: word beginnings by their length, and whole words."""

    def __init__(self, stems: dict[bytes, float], words: dict[bytes, float], threats: dict[bytes, float] | None = None):
        def build(entries: list[tuple[bytes, int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            rows = sorted((_hash(t), c, w) for t, c, w in entries)
            return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])

        fixed = {t.encode(): c for c, ws in WORDS.items() for t in ws.split()}
        self.whole = build([(t, c, (threats or {}).get(t, THREAT_WEIGHT)) for t, c in fixed.items() if t not in words] + [(t, INSULT, w) for t, w in words.items()])
        self.stems = {n: build([(t, INSULT, w) for t, w in stems.items() if len(t) == n]) for n in sorted({len(t) for t in stems})}

    def find(self, b: np.ndarray, offs: np.ndarray, w: X.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class and weight of every word of a slice of lower-cased bytes; a stem wins over a whole word."""
        sums = X.prefix_sums(b)
        cls, weight = np.zeros(len(w.start), np.int64), np.zeros(len(w.start))
        for length, (keys, classes, weights) in [(0, self.whole), *self.stems.items()]:
            if not len(keys):
                continue
            fits = np.flatnonzero(w.end - w.start >= length) if length else np.arange(len(w.start))
            stop = w.start[fits] + length if length else w.end
            h = X.span_hashes(sums, w.start[fits], stop)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            better = hit & ((cls[fits] != INSULT) | (weights[at] > weight[fits]))
            cls[fits[better]], weight[fits[better]] = classes[at[better]], weights[at[better]]
        # The t of isn't and the n of n'est are negations, the t of t'es is a target.
        one = np.flatnonzero(w.end - w.start == 1)
        padded = np.concatenate([np.zeros(4, b.dtype), b, np.zeros(1, b.dtype)])
        at, letter = w.start[one], b[w.start[one]]
        doc = np.searchsorted(offs, at, "right") - 1
        before, after = (padded[at + 3] == _APOSTROPHE) & (at > offs[doc]), (padded[at + 5] == _APOSTROPHE) & (at + 1 < offs[doc + 1])
        base = np.where(padded[at + 2] == _APOSTROPHE, padded[at], padded[at + 2])
        cls[one[(letter == ord("t")) & before & (base == ord("n")) | (letter == ord("n")) & after]] = NEGATION
        cls[one[(letter == ord("t")) & ~before & after]] = TARGET
        return cls, weight


def _hash(t: bytes) -> int:
    a = np.frombuffer(t, np.uint8)
    return int(X.span_hashes(X.prefix_sums(a), np.array([0]), np.array([len(a)]))[0])


def _marked(raw: np.ndarray) -> np.ndarray:
    """Lower-cased bytes; typographic apostrophes and quotation marks become plain ones, repeated to keep the length."""
    b = X.lowered(raw)
    for mark, plain in _MARKS:
        if len(b) >= len(mark):
            hit = b[: len(b) - len(mark) + 1] == mark[0]
            for i in range(1, len(mark)):
                hit &= b[i : len(b) - len(mark) + 1 + i] == mark[i]
            at = np.flatnonzero(hit)
            # A quotation mark counts once.
            b[at] = plain
            for i in range(1, len(mark)):
                b[at + i] = plain if plain == _APOSTROPHE else 0x20
    return b


def document_weights(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """For each text its sums of weights by KINDS and, last, its number of words."""
    parts = []
    for _, _, raw, offs in X.slices(texts):
        b = _marked(raw)
        w = X.Words(b, offs, _LETTERS)
        cls, weight = lexicon.find(b, offs, w)
        out = np.zeros((len(offs) - 1, len(KINDS) + 1))
        out[:, -1] = w.count
        known = np.flatnonzero(cls)
        # Quotation marks pair within a line of a document; a last one without a partner is none.
        line_ends = np.union1d(np.flatnonzero(b == 10), offs[1:-1])
        quotes = np.flatnonzero(b == _QUOTATION)
        line = np.searchsorted(line_ends, quotes, "right")
        starts = np.flatnonzero(np.diff(line, prepend=-1))
        per_line = np.diff(np.append(starts, len(quotes)))
        quotes = np.delete(quotes, (starts + per_line - 1)[per_line % 2 == 1])
        # Words and quotation marks in order: byte, class, weight, words before it and up to it.
        place = np.concatenate([w.start[known], quotes])
        before = np.concatenate([known, np.searchsorted(w.start, quotes)])
        symbol = np.concatenate([cls[known], np.full(len(quotes), QUOTE)])
        order = np.argsort(place, kind="stable")
        place, before, symbol = place[order], before[order], symbol[order]
        value = np.concatenate([weight[known], np.zeros(len(quotes))])[order]
        upto = before + (symbol != QUOTE)
        doc = np.searchsorted(offs, place, "right") - 1
        clause_ends = np.union1d(np.flatnonzero(_BREAK[b]), offs[1:-1])
        clause = np.searchsorted(clause_ends, place, "right")
        hot = (symbol == INSULT) | (symbol == THREAT)
        for c in np.unique(clause[hot]).tolist():
            s, e = np.searchsorted(clause, [c, c + 1])
            gaps = [0, *(before[s + 1 : e] - upto[s : e - 1]).tolist()]
            symbols, values = symbol[s:e].tolist(), value[s:e].tolist()
            from_ = clause_ends[c - 1] if c else 0
            opened = np.searchsorted(quotes, from_) - np.searchsorted(quotes, line_ends[i - 1] if (i := np.searchsorted(line_ends, from_, "right")) else 0)
            if opened % 2:
                symbols, values, gaps = [QUOTE, *symbols], [0.0, *values], [0, *gaps]
            out[doc[s], :-1] += clause_weights(symbols, values, gaps)
        parts.append(out)
    return np.concatenate(parts) if parts else np.zeros((0, len(KINDS) + 1))


def _families(texts: pa.Array) -> list[int]:
    """A number for each text that near copies share: those that links of word shingle Jaccard similarity 0.8 or more connect.

    Copies of one document are one piece of evidence for a terminal, not many.
    Every link is an exact comparison. Two sets that link share one of their
    first n - ceil(0.8 n) + 1 shingles, rare ones first, so lists of these find
    all pairs to compare; a list is a number whose bits are its texts.
    """
    sets = list(shingle_sets(texts))
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    same: dict[int, int] = {}
    for d, s in enumerate(sets):
        if len(s):
            parent[d] = same.setdefault(node_of(s), d)
    hashes, held = np.unique(np.concatenate([np.zeros(0, np.uint64), *(sets[d] for d in same.values())]), return_counts=True)
    lists: dict[int, int] = {}
    for d in same.values():
        s = sets[d]
        count = held[np.searchsorted(hashes, s)]
        short = np.argsort(count, kind="stable")[: len(s) + (-NUM * len(s)) // DEN + 1]
        near, short = 0, s[short[count[short] > 1]].tolist()
        for t in short:
            near |= lists.get(t, 0)
            lists[t] = lists.get(t, 0) | 1 << d
        while near:
            e = near.bit_length() - 1
            near ^= 1 << e
            if root(e) != root(d) and len(np.intersect1d(s, sets[e], assume_unique=True)) >= least_overlap(len(s), len(sets[e])):
                parent[root(d)] = root(e)
    return [root(i) for i in range(len(sets))]


def _threats(texts: pa.Array, toxic: np.ndarray, families: list[int]) -> dict[bytes, float]:
    """Weights of the threat terminals: log-odds, drawn towards THREAT_WEIGHT by as much as ten texts."""
    words = {t.encode() for t in WORDS[THREAT].split()}
    yes, no = Counter(), Counter()
    held: dict[int, set[bytes]] = {}
    toxic_families = iter(families)
    for i, y in enumerate(toxic):
        found = words.intersection(_WORD.findall(_marked(np.frombuffer((texts[i].as_py() or "").encode(), np.uint8)).tobytes()))
        if y:
            held.setdefault(next(toxic_families), set()).update(found)
        else:
            no.update(found)
    for found in held.values():
        yes.update(found)
    n1, n0, out = len(held), int((1 - toxic).sum()), {}
    for t in words:
        n = yes[t] + no[t]
        odds = math.log((yes[t] + 0.5) / (n1 + 1)) - math.log((no[t] + 0.5) / (n0 + 1))
        out[t] = max(0.0, (n * odds + 10 * THREAT_WEIGHT) / (n + 10)) if n else THREAT_WEIGHT
    return out


def _terminals(texts: pa.Array, toxic: np.ndarray) -> tuple[dict[bytes, float], dict[bytes, float], dict[bytes, float]]:
    """Word beginnings and whole short words that toxic documents hold significantly more often, and the threats' weights."""

    def candidates(text: str | None) -> set[bytes]:
        found = set()
        for t in set(_WORD.findall(_marked(np.frombuffer((text or "").encode(), np.uint8)).tobytes())):
            found.add(t + b"$" if len(t) < LONGEST_STEM else t[:LONGEST_STEM])
            found.update(t[:n] for n in range(SHORTEST, min(len(t), LONGEST_STEM) + 1))
        return found

    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    if not n1 or not n0:
        return {}, {}, {}
    yes, no = Counter(), Counter()
    rows = texts.take(pa.array(np.flatnonzero(toxic == 1)))
    families: dict[int, set[bytes]] = {}
    of_row = _families(rows)
    for family, text in zip(of_row, rows, strict=True):
        families.setdefault(family, set()).update(candidates(text.as_py()))
    for found in families.values():
        yes.update(found)
    n1 = len(families)
    yes = Counter({t: a for t, a in yes.items() if a >= 4})
    for i in np.flatnonzero(toxic == 0):
        no.update(c for c in candidates(texts[i].as_py()) if c in yes)
    bar = 2 * math.log(len(yes) + 1) + 2

    def gain(t: bytes) -> float:
        a, b, share = yes[t], no[t], n1 / (n1 + n0)
        return 2 * (a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0))

    def odds(t: bytes) -> float:
        return math.log((yes[t] + 0.5) / (n1 + 1)) - math.log((no[t] + 0.5) / (n0 + 1))

    good = sorted((t for t in yes if odds(t) >= LEAST_ODDS and gain(t) >= bar), key=lambda t: (-gain(t), -len(t), t))
    stems: dict[bytes, float] = {}
    words: dict[bytes, float] = {}
    for t in good:
        bare = t.rstrip(b"$")
        # One of a chain of beginnings is enough: the one of the largest gain.
        if any(bare.startswith(s) or s.startswith(bare) for s in (*stems, *words)):
            continue
        (words if t.endswith(b"$") else stems)[bare] = odds(t)
    return stems, words, _threats(texts, toxic, of_row)


class Model(NamedTuple):
    stems: dict[bytes, float]
    words: dict[bytes, float]
    threats: dict[bytes, float]
    coef: np.ndarray


def _inputs(sums: np.ndarray) -> np.ndarray:
    """Two inputs of the kinds in the ratios of PRIOR, two of each kind, and a constant."""
    n = np.maximum(sums[:, -1:], 20)
    kinds = sums[:, :-1]
    together = kinds @ PRIOR[:, None]
    return np.concatenate([np.log1p(together), np.log1p(100 * together / n), np.log1p(kinds), np.log1p(100 * kinds / n), np.ones_like(n)], 1)


def fit(texts: pa.Array, toxic: np.ndarray, weight: np.ndarray) -> Model:
    stems, words, threats = _terminals(texts, toxic)
    x = _inputs(document_weights(texts, Lexicon(stems, words, threats)))
    coef, k = np.zeros(x.shape[1]), weight / max(weight.sum(), 1e-9)
    penalty = np.full(x.shape[1], 1e-3)
    penalty[:2], penalty[-1] = 1e-4, 1e-9
    share = float(np.clip((k * toxic).sum(), 1e-3, 1 - 1e-3)) if len(toxic) else 1e-3
    coef[-1] = math.log(share / (1 - share))
    for _ in range(40 if len(toxic) and 0 < toxic.mean() < 1 else 0):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -35, 35)))
        g = x.T @ ((p - toxic) * k) + penalty * coef
        h = (x * (k * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        coef = coef - step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
    return Model(stems, words, threats, coef)


def train_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: dict[int, int] | None = None) -> Model:
    """Fit terminals and weights on about ``sample[label]`` labelled rows of each label, chosen by a hash of their id.

    One executor task holds the sample, which bounded_rows() keeps to that many rows
    and to bounded bytes where ids repeat; the terminals and a few coefficients reach
    the driver. Repeated labels of an id count once, the larger label;
    null labels and ids without a document are left out. Without toxic rows the
    lexicon is empty and every document gets the same low score.
    """
    sample = sample or SAMPLE
    rated = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("_y"))
    counts = rated.groupBy("_y").agg(F.count(F.lit(1)).alias("_n"))
    parts = [thinned(rated.where(F.col("_y") == y), "_y", id_col, most).withColumn("_m", F.lit(float(most))) for y, most in sample.items()]
    ids = parts[0].unionByName(parts[1]).join(F.broadcast(counts), "_y").select(F.col(id_col).alias("_id"), "_y", (F.col("_n") / F.least(F.col("_n"), F.col("_m"))).alias("_k"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(ids), "_id").select("_t", "_y", "_k", "_id")
    rows = bounded_rows(rows, "_y", "_id", "_t", sample).select("_t", "_y", (F.col("_k") * F.col("_f")).alias("_k"), "_id")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gathered(batches, pa.schema([("_t", pa.string()), ("_y", pa.int32()), ("_k", pa.float64()), ("_id", pa.int64())]))
        t = t.sort_by([("_id", "ascending"), ("_t", "ascending")])
        m = fit(t["_t"].cast(pa.large_string()).combine_chunks(), t["_y"].to_numpy(), t["_k"].to_numpy())
        for text, kind, v in [*((s, kind, v) for kind, found in (("stem", m.stems), ("word", m.words), ("threat", m.threats)) for s, v in found.items()), *((b"%d" % i, "coef", v) for i, v in enumerate(m.coef))]:
            yield pa.record_batch([pa.array([text], pa.binary()), pa.array([kind]), pa.array([float(v)])], names=["t", "kind", "v"])

    got = rows.withColumn("_id", F.pmod(F.xxhash64("_id"), F.lit(1 << 62))).repartition(1).mapInArrow(one, "t binary, kind string, v double").collect()
    if not got:  # an empty sample may run no task
        return fit(pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0))
    by = {k: {bytes(r["t"]): r["v"] for r in got if r["kind"] == k} for k in ("stem", "word", "threat", "coef")}
    return Model(by["stem"], by["word"], by["threat"], np.array([by["coef"][b"%d" % i] for i in range(len(by["coef"]))]))


def score_toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text.

    Returns the id, score (0 to 1), predicted (1 where score >= 0.5), and a
    column of summed weights for each of KINDS. A null or empty text scores as
    one without matches. Other columns are not read; equal rows get equal
    results; no row is dropped.
    """
    stems, words, threats, coef = model
    kind = dict(docs.select(id_col).dtypes)[id_col]
    names = [id_col, "score", "predicted", *(k.replace(" ", "_") for k in KINDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(stems, words, threats)
        for batch in batches:
            sums = document_weights(batch.column(1), lexicon)
            score = 1 / (1 + np.exp(-np.clip(_inputs(sums) @ coef, -35, 35)))
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), *(pa.array(sums[:, i]) for i in range(len(KINDS)))], names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, " + ", ".join(f"{n} double" for n in names[3:]))


def op2_toxic_clauses(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_of_id("doc_id", 5) == 0
    model = train_toxicity(docs, table(spark, sf_dir, "labels").where(~held))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held.alias("held_out"), *scored.columns[1:])
