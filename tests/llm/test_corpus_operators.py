"""Each operator against brute force, and on the tables that go wrong."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import WORD, base_stats, clause_brute, jaccard_brute
from pyspark.sql import functions as F

from scrivane.llm import embeddings, jaccard, language, licenses, mixing, packing, quality, sharding, toxicity, urls
from scrivane.llm._graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for their own columns.
CLASH = ["_id", "_t", "node", "n", "short", "shard", "slot", "law", "_row", "_s", "_h", "size", "score", "kept", "sequence_id", "component_id", "host", "rule", "quality"]


def awkward(spark):
    long = " ".join(f"w{i % 701}x{i % 13}" for i in range(60_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "  \n\t ", None, "a", 5), (4, "one", "en", "b", 3), (5, "one", "en", "b", 3), (5, "one", "en", "b", 3), (6, long, "en", "a", len(long)),
        (None, "no id here at all", "en", None, 1), (8, "é\u3000ü\x1c ñ", "fr", "ä", 5), (9, "x" * 30_000, None, "a", 30_000), (10, "a b c d e f g h", None, "b", 15), (11, "A B  C D E f G h", None, None, 15),
    ]
    d = spark.createDataFrame(rows, DOCS)
    return d.select("*", *(F.lit("clash").alias(c) for c in CLASH))


def empty(spark):
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark, sf):
    return {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "embeddings", "pages")}


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 130)]
    parent = {x: x for p in links for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for p in links for x in p if p[0] != p[1]}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


# Jaccard join.


def edited(base, rng, words, n):
    w = base.split(" ")
    for i in rng.integers(0, len(w), n):
        w[i] = words[rng.integers(len(words))]
    return " ".join(w)


@pytest.mark.parametrize("probes", [2, jaccard.PROBES])
def test_jaccard_equals_brute_force(spark, monkeypatch, probes):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "PROBES", probes)
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words, 60))
    docs = {}
    for _ in range(8):
        base = " ".join(rng.choice(words, int(rng.integers(20, 250))))
        for _ in range(int(rng.integers(1, 14))):
            docs[len(docs)] = edited(base, rng, words, int(rng.integers(0, 9)))
    for _ in range(25):
        docs[len(docs)] = passage + " " + " ".join(rng.choice(words, int(rng.integers(2, 80))))
    for t in ("a b", "A b", "a b c", "", None, "  ", "p q r s t", "P q R s\nt", "p q r s t u"):
        docs[len(docs)] = t
    got = jaccard.jaccard_classes(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == jaccard_brute(docs.items())


def test_jaccard_in_parts_of_frequent_lists(spark, monkeypatch):
    """With every shingle frequent and lists in several parts, links stay the same."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    base = " ".join(rng.choice(words, 120))
    docs = {i: edited(base, rng, words, int(rng.integers(0, 6))) for i in range(40)}
    monkeypatch.setattr(jaccard, "frequency_levels", lambda *a: np.full(1 << jaccard.COUNT_BITS, 9, np.uint8))
    got = jaccard.jaccard_classes(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == jaccard_brute(docs.items())


def test_jaccard_awkward(spark):
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in jaccard.jaccard_classes(awkward(spark)).collect()))
    assert len(got) == 12 and [x for x in got if x[0] in (1, 2, 3)] == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert [x for x in got if x[0] in (4, 5)] == [(4, 1, 4), (5, 1, 4), (5, 1, 4)] and [x[2] for x in got if x[0] in (10, 11)] == [10, 10]
    assert jaccard.jaccard_classes(empty(spark)).isEmpty()
    kept = jaccard.keep_one_of_each(awkward(spark))
    assert kept.columns == awkward(spark).columns and 5 not in {r["doc_id"] for r in kept.collect()}


def test_jaccard_keeps_rows_and_not_ids(spark):
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in jaccard.keep_one_of_each(awkward(spark)).collect())
    assert [i for i, _ in got] == [0, 1, 2, 3, 4, 6, 8, 9, 10] and got[0][1] == "no id here at all"
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(400)]
    a, b, c, d = (" ".join(rng.choice(words, 100)) for _ in range(4))
    rows = [
        (5, "one two"), (5, "one two"), (5, "ONE two"), (7, a), (8, b), (8, edited(a, rng, words, 2)), (None, c), (None, edited(c, rng, words, 2)),
        (None, d), (9, edited(d, rng, words, 2)), (None, "alone"), (2, ""), (2, ""), (None, None),
    ]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _kept int, _key int")
    kept = jaccard.keep_one_of_each(docs)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == docs.columns and len(got) == 9 and Counter(i for i, _ in got) == {5: 1, 7: 1, 8: 1, 9: 1, 2: 2, None: 3}
    assert {(7, a), (8, b), (9, rows[9][1]), (None, "alone"), (None, None)} <= set(got) and len({t for _, t in got} & {c, rows[7][1]}) == 1
    assert len(jaccard.keep_one_of_each(docs.where("doc_id is null")).collect()) == 4


def test_jaccard_links_rows_without_ids(spark):
    """Only a chain through texts without ids ties the first to the id."""
    w = [f"w{i}" for i in range(100)]
    chain = [(None, " ".join(w))]
    for at, i in ((10, None), (50, 9)):
        w[at], w[at + 20] = "x", "y"
        chain.append((i, " ".join(w)))
    sets = jaccard_brute([(i, t) for i, (_, t) in enumerate(chain[::2])])
    assert sets[0][1] != sets[1][1]
    got = jaccard.jaccard_classes(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    assert [(r["doc_id"] or 0, r["component_id"]) for r in sorted(got, key=lambda r: r["doc_id"] or 0)] == [(0, 9), (0, 9), (9, 9)]


# Quality rules.


def test_quality_statistics_and_accuracy(spark, tables):
    docs = tables["documents"]
    model = quality.train_quality(docs, tables["labels"].where("doc_id % 2 = 0"))
    got = {r["doc_id"]: r for r in quality.score_quality(docs, model).collect()}
    for d in docs.collect():
        r = got[d["doc_id"]]
        assert (*(r[c] for c in quality.STATS), r["base_failed"]) == base_stats(d["text"])
        assert not (r["base_failed"] and r["kept"])
    held = [(r["quality"], got[r["doc_id"]]) for r in tables["labels"].where("doc_id % 2 = 1").collect()]
    judged = [(y, r["kept"]) for y, r in held if not r["base_failed"]]
    assert sum(y == k for y, k in judged) >= 0.9 * len(judged)


def test_quality_weights_are_means_over_grams():
    """The vectorised score of each text is the sum of three plain means: over words, pairs of words and runs of code points."""
    rng = np.random.default_rng(14)
    weights = rng.standard_normal(quality.PARTS << quality.DIM_BITS).astype(np.float32)
    texts = ["héllo wörld foo bar", "", "a", "a b", " x\ty ", "日本語テキスト です", "ab", *(" ".join(rng.choice(["ñu", "oak", "e", "日本"], 30)) for _ in range(5))]
    mask = (1 << quality.DIM_BITS) - 1

    def mean(hashes, part):
        return float(np.mean([weights[((int(h) >> 20) & mask) + (part << quality.DIM_BITS)] for h in hashes])) if len(hashes) else 0.0

    want = []
    for t in texts:
        h = np.array([quality.X.hash_text(x) for x in WORD.findall(t)], np.uint64)
        runs = [quality.X.hash_text(t[i : i + quality.CHAR_N]) for i in range(len(t) - quality.CHAR_N + 1)]
        want.append(mean(h, 0) + mean(quality.X.windows(h, 2), 1) + mean(runs, 2))
    got = quality.judged(pa.array(texts, pa.large_string()), (weights, 1.0, 0.0))["quality"]
    assert np.allclose(got, 1 / (1 + np.exp(-np.array(want))), atol=1e-5)


def test_quality_probabilities_are_calibrated():
    """Rows whose label is drawn with a known chance: the mean probability is the share of good rows, in all and by thirds."""
    rng = np.random.default_rng(15)
    share = rng.random(3000)
    texts = pa.array([" ".join("good" if x else "bad" for x in rng.random(40) < s) for s in share], pa.large_string())
    y = (rng.random(3000) < share).astype(int)
    model = quality.fit(texts, y, np.ones(3000), np.arange(3000))
    p = quality.judged(texts, model)["quality"]
    thirds = np.array_split(np.argsort(share), 3)
    assert abs(p.mean() - y.mean()) < 0.05 and all(abs(p[t].mean() - y[t].mean()) < 0.1 for t in thirds)


def test_quality_awkward(spark):
    model = quality.train_quality(awkward(spark), spark.createDataFrame([(6, 1, 0), (6, 1, 0), (9, 0, 0), (77, 1, 1), (None, 1, 1), (4, None, None)], LABELS))
    got = quality.score_quality(awkward(spark), model).collect()
    assert len(got) == 12 and all((*(r[c] for c in quality.STATS),)[0] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    none = quality.train_quality(empty(spark), spark.createDataFrame([], LABELS))
    assert all(r["kept"] == (not r["base_failed"]) for r in quality.score_quality(awkward(spark), none).collect())
    assert quality.score_quality(empty(spark), none).isEmpty()
    assert quality.keep_quality(awkward(spark), spark.createDataFrame([], LABELS)).columns == awkward(spark).columns


# Language.


def test_language_accuracy_and_mixtures(spark, tables):
    docs = tables["documents"]
    model = language.train_language(docs.where("doc_id % 2 = 0"))
    got = {r["doc_id"]: r for r in language.identify_language(docs, model).collect()}
    held = docs.where("doc_id % 2 = 1 and lang is not null").collect()
    assert sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.97 * len(held)
    # A document of two halves is a mixture of both languages.
    by = {}
    for d in docs.where("lang in ('en', 'fr') and n_chars between 900 and 4000").collect():
        by.setdefault(d["lang"], " ".join(WORD.findall(d["text"])[:120]))
    both = spark.createDataFrame([(1, by["en"] + " " + by["fr"]), (2, by["en"])], "doc_id long, text string")
    sets = {r["doc_id"]: set(r["langs"].split(",")) for r in language.identify_language(both, model).collect()}
    assert sets == {1: {"en", "fr"}, 2: {"en"}}


def test_language_sets_of_all_sizes(spark, tables):
    docs = tables["documents"]
    model = language.train_language(docs)
    by = {}
    for d in docs.where("lang is not null and n_chars between 900 and 4000").collect():
        by.setdefault(d["lang"], " ".join(WORD.findall(d["text"])[:120]))
    names = sorted(by)
    assert names == ["de", "en", "es", "fr"]
    rows = [(k, " ".join(by[x] for x in names[:k])) for k in range(1, 5)]
    got = {r["doc_id"]: (set(r["langs"].split(",")), sum(map(float, r["shares"].split(",")))) for r in language.identify_language(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(got[k][0] == set(names[:k]) and abs(got[k][1] - 1) < 0.01 for k in range(1, 5))


def em_plain(p, allowed):
    """Proportions and log-likelihood of the allowed languages for one document's words, one by one."""
    pi = [1 / len(allowed)] * len(allowed)
    for _ in range(language.ROUNDS):
        sums = [0.0] * len(allowed)
        for row in p:
            r = [row[j] * x for j, x in zip(allowed, pi, strict=True)]
            sums = [s + x / sum(r) for s, x in zip(sums, r, strict=True)]
        pi = [s / len(p) for s in sums]
    return pi, sum(math.log(sum(row[j] * x for j, x in zip(allowed, pi, strict=True))) for row in p)


@pytest.mark.parametrize("cells", [1 << 21, 64])
def test_language_sets_equal_plain_em(monkeypatch, cells):
    """The proportions, and the set of the best penalised likelihood among all sizes, by loops over words; in one chunk and in many."""
    monkeypatch.setattr(language, "CELLS", cells)
    rng = np.random.default_rng(31)
    alphabets = ["abcdef", "efghij", "ijklmn", "mnopqr"]
    word = lambda k: "".join(rng.choice(list(alphabets[k]), int(rng.integers(2, 8))))
    model = language.fit(pa.array([" ".join(word(k) for _ in range(300)) for k in range(4)], pa.large_string()), ["l0", "l1", "l2", "l3"])
    texts = [" ".join(word(int(k)) for k in rng.choice(kinds, n)) for kinds, n in (([0], 40), ([0, 1], 60), ([0, 2, 3], 90), ([0, 1, 2, 3], 200), ([3], 1))]
    b = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *(len(t) for t in texts)])
    w = language.X.Words(b, offs)
    best, full = language.mixtures(b, offs, w, model[1])
    grams, ok = language._grams(b)
    ok = language._whole(ok, offs)
    for d in range(len(texts)):
        p = []
        for i in range(w.first[d], w.first[d + 1]):
            stop = w.start[i + 1] if i + 1 < w.first[d + 1] else offs[d + 1]
            ll = sum(model[1][grams[x]].astype(float) for x in range(w.start[i], stop) if ok[x]) + np.zeros(4)
            p.append(np.maximum(np.exp(ll - ll.max()), 1e-12).tolist())
        pi, _ = em_plain(p, [0, 1, 2, 3])
        assert np.allclose(full[d], pi, atol=1e-4)
        order = sorted(range(4), key=lambda j: -pi[j])
        single = max(range(4), key=lambda j: sum(math.log(r[j]) for r in p))
        fits = [(sum(math.log(r[single]) for r in p), {single: 1.0})]
        for k in range(2, 5):
            part, ll = em_plain(p, sorted(order[:k]))
            fits.append((ll - language.PENALTY * math.log(len(p) + 2) * (k - 1), dict(zip(sorted(order[:k]), part, strict=True))))
        chosen = max(fits, key=lambda f: f[0])[1]
        assert np.allclose(best[d], [chosen.get(j, 0.0) for j in range(4)], atol=1e-4)


def test_language_awkward(spark):
    model = language.train_language(awkward(spark))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify_language(awkward(spark), model).collect()]
    assert len(got) == 12 and all(0 <= s <= 1 for _, _, s in got)
    assert {(i, p) for i, p, _ in got if i in (1, 2, 3)} == {(1, "und"), (2, "und"), (3, "und")} and {p for i, p, _ in got if i not in (1, 2, 3)} <= {"en", "fr"}
    none = language.train_language(empty(spark))
    assert {r["lang_pred"] for r in language.identify_language(awkward(spark), none).collect()} == {"und"}
    assert language.identify_language(empty(spark), none).isEmpty()
    letters = spark.createDataFrame([(1, "12 34 ..."), (2, "пример"), (3, "例")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in language.identify_language(letters, model).orderBy("doc_id").collect()] == [True, False, False]


def test_language_of_an_unlabelled_corpus(spark):
    bare = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="no language can be learned"):
        language.keep_language(bare)
    assert language.keep_language(empty(spark)).isEmpty() and language.keep_language(bare.where("doc_id in (1, 2, 3)")).isEmpty()
    some = bare.withColumn("lang", F.when(F.col("doc_id") == 6, "en"))
    assert {r["doc_id"] for r in language.keep_language(some).collect()} >= {4, 6, 9}


# Toxicity.


def test_grammar_tells_clauses_apart():
    t = toxicity
    kind = lambda symbols, gaps: t.KINDS[int(t.clause_weights(symbols, [1.0] * len(symbols), gaps).argmax())]
    assert kind([t.INSULT], [0]) == "insult" and kind([t.TARGET, t.INSULT], [0, 1]) == "aimed insult" and kind([t.INSULT, t.TARGET], [0, 4]) == "aimed insult"
    assert kind([t.NEGATION, t.INSULT], [0, 2]) == "negated insult" and kind([t.NEGATION, t.INSULT], [0, 3]) == "insult"
    assert kind([t.REPORT, t.INSULT], [0, 30]) == "reported insult" and kind([t.INTENT, t.THREAT, t.TARGET], [0, 0, 0]) == "aimed threat"
    assert kind([t.QUOTE, t.INSULT, t.QUOTE], [0, 0, 0]) == "reported insult" and kind([t.QUOTE, t.QUOTE, t.INSULT], [0, 1, 0]) == "insult" and t.clause_weights([t.THREAT], [1.0], [0])[4] == t.BARE
    assert kind([t.NEGATION, t.THREAT], [0, 0]) == "negated threat"
    assert not t.clause_weights([t.TARGET, t.NEGATION], [1.0, 1.0], [0, 0]).any()


SENTENCES = {
    "An idiot wrote the manual.": "insult", "What an idiot he is.": "insult", "You are an idiot!": "aimed insult", "You aren't an idiot.": "negated insult", "You aren\u2019t an idiot.": "negated insult",
    "She said: you are an idiot.": "reported insult", "She said you are an idiot": "reported insult", '"What an idiot!" was heard.': "reported insult", "\u201cYou idiot\u201d, they shouted": "reported insult", "Tu n'es pas un idiot": "negated insult", "T'es un idiot": "aimed insult",
    "He will kill time.": "threat", "I will hurt you.": "aimed threat", "I won't hurt you.": "negated threat", "She said he will hurt them.": "reported threat", 'It\'s 5" long; you idiot': "aimed insult",
}


def test_every_kind_fires_on_sentences():
    lexicon = toxicity.Lexicon({b"idiot": 2.0}, {})
    got = toxicity.document_weights(pa.array(list(SENTENCES), pa.large_string()), lexicon)
    for text, row in zip(SENTENCES, got, strict=True):
        assert [toxicity.KINDS[i] for i in np.flatnonzero(row[:-1])] == [SENTENCES[text]], text
    assert set(SENTENCES.values()) == set(toxicity.KINDS)


def test_grammar_equals_a_plain_parser():
    names = {toxicity.INSULT: "insult", toxicity.THREAT: "threat", toxicity.INTENT: "intent", toxicity.TARGET: "target", toxicity.NEGATION: "negation", toxicity.REPORT: "report"}
    classes = {w: names[c] for c, ws in toxicity.WORDS.items() for w in ws.split()} | {"blorf": "insult", "grump": "insult"}
    weights = {w: toxicity.THREAT_WEIGHT for w in toxicity.WORDS[toxicity.THREAT].split()} | {"blorf": 2.0, "grump": 3.5}
    rng = np.random.default_rng(4)
    pieces = ["blorf", "grump", "kill", "hurt", "will", "you", "them", "not", "nie", "said", "dit", "isn't", "don\u2019t", "n'est", "t'es", "tree", "house", "sky", "blue", "ran"]
    ends = [" ", " ", " ", " ", " ", ", ", ": ", ". ", "! ", "; ", "\n", ' "', '" ', " \u201c", "\u201d "]
    texts = ["".join(str(rng.choice(pieces)) + str(rng.choice(ends)) for _ in range(int(rng.integers(0, 60)))) for _ in range(400)]
    got = toxicity.document_weights(pa.array(texts, pa.large_string()), toxicity.Lexicon({}, {b"blorf": 2.0, b"grump": 3.5}))[:, :-1]
    want = np.array([clause_brute(t, classes, weights) for t in texts])
    assert (want > 0).all(0).sum() == 0 and (want > 0).any(0).all() and np.allclose(got, want)


def test_toxicity_with_text_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", "nice words here " * 5 + ("blorf" if i % 4 == 0 else "") + f" x{i}") for i in range(80)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", int(i % 4 == 0)) for i in range(80)], "doc_id string, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)).collect()
    assert {r["doc_id"] for r in got if r["predicted"]} == {f"d{i}" for i in range(0, 80, 4)}


def test_toxicity_learns_terminals_and_scores_held_out(spark):
    rng = np.random.default_rng(2)
    plain = ["".join(rng.choice(list("abdeghmnorst"), 6)) for _ in range(300)]
    rows = []
    for i in range(600):
        w = list(rng.choice(plain, int(rng.integers(40, 160))))
        if i % 5 == 0:
            for at in rng.integers(0, len(w), 6):
                w[at] = ("zwick" + plain[rng.integers(300)][:3]) if i % 2 else "blorf!"
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i % 3], LABELS)
    model = toxicity.train_toxicity(docs, labels)
    assert any(s.startswith(b"zwic") for s in model.stems) and b"blorf" in {*model.words, *model.stems}
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert np.mean([got[i] == y for i, _, y in rows if i % 3 == 0]) >= 0.98


def test_families_are_verified_copies():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words, 220)) for _ in range(2000)]
    family = toxicity._families(pa.array(texts, pa.large_string()))
    assert len(set(family)) == 2000
    # Exact and near copies are one family; texts that share half of their words, short and blank ones are not.
    near = [edited(texts[0], rng, words, 3) for _ in range(20)]
    half = [" ".join(texts[0].split(" ")[:110] + t.split(" ")[110:]) for t in texts[1:20]]
    odd = [texts[0], texts[0].upper(), *near, *half, "a b", "A  b", "a c", None, "", " "]
    got = toxicity._families(pa.array(odd, pa.large_string()))
    want = jaccard_brute(enumerate(odd))
    assert [got.index(f) for f in got] == [want[i][1] for i in range(len(odd))] and len(set(got[:22])) == 1 and len(set(got)) == 1 + 19 + 2 + 3


def test_toxicity_awkward(spark):
    model = toxicity.train_toxicity(awkward(spark), spark.createDataFrame([(4, 1, 1), (4, 1, 0), (6, 1, 0), (77, 0, 1), (None, 0, 1), (9, 1, None)], LABELS))
    got = toxicity.score_toxicity(awkward(spark), model).collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.train_toxicity(empty(spark), spark.createDataFrame([], LABELS))
    assert {r["predicted"] for r in toxicity.score_toxicity(awkward(spark), none).collect()} == {0}
    assert toxicity.score_toxicity(empty(spark), none).isEmpty()


# Packing.


def test_differencing():
    rng = np.random.default_rng(4)
    for n, k in ((0, 3), (1, 4), (40, 7), (300, 40)):
        sizes = rng.integers(1, 257, n)
        most, items = packing.difference(sizes, k)
        assert sorted(i for w in items for i in w) == list(range(n)) and len(items) <= k
        sums = [int(sizes[w].sum()) for w in items]
        assert most == max(sums, default=0) and (n < 10 * k or max(sums) - min(sums) <= 60)
    w = packing.windows_for(rng.integers(1, 257, 900))
    assert len(w) > 1


def check_packing(spark, docs, **how):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, with_ids=True, **how).collect()
    at, used, pieces = defaultdict(int), defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        used[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
    for spans in used.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 1024
    want = defaultdict(list)
    for d in docs.select("doc_id", "text").collect():
        want[d["doc_id"]].append(np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    for i, texts in want.items():
        if len(texts) == 1:
            assert b"".join(p for _, p, _ in sorted(pieces[i])) == texts[0] and {n for *_, n in pieces[i]} == {len(texts[0]) // 4}
        else:
            assert sum(len(p) for _, p, _ in pieces[i]) == sum(map(len, texts))
    total = sum(r["length"] for r in got)
    return total / (1024 * max(1, len(used)))


def test_packing_round_trip(spark, tables):
    assert check_packing(spark, tables["documents"]) >= 0.98


def test_packing_awkward(spark):
    check_packing(spark, awkward(spark))
    odd = ["a  b", " a", "a ", "\n\na b\n", "a\tb \r\nc", "x<|endoftext|>y z", "<|endoftext|>", "a\u00a0 b", "é\u2003 x", "\x1c a\x1c b", "don't  stop", "1 2  33"]
    check_packing(spark, spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"))
    assert packing.pack_documents(empty(spark)).isEmpty()


# Sharding.


def check_shards(rows, n, total):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert sum(map(len, by.values())) == total and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert total < n or set(by) == set(range(n))
    assert max(map(len, by.values()), default=0) - (min(map(len, by.values()), default=0) if len(by) == n else 0) <= 1


@pytest.mark.parametrize("bucket", [4096, 16])
def test_sharding_keeps_the_mixture(spark, tables, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
    docs = tables["documents"].select("doc_id", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 7 == 1, None).otherwise(F.col("source")).alias("source"))
    got = sharding.interleave_shards(docs, 7).collect()
    check_shards(got, 7, docs.count())
    n, part = Counter(r["source"] for r in got), Counter((r["source"], r["shard"]) for r in got)
    # Each source's rank is within one half of its fraction, so a cut is off by half a row of every source, in this source's share.
    assert all(abs(part[s, k] - n[s] / 7) <= 1 + n[s] * (len(n) + 2) / len(got) for s in n for k in range(7))
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.interleave_shards(docs.repartition(5), 7).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in got}
    monkeypatch.setattr(sharding, "MOST_BROADCAST", 0)
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.interleave_shards(docs, 7).collect()} == again


def test_sharding_awkward(spark):
    check_shards(sharding.interleave_shards(awkward(spark), 24).collect(), 24, 12)
    assert sharding.interleave_shards(empty(spark), 24).isEmpty()
    with pytest.raises(ValueError):
        sharding.interleave_shards(empty(spark), 2, law="key")


# Mixing.


def test_targets_are_filled_by_weight():
    t = mixing.fill_targets([100, 1, 100])
    assert t[1] == 3 and math.isclose(sum(t), 201) and math.isclose(t[2], 3 * t[0])
    assert mixing.fill_targets([]) == [] and mixing.fill_targets([0, 0]) == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    keys = mixing._round_keys("s", 1, 2)
    p = mixing.permuted(np.arange(n), n, keys)
    assert sorted(p) == list(range(n)) and (mixing.permuted(p, n, keys, back=True) == np.arange(n)).all()


def test_draws_meet_the_totals():
    slots, shards = [1000, 10, 0, 5000], 24
    got = list(mixing.draw_counts(slots, shards, 0, shards))
    c = np.array([n for _, _, n in got])
    assert [j for j, _, _ in got] == list(range(shards)) and c.sum(0).tolist() == slots and c.sum(1).max() - c.sum(1).min() <= 1 and abs(c[:, 0] - 1000 / shards).max() < 60
    assert (np.array([f for _, f, _ in got]) == np.cumsum(c, 0) - c).all()
    # Any part of the shards draws the same.
    some = list(mixing.draw_counts(slots, shards, 5, 9))
    assert [j for j, _, _ in some] == [5, 6, 7, 8] and all((a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(some, got[5:9], strict=True))


def targets_brute(sizes, cap=3.0):
    """The level at which the sources' weights fill up, by bisection."""
    w, total = [1 + i % 3 for i in range(len(sizes))], float(sum(sizes))
    lo, hi = 0.0, total + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cap * s, mid * x) for s, x in zip(sizes, w, strict=True)) < total else (lo, mid)
    return [min(cap * s, hi * x) for s, x in zip(sizes, w, strict=True)]


def test_targets_equal_bisection():
    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 10, 400):
        sizes = [int(x) for x in rng.choice([0, 1, 5, 50, 3000, 10**9], n)]
        if sum(sizes):
            assert np.allclose(mixing.fill_targets(sizes), targets_brute(sizes), rtol=1e-9, atol=1e-6)


def test_mixing_of_5000_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 512)
    rows = [(i, "w " * (1 + i % 40) * (400 if i % 5000 == 7 else 1), f"s{i % 5000}") for i in range(10_000)]
    taken, runs = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=("source",))
    got = taken.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert len(got) == 5000 and all(abs(r["t"] - r["w"]) <= 1 and r["over"] <= 0 for r in got)
    assert runs.select("shard").distinct().count() > 8


@pytest.mark.parametrize(("block", "bucket"), [(256, 4096), (7, 16)])
def test_mixing(spark, tables, monkeypatch, block, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    docs = tables["documents"].withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 11 == 1, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 4)))
    taken, runs = mixing.mix_sources(docs, block=block, carry=("source",))
    got = taken.collect()
    size = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in docs.collect()}
    assert {r["doc_id"]: r["size"] for r in got} == size and all(r["taken"] <= 3 * r["size"] for r in got)
    sums, words, target = Counter(), Counter(), {}
    for r in got:
        sums[r["source"]] += r["taken"]
        words[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    order = sorted(s for s in words if s is not None) + [None]
    assert [target[s] for s in order] == mixing.fill_targets([words[s] for s in order])
    assert all(abs(sums[s] - target[s]) <= 1 for s in order)
    again, _ = mixing.mix_sources(docs.repartition(6), block=block)
    assert {(r["doc_id"], r["taken"]) for r in again.collect()} == {(r["doc_id"], r["taken"]) for r in got}
    assert runs.groupBy("shard").agg(F.sum("words")).count() >= 1
    made = mixing.mixed_documents(docs, block=block)
    assert made.columns == docs.columns
    n = Counter()
    for r in made.collect():
        n[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert n == Counter({r["doc_id"]: r["taken"] for r in got if r["taken"]})


def test_mixing_awkward(spark):
    taken, _ = mixing.mix_sources(awkward(spark))
    got = taken.collect()
    assert len(got) == 12 and {(r["size"], r["taken"]) for r in got if r["doc_id"] in (1, 2, 3)} == {(0, 0)}
    taken, runs = mixing.mix_sources(empty(spark))
    assert taken.isEmpty() and runs.isEmpty() and mixing.mixed_documents(empty(spark)).isEmpty()
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, " ", "en", None, 1)], DOCS)
    assert [r["taken"] for r in mixing.mix_sources(blank)[0].collect()] == [0, 0]


# Embeddings.


def cosine_brute(vectors):
    ok = {i: np.array(v, float) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    link = {i: [j for j, b in ok.items() if i in ok and j != i and len(b) == len(ok[i]) and ok[i] @ b / np.linalg.norm(ok[i]) / np.linalg.norm(b) >= 0.95] for i, _ in vectors}
    out = {}
    for i, _ in vectors:
        seen, todo = {i}, [i]
        while todo:
            todo += (more := [j for j in link[todo.pop()] if j not in seen])
            seen.update(more)
        out[i] = (len(link[i]), min(seen))
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_embedding_links(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(9)
    vectors = []
    for _ in range(30):
        base = rng.standard_normal(32)
        vectors += [(base + rng.standard_normal(32) * rng.choice([0.02, 0.1, 0.2])).astype(np.float32).tolist() for _ in range(int(rng.integers(1, 20)))]
    vectors += [vectors[0], vectors[0], None, [], [0.0] * 32, [math.nan] + [1.0] * 31, [math.inf] * 32, [None] + [1.0] * 31, [1.0, 2.0], [2.0, 4.0], [5.0], [-3.0]]
    rows = list(enumerate(vectors))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.embedding_classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    want = cosine_brute(rows)
    assert set(got) == set(want) and all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())
    assert np.mean([got[i][1] == want[i][1] for i in want]) >= 0.97
    assert all(got[i] == (0, i) for i, v in rows if v is None or not v or i in range(len(vectors) - 8, len(vectors) - 4))
    assert embeddings.embedding_classes(spark.createDataFrame([], "vec_id long, embedding array<float>")).isEmpty()


@pytest.mark.parametrize("dim", [3, 33, 64])
def test_codes_and_factors_bound_the_cosine(dim):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((200, dim))
    x = np.concatenate([base, base + 0.1 * rng.standard_normal((200, dim))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    stored = embeddings.encoded(x)
    assert stored[0].shape[1] == -(-dim // 8) and stored[2].shape[1] == -(-dim // 2)
    need, near = embeddings.undecided(stored, stored, dim, 0.95), x @ x.T >= 0.95
    assert not (near & ~need).any()
    if dim == 64:
        assert (need & ~near).mean() < 0.03
        code = (2.0 * np.unpackbits(stored[0], axis=1) - 1) / 8
        levels = (np.stack([stored[2] >> 4, stored[2] & 15], 2).reshape(400, -1) - 8.0) * stored[3][:, None]
        off = (code @ levels.T) / stored[1][:, None] - x @ x.T
        assert abs(off[~np.eye(400, dtype=bool)].mean()) < 0.01


def test_embeddings_with_repeated_ids_and_clashing_names(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [2.0, 0.01], 0), (2, [0.0, 1.0], 0), (None, [0.0, 3.0], 0), (2, None, 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int").select("*", *(F.lit(0).alias(c) for c in ("t", "key", "i", "low", "copies", "raw", "_id")))
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embeddings.embedding_classes(v).collect()))
    assert got == [(0, 1, 2, False), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (2, 1, 2, True)]


# URLs.


def glob_brute(pattern, text):
    return re.fullmatch("".join({"*": "(?s:.)*", "~": "[^/]*", "?": "(?s:.)"}.get(c, re.escape(c)) for c in pattern), text) is not None


def test_automaton_equals_regular_expressions():
    rng = np.random.default_rng(6)
    patterns = list({"".join(rng.choice(list("ab/*~?"), int(rng.integers(1, 9)))) for _ in range(60)})
    texts = ["".join(rng.choice(list("ab/"), int(rng.integers(0, 12)))) for _ in range(300)] + [""]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    a = urls.Automaton([urls.parsed(p) for p in patterns])
    assert a.words > 1
    hit = a.run(np.frombuffer(b"".join(raw), np.uint8), offs)
    assert all(hit[i, k] == glob_brute(p, t) for i, t in enumerate(texts) for k, p in enumerate(patterns))


def test_urls_awkward(spark):
    rows = [
        (1, None), (2, ""), (3, "no scheme/path"), (4, "http://EXAMPLE.ORG/es/1?q=/x#y"), (5, "http://notexample.org/es/1"), (6, "http://sub.example.org/en/19"), (7, "http://a.com"), (8, "http://a.com/fr/"), (9, "http://x?y://z.com/de/"),
        (10, "http://a.net/" + "p" * 20_000 + "/ads/x"), (11, "https://www.adult-x.example.net/en/1"), (11, "https://www.adult-x.example.net/en/1"), (12, "://org/"), (13, "http://É.net/\nfile.exe"), (14, "http://.org/x"), (None, "http://b.org/x/y#z"),
    ]
    d = spark.createDataFrame(rows, "page_id long, url string").select("*", F.lit(1).alias("host"), F.lit(2).alias("rule"), F.lit(3).alias("_url"))
    got = [(r["page_id"], r["host"], r["path"][:20], r["rule"], r["verdict"]) for r in urls.judge_urls(d).collect()]
    want = {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("example.org", "/es/1", "example.org/es/", "block"), 5: ("notexample.org", "/es/1", "org/", "allow"),
        6: ("sub.example.org", "/en/19", "example.org/en/1", "block"), 7: ("a.com", "", None, "allow"), 8: ("a.com", "/fr/", "com/fr/", "allow"), 9: ("x", "", None, "allow"), 10: ("a.net", "/" + "p" * 19, None, "block"),
        11: ("www.adult-x.example.net", "/en/1", None, "block"), 12: ("org", "/", "org/", "allow"), 13: ("É.net", "/\nfile.exe", None, "block"), 14: (".org", "/x", "org/", "allow"), None: ("b.org", "/x/y", "org/", "allow"),
    }
    assert len(got) == 16 and all(tuple(r[1:]) == want[r[0]] for r in got)
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).isEmpty()


# Licenses.


def test_licenses(spark):
    filler = " ".join(f"word{i}" for i in range(300))
    rows = [
        (1, filler + " Released under the MIT License. " + filler), (2, "RELEASED under the\nMIT (license)!"), (3, "Released under the BSD License"), (4, None), (5, ""), (6, "too short"), (7, "Licensed under the Apache License, Version 2.0."),
        (8, "This work was licensed under the GNU General Public License, version 3."), (1, "Licensed under CC BY-NC 4.0."), (9, (filler + " ") * 60 + "Licensed under CC BY-NC 4.0"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("c").alias(c) for c in ("_h", "_at", "license", "template")))
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan_licenses(d).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (7, "Apache-2.0"), (1, "CC-BY-NC-4.0"), (9, "CC-BY-NC-4.0")}
    assert got[1, "MIT"]["containment"] == 1.0 and 298 <= got[1, "MIT"]["first_word"] <= 300
    near = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(d, least=0.6).collect()}
    assert (8, "GPL-3.0-only") in near
    assert licenses.scan_licenses(empty(spark)).isEmpty()


def test_license_bands_miss_nothing(spark):
    """Edited notices in filler: the bands retrieve every window whose containment is enough, and ties between templates are all reported."""
    rng = np.random.default_rng(21)
    words = [f"v{i}" for i in range(900)]
    templates = [(f"L{i}", " ".join(rng.choice(words, int(rng.integers(5, 60))))) for i in range(30)]
    templates.append(("twin", templates[0][1]))
    texts = []
    for i in range(600):
        w = templates[i % 31][1].split(" ")
        for at in rng.integers(0, len(w), int(rng.integers(0, 3))):
            w[at] = "edit"
        texts.append((i, " ".join([*rng.choice(words, int(rng.integers(0, 80))), *w, *rng.choice(words, int(rng.integers(0, 80)))])))

    def shingles(w):
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    want = set()
    for i, text in texts:
        s = shingles(text.split(" "))
        for t, (_, notice) in enumerate(templates):
            w = notice.split(" ")
            mine, stride = set(shingles(w)), max(2, len(w) // 2)
            if any(len(mine & set(s[k : k + len(w) + stride - 5])) / len(mine) >= 0.8 for k in range(0, max(1, len(s)), stride)):
                want.add((i, t))
    got = {(r["doc_id"], r["template"]) for r in licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"), templates=tuple(templates)).collect()}
    assert got == want and {(i, 30) for i, t in want if t == 0} <= want and len(want) > 400
