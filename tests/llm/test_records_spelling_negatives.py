"""Token records, spelling variants and hard negatives against brute force, round trips and awkward tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scrivane.llm import negatives, records, spelling

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, key string, ids binary, word string, n long, id long, h long, r long, start long"


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(TOKENIZER)


def ids_of(plain, text, end=2):
    return np.array([*plain.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def awkward(spark):
    long = " ".join(f"word{i % 701}x, Straße{i % 13}" for i in range(40_000))
    texts = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (5, "one"), (5, "two"), (6, long), (None, "no id"), (None, None), (-7, "é　ü\x1c ñ don't\n\nstop<|endoftext|> x"), (9, "x" * 30_000), (10, "Colour colour Color color colours colour. colour")]
    return spark.createDataFrame([(i, t, "clash", b"clash", "clash", 1, 2, 3, 4, 5) for i, t in texts], DOCS)


# Token records


def test_stretches_give_the_tokenisers_ids(plain):
    enc = records.Remembering(TOKENIZER)
    rng = random.Random(5)
    bits = ["a", "Bc", " ", "  ", "\n", "\n\n", "é", "ß", "×", "'", "'s", "'ll", ".", ",", "#", "1", "²", "ª", "中", "\x1c", "　", " ", "\t", "<|endoftext|>", "<|", "😀", "\x00", "_", "ÿ", "\r\n"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(1, 10)))
        assert enc.encode(text) == ids_of(plain, text)[:-1].tobytes(), repr(text)


def test_memory_keeps_giving_the_same_ids(plain, monkeypatch):
    monkeypatch.setattr(records._Known, "MOST_HELD", 7)
    enc = records.Remembering(TOKENIZER)
    text = " ".join(f"tok{i * 7 % 23}en" + "z" * (i % 90) for i in range(400))
    assert enc.encode(text) == ids_of(plain, text)[:-1].tobytes()
    assert len(enc.known) <= 7 and len(enc.known.old) <= 7


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenisers_get_whole_texts(name):
    path = public_tokenizers.path(name)
    enc, other = records.Remembering(path), Tokenizer.from_file(path)
    text = "Some  Words, don't\n\nStop here " * 50
    assert not enc.cuts and enc.encode(text) == np.array(other.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_op11_equals_the_tokeniser_on_whole_tables(spark, sf, plain):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want, start = [], 0
    for d, text in rows:
        ids = ids_of(plain, text)
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, records.op11_token_records(spark, sf).collect())) == want


def test_records_of_awkward_rows(spark, plain, tmp_path):
    docs, path = awkward(spark), str(tmp_path / "r")
    records.write_token_records(docs, path, files=3)
    got = sorted(records.read_token_records(spark, path, records=2).collect(), key=lambda r: (r["file"], r["number"]))
    assert [r["key"] for r in got] == [None, None, "-7", "1", "2", "3", "4", "5", "5", "5", "6", "9", "10"]
    want = Counter((None if r["doc_id"] is None else str(r["doc_id"]), ids_of(plain, r["text"]).tobytes()) for r in docs.collect())
    assert Counter((r["key"], bytes(r["ids"])) for r in got) == want
    assert [r["start"] for r in got] == np.cumsum([0, *(len(r["ids"]) // 4 for r in got)])[:-1].tolist()
    r = got[5]
    key, ids = records.read_record(path, r["file"], r["number"])
    assert (key, ids.tobytes()) == (r["key"], bytes(r["ids"]))
    with pytest.raises(IndexError):
        records.read_record(path, 0, 10**6)
    records.write_token_records(docs.where("false"), str(tmp_path / "e"))
    assert records.read_token_records(spark, str(tmp_path / "e")).isEmpty()


def test_one_id_in_many_rows_is_spread_over_files(spark, tmp_path):
    docs = spark.range(3000).select(F.lit(7).alias("doc_id"), F.lit("same text").alias("text"))
    records.write_token_records(docs, str(tmp_path / "r"), files=6)
    assert max(m["records"] for m in records.manifest(str(tmp_path / "r"))) < 1500


def test_broken_records_are_errors(spark, tmp_path):
    path = tmp_path / "r"
    records.write_token_records(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), str(path), files=1)
    (data,) = path.glob("part-*.rec")
    whole = data.read_bytes()
    for at in (9, len(whole) - 6):
        data.write_bytes(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
        with pytest.raises(ValueError, match="broken record"):
            records.read_record(str(path), 0, 0)
    data.write_bytes(whole[:-3])
    with pytest.raises(ValueError, match="broken record"):
        records.read_record(str(path), 0, 0)


def test_a_failed_write_leaves_the_old_records(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.dataSource.register(records.TokenRecords)
    ids = lambda *x: np.array(x, "<u4").tobytes()
    rows = spark.createDataFrame([("a", bytearray(ids(1, 70_000))), ("b", bytearray(ids()))], "key string, ids binary").coalesce(1)
    rows.write.format(records.FORMAT).mode("append").save(path)
    with pytest.raises(Exception, match="holds records already"):
        rows.write.format(records.FORMAT).mode("append").save(path)
    bad = rows.withColumn("ids", F.when(F.col("key") == "b", F.raise_error("stop")).otherwise(F.col("ids")))
    with pytest.raises(Exception, match="stop"):
        bad.write.format(records.FORMAT).mode("overwrite").save(path)
    read = lambda: [(r["key"], bytes(r["ids"])) for r in records.read_token_records(spark, path).orderBy("number").collect()]
    assert read() == [("a", ids(1, 70_000)), ("b", ids())]
    rows.where("key = 'b'").write.format(records.FORMAT).mode("overwrite").save(path)
    assert read() == [("b", ids())] and len(list((tmp_path / "r").glob("part-*.rec"))) == 1
    with pytest.raises(ValueError, match="no committed records"):
        records.manifest(str(tmp_path / "none"))


# Spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or len(a) == len(b) and a[i + 1 :] == b[i + 1 :]


def forms_brute(counts, ratio=2):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(v, key=lambda x: (-counts[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if counts[b] >= ratio * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), counts[w], len(near[w]), counts[form[w]] if w in form else None) for w in counts}


def words_brute(docs, slips=None, least_length=5, least_count=3):
    total = Counter()
    for d, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if slips and h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= least_length and n >= least_count}


def spelled(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("alphabet,most,large", [("ab", 7, 1024), ("abcÉé", 4, 8), ("xyz", 6, 2)])
def test_one_edit_words_equal_brute_force(spark, monkeypatch, alphabet, most, large):
    monkeypatch.setattr(spelling, "LARGE", large)
    rng = random.Random(alphabet)
    counts = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, most))): rng.randint(1, 40) for _ in range(160)}
    got = {r["word"]: (r["n_near"], r["near"], r["near_n"]) for r in spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    want = {}
    for w in counts:
        near = [v for v in counts if one_edit(w, v)]
        if near:
            best = min(near, key=lambda x: (-counts[x], x))
            want[w] = (len(near), best, counts[best])
    assert got == want


def test_long_words_and_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART", 1000)
    monkeypatch.setattr(spelling, "SLICE", 50)
    base = "ab" * 1500
    words = [base, base[:700] + "z" + base[700:], base[:-1], base[:5] + base[6:], "short", "shorts"]
    docs = [(i, " ".join(words * 4)) for i in range(2)]
    assert spelled(spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"))) == forms_brute(words_brute(docs))


def test_chains_end_at_their_root(spark):
    chain = ["a" * 5 + "b" * i for i in range(12)]
    text = " ".join(w for i, w in enumerate(chain) for _ in range(3 << i))
    got = spelled(spelling.spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert {w: g[1] for w, g in got.items()} == dict.fromkeys(chain, chain[-1]) and got[chain[3]][0] == chain[4]


def test_op12_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counts = words_brute(rows, slips=97)
    keyed: dict[str, list[str]] = {}
    for w in counts:
        for k in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            keyed.setdefault(k, []).append(w)
    near = {w: {v for k in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} for v in keyed[k] if one_edit(w, v)} for w in counts}
    got = spelled(spelling.op12_spelling_variants(spark, sf))
    assert {w: g[2:4] for w, g in got.items()} == {w: (n, len(near[w])) for w, n in counts.items()}
    best = {w: min(v, key=lambda x: (-counts[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if counts[b] >= 2 * counts[w]}
    assert {w: g[0] for w, g in got.items() if g[0]} == form and len(form) > 100


def test_spelling_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for slips in (None, 3):
        assert spelled(spelling.spelling_variants(docs, slips=slips)) == forms_brute(words_brute(rows, slips))
    assert spelling.spelling_variants(docs.where("false")).isEmpty()
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs, ratio=1)


# Hard negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def negatives_brute(rows, is_anchor, positives=5, count=10):
    took = []
    for place, (i, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(np.float32(x)) for x in v):
            took.append((place, i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label))
    out = []
    rank = lambda s, i, p: (-s, i is None, i or 0, p)
    for place, i, v, label in took:
        if i is None or not is_anchor(i):
            continue
        scored = sorted((rank(sum(a * b for a, b in zip(v, w, strict=True)), j, p), m) for p, j, w, m in took if p != place and len(w) == len(v))
        for (s, _, j, p), _ in [x for x in scored if x[1] == label][:positives]:
            fits = [(r, m) for r, m in scored if m != label and 30 * -s <= 100 * -r[0] <= 90 * -s][:count]
            out += [(i, None if not j and rows[p][0] is None else j, k, None if rows[r[3]][0] is None else r[2], -s, -r[0]) for k, (r, _) in enumerate(fits, 1)]
    return Counter(out)


def mined(df):
    return Counter(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


@pytest.mark.parametrize("pivots,rows_least", [(1, 4), (4, 64), (16, 2048)])
def test_negatives_equal_brute_force(spark, monkeypatch, pivots, rows_least):
    monkeypatch.setattr(negatives, "LEAST_ROWS", rows_least)
    monkeypatch.setattr(negatives, "AT_ONCE", 3)
    rng = np.random.default_rng(pivots)
    spots = rng.standard_normal((6, 5))
    rows = [(int(i), [float(np.float32(x)) for x in spots[i % 6] + 0.3 * rng.standard_normal(5).round(1)], int(rng.integers(0, 3))) for i in range(260)]
    rows += [(100, rows[3][1], 0), (100, rows[3][1], 1), (400, None, 1), (500, [], 1), (600, [1.0, None, 1.0, 1.0, 1.0], 1), (700, [1.0, float("nan"), 1.0, 1.0, 1.0], 1), (800, rows[1][1], None), (900, [0.0] * 5, 2), (1000, [1.5, 2.5], 1), (1001, [1.25, 2.5], 1), (1002, [1.0, 1.5], 0), (None, rows[7][1], 1), (None, rows[7][1], 2)]
    df = spark.createDataFrame(rows, VECTORS).coalesce(1)
    got = mined(negatives.hard_negatives(df.withColumns({c: F.lit("clash") for c in ("id", "i", "j", "v", "d", "raw", "anchor", "score", "place", "_row")}), F.col("vec_id") % 50 == 0, pivots=pivots))
    assert got == negatives_brute(rows, lambda i: i % 50 == 0) and sum(got.values()) > 100


def test_scores_beyond_doubles_are_exact_and_cut_to_64_bits(spark):
    rows = [(0, [2.0**20, 1.0], 0), (1, [2.0**20, 3.0], 0), (2, [2.0**19, 1.0], 1), (3, [2.0**19, 1.0 + 1 / 256], 1), (4, [2.0**19, 1.5], 1)]
    df = spark.createDataFrame(rows, VECTORS)
    got = mined(negatives.hard_negatives(df, F.col("vec_id") == 0))
    assert got == negatives_brute(rows, lambda i: i == 0) and [g[3] for g in sorted(got)] == [4, 3, 2]
    huge = spark.createDataFrame([(i, [1e30, 1e30], i % 2) for i in range(6)], VECTORS)
    assert negatives.hard_negatives(huge, F.col("vec_id") == 0).isEmpty()
    q, x = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [2.0**20, 2.0]])
    assert negatives.scores(q, x).tolist() == [[2**60 + 3, 2**60 + 6]]
    assert negatives.scores(np.array([[2.0**60]]), np.array([[-(2.0**60)]])).tolist() == [[-(1 << 63)]]


def test_one_hot_vector_and_no_anchor(spark):
    rows = [(i, [1.0, 0.5], i % 2) for i in range(300)] + [(i, [0.5, 0.5], 1 - i % 2) for i in range(300, 330)]
    df = spark.createDataFrame(rows, VECTORS)
    got = mined(negatives.hard_negatives(df, F.col("vec_id") % 100 == 0))
    assert got == negatives_brute(rows, lambda i: i % 100 == 0) and got
    assert negatives.hard_negatives(df, F.lit(False)).isEmpty() and negatives.hard_negatives(df.where("false"), F.lit(True)).isEmpty()
