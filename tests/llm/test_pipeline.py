"""The pipeline's stages against brute force, and the queries' columns."""

import zlib
from collections import Counter

import pytest
from brute import WORD, base_stats, jaccard_brute

import corpus_pipeline
from scrivane.llm import mixing
from scrivane.llm import queries as Q

CONTRACT = {
    "op1_mixture": "doc_id size:bigint source_size:bigint target:double taken:bigint",
    "op2_toxic_clauses": "doc_id held_out:boolean score:double predicted:int",
    "op3_language_mixture": "doc_id held_out:boolean lang_pred:string score:double",
    "op4_quality_rules": "doc_id n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
    "op5_pack_sequences": "doc_id start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
    "op6_embedding_classes": "vec_id n_links:bigint component_id:bigint kept:boolean",
    "op7_url_filters": "page_id host:string path:string rule:string verdict:string",
    "op8_interleaved_shards": "doc_id size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op9_license_scan": "doc_id license:string",
    "op10_jaccard_join": "doc_id n_shingles:bigint component_id:bigint",
}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = docs.collect()
    rows = list(kept.values())
    assert all(not base_stats(r["text"])[5] for r in rows[0])
    assert {r["doc_id"] for r in rows[1]} <= {r["doc_id"] for r in rows[0]} and len(rows[1]) > 0.9 * len(rows[0])
    classes = jaccard_brute([(r["doc_id"], r["text"]) for r in rows[1]])
    assert {r["doc_id"] for r in rows[2]} == {c for _, c in classes.values()}
    size, took = Counter(), Counter()
    for r in rows[2]:
        size[r["source"]] += len(WORD.findall(r["text"]))
    for r in rows[3]:
        took[r["source"]] += len(WORD.findall(r["text"]))
    order = sorted(size)
    assert all(abs(took[s] - t) <= 1 for s, t in zip(order, mixing.fill_targets([size[s] for s in order]), strict=True))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in rows[3]}


def test_run_equals_its_stages(spark, sf):
    a = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert a and a == Counter(tuple(r) for r in docs.select("doc_id", "start", "length", "ids_crc32").collect())


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract(spark, sf, name):
    made = Q.queries()[name](spark, sf)
    types = dict(made.dtypes)
    for column in CONTRACT[name].split():
        c, _, kind = column.partition(":")
        assert types[c] == (kind or "bigint")
    rows = made.collect()
    assert name == "op9_license_scan" or rows
    if "held_out" in types:
        mod, rest = (5, 0) if name.startswith("op2") else (3, 1)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest) for r in rows)


def written(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row int, comp string, shard int, kept string, _t int"


def test_awkward_tables_through_the_whole_pipeline(spark, tmp_path):
    """Null and repeated ids, null texts, repeated rows, a long text, unknown sources and clashing names."""
    words = ["the", "a", "stone", "river", "green", "hill", "walks", "sings", "under", "over", "cloud", "lamp", "early", "window", "paper"]
    text = lambda seed, n: " ".join(words[(seed * 7 + i * i + i * seed) % len(words)] + str((i * seed) % 11) for i in range(n))
    extra = (1, "c", 2, "k", 3)
    rows = [(1, text(3, 80), "en", "a", 0), (1, text(3, 80), "en", "a", 0), (1, text(5, 90), "en", None, 0), (None, text(8, 120), None, "a", 0), (None, text(8, 120), "en", "b", 0), (None, None, "en", "a", 0), (2, "", "en", "a", 0), (3, text(13, 40_000), "en", "b", 0), (4, "short", "en", None, 0)]
    sf = written(spark, tmp_path, spark.createDataFrame([(*r, *extra) for r in rows], DOCS))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
        assert name == "packing" or docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] > 0 and sizes[3] > 0
    assert corpus_pipeline.run(spark, sf).count() == sizes[-1]


def test_an_empty_table_through_the_whole_pipeline(spark, tmp_path):
    sf = written(spark, tmp_path, spark.createDataFrame([], DOCS))
    made = corpus_pipeline.run(spark, sf)
    assert made.isEmpty() and {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(made.columns)
    for name, query in Q.queries().items():
        if name not in ("op6_embedding_classes", "op7_url_filters", "op13_hard_negatives"):
            assert query(spark, sf).isEmpty(), name
