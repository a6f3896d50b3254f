"""The corpus operators' queries, by name, and the SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scrivane.llm import embeddings, jaccard, language, licenses, mixing, negatives, packing, quality, records, sharding, spelling, toxicity, urls

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = [
        mixing.op1_mixture,
        toxicity.op2_toxic_clauses,
        language.op3_language_mixture,
        quality.op4_quality_rules,
        packing.op5_pack_sequences,
        embeddings.op6_embedding_classes,
        urls.op7_url_filters,
        sharding.op8_interleaved_shards,
        licenses.op9_license_scan,
        jaccard.op10_jaccard_join,
        records.op11_token_records,
        spelling.op12_spelling_variants,
        negatives.op13_hard_negatives,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {**urls.SQL, **licenses.SQL, **negatives.SQL}
