"""Documents and pages: selection, assembly, batches, markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivane.functions.text import word_count
from scrivane.operators.ordered import numbered, page_block


def selected_pages(indexes: Column, n_pages: Column) -> Column:
    """Zero-based page indexes, sorted and distinct; an index out of range is an error of the query."""
    bad = F.exists(indexes, lambda i: (i < 0) | (i >= n_pages))
    return F.when(bad, F.raise_error(F.concat(F.lit("page indexes out of range for "), n_pages.cast("string"), F.lit(" pages")))).otherwise(F.array_sort(F.array_distinct(indexes)))


def selection_error(indexes: Column, n_pages: Column) -> Column:
    """The same check as a column: null where all indexes are in range."""
    return F.when(F.exists(indexes, lambda i: (i < 0) | (i >= n_pages)), "page index out of range")


def pages_of_selection(pages: DataFrame, selection: DataFrame, doc: str, page: str = "page_number") -> DataFrame:
    """The pages (numbered from 1) of each document whose zero-based indexes ``selection`` (doc, idx) holds."""
    wanted = selection.select(doc, (F.col("idx") + 1).alias(page)).distinct()
    return pages.join(wanted, [doc, page], "left_semi")


def assemble(pages: DataFrame, doc: str, page: str = "page_number", content: str = "page_content") -> DataFrame:
    """One row for each document: pages (array of structs in page order), total_words, n_pages, and the text joined by newlines."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page).cast("int").alias("page_number"), F.col(content).alias("page_content"))))
    out = pages.groupBy(doc).agg(ordered.alias("pages"), F.sum(word_count(F.col(content))).alias("total_words"), F.count(F.lit(1)).alias("n_pages"))
    return out.withColumn("content", F.array_join(F.transform("pages", lambda p: F.coalesce(p["page_content"], F.lit(""))), "\n"))


def document_records(assembled: DataFrame, files: DataFrame, doc: str) -> DataFrame:
    """File records from assembled pages and ``files`` (doc, file_name, cache_key, file_full_path, total_pages, page_indexes).

    processed_pages and page_indexes are set only where fewer pages than the
    document has were asked for; total_pages is always the document's own.
    """
    part = F.col("page_indexes").isNotNull() & (F.size("page_indexes") < F.col("total_pages"))
    return files.join(assembled, doc).select(
        doc, "file_name", "cache_key", "total_pages", "total_words", "file_full_path",
        F.when(part, F.size("page_indexes")).alias("processed_pages"), F.when(part, F.col("page_indexes")).alias("page_indexes"), "pages",
    )


def markdown(pages: Column) -> Column:
    """Markdown of an array of page structs."""
    return F.array_join(F.transform(pages, lambda p: page_block(p["page_number"], p["page_content"])), "")


def batches(pages: DataFrame, doc: str, order: str, size: int, ties: list[str] | None = None) -> DataFrame:
    """Adds ``batch``: numbers runs of ``size`` rows of each document in order, from 0; a document of any length is spread over tasks."""
    return numbered(pages, doc, order, ties=ties, name="batch").withColumn("batch", F.floor(F.col("batch") / size))
