"""Numbers, running sums and concatenation in the order of a document's pages, for documents of any length.

A window over a whole document sorts it in one task, and a collected list of its
pages is one row. Here a document is cut into buckets of places (page numbers,
turns, positions): only a bucket is sorted, sums of buckets carry the numbers on, and
texts are put together in parts of a bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bits of a place below a bucket, and below a bucket of buckets.
BUCKET_BITS, OUTER_BITS = 12, 24
#: Characters of a part of a document, about.
PART_CHARACTERS = 1 << 20


def running(rows: DataFrame, by: str, place: str, *, weight: Column | None = None, ties: list[str] | None = None, before: str = "before", total: str | None = None) -> DataFrame:
    """Adds ``before``: the sum of ``weight`` (1 by default) over the earlier rows of a ``by``; and with ``total`` the sum over all of its rows.

    Rows are ordered by ``place``, whole numbers with null first, then by ``ties``.
    A task sorts the rows of one bucket of 4,096 places of one ``by``, so a document of
    any length is spread over tasks as long as its places do not repeat; sums of
    buckets are carried on within 4,096 buckets, and sums of these within the document.
    Null ``by`` is a document of its own; a null weight counts as 0.
    """
    text = isinstance(rows.schema[by].dataType, StringType)
    at = F.coalesce(F.col(place).cast("long"), F.lit(-(1 << 63)))
    key, outer, inner = ["_by", "_null"], "_outer", "_inner"
    marked = rows.withColumns({
        "_by": F.coalesce(F.col(by), F.lit("") if text else F.lit(0).cast(rows.schema[by].dataType)), "_null": F.col(by).isNull(),
        outer: F.shiftright(at, OUTER_BITS), inner: F.shiftright(at, BUCKET_BITS), "_w": F.coalesce((F.lit(1) if weight is None else weight).cast("long"), F.lit(0)),
    })

    def earlier(frame: DataFrame, within: list[str], order: list[Column]) -> Column:
        return F.coalesce(F.sum("_w").over(Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    small = marked.groupBy(*key, outer, inner).agg(F.sum("_w").alias("_w"))
    large = small.groupBy(*key, outer).agg(F.sum("_w").alias("_w"))
    large = large.select(*key, outer, earlier(large, key, [F.col(outer)]).alias("_b"), F.sum("_w").over(Window.partitionBy(*key)).alias("_t"))
    small = small.withColumn("_s", earlier(small, [*key, outer], [F.col(inner)])).join(large, [*key, outer])
    starts = small.select(*key, outer, inner, (F.col("_b") + F.col("_s")).alias("_start"), "_t")
    met = marked.join(starts, [*key, outer, inner])
    order = [F.col(place).asc_nulls_first(), *(F.col(t).asc_nulls_first() for t in ties or [])]
    out = met.withColumn("_r", earlier(met, [*key, outer, inner], order))
    return out.select(*rows.columns, (F.col("_start") + F.col("_r")).alias(before), *([F.col("_t").alias(total)] if total else []))


def numbered(rows: DataFrame, by: str, place: str, *, ties: list[str] | None = None, name: str = "number", total: str | None = None) -> DataFrame:
    """Adds the number of each row in its ``by``, from 0 and without gaps, and with ``total`` how many there are."""
    return running(rows, by, place, ties=ties, before=name, total=total)


def parts(pages: DataFrame, doc: str, page: str = "page_number", content: str = "page_content", *, separator: str = "\n", block: Column | None = None, most: int = PART_CHARACTERS) -> DataFrame:
    """Documents in parts: doc, part, first_page, last_page, n_pages, content; the contents in the order of ``part`` make the document.

    A part takes the pages that begin within its ``most`` characters of the document, so
    it has less than ``most`` characters and one page. Between the pages of a part, and
    between parts, lies ``separator``, which is in no part's end. A page that begins
    beyond several borders leaves numbers of parts out. ``block`` is what a page adds
    to its document where that is not its content, such as page_block() of markdown.
    Pages with the same number follow each other by content; a null content is empty.
    """
    shown = pages.select(F.col(doc), F.col(page).cast("long").alias("_p"), F.coalesce(F.col(content) if block is None else block, F.lit("")).alias("_c"))
    placed = running(shown, doc, "_p", weight=F.length("_c") + len(separator), ties=["_c"], before="_at")
    made = placed.groupBy(doc, F.floor(F.col("_at") / most).alias("part")).agg(
        F.min("_p").alias("first_page"), F.max("_p").alias("last_page"), F.count(F.lit(1)).alias("n_pages"), F.array_sort(F.collect_list(F.struct("_at", "_c"))).alias("_l")
    )
    return made.select(doc, "part", "first_page", "last_page", "n_pages", F.array_join(F.transform("_l", lambda x: x["_c"]), separator).alias("content"))


def page_block(page: Column, content: Column) -> Column:
    """What a page adds to the markdown of its document; with parts() its separator is empty."""
    return F.concat(F.lit("\n===== Page: "), page.cast("string"), F.lit(" =====\n\n"), F.coalesce(content, F.lit("")), F.lit("\n\n"))
