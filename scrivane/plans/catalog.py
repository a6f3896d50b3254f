"""Queries over the driver tables, by name, each with its SQL equivalent where SQL has one.

The tables stand in for what the engine reads: documents for page texts and
files, conversations for the pages of a document or the messages of a chat,
events for timed segments, parts for image sizes. Values that the tables lack
(inline payloads, blank texts, upper-case extensions) are injected in the query
and in its SQL alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.functions import keys as K
from scrivane.functions import media as M
from scrivane.functions import prompts as P
from scrivane.functions import requests as R
from scrivane.functions import text as T
from scrivane.functions import transcript as S
from scrivane.functions.pixels import PNG_START
from scrivane.operators import cache as C
from scrivane.operators import model as X
from scrivane.operators import ordered as O
from scrivane.operators import pages as G
from scrivane.operators import timeline as L
from scrivane.sources import files as IO
from scrivane.sources.content import work_folder
from scrivane.sources.page_store import PageStore
from scrivane.streaming.resume import answer_units, answers_of, fold_units

Query = Callable[[SparkSession, str], DataFrame]
_made: dict[str, tuple[Query, str | None]] = {}

PROMPT = "Describe the page"
CHUNK, RATE, MOST_SECONDS = 3600.0, 0.5, 300.0


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _made[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _made.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _made.items() if sql}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Fixtures: the same values in Spark and in SQL.


def _dirty(c: Column, n: Column) -> Column:
    """Every third text gets a payload, every fifth a run of five to seven blanks, every seventh four blanks."""
    return F.concat(
        F.when(n % 2 == 0, "  ").otherwise(""), c,
        F.when(n % 3 == 0, F.concat(F.lit(" "), F.repeat(F.lit("QUJD"), 15), F.lit("=="))).otherwise(""),
        F.when(n % 5 == 0, F.concat(F.repeat(F.lit("&NBSP;"), (F.lit(5) + n % 3).cast("int")), F.lit("x"))).otherwise(""),
        F.when(n % 7 == 0, F.lit("&nbsp;&nbsp;&nbsp;&nbsp;y ")).otherwise(""),
    )


_DIRTY_SQL = """(CASE WHEN doc_id % 2 = 0 THEN '  ' ELSE '' END || text
 || CASE WHEN doc_id % 3 = 0 THEN ' ' || repeat('QUJD', 15) || '==' ELSE '' END
 || CASE WHEN doc_id % 5 = 0 THEN repeat('&NBSP;', CAST(5 + doc_id % 3 AS INT)) || 'x' ELSE '' END
 || CASE WHEN doc_id % 7 = 0 THEN '&nbsp;&nbsp;&nbsp;&nbsp;y ' ELSE '' END)"""
_STRIP = "regexp_replace({}, '^[\\s]+|[\\s]+$', '', 'g')"
_CLEAN_SQL = _STRIP.format(f"regexp_replace(regexp_replace({_DIRTY_SQL}, '[A-Za-z0-9+/]{{50,}}={{0,2}}', '', 'g'), '(&nbsp;){{5,}}', ' ', 'gi')")
_WORDS_SQL = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"


@query(f"SELECT doc_id, {_CLEAN_SQL} AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", T.clean(_dirty(F.col("text"), F.col("doc_id"))).alias("cleaned"))


@query(f"""SELECT doc_id, cleaned, len(cleaned) AS n FROM (SELECT doc_id, {_CLEAN_SQL} AS cleaned FROM documents)""")
def clean_pages(spark, sf_dir):
    """Cleaning inside nested records."""
    d = _table(spark, sf_dir, "documents")
    pages = d.select("doc_id", F.array(F.struct(F.lit(1).alias("page_number"), _dirty(F.col("text"), F.col("doc_id")).alias("page_content"))).alias("pages"))
    made = pages.select("doc_id", T.clean_pages(F.col("pages"))[0]["page_content"].alias("cleaned"))
    return made.select("doc_id", "cleaned", F.length("cleaned").cast("long").alias("n"))


@query(f"SELECT doc_id, CAST({_WORDS_SQL.format('text')} AS BIGINT) AS n_words FROM documents")
def word_count(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_words"))


@query("""SELECT doc_id, 'p' || (1 + doc_id % 9) || '_' || substr(sha256(text), 1, 16) AS page_hash FROM documents""")
def page_hash(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", K.page_hash(F.lit(1) + F.col("doc_id") % 9, F.col("text")).alias("page_hash"))


@query(f"""SELECT doc_id, sha256(text) AS file_hash, sha256(text) || '_' || sha256('{PROMPT}') AS cache_key,
 sha256(text) || '_' || sha256('{PROMPT}') || CASE WHEN doc_id % 2 = 0 THEN '_pages_0_2_' || (3 + doc_id % 4) ELSE '' END AS subset_key,
 sha256(text) || '_' || sha256('{PROMPT}') || '_0.5_transcribe_whisper-1' AS video_key,
 sha256(text) || '_whisper-1_' || CASE WHEN doc_id % 3 = 0 THEN 'auto' ELSE lang END AS transcript_key,
 'cache/' || sha256(text) || '.json' AS entry_path, sha256(text) || '_partial.json' AS partial_path, 'tmp/images/' || sha256(text) AS image_folder
 FROM documents""")
def cache_keys(spark, sf_dir):
    h = K.content_hash(F.col("text").cast("binary"))
    d = _table(spark, sf_dir, "documents").withColumn("file_hash", h)
    key, h = K.cache_key(h, F.lit(PROMPT)), F.col("file_hash")
    pages = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(0).cast("long"), F.lit(2).cast("long"), 3 + F.col("doc_id") % 4))
    lang = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    return d.select(
        "doc_id", "file_hash", key.alias("cache_key"), F.concat(key, K.page_suffix(pages)).alias("subset_key"), K.video_key(h, F.lit(PROMPT), RATE, "whisper-1").alias("video_key"),
        K.transcript_key(h, F.lit("whisper-1"), lang).alias("transcript_key"), K.entry_path(h, "cache/").alias("entry_path"), K.partial_path(h).alias("partial_path"), K.image_folder("tmp/images", h).alias("image_folder"),
    )


@query("""SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE substr(v, 1, 4) || repeat('*', greatest(0, length(v) - 4)) END AS masked
 FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN substr(c_name, 1, 3) WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS v FROM customer)""")
def mask_secret(spark, sf_dir):
    n = F.col("c_custkey")
    v = F.when(n % 7 == 0, F.substring("c_name", 1, 3)).when(n % 11 == 0, "").otherwise(F.col("c_name"))
    return _table(spark, sf_dir, "customer").select("c_custkey", T.mask_secret(F.when(n % 10 != 0, v)).alias("masked"))


# Pages and documents: a conversation is a document, its turns are the pages.


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("page_number"), F.col("text").alias("page_content"))


@query(f"""SELECT conv_id, CAST(count(*) AS BIGINT) AS n_pages, CAST(sum({_WORDS_SQL.format('text')}) AS BIGINT) AS total_words,
 string_agg(text, chr(10) ORDER BY turn, text) AS content FROM conversations GROUP BY conv_id""")
def assemble_pages(spark, sf_dir):
    return G.assemble(_pages(spark, sf_dir), "conv_id").select("conv_id", "n_pages", F.col("total_words").cast("long").alias("total_words"), "content")


@query("""WITH d AS (SELECT conv_id, count(*) AS n, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS h FROM conversations GROUP BY conv_id)
SELECT conv_id, 'conv' || conv_id || '.pdf' AS file_name, h AS cache_key, CAST(n AS INT) AS total_pages,
 CASE WHEN n > 2 THEN 2 END AS processed_pages, CASE WHEN n > 2 THEN '0,1' END AS page_indexes FROM d""")
def document_records(spark, sf_dir):
    """File records; the selected pages are recorded only where they are fewer than the document's."""
    made = G.assemble(_pages(spark, sf_dir), "conv_id")
    files = made.select(
        "conv_id", F.concat(F.lit("conv"), "conv_id", F.lit(".pdf")).alias("file_name"), K.content_hash(F.col("content").cast("binary")).alias("cache_key"),
        F.concat(F.lit("/in/conv"), "conv_id", F.lit(".pdf")).alias("file_full_path"), F.col("n_pages").cast("int").alias("total_pages"), F.array(F.lit(0), F.lit(1)).alias("page_indexes"),
    )
    out = G.document_records(made.drop("n_pages"), files, "conv_id")
    return out.select("conv_id", "file_name", "cache_key", "total_pages", "processed_pages", F.array_join("page_indexes", ",").alias("page_indexes"))


@query("""SELECT conv_id, string_agg(chr(10) || '===== Page: ' || (turn + 1) || ' =====' || chr(10) || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn, text) AS markdown
 FROM conversations GROUP BY conv_id""")
def markdown_doc(spark, sf_dir):
    return G.assemble(_pages(spark, sf_dir), "conv_id").select("conv_id", G.markdown(F.col("pages")).alias("markdown"))


@query("""WITH i AS (SELECT conv_id, unnest([2, 0, conv_id % 4, 2]) AS idx FROM (SELECT DISTINCT conv_id FROM conversations)),
s AS (SELECT DISTINCT conv_id, idx FROM i)
SELECT c.conv_id, CAST(turn + 1 AS INT) AS page_number, '_pages_' || suffix AS suffix FROM conversations c
JOIN s ON s.conv_id = c.conv_id AND s.idx = c.turn
JOIN (SELECT conv_id, string_agg(idx, '_' ORDER BY idx) AS suffix FROM s GROUP BY conv_id) t ON t.conv_id = c.conv_id""")
def page_selection(spark, sf_dir):
    """Zero-based indexes with repeats, out of order, to sorted pages numbered from 1."""
    pages = _pages(spark, sf_dir)
    asked = pages.select("conv_id").distinct().withColumn("idx", G.selected_pages(F.array(F.lit(2).cast("long"), F.lit(0).cast("long"), F.col("conv_id") % 4, F.lit(2).cast("long")), F.lit(4)))
    kept = G.pages_of_selection(pages, asked.select("conv_id", F.explode("idx").alias("idx")), "conv_id")
    return kept.join(asked, "conv_id").select("conv_id", "page_number", K.page_suffix(F.col("idx")).alias("suffix"))


@query("""SELECT conv_id, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1) // 3 AS BIGINT) AS batch, turn FROM conversations""")
def page_batches(spark, sf_dir):
    return G.batches(_table(spark, sf_dir, "conversations"), "conv_id", "turn", 3, ties=["text"]).select("conv_id", "batch", "turn")


@query("""WITH p AS (SELECT source, doc_id, row_number() OVER w - 1 AS number, count(*) OVER (PARTITION BY source) AS n_pages,
 sum(coalesce(length(text), 0) + 1) OVER w - coalesce(length(text), 0) - 1 AS begins FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id, text ROWS UNBOUNDED PRECEDING))
SELECT source, doc_id, CAST(number AS BIGINT) AS number, CAST(n_pages AS BIGINT) AS n_pages, CAST(begins AS BIGINT) AS begins FROM p""")
def page_offsets(spark, sf_dir):
    """A source as one document whose pages are its texts: each page's number, their count, and where its text begins in the document."""
    d = _table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    n = O.numbered(d, "source", "doc_id", ties=["text"], total="n_pages")
    at = O.running(n, "source", "doc_id", weight=F.coalesce(F.length("text"), F.lit(0)) + 1, ties=["text"], before="begins")
    return at.select("source", "doc_id", "number", "n_pages", "begins")


@query("""WITH p AS (SELECT source, doc_id, coalesce(text, '') AS c, sum(coalesce(length(text), 0) + 1) OVER (PARTITION BY source ORDER BY doc_id, text ROWS UNBOUNDED PRECEDING) - coalesce(length(text), 0) - 1 AS begins FROM documents)
SELECT source, CAST(begins // 100000 AS BIGINT) AS part, min(doc_id) AS first_page, max(doc_id) AS last_page, count(*) AS n_pages, string_agg(c, chr(10) ORDER BY begins) AS content FROM p GROUP BY source, begins // 100000""")
def document_parts(spark, sf_dir):
    """The same documents, put together in parts of 100,000 characters."""
    return O.parts(_table(spark, sf_dir, "documents"), "source", "doc_id", "text", most=100_000)


@query("""WITH p AS (SELECT conv_id, row_number() OVER w - 1 AS unit, text, sum(coalesce(length(text), 0) + 1) OVER w - coalesce(length(text), 0) - 1 AS begins, count(*) OVER (PARTITION BY conv_id) AS total
 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING))
SELECT 'c' || conv_id AS file_hash, CAST(begins // 200 AS BIGINT) AS part, CAST(min(unit) AS BIGINT) AS first_unit, CAST(max(unit) AS BIGINT) AS last_unit, count(*) AS n_units, CAST(count(*) FILTER (text IS NULL) AS BIGINT) AS failed_units,
 string_agg(coalesce(text, ''), chr(10) ORDER BY unit) AS content, max(unit) = max(total) - 1 AS ended FROM p GROUP BY conv_id, begins // 200""")
def streamed_parts(spark, sf_dir):
    """Turns as a stream of units out of order, asked about once each through the cache, and put together in parts as they come; the answer is the text itself."""
    c = O.numbered(_table(spark, sf_dir, "conversations"), "conv_id", "turn", ties=["text"], name="unit", total="total")
    name = F.concat(F.lit("c"), "conv_id")
    units = c.select(name.alias("file_hash"), "unit", "total", "text", F.sha2(F.concat_ws("/", "conv_id", "unit").cast("binary"), 256).alias("cache_key"))
    folder = work_folder(spark, f"units-{uuid.uuid4().hex}")
    units.repartition(4, F.xxhash64("cache_key")).write.parquet(f"{folder}/units")
    read = spark.readStream.schema(units.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/units")
    cache = C.CacheTable(spark, f"{folder}/cache")
    answer_units(read, cache, lambda misses: misses.select("cache_key", F.col("text").alias("value")), f"{folder}/answers", f"{folder}/asked").awaitTermination()
    parts = fold_units(answers_of(spark, f"{folder}/answers"), most=200)
    parts.writeStream.format("parquet").option("path", f"{folder}/parts").option("checkpointLocation", f"{folder}/folded").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(parts.schema).parquet(f"{folder}/parts")


@query(f"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '{PROMPT}' ELSE '{PROMPT}' || chr(10) || chr(10)
 || 'Text content extracted from this page by using PyMuPDF, use this for reference and improve accuracy:' || chr(10) || '<text_content>' || chr(10) || text || chr(10) || '</text_content>' END AS prompt FROM documents""")
def page_prompt(spark, sf_dir):
    text = F.when(F.col("doc_id") % 8 == 0, " \n\t ").when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", P.page_prompt(F.lit(PROMPT), text).alias("prompt"))


@query("""SELECT conv_id, 'Extract information and output in the template format: ' || chr(10) || '<template>alarm: string</template>' || chr(10) || 'Content: ' || chr(10)
 || '<content>' || string_agg(text, chr(10) ORDER BY turn, text) || '</content>' AS prompt FROM conversations GROUP BY conv_id""")
def template_prompt(spark, sf_dir):
    return G.assemble(_pages(spark, sf_dir), "conv_id").select("conv_id", P.template_prompt(F.lit("alarm: string"), F.col("content")).alias("prompt"))


# Cache.


def _requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests with a primary and a fallback key, and a cache whose tiers hold some of either."""
    d = _table(spark, sf_dir, "documents").withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    asked = d.select(F.col("doc_id").alias("request_id"), F.array(F.concat(F.lit("a_"), "h"), F.concat(F.lit("b_"), "h")).alias("keys"), (F.col("doc_id") % 13 == 0).alias("bypass"))
    one = d.groupBy("h").agg(F.min("doc_id").alias("n"))
    entry = lambda key, tier, when: one.where(when).select(F.concat(F.lit(key), "h").alias("cache_key"), F.lit(tier).alias("tier"), F.to_json(F.struct(F.lit(key + tier).alias("v"), "n")).alias("value"))
    n = F.col("n")
    return asked, entry("a_", "s3", n % 5 == 0).union(entry("a_", "file", n % 3 == 0)).union(entry("b_", "file", n % 2 == 0)).union(entry("b_", "s3", n % 7 == 0))


_CACHE_SQL = """WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents), o AS (SELECT h, min(doc_id) AS n FROM d GROUP BY h),
cache AS (SELECT 'a_' || h AS cache_key, 's3' AS tier, '{"v":"a_s3","n":' || n || '}' AS value FROM o WHERE n % 5 = 0
 UNION ALL SELECT 'a_' || h, 'file', '{"v":"a_file","n":' || n || '}' FROM o WHERE n % 3 = 0
 UNION ALL SELECT 'b_' || h, 'file', '{"v":"b_file","n":' || n || '}' FROM o WHERE n % 2 = 0
 UNION ALL SELECT 'b_' || h, 's3', '{"v":"b_s3","n":' || n || '}' FROM o WHERE n % 7 = 0),
asked AS (SELECT doc_id AS request_id, unnest(['a_' || h, 'b_' || h]) AS cache_key, unnest([0, 1]) AS p FROM d WHERE doc_id % 13 <> 0),
hit AS (SELECT request_id, value, c.cache_key, tier, row_number() OVER (PARTITION BY request_id ORDER BY p, tier = 'file') AS r
 FROM asked JOIN cache c ON asked.cache_key = c.cache_key)
"""


@query(_CACHE_SQL + "SELECT d.doc_id AS request_id, value, cache_key AS hit_key, tier AS hit_tier FROM d LEFT JOIN hit ON request_id = doc_id AND r = 1")
def cache_fallback(spark, sf_dir):
    asked, cache = _requests(spark, sf_dir)
    return C.lookup(asked, cache, bypass="bypass")


@query(_CACHE_SQL + """SELECT DISTINCT cache_key, 'file' AS tier, value FROM hit WHERE r = 1 AND tier = 's3'
 AND cache_key NOT IN (SELECT cache_key FROM cache WHERE tier = 'file')""")
def cache_backfill(spark, sf_dir):
    asked, cache = _requests(spark, sf_dir)
    return C.backfill(C.lookup(asked, cache, bypass="bypass"), cache)


@query("""SELECT doc_id, doc_id % 3 = 0 AND doc_id % 9 <> 0 AS hit FROM documents""")
def cache_hits(spark, sf_dir):
    """Hits and misses; entries that are no JSON count as missing."""
    work = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("cache_key"))
    cache = work.where("doc_id % 3 = 0").select("cache_key", F.when(F.col("doc_id") % 9 == 0, "{broken").otherwise('{"v": 1}').alias("value"))
    hits, misses = C.hits_and_misses(work, cache)
    return hits.select("doc_id", F.lit(True).alias("hit")).union(misses.select("doc_id", F.lit(False)))


@query("""SELECT conv_id, turn, turn % 2 = 1 AS from_saved FROM conversations""")
def partial_resume(spark, sf_dir):
    """Odd turns are saved; the others are processed and put together with them."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    done = rows.where("turn % 2 = 1").withColumn("from_saved", F.lit(True))
    todo = C.resume(rows, done, ["conv_id", "turn"]).withColumn("from_saved", F.lit(False))
    return C.with_saved(todo, done, ["conv_id", "turn"])


@query("""SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def upsert_last_wins(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return C.upsert(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""SELECT conv_id, CAST(turn + 1 AS INT) AS page_number, text AS page_content, 'p' || (turn + 1) || '_' || substr(sha256(text), 1, 16) AS page_hash FROM conversations""")
def partial_round_trip(spark, sf_dir):
    """Partial results to one JSON object for each key and back."""
    pages = _pages(spark, sf_dir).withColumn("page_hash", K.page_hash(F.col("page_number"), F.col("page_content")))
    return C.from_partial_json(C.partial_json(pages, "conv_id"), "conv_id")


@query("""SELECT conv_id AS file_hash, count(*) FILTER (turn % 3 <> 1) >= 4 AS complete FROM conversations GROUP BY conv_id""")
def images_complete(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    images = c.select(F.col("conv_id").alias("file_hash"), F.when(F.col("turn") % 3 == 0, "p.png").when(F.col("turn") % 3 == 2, "P.PNG").otherwise("p.json").alias("name"))
    return C.images_complete(images, c.select(F.col("conv_id").alias("file_hash"), F.lit(4).alias("expected")).distinct())


@query("""WITH e AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS cache_key, lang, source, sha256(text) AS h FROM documents)
SELECT cache_key, 'file' AS tier, CASE WHEN lang = 'de' THEN 'later ' || h ELSE h END AS value FROM e WHERE source IS DISTINCT FROM 'src7'""")
def cache_versions(spark, sf_dir):
    """A cache after writing, writing again, compacting and invalidating, looked up by keys that it holds and keys that it lacks."""
    d = _table(spark, sf_dir, "documents").select(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256).alias("cache_key"), "lang", "source", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    cache = C.CacheTable(spark, work_folder(spark, f"cache-{uuid.uuid4().hex}"))
    cache.write(d.select("cache_key", F.col("h").alias("value")))
    cache.write(d.where("lang = 'de'").select("cache_key", F.concat(F.lit("later "), "h").alias("value")))
    cache.compact()
    cache.invalidate(d.where("source = 'src7'"))
    asked = d.select("cache_key").union(_table(spark, sf_dir, "pages").select(F.col("url").alias("cache_key")))
    return cache.read(asked).select("cache_key", "tier", "value")


@query("""WITH p AS (SELECT sha256(CAST(conv_id AS VARCHAR)) AS file_hash, 'p' || turn AS page_hash, 16 + octet_length(encode(text)) AS length, role FROM conversations),
n AS (SELECT file_hash, count(*) AS expected, count(*) FILTER (role <> 'system') AS stored, CAST(sum(length) FILTER (role <> 'system') AS BIGINT) AS bytes FROM p GROUP BY file_hash)
SELECT file_hash, coalesce(stored, 0) AS stored, bytes, stored >= expected AS complete FROM n""")
def page_store(spark, sf_dir):
    """Turns as page images in a store: stored, found again through its index, and counted."""
    c = _table(spark, sf_dir, "conversations").select(F.sha2(F.col("conv_id").cast("string").cast("binary"), 256).alias("file_hash"), F.concat(F.lit("p"), "turn").alias("page_hash"), "text", "role")
    image = F.concat(F.lit(PNG_START), F.col("text").cast("binary"), F.lit(b"IEND0000"))
    store = PageStore(spark, work_folder(spark, f"images-{uuid.uuid4().hex}"))
    store.add(c.where("role <> 'system'").select("file_hash", "page_hash", image.alias("image")))
    expected = c.groupBy("file_hash").agg(F.count(F.lit(1)).alias("expected"))
    whole = store.lookup(c).join(store.index(), ["file_hash", "page_hash"]).groupBy("file_hash").agg(F.count(F.lit(1)).alias("stored"), F.sum("length").alias("bytes"))
    return store.complete(expected).join(whole, "file_hash", "left").select("file_hash", F.coalesce("stored", F.lit(0)).alias("stored"), "bytes", "complete")


@query("""SELECT coalesce(source, 'none') || '/' || doc_id || '.txt' AS key, octet_length(encode(text)) AS size FROM documents""")
def stored_objects(spark, sf_dir):
    """Texts as objects of a store, written together and listed by tasks."""
    d = _table(spark, sf_dir, "documents")
    path = work_folder(spark, f"objects-{uuid.uuid4().hex}")
    IO.write_objects(d.select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), "doc_id", F.lit(".txt")).alias("key"), F.col("text").alias("content")), path)
    return IO.list_objects(spark, path).select(F.regexp_extract("key", r"([^/]+/[^/]+)$", 1).alias("key"), "size")


# Timelines: users are videos, events are segments.


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", (30 + 4.25 * F.col("user_id")).alias("duration"), (24 + F.col("user_id") % 7).cast("double").alias("fps"))


_VIDEOS_SQL = "v AS (SELECT DISTINCT user_id, 30 + 4.25 * user_id AS duration, CAST(24 + user_id % 7 AS DOUBLE) AS fps FROM events)"
_CHUNKS_SQL = f"{_VIDEOS_SQL}, n AS (SELECT *, greatest(1, CAST(floor((duration + 60 - 1) / 60) AS INT)) AS total_chunks FROM v), c AS (SELECT *, unnest(range(0, total_chunks)) AS k FROM n)"


@query(f"""WITH {_CHUNKS_SQL} SELECT user_id, CAST(k AS INT) AS chunk_idx, CAST(k * 60 AS DOUBLE) AS start_sec, CAST(least((k + 1) * 60, duration) AS DOUBLE) AS end_sec, total_chunks FROM c""")
def chunk_plan(spark, sf_dir):
    return L.chunk_plan(_videos(spark, sf_dir), 60.0).select("user_id", "chunk_idx", "start_sec", F.col("end_sec").cast("double").alias("end_sec"), "total_chunks")


@query(f"""WITH {_VIDEOS_SQL}, f AS (SELECT *, unnest(range(0, CAST(least(floor(duration * 0.5), 150) AS INT))) AS i FROM v)
SELECT user_id, CAST(i AS INT) AS i, CAST(i * 2.0 AS DOUBLE) AS ts_sec, CAST(floor(i * 2.0 * fps) AS BIGINT) AS frame_position FROM f""")
def frame_plan(spark, sf_dir):
    return L.frame_plan(_videos(spark, sf_dir), RATE, MOST_SECONDS).select("user_id", "i", "ts_sec", "frame_position")


@query(f"""WITH {_CHUNKS_SQL}, r AS (SELECT user_id, k, fps, k * 60 AS s, least((k + 1) * 60, duration) AS e FROM c),
f AS (SELECT *, unnest(range(0, CAST(floor((e - s) * 0.5) AS INT))) AS i FROM r)
SELECT user_id, CAST(k AS INT) AS chunk_idx, CAST(i AS INT) AS i, CAST(floor((s + i * 2.0) * fps) AS BIGINT) AS frame_position FROM f WHERE s + i * 2.0 < e""")
def range_frames(spark, sf_dir):
    chunks = L.chunk_plan(_videos(spark, sf_dir), 60.0, alike=["fps"])
    return L.range_frame_plan(chunks, RATE).select("user_id", "chunk_idx", "i", "frame_position")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    sec = F.unix_micros(F.date_trunc("second", F.col("ts").cast("timestamp"))) / 1e6 % 86400
    return e.select("user_id", F.col("event_id").alias("seg_idx"), sec.alias("start"), (sec + F.coalesce(F.abs("value"), F.lit(0.0))).alias("end"), F.col("event_type").alias("text"))


def _day_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _segments(spark, sf_dir).groupBy("user_id").agg(F.max("end").alias("duration"))
    return L.chunk_plan(s, CHUNK)


_SEGMENTS_SQL = f"""s AS (SELECT user_id, event_id AS seg_idx, CAST(epoch(date_trunc('second', ts)) % 86400 AS DOUBLE) AS "start",
 CAST(epoch(date_trunc('second', ts)) % 86400 AS DOUBLE) + coalesce(abs(value), 0) AS "end", event_type AS text FROM events),
d AS (SELECT user_id, max("end") AS duration FROM s GROUP BY user_id),
c AS (SELECT user_id, duration, total_chunks, k, k * {CHUNK} AS start_sec, least((k + 1) * {CHUNK}, duration) AS end_sec
 FROM (SELECT *, unnest(range(0, total_chunks)) AS k FROM (SELECT *, greatest(1, CAST(floor((duration + {CHUNK} - 1) / {CHUNK}) AS INT)) AS total_chunks FROM d))),
j AS (SELECT c.*, seg_idx, "start", "end", text FROM c JOIN s ON s.user_id = c.user_id AND "start" < end_sec AND "end" > start_sec)"""


@query(f"WITH {_SEGMENTS_SQL} SELECT user_id, CAST(k AS INT) AS chunk_idx, seg_idx FROM j")
def overlap_join(spark, sf_dir):
    """Chunks and segments that overlap; a segment across a border is in both chunks."""
    return L.overlap_join(_day_chunks(spark, sf_dir), _segments(spark, sf_dir), "user_id", CHUNK).select("user_id", "chunk_idx", "seg_idx")


@query(f"""WITH {_SEGMENTS_SQL} SELECT user_id, CAST(k AS INT) AS chunk_idx, CAST(round(any_value(end_sec - start_sec), 6) AS DOUBLE) AS duration,
 CAST(count(*) AS INT) AS n_segments, string_agg(text, ' ' ORDER BY seg_idx) AS full_text FROM j GROUP BY user_id, k""")
def chunk_transcripts(spark, sf_dir):
    joined = L.overlap_join(_day_chunks(spark, sf_dir), _segments(spark, sf_dir), "user_id", CHUNK).drop("duration")
    t = L.chunk_transcripts(joined, ["user_id", "chunk_idx"])
    return t.select("user_id", "chunk_idx", F.round("duration", 6).alias("duration"), F.size("segments").alias("n_segments"), "full_text")


_CLOCK = "printf('%02d:%02d', CAST(floor({0} / 60) AS BIGINT), CAST(floor({0} % 60) AS BIGINT))"


@query(f"SELECT event_id, {_CLOCK.format('(event_id * 7.3)')} AS clock FROM events")
def format_time(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", S.clock(F.col("event_id") * F.lit(7.3)).alias("clock"))


@query("""SELECT event_id, printf('[%02d:%02d.%02d] %s', (event_id * 37) // 6000, (event_id * 37) % 6000 // 100, (event_id * 37) % 100, event_type) AS line FROM events""")
def lrc_lines(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", S.lrc_line_of_cents(F.col("event_id") * 37, F.col("event_type")).alias("line"))


@query("""SELECT user_id, string_agg(printf('[%02d:%02d.%02d] %s', event_id // 6000, event_id % 6000 // 100, event_id % 100, event_type), chr(10) ORDER BY event_id) AS lrc,
 chr(10) || '--- Video Audio Transcription ---' || chr(10) || string_agg(printf('[%02d:%02d.%02d] %s', event_id // 6000, event_id % 6000 // 100, event_id % 100, event_type), chr(10) ORDER BY event_id) || chr(10) || '---' || chr(10) AS context
 FROM events GROUP BY user_id""")
def lrc_documents(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", S.lrc_line_of_cents(F.col("event_id"), F.col("event_type")).alias("line"))
    made = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("l"))
    lrc = S.lrc_document(F.transform("l", lambda x: x["line"]))
    return made.select("user_id", lrc.alias("lrc"), S.prompt_context(lrc).alias("context"))


@query("""SELECT conv_id, turn, CAST(turn * 1.5 AS DOUBLE) AS "start", CASE WHEN turn % 2 = 0 THEN 0.0 ELSE CAST(turn + 1 AS DOUBLE) END AS "end", trim(text, ' ' || chr(10)) AS text
 FROM conversations WHERE turn % 3 <> 1""")
def transcript_parse(spark, sf_dir):
    """Speech responses as JSON: blank segments go, texts are stripped, missing times are 0."""
    c = _table(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 3 == 1, "  ").otherwise(F.concat(F.lit("  "), "text", F.lit("\n ")))
    segment = F.struct((F.col("turn") * 1.5).alias("start"), F.when(F.col("turn") % 2 == 1, F.col("turn") + 1.0).alias("end"), text.alias("text"))
    docs = c.select("conv_id", "turn", F.to_json(F.struct(F.array(segment).alias("segments"), F.lit("en").alias("language"))).alias("json"))
    return docs.select("conv_id", "turn", F.explode(S.speech_response(F.col("json"))["segments"]).alias("s")).select("conv_id", "turn", "s.start", "s.end", "s.text")


@query("""SELECT conv_id, CAST(count(*) AS INT) AS n_segments, string_agg(text, '|' ORDER BY turn, text) AS texts, 'en' AS language, CAST(12.5 AS DOUBLE) AS duration, '' AS full_text FROM conversations GROUP BY conv_id""")
def transcript_round_trip(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("double").alias("start"), "text"))).alias("segments"))
    made = c.select("conv_id", S.parse(F.to_json(F.struct("segments", F.lit("en").alias("language"), F.lit(12.5).alias("duration")))).alias("t"))
    back = made.select("conv_id", S.parse(S.to_json(F.col("t"))).alias("t"))
    return back.select("conv_id", F.size("t.segments").alias("n_segments"), F.array_join(F.transform("t.segments", lambda s: s["text"]), "|").alias("texts"), "t.language", "t.duration", "t.full_text")


_NOTE = "CASE WHEN total_chunks > 1 THEN chr(10) || chr(10) || 'Note: This is chunk ' || (k + 1) || ' of ' || total_chunks || '. Focus on analyzing the content within this time range (' || s || ' - ' || e || ').' ELSE '' END"


@query(f"""WITH {_CHUNKS_SQL}, r AS (SELECT *, {_CLOCK.format('(k * 60)')} AS s, {_CLOCK.format('least((k + 1) * 60, duration)')} AS e, {_CLOCK.format('duration')} AS t FROM c)
SELECT user_id, CAST(k AS INT) AS chunk_idx, '--- Video Analysis: Chunk ' || (k + 1) || '/' || total_chunks || ' ---' || chr(10) || 'Time range: ' || s || ' to ' || e || ' (total video duration: ' || t || ')' || chr(10)
 || 'Frames: 30 frames captured at 0.5 fps (1 frame every 2.0 seconds)' || chr(10) || CASE WHEN k % 2 = 1 THEN 'CTX' ELSE '' END || chr(10) || 'Describe the scene' || {_NOTE} AS prompt FROM r""")
def chunk_prompt(spark, sf_dir):
    c = L.chunk_plan(_videos(spark, sf_dir), 60.0)
    context = F.when(F.col("chunk_idx") % 2 == 1, "CTX")
    prompt = P.chunk_prompt(F.lit("Describe the scene"), F.col("chunk_idx"), F.col("total_chunks"), F.col("start_sec"), F.col("end_sec"), F.col("duration"), F.lit(30), context, RATE)
    return c.select("user_id", "chunk_idx", prompt.alias("prompt"))


@query(f"""WITH {_CHUNKS_SQL}, r AS (SELECT *, {_CLOCK.format('(k * 60)')} AS s, {_CLOCK.format('least((k + 1) * 60, duration)')} AS e FROM c)
SELECT user_id, CAST(count(*) AS INT) AS n_chunks, CASE WHEN count(*) = 1 THEN 'r0' END AS answer,
 CASE WHEN count(*) > 1 THEN 'The following are analysis results from ' || count(*) || ' consecutive chunks of a video (total duration: ' || {_CLOCK.format('any_value(duration)')} || '), processed at 0.5 fps.' || chr(10) || chr(10)
 || string_agg('--- Chunk ' || (k + 1) || '/' || total_chunks || ' [' || s || ' - ' || e || '] ---' || chr(10) || 'r' || k || chr(10) || chr(10), '' ORDER BY k)
 || 'Based on all the chunk analyses above, provide a comprehensive and unified response to:' || chr(10) || 'Describe the scene' END AS prompt
FROM r GROUP BY user_id""")
def synthesis_fold(spark, sf_dir):
    results = L.chunk_plan(_videos(spark, sf_dir), 60.0, by="user_id").withColumn("result", F.concat(F.lit("r"), "chunk_idx"))
    return L.fold(results, "user_id", "Describe the scene", RATE)


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Watch' ELSE 'Watch' || chr(10) || event_type || chr(10) || 'Please use both the visual frames and the audio transcription above to analyze this video.' END AS prompt FROM events""")
def transcript_prompt(spark, sf_dir):
    context = F.when(F.col("event_id") % 6 == 0, "").when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("event_type"))
    return _table(spark, sf_dir, "events").select("event_id", P.with_transcript(F.lit("Watch"), context).alias("prompt"))


# Images: sizes from part keys.

_W, _H = "(1 + l.p_partkey * 37 % 9000)", "(1 + l.p_partkey * 53 % 9500)"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select("p_partkey", (1 + k * 37 % 9000).cast("int").alias("w"), (1 + k * 53 % 9500).cast("int").alias("h"), (k % 103).cast("int").alias("n"), (k * 4099 % 5000000).alias("bytes"))


_FIT = "CAST(trunc({0} * least(1.0, {2} / CAST(greatest({1}) AS DOUBLE))) AS INT)"


@query("SELECT p_partkey, " + ", ".join(f"{_FIT.format(d, f'{_W}, {_H}', side)} AS {name}_{x}" for side, name in ((2000.0, "page"), (768.0, "frame"), (1568.0, "provider")) for d, x in ((_W, "w"), (_H, "h"))) + " FROM part l")
def resize_plan(spark, sf_dir):
    w, h = F.col("w"), F.col("h")
    fits = [(side, name) for side, name in ((M.PAGE_SIDE, "page"), (M.FRAME_SIDE, "frame"), (M.PROVIDER_SIDE, "provider"))]
    return _images(spark, sf_dir).select("p_partkey", *(M.fitted(w, h, side)[d].alias(f"{name}_{d[0]}") for side, name in fits for d in ("width", "height")))


@query(f"SELECT p_partkey, CAST(floor({_W} * {_H} / 750.0) AS BIGINT) AS tokens FROM part l")
def image_tokens(spark, sf_dir):
    return _images(spark, sf_dir).select("p_partkey", M.image_tokens(F.col("w").cast("long"), F.col("h").cast("long")).alias("tokens"))


@query("""SELECT p_partkey, CASE WHEN n < 1 THEN 'no images' WHEN n > 100 THEN 'too many images' WHEN w > side OR h > side THEN 'dimensions' WHEN b64 > 5242880 THEN 'file size' END AS error
FROM (SELECT p_partkey, p_partkey % 103 AS n, 1 + p_partkey * 37 % 9000 AS w, 1 + p_partkey * 53 % 9500 AS h, CASE WHEN p_partkey % 103 > 1 THEN 2000 ELSE 8000 END AS side,
 ceil((p_partkey * 4099 % 5000000) / 3.0) * 4 AS b64 FROM part)""")
def image_limits(spark, sf_dir):
    return _images(spark, sf_dir).select("p_partkey", M.image_error(F.col("w"), F.col("h"), F.col("n"), M.base64_length(F.col("bytes"))).alias("error"))


@query("""SELECT p_partkey, chr(CAST(97 + p_partkey % 26 AS INT)) || chr(CAST(48 + p_partkey % 10 AS INT)) || 'v1' AS codec, CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE p_partkey * 10 / CAST(p_partkey % 5 * 10 AS DOUBLE) END AS duration FROM part""")
def video_facts(spark, sf_dir):
    k = F.col("p_partkey")
    codec = (97 + k % 26) + (48 + k % 10) * 256 + F.lit(ord("v") * 65536 + ord("1") * 16777216)
    return _table(spark, sf_dir, "part").select("p_partkey", M.codec_name(codec).alias("codec"), M.duration(k * 10, (k % 5 * 10).cast("double")).alias("duration"))


@query("""WITH v AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 'a.MP4' WHEN p_partkey % 4 = 1 THEN 'b.webm' ELSE 'c.mkv' END AS path, p_partkey % 6 <> 0 AS opens, p_partkey % 500 AS secs FROM part)
SELECT k AS p_partkey, CASE WHEN path = 'b.webm' THEN 'format' WHEN NOT opens THEN 'cannot open' WHEN secs > 300 THEN 'too long' END AS error FROM v""")
def video_limits(spark, sf_dir):
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, "a.MP4").when(k % 4 == 1, "b.webm").otherwise("c.mkv")
    return _table(spark, sf_dir, "part").select("p_partkey", M.video_error(path, k % 6 != 0, k % 500 * 25, F.lit(25.0), MOST_SECONDS).alias("error"))


# Files and objects.

_EXT = ("pdf", "PDF", "jpg", "Jpeg", "PNG", "tiff", "tif", "webp", "bmp", "gif", "svg", "txt", "mp4", "MOV", "mkv", "avi", "")


@query(f"""WITH f AS (SELECT doc_id, 'dir.v1/file' || doc_id || CASE WHEN e = '' THEN '' ELSE '.' || e END AS path, lower(e) AS e
 FROM (SELECT doc_id, [{', '.join(f"'{x}'" for x in _EXT)}][CAST(doc_id % {len(_EXT)} AS INT) + 1] AS e FROM documents))
SELECT doc_id, path, CASE WHEN e = 'pdf' THEN 'pdf' WHEN e IN ('jpg', 'jpeg', 'png', 'tiff', 'tif', 'webp', 'bmp') THEN 'image' WHEN e IN ('mp4', 'avi', 'mov', 'mkv') THEN 'video' END AS media_type FROM f""")
def route_files(spark, sf_dir):
    e = F.array(*map(F.lit, _EXT))[(F.col("doc_id") % len(_EXT)).cast("int")]
    path = F.concat(F.lit("dir.v1/file"), "doc_id", F.when(e == "", "").otherwise(F.concat(F.lit("."), e)))
    return _table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), M.media_type(path).alias("media_type"))


@query("""SELECT key FROM (SELECT CASE WHEN page_id = 0 THEN 'in/' WHEN page_id % 4 = 0 THEN 'in/images/' || page_id ELSE 'in/' || page_id || '.pdf' END AS key FROM pages) WHERE key <> 'in/' AND key NOT LIKE '%/images/%'""")
def object_listing(spark, sf_dir):
    n = F.col("page_id")
    key = F.when(n == 0, "in/").when(n % 4 == 0, F.concat(F.lit("in/images/"), n)).otherwise(F.concat(F.lit("in/"), n, F.lit(".pdf")))
    return IO.listed_objects(_table(spark, sf_dir, "pages").select(key.alias("key")), "in/")


# Requests and models.


@query("""SELECT conv_id, max_by(text, turn) FILTER (role = 'system') AS instructions, count(*) FILTER (role <> 'system') AS n_inputs FROM conversations GROUP BY conv_id""")
def system_instructions(spark, sf_dir):
    return R.system_instructions(_table(spark, sf_dir, "conversations"))


_MODELS = ("gpt-5", "gpt-5.1", "o1", "o3-mini", "gpt-4.1", "gpt-4-turbo", "sonnet")


@query(f"""WITH r AS (SELECT event_id, [{', '.join(f"'{m}'" for m in _MODELS)}][CAST(event_id % 7 AS INT) + 1] AS model, [NULL, 'none', 'high'][CAST(event_id % 3 AS INT) + 1] AS effort FROM events),
q AS (SELECT *, model LIKE 'gpt-5%' OR model LIKE 'o1%' OR model LIKE 'o3%' AS reasoning FROM r)
SELECT event_id, model, reasoning, CASE WHEN NOT reasoning THEN 4096 END AS max_tokens, CASE WHEN reasoning THEN 4096 END AS max_completion_tokens,
 CASE WHEN reasoning THEN effort END AS reasoning_effort, CASE WHEN NOT reasoning OR effort = 'none' THEN CAST(0.5 AS DOUBLE) END AS temperature FROM q""")
def request_params(spark, sf_dir):
    n = F.col("event_id")
    model, effort = F.array(*map(F.lit, _MODELS))[(n % 7).cast("int")], F.array(F.lit(None).cast("string"), F.lit("none"), F.lit("high"))[(n % 3).cast("int")]
    p = R.chat_parameters(model, F.lit(4096), effort, F.lit(0.5))
    return _table(spark, sf_dir, "events").select("event_id", R.is_reasoning(model).alias("reasoning"), p.alias("p")).select("event_id", "reasoning", "p.*")


@query("""SELECT source, CAST(count(*) AS BIGINT) AS calls, CAST(sum(n_chars) AS BIGINT) AS input_tokens, CAST(sum(n_chars % 50) AS BIGINT) AS output_tokens, CAST(sum(n_chars + n_chars % 50) AS BIGINT) AS total_tokens FROM documents GROUP BY source""")
def usage_rollup(spark, sf_dir):
    """Usage maps of two shapes, normalised and summed over all calls."""
    i, o = F.col("n_chars"), F.col("n_chars") % 50
    a = F.create_map(F.lit("input_tokens"), i, F.lit("output_tokens"), o)
    b = F.create_map(F.lit("prompt_tokens"), i, F.lit("completion_tokens"), o, F.lit("total_tokens"), i + o)
    rows = _table(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 2 == 0, a).otherwise(b).alias("usage")).select("source", R.normal_usage(F.col("usage")).alias("u"))
    return X.usage_totals(rows.select("source", "u.*"), ["source"])


@query("""SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id) > 1 THEN 'Image ' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || ':' END AS label FROM conversations""")
def image_labels(spark, sf_dir):
    return R.labelled_images(_table(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")


_PAGE_PROMPT_SQL = f"""CASE WHEN text IS NULL OR regexp_full_match(text, '\\s*') THEN '{PROMPT}' ELSE '{PROMPT}' || chr(10) || chr(10)
 || 'Text content extracted from this page by using PyMuPDF, use this for reference and improve accuracy:' || chr(10) || '<text_content>' || chr(10) || text || chr(10) || '</text_content>' END"""
_STUB_SQL = "'stub:' || substr(sha256({}), 1, 12)"


@query(f"""SELECT doc_id, {_STUB_SQL.format('prompt')} AS result, CAST(NULL AS VARCHAR) AS error, CAST(1 AS INT) AS tries, CAST(n AS BIGINT) AS input_tokens, CAST(1 AS BIGINT) AS output_tokens, CAST(n + 1 AS BIGINT) AS total_tokens
FROM (SELECT doc_id, prompt, {_WORDS_SQL.format('prompt')} AS n FROM (SELECT doc_id, {_PAGE_PROMPT_SQL} AS prompt FROM documents))""")
def model_map_stub(spark, sf_dir):
    """The batched model operator with the stub in place of a model; its answer is a digest of the prompt."""
    d = _table(spark, sf_dir, "documents")
    rows = d.select("doc_id", P.page_prompt(F.lit(PROMPT), F.col("text")).alias("prompt"))
    return X.map_model(rows, X.StubModel, keys=["doc_id"])


@query(f"""SELECT file_hash, count(*) AS n_pages, CAST(count(*) AS BIGINT) AS total_words, string_agg(r, chr(10) ORDER BY turn, r) AS content
FROM (SELECT sha256(CAST(conv_id AS VARCHAR)) AS file_hash, turn, {_STUB_SQL.format(_PAGE_PROMPT_SQL)} AS r FROM conversations) GROUP BY file_hash""")
def document_pipeline_stub(spark, sf_dir):
    """Pages to documents with model stub, cleaning and assembly."""
    from scrivane.plans.pipelines import process_pages

    pages = _pages(spark, sf_dir).withColumnsRenamed({"conv_id": "file_hash", "page_content": "text"}).withColumn("file_hash", F.sha2(F.col("file_hash").cast("string").cast("binary"), 256))
    return process_pages(pages, X.StubModel, PROMPT).select("file_hash", "n_pages", "total_words", "content")


@query(f"""WITH {_CHUNKS_SQL}, g AS (SELECT user_id, event_id AS seg_idx, CAST(epoch(date_trunc('second', ts)) % 86400 AS DOUBLE) AS a,
 CAST(epoch(date_trunc('second', ts)) % 86400 AS DOUBLE) + coalesce(abs(value), 0) AS z, event_type FROM events),
x AS (SELECT c.user_id, k, chr(10) || '--- Video Audio Transcription ---' || chr(10)
 || string_agg(printf('[%02d:%05.2f] %s', CAST(floor(a / 60) AS BIGINT), a % 60, event_type), chr(10) ORDER BY seg_idx) || chr(10) || '---' || chr(10) AS context
 FROM c JOIN g ON g.user_id = c.user_id AND a < least((k + 1) * 60, duration) AND z > k * 60 GROUP BY c.user_id, k),
r AS (SELECT c.*, context, CAST(floor((least((k + 1) * 60, duration) - k * 60) * 0.5) AS INT) AS frames, {_CLOCK.format('(k * 60)')} AS s, {_CLOCK.format('least((k + 1) * 60, duration)')} AS e, {_CLOCK.format('duration')} AS t
 FROM c LEFT JOIN x USING (user_id, k)),
q AS (SELECT *, '--- Video Analysis: Chunk ' || (k + 1) || '/' || total_chunks || ' ---' || chr(10) || 'Time range: ' || s || ' to ' || e || ' (total video duration: ' || t || ')' || chr(10)
 || 'Frames: ' || frames || ' frames captured at 0.5 fps (1 frame every 2.0 seconds)' || chr(10) || coalesce(context, '') || chr(10) || 'Describe the scene' || {_NOTE} AS prompt FROM r),
m AS (SELECT *, {_STUB_SQL.format('prompt')} AS made FROM q)
SELECT user_id, CAST(count(*) AS INT) AS n_chunks, CAST(0 AS BIGINT) AS failed_chunks, CASE WHEN count(*) = 1 THEN any_value(made) ELSE
 {_STUB_SQL.format("'The following are analysis results from ' || count(*) || ' consecutive chunks of a video (total duration: ' || any_value(t) || '), processed at 0.5 fps.' || chr(10) || chr(10) || string_agg('--- Chunk ' || (k + 1) || '/' || total_chunks || ' [' || s || ' - ' || e || '] ---' || chr(10) || made || chr(10) || chr(10), '' ORDER BY k) || 'Based on all the chunk analyses above, provide a comprehensive and unified response to:' || chr(10) || 'Describe the scene'")} END AS answer,
 CAST(NULL AS VARCHAR) AS error FROM m GROUP BY user_id""")
def video_pipeline_stub(spark, sf_dir):
    """Videos by chunks with transcripts, model stub and synthesis."""
    from scrivane.plans.pipelines import process_videos

    return process_videos(_videos(spark, sf_dir), _segments(spark, sf_dir), X.StubModel, "Describe the scene", key="user_id")


@query("""WITH p AS (SELECT p_partkey AS k, 1 + p_partkey % 61 AS w, 1 + p_partkey * 3 % 37 AS h, least(1.0, 24 / CAST(greatest(1 + p_partkey % 61, 1 + p_partkey * 3 % 37) AS DOUBLE)) AS f, p_partkey % 256 AS a FROM part)
SELECT k AS p_partkey, CASE WHEN k % 50 <> 0 THEN CAST(greatest(1, trunc(w * f)) AS INT) ELSE -1 END AS width, CASE WHEN k % 50 <> 0 THEN CAST(greatest(1, trunc(h * f)) AS INT) ELSE -1 END AS height,
 CASE WHEN k % 50 <> 0 THEN CAST((k * 5 % 256 * a + 255 * (255 - a) + 127) // 255 AS INT) ELSE -1 END AS red, CASE WHEN k % 50 <> 0 THEN CAST((k * 11 % 256 * a + 255 * (255 - a) + 127) // 255 AS INT) ELSE -1 END AS blue, k % 50 = 0 AS failed FROM p""")
def prepared_images(spark, sf_dir):
    """Image files made of parts, each of one translucent colour: decoded, laid on white, fitted and encoded; every fiftieth file is broken and gets -1."""
    import numpy as np
    import pandas as pd

    from scrivane.functions import pixels as W
    from scrivane.sources.images import prepare_images

    def made(parts):
        for part in parts:
            of = lambda k: W.encode_png(np.full((1 + k * 3 % 37, 1 + k % 61, 4), (k * 5 % 256, 0, k * 11 % 256, k % 256), np.uint8), 1) if k % 50 else b"broken"
            yield pd.DataFrame({"path": part["p_partkey"].astype(str), "file_hash": "", "content": [of(int(k)) for k in part["p_partkey"]]})

    def seen(parts):
        for part in parts:
            first = [(-1, -1, -1) if x is None else W.decode_png(bytes(x))[-1, -1].tolist() for x in part["image"]]
            colour = lambda i: np.array([f[i] for f in first], np.int32)
            yield pd.DataFrame({"p_partkey": part["path"].astype("int64"), "width": part["width"].fillna(-1).astype("int32"), "height": part["height"].fillna(-1).astype("int32"), "red": colour(0), "blue": colour(2), "failed": part["error"].notna()})

    files = _table(spark, sf_dir, "part").select("p_partkey").repartition(8).mapInPandas(made, "path string, file_hash string, content binary")
    return prepare_images(files, side=24).mapInPandas(seen, "p_partkey long, width int, height int, red int, blue int, failed boolean")


@query(f"""SELECT source, count(*) AS documents, CAST(sum({_WORDS_SQL.format('cleaned')}) AS BIGINT) AS words, count(DISTINCT key) AS cache_keys
FROM (SELECT source, {_CLEAN_SQL} AS cleaned, sha256(text) || '_' || sha256('{PROMPT}') AS key FROM documents) GROUP BY source""")
def flagship(spark, sf_dir):
    """Cleaned word counts and cache keys by source."""
    cleaned = T.clean(_dirty(F.col("text"), F.col("doc_id")))
    d = _table(spark, sf_dir, "documents").select("source", T.word_count(cleaned).alias("words"), K.cache_key(K.content_hash(F.col("text").cast("binary")), F.lit(PROMPT)).alias("key"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("words").cast("long").alias("words"), F.count_distinct("key").alias("cache_keys"))
