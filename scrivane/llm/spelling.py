"""Grouping of spelling variants by merging an errata trie.

All words form one trie. Every node has a heavy child, the one with the most
words below it, so a word leaves the heavy paths on at most log2(words) edges,
its light edges. Two words that are one edit apart part at exactly one node, and
at least one of them by a light edge. Light subtrees are merged into the rest of
their node with one character skipped or replaced: each word of a light subtree
is carried to the place where it would end

* with the light character replaced by the heavy one,
* with the light character skipped,
* with the heavy character put before the light one,

and the first two words that end at one place are a pair. Two light subtrees of a
node meet under a wildcard in the place of their first characters, and words that
coincide there are pairs as well. Each pair is found exactly once, whichever
child is called heavy, so the labels decide the cost only: log2(words) times a
word's length, against the length times the alphabet for plain deletion or
replacement neighbourhoods.

Scale. Texts are counted in the tasks that read them. A node is a 64-bit hash of
a prefix; subtree sizes are counts by node and child with partial sums. Nodes that
hold more than 1 / LARGE of all words are few (LARGE times the words' mean length
at most) and go to every task; the rest meet their words in a join in which no key
has more than 1 / LARGE of the words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm import _text as X
from scrivane.llm._kit import dropped, saved, table

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Characters of a long text, distinct runs, and letters of words that a task works on at once, about.
PART, MOST_HELD, SLICE = 1 << 20, 1 << 17, 1 << 17
#: A node with more than 1 / LARGE of the words is large; large nodes up to which they are broadcast.
LARGE, MOST_BROADCAST = 1024, 100_000


def _parts(text: str, gap: re.Pattern) -> Iterator[str]:
    at = 0
    while len(text) - at > PART and (m := gap.search(text, at + PART)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def counted_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slips: int | None = None) -> DataFrame:
    """Distinct words and their occurrences ``n`` over all whole texts: maximal runs of ``letters`` (the inside of a character class), only A-Z lower-cased.

    ``slips``: with it, a run whose ``h`` it divides loses its code point ``h %
    length`` first, where h is the unsigned crc32 of ``<id>:<run>`` in UTF-8 (a
    null id is empty there); so known misspellings can be planted. Words with fewer
    than ``least_length`` code points or ``least_count`` occurrences are left out.
    """
    run_of, gap = re.compile(f"[{letters}]+"), re.compile(f"[^{letters}]")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def made() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                seed = zlib.crc32(f"{doc.as_py() or ''}:".encode())
                for part in _parts(text.as_py() or "", gap):
                    # Bytes lower-case A-Z only.
                    for word, n in Counter(run_of.findall(part.encode().lower().decode())).items():
                        if slips and (h := zlib.crc32(word.encode(), seed)) % slips == 0:
                            word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        if len(word) >= least_length:
                            total[word] += n
                if len(total) > MOST_HELD:
                    yield made()
        yield made()

    counts = docs.select(F.col(id_col).cast("string"), text_col).mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _edges(words: DataFrame) -> DataFrame:
    """(wid, node, depth, child): the nodes on each word's path and the child that it takes there; at its end the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wid, text = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            length = np.array([len(w) for w in text], np.int64)
            ends = np.cumsum(length)
            lo = 0
            while lo < len(text):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
                n = length[lo:hi]
                codes = np.frombuffer("".join(text[lo:hi]).encode("utf-32-le"), "<u4")
                power, inverse = X.powers(len(codes) + 1)
                sums = np.zeros(len(codes) + 1, np.uint64)
                np.cumsum(X.mixed(codes.astype(np.uint64) + X.U(0x51ED270B)) * power[: len(codes)], out=sums[1:])
                first = np.cumsum(n) - n
                word = np.repeat(np.arange(hi - lo), n + 1)
                depth = np.arange(len(word)) - np.repeat(first + np.arange(hi - lo), n + 1)
                at = first[word] + depth
                node = X.mixed((sums[at] - sums[first[word]]) * inverse[first[word]] + depth.astype(np.uint64) * X.U(0xD6E8FEB86659FD93))
                child = np.where(depth == n[word], "", np.append(codes, 0).astype("<u4").view("<U1")[at])
                yield pa.record_batch([pa.array(wid[lo:hi][word]), pa.array(node.view(np.int64)), pa.array(depth.astype(np.int32)), pa.array(child.tolist(), pa.string())], names=["wid", "node", "depth", "child"])
                lo = hi

    return words.select("wid", "word").mapInArrow(run, "wid long, node long, depth int, child string")


def _light_edges(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wid, depth, heavy): each word's edges off the heavy paths and the heavy child there; and what it reads, to be dropped later."""
    edges = _edges(words)
    sizes = edges.groupBy("node", "child").agg(F.count(F.lit(1)).alias("n"))
    nodes = sizes.groupBy("node").agg(F.max_by("child", F.struct("n", "child")).alias("heavy"), F.count(F.lit(1)).alias("children"), F.sum("n").alias("words")).where("children > 1")
    nodes = saved(nodes.select("node", "heavy", "words"))
    most = words.count() / LARGE
    large = nodes.where(F.col("words") > most).select("node", F.col("heavy").alias("_large"))
    if large.count() > MOST_BROADCAST:
        large = large.limit(0)
    marked = edges.join(F.broadcast(large), "node", "left")
    at_large = marked.where("_large is not null").select("wid", "depth", "child", F.col("_large").alias("heavy"))
    at_small = marked.where("_large is null").join(nodes, "node").select("wid", "depth", "child", "heavy")
    return at_large.union(at_small).where("child <> heavy").select("wid", "depth", "heavy"), nodes


def near_words(words: DataFrame) -> DataFrame:
    """For each word (word, n; distinct) with a word one inserted, deleted or replaced code point away: word, n_near, and ``near``, the one of largest n (ties: smallest in code-point order), with near_n."""
    words = saved(words.select("word", "n").withColumn("wid", F.monotonically_increasing_id()))
    light, nodes = _light_edges(words)
    parts = light.join(words, "wid").select(
        "word", "n", "depth", "heavy", F.expr("substring(word, 1, depth)").alias("p"), F.expr("substring(word, depth + 1, 1)").alias("a"), F.expr("substring(word, depth + 2)").alias("s")
    )
    parts = saved(parts)
    light_char, heavy_char = F.col("a") != "", F.col("heavy") != ""
    # The last place needs a parting at this very node: what follows the skipped character differs from it.
    places = F.array_compact(F.array(
        F.when(light_char & heavy_char, F.concat("p", "heavy", "s")),
        F.when(light_char & (F.substring("s", 1, 1) != F.col("a")), F.concat("p", "s")),
        F.when(heavy_char, F.concat("p", "heavy", "a", "s")),
    ))
    carried = parts.select(F.col("word").alias("x"), F.col("n").alias("x_n"), F.explode(places).alias("word"))
    pairs = carried.join(words.select("word", F.col("n").alias("y_n")), "word").select("x", "x_n", F.col("word").alias("y"), "y_n")
    one = F.lit(1).cast("long")
    sides = F.explode(F.array(F.struct(F.col("x").alias("word"), one.alias("k"), F.struct((-F.col("y_n")).alias("m"), F.col("y").alias("near")).alias("best")), F.struct(F.col("y").alias("word"), one.alias("k"), F.struct((-F.col("x_n")).alias("m"), F.col("x").alias("near")).alias("best"))))
    one_heavy = pairs.select(sides.alias("r")).select("r.*")
    # Words that coincide under the wildcard differ in one character, so there are no more of them than the alphabet has characters.
    group = parts.where(light_char).groupBy("depth", F.concat("p", F.lit("\0"), "s").alias("place")).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("word").alias("near")))).alias("g")).where("size(g) > 1")
    members = group.select(F.posexplode("g").alias("i", "w"), (F.size("g") - 1).cast("long").alias("k"), "g")
    both_light = members.select(F.col("w.near").alias("word"), "k", F.when(F.col("i") == 0, F.col("g")[1]).otherwise(F.col("g")[0]).alias("best"))
    found = saved(one_heavy.unionByName(both_light).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best")))
    dropped(words, nodes, parts)
    return found.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms (word, form; at most one form a word, no cycles) ends, by pointer jumping; a chain of n forms takes log2(n) rounds."""
    at = saved(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("_to"))
        after = saved(at.join(step, "root", "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved")))
        dropped(at)
        at = after
        if at.where("_moved").isEmpty():
            return at.select("word", "root")


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: float = RATIO, slips: int | None = None) -> DataFrame:
    """Words of a corpus with the more frequent word that each is a variant of.

    Words and ``n`` are counted_words(). A word's ``form`` is the word one inserted,
    deleted or replaced code point away that has the largest n (ties: the smallest
    in code-point order), if that n is ``ratio`` (above 1) times the word's or more;
    ``root`` follows the forms to their end. Returns word, form and form_n (null
    without one), root (the word itself without a form), n and n_near (words one
    edit away).

    Null and empty texts have no words, and a table without words gives an empty
    result. Long texts are counted piecewise, cut between words. Repeated rows count
    each; ``id_col`` matters with ``slips`` only. Other columns are not read.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1, or forms could run in circles")
    words = saved(counted_words(docs, id_col=id_col, text_col=text_col, letters=letters, least_length=least_length, least_count=least_count, slips=slips))
    near = words.join(near_words(words), "word", "left")
    fits = F.col("near_n") >= ratio * F.col("n")
    formed = saved(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")))
    dropped(words)
    return formed.join(roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), slips=97)
