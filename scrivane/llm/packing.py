"""Packing tokenised documents into fixed-length sequences by Karmarkar-Karp differencing.

A document is cut into whole sequences and a rest; rests are cut into pieces of
at most GRAIN tokens, dealt into even groups by a hash, and each group's pieces
are spread over windows by multiway differencing: partial partitions of the
largest spread are merged with their imbalances opposed, which leaves windows of
nearly equal sums. A group starts with the fewest windows that could hold its
tokens; while some window exceeds the capacity, their number rises.
"""

from __future__ import annotations

import base64
import heapq
import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm._kit import saved, table

CAPACITY = 1024
#: Most tokens of a piece that shares a sequence with others.
GRAIN = 256
#: Pieces in a group, about.
GROUP = 2048
#: Characters of a long text that are tokenised at once, about.
PART = 1 << 20

#: Unicode's White_Space, as the tokeniser's pattern has it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD_END = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    With ``ranks``, the rank file of the same vocabulary, a faster library gives
    the same ids; texts that hold a special token's string stay the tokeniser's.
    A byte-level pre-tokeniser never joins a character and white space after it,
    so a long text's ids are those of its parts cut there, one after another.
    """

    def __init__(self, path: str, ranks: str | None = None):
        self.path, self.tokenizer, self.quick = path, None, None
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens") or []]
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table_ = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
            self.quick = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={}).encode_ordinary

    def _ids(self, text: str) -> list[int]:
        if self.quick is not None and not any(s in text for s in self.special):
            return self.quick(text)
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def parts(text: str, size: int = PART) -> Iterator[str]:
        at = 0
        while len(text) - at > size and (end := _WORD_END.search(text, at + size)):
            yield text[at : end.start()]
            at = end.start()
        yield text[at:] if at else text

    def encode(self, text: str | None) -> bytes:
        return b"".join(array("I", self._ids(p)).tobytes() for p in self.parts(text)) if text else b""


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """The worker's encoder of a tokenizers file; None is the public one with its rank file."""
    if path not in _encoders:
        if path is None:
            import public_tokenizers

            _encoders[path] = Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
        else:
            _encoders[path] = Encoder(path)
    return _encoders[path]


def difference(sizes: np.ndarray, k: int) -> tuple[int, list[list[int]]]:
    """Partition items into k windows by Karmarkar-Karp multiway differencing.

    Returns the largest window's sum and the windows' items. A partial partition
    is its non-zero sums in falling order; merging two puts the larger sums of
    one on the smaller (or empty) windows of the other.
    """
    heap = [(-int(sizes[i]), n, np.array([int(sizes[i])]), [[int(i)]]) for n, i in enumerate(np.argsort(-sizes, kind="stable"))]
    if not heap:
        return 0, []
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        if len(a) < len(b):
            a, in_a, b, in_b = b, in_b, a, in_a
        free = k - len(a)
        sums, items = np.concatenate([a, b[:free]]), in_a + in_b[:free]
        for j, (s, more) in enumerate(zip(b[free:].tolist(), in_b[free:], strict=True)):
            at = len(a) - 1 - j
            sums[at] += s
            items[at] = items[at] + more
        order = np.argsort(-sums, kind="stable")
        sums, items = sums[order], [items[j] for j in order.tolist()]
        n += 1
        heapq.heappush(heap, (int((sums[-1] if len(sums) == k else 0) - sums[0]), n, sums, items))
    return int(heap[0][2][0]), heap[0][3]


def windows_for(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity`` for items of at most that size each."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        most, items = difference(sizes, k)
        if most <= capacity:
            return items
        k = max(k + 1, math.ceil(k * 1.005))


def tokenised(docs: DataFrame, *, id_col: str, text_col: str, tokenizer: str | None, end_id: int, capacity: int, grain: int, with_ids: bool) -> DataFrame:
    """Pieces of every document: its id, start, length, ids_crc32, doc_tokens, a row number ``_row`` and, if asked for, the ids."""
    end = np.array([end_id], "<u4").tobytes()
    kind = dict(docs.select(id_col).dtypes)[id_col]
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "_row", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = encoder(tokenizer), TaskContext.get().partitionId() << 36
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                doc, start, length, crc, total, ids = [], [], [], [], [], []
                for d, text in enumerate(batch.column(1)):
                    got = enc.encode(text.as_py()) + end
                    n = len(got) // 4
                    cuts = [*range(0, n - n % capacity, capacity), *range(n - n % capacity, n, grain), n]
                    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                        piece = got[4 * s : 4 * e]
                        doc.append(d)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if with_ids:
                            ids.append(piece)
                out = [batch.column(0).take(pa.array(doc, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array(np.arange(row, row + len(doc)))]
                row += len(doc)
                yield pa.record_batch(out + [pa.array(ids, pa.binary())] * with_ids, names=names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, _row long" + ", ids binary" * with_ids)


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, grain: int = GRAIN, group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """Cut, tokenise and pack every document of ``docs``.

    ``tokenizer``: path of a byte-level tokenizers file; by default the public
    byte_bpe_50k. Every document ends with ``end_id``; a null or empty text is
    that id alone. Returns one row for each piece: the id, start (the document's
    ids before it), length, ids_crc32 (of the ids as little-endian unsigned 32-bit
    numbers), doc_tokens, sequence_id, offset (in its sequence, gapless from 0)
    and, with ``with_ids``, ids in that byte form. Rows with equal ids are
    documents of their own. An empty table gives an empty result. Other columns
    are not read.

    The pieces are written to the shared checkpoint folder once, so texts are
    tokenised once; only pieces are shuffled.
    """
    if not 0 < grain <= capacity:
        raise ValueError("grain must be from 1 to capacity")
    pieces = saved(tokenised(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer, end_id=end_id, capacity=capacity, grain=grain, with_ids=with_ids))
    groups = max(1, math.ceil(pieces.count() / group))
    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64("_row"), F.lit(groups)))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("_row", "ascending")])
        length = t["length"].to_numpy()
        full = int((length == capacity).sum())
        sequence, offset = np.arange(len(length), dtype=np.int64), np.zeros(len(length), np.int64)
        for w, items in enumerate(windows_for(length[full:], capacity)):
            at = full + np.array(items)
            sequence[at] = full + w
            offset[at] = np.cumsum(length[at]) - length[at]
        number = pa.array(sequence + (t["_g"][0].as_py() << 24))
        out = t.drop_columns(["_row", "_g"] + ["ids"] * with_ids).append_column("sequence_id", number).append_column("offset", pa.array(offset))
        return out.append_column("ids", t["ids"]) if with_ids else out

    kind = dict(docs.select(id_col).dtypes)[id_col]
    columns = [f"`{id_col}` {kind}", *(f"{c} long" for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), *["ids binary"] * with_ids]
    return dealt.groupBy("_g").applyInArrow(pack, ", ".join(columns))


def op5_pack_sequences(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
