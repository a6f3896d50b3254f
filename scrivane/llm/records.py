"""Token sequences as length-delimited binary records, and a Spark data source for them.

A folder holds data files ``part-<file>.rec``, an index ``part-<file>.idx`` of each,
and ``_manifest.json``. Every number is little-endian.

    data file   8 bytes MAGIC, then records
    record      u64 payload length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload
    payload     u32 length of the key (NO_KEY: null) | the key in UTF-8 | u8 width | ids of 2 or 4 bytes each
    index       for each record: u64 offset in the data file | u64 tokens of the file's records before it
    manifest    version, and for each file its number, records and tokens

A checksum is masked (turned by 15 bits, plus a constant), because the checksum of
data that hold their own checksum is a bad one. Ids have two bytes where all of a
record fit. A file is written under the name of its attempt and renamed when it is
whole; the manifest comes last and names the files of the committed job only, so
what a lost or repeated task leaves behind is never read.

``df.write.format("token_records")`` takes key (string) and ids (binary), or key and
text, which it encodes by its options ``tokenizer`` and ``end``, and writes one file
for each partition, in the order of the rows; ``spark.read.format(...)`` deals
ranges of records to tasks by the index and gives key, file, number, start (tokens
of all records before it) and ids as unsigned 32-bit numbers. A record can be read
alone by read_record(). The index is what a shuffled reader needs.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from scrivane.llm._kit import saved, shared_folder, spread, table
from scrivane.llm.packing import _SPACE, Encoder

FORMAT = "token_records"
MAGIC = b"SCRVTOK1"
NO_KEY = 0xFFFFFFFF
MASK = 0xA282EAD8
HEAD, FOOT, ENTRY, KEY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<QQ"), struct.Struct("<I")
#: Records in a range that one task reads; bytes of an input file that make up an output file, and of a batch of records read.
RANGE, FILE_BYTES, BATCH_BYTES = 1 << 14, 128 << 20, 8 << 20


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def payload(key: str | None, ids: np.ndarray) -> bytes:
    name = None if key is None else key.encode()
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return KEY.pack(NO_KEY if name is None else len(name)) + (name or b"") + bytes([width]) + ids.astype(f"<u{width}").tobytes()


def framed(data: bytes) -> bytes:
    head = struct.pack("<Q", len(data))
    return head + FOOT.pack(masked(head)) + data + FOOT.pack(masked(data))


def unframed(f, where: str) -> bytes:
    """The next record's payload; a ValueError where its length or content was changed or cut."""
    head = f.read(HEAD.size)
    if len(head) < HEAD.size or masked(head[:8]) != HEAD.unpack(head)[1]:
        raise ValueError(f"{where}: broken record length")
    n = HEAD.unpack(head)[0]
    data, foot = f.read(n), f.read(FOOT.size)
    if len(data) < n or len(foot) < FOOT.size or masked(data) != FOOT.unpack(foot)[0]:
        raise ValueError(f"{where}: broken record")
    return data


def parsed(data: bytes) -> tuple[str | None, np.ndarray]:
    (n,) = KEY.unpack_from(data)
    at = KEY.size + (0 if n == NO_KEY else n)
    return None if n == NO_KEY else data[KEY.size : at].decode(), np.frombuffer(data, f"<u{data[at]}", offset=at + 1).astype("<u4")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9+.-]+:", path) else "file://" + os.path.abspath(path))


@dataclass
class Written(WriterCommitMessage):
    file: int
    records: int
    tokens: int
    names: tuple[str, str]


@dataclass
class Range(InputPartition):
    file: int
    first: int
    last: int
    base: int


class RecordWriter(DataSourceArrowWriter):
    """Writes a new folder, or with ``overwrite`` replaces one; readers see the old records until the new ones are committed."""

    def __init__(self, path: str, overwrite: bool, tokenizer: str | None, end: int):
        self.path, self.tokenizer, self.end, self.before = path, tokenizer, end, []
        try:
            self.before = manifest(path)
        except ValueError:
            return
        if not overwrite:
            raise ValueError(f"{path} holds records already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        file, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        encode, end = _encoder(self.tokenizer).encode if self.tokenizer else None, np.array([self.end], "<u4").tobytes()
        names = (f"part-{file:06d}-{attempt}.rec", f"part-{file:06d}-{attempt}.idx")
        offset, records, tokens = len(MAGIC), 0, 0
        with store.open_output_stream(f"{at}/_{names[0]}") as data, store.open_output_stream(f"{at}/_{names[1]}") as index:
            data.write(MAGIC)
            for batch in iterator:
                for key, value in zip(batch.column("key"), batch.column("text" if encode else "ids"), strict=True):
                    found = np.frombuffer(encode(value.as_py()) + end if encode else value.as_py() or b"", "<u4")
                    record = framed(payload(key.as_py(), found))
                    data.write(record)
                    index.write(ENTRY.pack(offset, tokens))
                    offset, records, tokens = offset + len(record), records + 1, tokens + len(found)
        for name in names:
            store.move(f"{at}/_{name}", f"{at}/{name}")
        return Written(file, records, tokens, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        made = sorted((m for m in messages if m is not None), key=lambda m: m.file)
        parts = [{"file": m.file, "records": m.records, "tokens": m.tokens, "data": m.names[0], "index": m.names[1]} for m in made]
        with store.open_output_stream(f"{at}/_manifest.tmp") as f:
            f.write(json.dumps({"version": 1, "files": parts}).encode())
        store.move(f"{at}/_manifest.tmp", f"{at}/_manifest.json")
        for m in self.before:
            store.delete_file(f"{at}/{m['data']}")
            store.delete_file(f"{at}/{m['index']}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, at = _store(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            store.delete_file(f"{at}/{name}")


def manifest(path: str) -> list[dict]:
    """The files of a folder in order; a ValueError where nothing was committed."""
    store, at = _store(path)
    try:
        with store.open_input_stream(f"{at}/_manifest.json") as f:
            return json.loads(f.read())["files"]
    except FileNotFoundError:
        raise ValueError(f"{path}: no committed records") from None


class RecordReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> Sequence[InputPartition]:
        self.files, out, base = manifest(self.path), [], 0
        for m in self.files:
            out += [Range(m["file"], first, min(first + self.size, m["records"]), base) for first in range(0, m["records"], self.size)]
            base += m["tokens"]
        return out or [Range(-1, 0, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        store, at = _store(self.path)
        m = next(f for f in manifest(self.path) if f["file"] == partition.file)
        with store.open_input_file(f"{at}/{m['index']}") as f:
            f.seek(ENTRY.size * partition.first)
            index = list(ENTRY.iter_unpack(f.read(ENTRY.size * (partition.last - partition.first))))
        rows: list[tuple] = []
        held = 0

        def made() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            out = pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["key", "file", "number", "start", "ids"])
            rows.clear()
            return out

        with store.open_input_file(f"{at}/{m['data']}") as f:
            if f.read(len(MAGIC)) != MAGIC:
                raise ValueError(f"{m['data']}: not a file of records")
            f.seek(index[0][0])
            for number, (offset, before) in enumerate(index, partition.first):
                if f.tell() != offset:
                    raise ValueError(f"{m['data']}: record {number} is not where its index says")
                key, ids = parsed(unframed(f, f"{m['data']}, record {number}"))
                rows.append((key, partition.file, number, partition.base + before, ids.tobytes()))
                held += 4 * len(ids)
                if held > BATCH_BYTES or len(rows) >= 4096:
                    yield made()
                    held = 0
        if rows:
            yield made()


class TokenRecords(DataSource):
    """The data source ``token_records``; see the module. Options: ``path``; to read, ``range``, the records that a task reads; to write texts, ``tokenizer``, a tokenizers file, and ``end``, the id after each text."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "key string, file int, number long, start long, ids binary"

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options["path"], int(self.options.get("range", RANGE)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        coded = "ids" not in schema.names
        if {*schema.names} != {"key", "text" if coded else "ids"}:
            raise ValueError("rows of key and ids, or of key and text, are needed")
        return RecordWriter(self.options["path"], overwrite, self.options["tokenizer"] if coded else None, int(self.options.get("end", 2)))


def read_record(path: str, file: int, number: int) -> tuple[str | None, np.ndarray]:
    """Key and ids of one record, by two short reads; for readers that shuffle the records' places."""
    store, at = _store(path)
    m = next((f for f in manifest(path) if f["file"] == file), None)
    if m is None or not 0 <= number < m["records"]:
        raise IndexError(f"no record {number} in file {file}")
    with store.open_input_file(f"{at}/{m['index']}") as f:
        f.seek(ENTRY.size * number)
        offset, _ = ENTRY.unpack(f.read(ENTRY.size))
    with store.open_input_file(f"{at}/{m['data']}") as f:
        f.seek(offset)
        return parsed(unframed(f, f"{m['data']}, record {number}"))


class _Known(dict):
    """Ids of stretches; two generations of MOST_HELD each, so that common ones stay."""

    MOST_HELD, LONGEST = 3 << 17, 64

    def __init__(self, ids):
        self.ids, self.old = ids, {}

    def __missing__(self, stretch: str) -> bytes:
        found = self.old.get(stretch)
        if found is None:
            found = array("I", self.ids(stretch)).tobytes()
        if len(stretch) <= self.LONGEST:
            if len(self) >= self.MOST_HELD:
                self.old = dict(self)
                self.clear()
            self[stretch] = found
        return found


class Remembering(Encoder):
    """The tokenizers library's ids, with a memory of the stretches that texts are made of.

    A byte-level pre-tokeniser with its usual pattern never joins a character and
    white space after it, letters and a following mark, or a single line feed and the
    letters after it. So a text's ids are those of its stretches, cut there, one after
    another, and a stretch is encoded once as long as it is remembered; one of letters
    alone is a single pre-token and goes straight to the merges. Tokenisers of other
    kinds, and texts that hold a special token, are encoded whole.
    """

    _LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
    #: ASCII but letters and the apostrophe, which can begin a contraction.
    _AFTER = "\\x00-&(-@\\[-`{-\\x7f"
    _stretch = re.compile(f"\\n(?=[{_LETTER}])| ?[{_LETTER}]+(?=[{_AFTER}]|\\Z)|[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
    _word = re.compile(f" ?[{_LETTER}]+")

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        before, model = kind.get("pre_tokenizer") or {}, kind["model"]
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and kind.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout") and not model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # How the library writes each byte of Latin-1's characters in UTF-8.
        split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {b: split.pre_tokenize_str(chr(b))[0][0] for b in range(128)} | {b: split.pre_tokenize_str(bytes([0xC3, b]).decode())[0][0][1] for b in range(0x80, 0xC0)} | {0xC3: split.pre_tokenize_str("é")[0][0][0]}
        self.known = _Known(self._ids)

    def _ids(self, stretch: str) -> list[int]:
        if self.cuts and self._word.fullmatch(stretch):
            return [t.id for t in self.tokenizer.model.tokenize(stretch.encode().decode("latin-1").translate(self.written))]
        return self.tokenizer.encode(stretch, add_special_tokens=False).ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cuts or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(b"".join(map(self.known.__getitem__, self._stretch.findall(p))) for p in self.parts(text))


_remembering: dict[str, Remembering] = {}


def _encoder(path: str) -> Remembering:
    if path not in _remembering:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _remembering[path] = Remembering(path)
    return _remembering[path]


def write_token_records(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, files: int | None = None) -> None:
    """Encode every whole text and write its ids, with ``end_id`` last, as records in ascending order of ``id_col``.

    ``path``: a new folder that all executors reach. ``tokenizer``: path of a
    tokenizers file; by default the public byte_bpe_50k. ``files``: number of data
    files, of near equal rows; by default by the size of the input. A null or empty
    text is the end id alone. Null ids come first. Rows with equal ids are records
    of their own, ordered by a hash of their text, and may lie in several files.
    The key of a record is its id as text. Other columns are not read. An empty
    table makes a folder without records.

    Texts are shuffled once, by ranges of ids; one task writes one file.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    spark.dataSource.register(TokenRecords)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if files is None:
        files = max(spread(rows), -(-int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // FILE_BYTES))
    # The row's place spreads equal rows over files; which of them comes first does not show.
    placed = rows.withColumns({"h": F.xxhash64("text"), "r": F.monotonically_increasing_id()})
    ordered = placed.repartitionByRange(files, "id", "h", "r").sortWithinPartitions("id", "h", "r")
    ordered.select(F.col("id").cast("string").alias("key"), "text").write.format(FORMAT).option("tokenizer", tokenizer).option("end", end_id).mode("append").save(path)


def read_token_records(spark: SparkSession, path: str, records: int = RANGE) -> DataFrame:
    """All records of a folder: key, file, number (in its file), start (tokens of all records before it) and ids."""
    spark.dataSource.register(TokenRecords)
    return spark.read.format(FORMAT).option("range", records).load(path)


def delete_records(path: str) -> None:
    store, at = _store(path)
    store.delete_dir(at)


def op11_token_records(spark, sf_dir: str) -> DataFrame:
    """Digests of the records as they were read back; these are stored, so that the files can go."""
    docs = table(spark, sf_dir, "documents")
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.records"
    write_token_records(docs, path)
    kind = dict(docs.dtypes)["doc_id"]
    found = saved(read_token_records(spark, path).select(F.col("key").cast(kind).alias("doc_id"), "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")))
    delete_records(path)
    return found
