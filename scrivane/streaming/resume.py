"""Files whose units (pages, chunks) come as a stream: each unit is asked about once, and files are put together as answers come.

Two queries work hand in hand. answer_units() asks about each batch's units that the
cache lacks and appends the answers to a folder. fold_units() reads that folder as
a stream and keeps, for each file, the answers that wait for an earlier one and the
part of the document that is being filled. Either can stop at any point, in the
middle of a file as well, and goes on from its checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from scrivane.operators.cache import CacheTable, get_or_compute
from scrivane.operators.ordered import PART_CHARACTERS


def answer_units(units: DataFrame, cache: CacheTable, compute: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, *, key: str = "file_hash") -> StreamingQuery:
    """Answers of a stream of units (key, unit, total, cache_key and what ``compute`` needs), appended to ``folder`` as key, unit, total, result.

    ``compute`` gets the units without a stored answer and returns cache_key and
    value, as in get_or_compute: answers are stored before anything reads them, so
    a batch that is run again asks about nothing that an earlier attempt stored. A
    null result is a failure. Answers of a batch may be appended twice after a
    failure; fold_units takes each unit once.
    """

    def batch(df: DataFrame, _: int) -> None:
        found = get_or_compute(df, cache, compute)
        found.select(key, F.col("unit").cast("long").alias("unit"), F.col("total").cast("long").alias("total"), F.col("value").alias("result")).write.mode("append").parquet(folder)

    return units.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answers_of(spark: SparkSession, folder: str, key_type: str = "string", *, key: str = "file_hash", per_trigger: int = 100) -> DataFrame:
    """The folder of answer_units as a stream."""
    return spark.readStream.schema(f"`{key}` {key_type}, unit long, total long, result string").option("maxFilesPerTrigger", per_trigger).parquet(folder)


#: A file's state: its next unit, where that begins, the part being filled, and answers that came early as JSON.
STATE = "next long, total long, begins long, part long, first long, n long, failed long, content string, early string, ended boolean"


def _fold(key: str, separator: str, most: int, forget_ms: int | None) -> Callable[..., Iterator[pd.DataFrame]]:
    columns = [key, "part", "first_unit", "last_unit", "n_units", "failed_units", "content", "ended"]

    def fold(name: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        unit, total, begins, part, first, n, failed, content, early, ended = state.get if state.exists else (0, -1, 0, 0, 0, 0, 0, "", "{}", False)
        if ended:
            for _ in frames:
                pass
            if forget_ms:
                state.setTimeoutDuration(forget_ms)
            return
        waiting: dict[int, str | None] = {int(u): r for u, r in json.loads(early).items()}
        # Texts of the part are joined once a call and not once a unit.
        texts = [content] if n else []

        def closed(last: bool) -> tuple:
            nonlocal first, n, failed, texts
            row = (*name, part, first, unit - 1, n, failed, separator.join(texts), last)
            first, n, failed, texts = unit, 0, 0, []
            return row

        for frame in frames:
            made = []
            known = frame["total"].dropna()
            total = max(int(known.max()), total) if len(known) else total
            for u, r in zip(frame["unit"], frame["result"], strict=True):
                if u == u and u is not None and u >= unit and waiting.get(int(u)) is None:
                    waiting[int(u)] = None if r is None or r != r else str(r)
            while unit in waiting:
                r = waiting.pop(unit)
                if n and begins // most > part:
                    made.append(closed(False))
                part = begins // most
                texts.append(r or "")
                n, failed, unit, begins = n + 1, failed + (r is None), unit + 1, begins + len(r or "") + len(separator)
            if made:
                yield pd.DataFrame(made, columns=columns)
        ended = 0 <= total <= unit
        if ended and n:
            yield pd.DataFrame([closed(True)], columns=columns)
        state.update((unit, total, begins, part, first, n, failed, separator.join(texts), "{}" if ended else json.dumps(waiting), ended))
        if ended and forget_ms:
            state.setTimeoutDuration(forget_ms)

    return fold


def fold_units(answers: DataFrame, *, key: str = "file_hash", separator: str = "\n", most: int = PART_CHARACTERS, forget_ms: int | None = None) -> DataFrame:
    """A stream of answers (key, unit from 0, total, result) as a stream of parts of documents.

    Returns key, part, first_unit, last_unit, n_units, failed_units, content, ended. A
    part is given as soon as it is full and all units before its end have come, and
    the last one, with ``ended``, when the file's ``total`` have; parts are cut as
    in operators.ordered.parts. A null result is a failed unit: it is counted and adds an
    empty text, unless an answer comes before its turn. Units that repeat, negative
    and null ones count once or not at all; a larger total replaces a smaller one as long as the file
    has not ended. A file's state is one part and
    its early answers, those that came before one that is still missing.
    """
    kind = dict(answers.dtypes)[key]
    schema = f"`{key}` {kind}, part long, first_unit long, last_unit long, n_units long, failed_units long, content string, ended boolean"
    taken = answers.select(key, "unit", "total", "result")
    return taken.groupBy(key).applyInPandasWithState(_fold(key, separator, most, forget_ms), schema, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout)
