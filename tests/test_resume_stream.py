"""Units as a stream: stops in the middle of a file, and parts against a plain fold."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrivane.operators import cache as C
from scrivane.streaming.resume import _fold, answer_units, answers_of, fold_units


class State:
    """One group's state, as the fold sees it."""

    hasTimedOut, exists, get = False, False, None  # noqa: N815  Spark's names

    def update(self, value):
        self.exists, self.get = True, value


@pytest.mark.parametrize("seed", range(5))
def test_fold_in_any_order_equals_a_plain_one(seed):
    r = random.Random(seed)
    texts = [None if r.random() < 0.1 else "x" * r.randrange(30) for _ in range(60)]
    texts[0] = texts[59] = "first"
    rows = [(u, 60, t) for u, t in enumerate(texts)] + [(u, 60, "late") for u in (0, 59)] + [(None, None, "lost"), (-1, None, "lost")]
    state, fold, got = State(), _fold("k", "\n", 100, None), []
    first = rows[:60]
    r.shuffle(first)
    rows = first + rows[60:] + first[:10]
    for i in range(0, len(rows), 7):
        frame = pd.DataFrame(rows[i : i + 7], columns=["unit", "total", "result"])
        got += [t for f in fold(("a",), iter([frame[:3], frame[3:]]), state) for t in f.itertuples(index=False)]
    want, at = {}, 0
    for u, t in enumerate(texts):
        want.setdefault(at // 100, []).append((u, t))
        at += len(t or "") + 1
    assert [(t.part, t.first_unit, t.last_unit, t.n_units, t.failed_units, t.content, t.ended) for t in got] == [
        (p, w[0][0], w[-1][0], len(w), sum(t is None for _, t in w), "\n".join(t or "" for _, t in w), p == max(want)) for p, w in sorted(want.items())
    ]
    assert state.get[-1] and state.get[-2] == "{}"


def test_a_stop_in_mid_file_asks_about_nothing_twice(spark, tmp_path):
    units = [("a", u, 6, f"a{u}") for u in (5, 0, 3)] + [("b", 0, 1, "b0")], [("a", u, 6, f"a{u}") for u in (1, 2, 4, 4)]
    base, calls = str(tmp_path), spark.sparkContext.accumulator(0)
    cache = C.CacheTable(spark, f"{base}/cache")
    schema = "file_hash string, unit long, total long, text string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).withColumn("cache_key", F.concat("file_hash", F.lit("/"), "unit")).coalesce(1).write.mode("append").parquet(f"{base}/units")

    @F.udf("string")
    def model(text):
        calls.add(1)
        return None if text == "a3" else text.upper()

    def compute(misses):
        return misses.select("cache_key", model.asNondeterministic()("text").alias("value"))

    def ask(folder):
        read = spark.readStream.schema(schema + ", cache_key string").parquet(f"{base}/units")
        answer_units(read, cache, compute, folder, f"{base}/asked").awaitTermination()

    def fold():
        out = fold_units(answers_of(spark, f"{base}/answers"), most=6)
        out.writeStream.format("parquet").option("path", f"{base}/parts").option("checkpointLocation", f"{base}/folded").trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.schema(out.schema).parquet(f"{base}/parts").collect()))

    arrive(units[0])
    # The answers are stored, then their folder cannot be written: the batch does not end.
    (tmp_path / "taken").write_text("a file")
    with pytest.raises(Exception, match="taken"):
        ask(f"{base}/taken/answers")
    assert calls.value == 4
    ask(f"{base}/answers")
    # Failures are not stored: only the failed unit is asked about again.
    assert calls.value == 5
    assert fold() == [("b", 0, 0, 0, 1, 0, "B0", True)]
    arrive(units[1])
    ask(f"{base}/answers")
    assert calls.value == 8
    assert fold() == [("a", 0, 0, 1, 2, 0, "A0\nA1", False), ("a", 1, 2, 4, 3, 1, "A2\n\nA4", False), ("a", 2, 5, 5, 1, 0, "A5", True), ("b", 0, 0, 0, 1, 0, "B0", True)]
