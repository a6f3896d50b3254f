"""Versioned tables: snapshots, writers that die at any step, concurrent writers, filters."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from scrivane.operators import cache as C
from scrivane.operators import snapshots as V


def entries(spark, rows):
    return spark.createDataFrame(rows, "cache_key string, value string")


def held(cache, **how):
    return {r["cache_key"]: r["value"] for r in cache.read(**how).collect()}


class Dies(Exception):
    pass


STEPS = [(V.VersionedTable, "_segment"), (V.Folder, "names"), (V.Folder, "write"), (V.Folder, "publish"), (V.VersionedTable, "_publish")]


@pytest.mark.parametrize("action", ["write", "invalidate", "compact", "clear"])
def test_a_writer_that_dies_at_any_step_leaves_the_old_or_the_new_state(spark, tmp_path, monkeypatch, action):
    cache = C.CacheTable(spark, str(tmp_path / "c"))
    cache.write(entries(spark, [("a", "1"), ("b", "2")]))
    cache.write(entries(spark, [("a", "3")]))
    old = {"a": "3", "b": "2"}
    do = {"write": lambda: cache.write(entries(spark, [("a", "4"), ("c", "5")])), "invalidate": lambda: cache.invalidate(entries(spark, [("b", "")])), "compact": cache.compact, "clear": cache.clear}[action]
    new = {"write": {"a": "4", "b": "2", "c": "5"}, "invalidate": {"a": "3"}, "compact": old, "clear": {}}[action]
    outcomes = []
    for owner, name in STEPS:
        for after in (False, True):
            own = getattr(owner, name)
            hits = []

            def dying(self, *a, own=own, after=after, hits=hits, **k):
                hits.append(1)
                if after:
                    own(self, *a, **k)
                raise Dies

            with monkeypatch.context() as m:
                m.setattr(owner, name, dying)
                try:
                    do()
                except Dies:
                    pass
            state = held(C.CacheTable(spark, cache.path))
            assert state in (old, new)
            outcomes.append(state)
            if state == new != old:
                # Back to the old state, for the next step.
                cache.clear()
                cache.write(entries(spark, list(old.items())))
    do()
    assert held(cache) == new
    assert new == old or new in outcomes and old in outcomes
    cache.vacuum(older_than=0)
    assert held(cache) == new
    data = [d for d in (tmp_path / "c" / "segments").iterdir()] if (tmp_path / "c" / "segments").exists() else []
    assert {d.name for d in data} == {s.name for s in cache.table.snapshot().segments} and len(list((tmp_path / "c" / "manifests").iterdir())) == 1


def test_older_snapshots_stay_readable(spark, tmp_path):
    cache = C.CacheTable(spark, str(tmp_path / "c"))
    for i in range(3):
        cache.write(entries(spark, [("k", str(i)), (f"k{i}", "x")]))
    before = cache.read()
    cache.compact()
    cache.clear()
    assert cache.table.versions() == [1, 2, 3, 4, 5] and held(cache) == {}
    assert [held(cache, version=v).get("k") for v in (1, 2, 3, 4)] == ["0", "1", "2", "2"] and held(cache, version=4) == held(cache, version=3)
    assert before.count() == 4
    cache.vacuum(keep=2, older_than=3600)
    assert cache.table.versions() == [1, 2, 3, 4, 5]
    cache.vacuum(keep=2, older_than=0)
    assert cache.table.versions() == [4, 5] and held(cache, version=4)["k"] == "2"


def test_the_last_write_wins_whatever_the_clock_says(spark, tmp_path):
    table = V.VersionedTable(spark, str(tmp_path / "t"), C.CacheTable.SCHEMA, "cache_key")
    row = lambda value, when: spark.createDataFrame([("k", "file", value)], "cache_key string, tier string, value string").withColumn("updated_at", F.lit(when).cast("timestamp"))
    table.append(row("first", "2031-01-01"))
    table.append(row("second", "2021-01-01"))
    assert held(C.CacheTable(spark, table.path)) == {"k": "second"}


def test_concurrent_writers_lose_nothing(spark, tmp_path):
    path, n = str(tmp_path / "c"), 6
    C.CacheTable(spark, path).write(entries(spark, [("k", "0")]))
    errors = []

    def work(i):
        try:
            cache = C.CacheTable(spark, path)
            cache.write(entries(spark, [(f"w{i}", str(i))]))
            if i % 3 == 0:
                cache.compact()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(n)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    cache = C.CacheTable(spark, path)
    assert not errors and held(cache) == {"k": "0"} | {f"w{i}": str(i) for i in range(n)}
    assert cache.table.versions() == list(range(1, len(cache.table.versions()) + 1))


def test_a_compaction_does_not_bring_back_what_was_cleared(spark, tmp_path):
    cache = C.CacheTable(spark, str(tmp_path / "c"))
    cache.write(entries(spark, [("k", "0")]))
    base = cache.table.snapshot()
    cache.clear()
    cache.write(entries(spark, [("m", "1")]))
    with pytest.raises(V.Conflict):
        cache.table.replace(None, base)
    assert held(cache) == {"m": "1"}


def test_publishing_never_overwrites(spark, tmp_path):
    folder = V.Folder(spark, str(tmp_path))
    for publish in (folder.publish, folder.renamed):
        name = publish.__name__
        for i in range(2):
            folder.write(f"made{i}", f"{name} {i}")
            assert publish(f"made{i}", name) is (i == 0)
        assert folder.read(name) == f"{name} 0" and not os.path.exists(tmp_path / "made1")


@pytest.mark.parametrize("most", [1 << 20, 8])
def test_filters_lose_no_hit_and_misses_open_no_file(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(V, "FILTER_KEYS", most)
    monkeypatch.setattr(V, "BUCKETS", 4)
    cache = C.CacheTable(spark, str(tmp_path / "c"))
    for i in range(3):
        cache.write(spark.range(400).select(F.concat(F.lit(f"{i}-"), "id").alias("cache_key"), F.lit(str(i)).alias("value")))
    assert {s.parts for s in cache.table.snapshot().segments} == {1 if most > 8 else 13}
    there = spark.range(0, 400, 7).select(F.concat(F.lit("1-"), "id").alias("cache_key"))
    assert cache.read(there).count() == there.count()
    one = cache.read(entries(spark, [("2-17", "")]))
    assert [r["value"] for r in one.collect()] == ["2"] and len(one.inputFiles()) <= 2
    misses = cache.read(entries(spark, [(f"no{i}", "") for i in range(3)] + [(None, "")]))
    assert misses.isEmpty() and len(misses.inputFiles()) <= 1
    many = spark.range(3000).select(F.concat(F.lit("no"), "id").alias("cache_key"))
    asked = many.select(*V._hashes(F.col("cache_key"))).toArrow()
    kept = spark.range(500).select(F.concat(F.lit("1-"), "id").alias("k")).select(F.lit("b").alias("bucket"), F.lit(0).alias("part"), *V._hashes(F.col("k"))).toArrow()
    bits = V._filter(kept)
    wrong = sum(len(V._possible(asked.slice(i, 1).append_column("segment", [["s"]]).append_column("bucket", [["b"]]), bits)) for i in range(0, 3000, 3))
    assert wrong < 20


def test_more_keys_than_are_tested_read_all(spark, tmp_path, monkeypatch):
    cache = C.CacheTable(spark, str(tmp_path / "c"))
    cache.write(entries(spark, [("a", "1"), ("b", "2")]))
    monkeypatch.setattr(V, "MOST_TESTED", 1)
    got = cache.read(entries(spark, [("a", ""), ("x", ""), ("y", "")]))
    assert [r["value"] for r in got.collect()] == ["1"] and len(got.inputFiles()) == 2
