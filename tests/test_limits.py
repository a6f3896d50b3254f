"""One call limit over all workers, and answers that come as they are made."""

import os
import socket
import subprocess
import sys
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrivane.operators import model as X
from scrivane.operators.limits import CallLimit
from scrivane.plans.pipelines import process_pages, process_videos


def slow_model(folder):
    class Slow:
        """Notes each call's begin and end in a file, and fails once for prompts that say so."""

        name = "slow"

        def __init__(self, folder):
            self.folder, self.failed = folder, set()

        def call(self, request):
            begin = time.time()
            time.sleep(0.03)
            with open(f"{self.folder}/{os.getpid()}-{threading.get_ident()}", "a") as f:
                f.write(f"{begin} {time.time()}\n")
            if "fail" in request.prompt and request.prompt not in self.failed:
                self.failed.add(request.prompt)
                raise RuntimeError("once")
            return X.Answer(request.prompt.upper(), filtered="filter" in request.prompt)

    return lambda: Slow(folder)


def most_at_once(folder):
    spans = [tuple(map(float, line.split())) for p in folder.iterdir() for line in p.read_text().splitlines()]
    marks = sorted([(b, 1) for b, _ in spans] + [(e, -1) for _, e in spans], key=lambda m: (m[0], m[1]))
    now = top = 0
    for _, step in marks:
        now += step
        top = max(top, now)
    return len(spans), top, {p.name.split("-")[0] for p in folder.iterdir()}


@pytest.mark.parametrize("most", [1, 5])
def test_no_more_calls_at_once_than_the_limit_in_several_workers(spark, tmp_path, most):
    rows = spark.range(0, 48, 1, 4).select("id", F.when(F.col("id") % 10 == 3, F.concat(F.lit("fail "), "id")).when(F.col("id") % 10 == 4, F.concat(F.lit("filter "), "id")).otherwise(F.concat(F.lit("p"), "id")).alias("prompt"))
    folder = str(tmp_path)
    with CallLimit(spark, most, host="127.0.0.1") as limit:
        got = X.map_model(rows, slow_model(folder), keys=["id"], concurrency=8, limit=limit.lease).collect()
        assert limit.peak <= most
    calls, top, workers = most_at_once(tmp_path)
    assert len(got) == 48 and all(r["error"] is None for r in got)
    assert calls == sum(r["tries"] for r in got) == limit.lent == 48 + 5 + 5
    assert top <= most and len(workers) > 1
    if most > 1:
        assert top == most


def test_a_lost_worker_gives_its_leases_back(spark):
    with CallLimit(spark, 1, host="127.0.0.1") as limit:
        lease = limit.lease
        hold = f"import socket,time; s=socket.create_connection(('127.0.0.1',{lease.port})); s.sendall(b'{lease.secret}'); print(s.recv(1), flush=True); time.sleep(60)"
        lost = subprocess.Popen([sys.executable, "-c", hold], stdout=subprocess.PIPE, text=True)
        assert lost.stdout.readline().strip() == "b'1'"
        with ThreadPoolExecutor(1) as pool:
            def take():
                with lease.taker()():
                    return time.time()

            taken = pool.submit(take)
            time.sleep(0.3)
            assert not taken.done()
            lost.kill()
            lost.wait()
            assert taken.result(10)


def test_strangers_get_nothing_and_an_ended_limit_is_an_error(spark):
    limit = CallLimit(spark, 1, host="127.0.0.1")
    lease = limit.lease
    with socket.create_connection(("127.0.0.1", lease.port), timeout=5) as s:
        s.sendall(b"x" * len(lease.secret))
        assert s.recv(1) == b"" and limit.lent == 0
    held = lease.taker()
    with held():
        waiting = ThreadPoolExecutor(1)
        other = waiting.submit(lambda: held().__enter__())
        time.sleep(0.2)
        limit.close()
        with pytest.raises(OSError):
            other.result(10)
        waiting.shutdown()
    limit.close()
    with pytest.raises(OSError), held():
        pass
    got = X.call_with_retry(X.StubModel(), X.Request("x"), 2, held)
    assert got["result"] is None and got["tries"] == 2 and "Error" in got["error"]
    with pytest.raises(ValueError):
        CallLimit(spark, 0)


def test_a_slow_call_holds_up_no_other():
    slow = threading.Event()

    def ask(x):
        if x == 0:
            assert slow.wait(20)
        return {"x": x}

    parts = [pd.DataFrame({"x": range(100 * k, 100 * k + 100)}) for k in range(3)]
    seen = []
    with ThreadPoolExecutor(4) as pool:
        for part, at, made in X.answered(pool, ask, ((p, ((x,) for x in p["x"])) for p in parts), 8):
            assert [r["x"] for r in made] == list(part["x"].iloc[at])
            seen += [r["x"] for r in made]
            if len(seen) > 200:
                slow.set()
    assert sorted(seen) == list(range(300)) and seen.index(0) > 200


def test_no_rows_and_rows_with_a_known_answer(spark):
    rows = spark.createDataFrame([(1, "a", "known"), (2, "b", None)], "id int, prompt string, k string")
    with CallLimit(spark, 2, host="127.0.0.1") as limit:
        assert X.map_model(rows.limit(0), X.StubModel, keys=["id"], limit=limit.lease).isEmpty()
        got = {r["id"]: (r["result"], r["tries"]) for r in X.map_model(rows, X.StubModel, keys=["id"], known="k", limit=limit.lease).collect()}
        assert limit.lent == 1
    assert got[1] == ("known", 0) and got[2][1] == 1


def test_pipelines_take_the_limit(spark):
    pages = spark.createDataFrame([("h", i, f"text {i}") for i in range(5)], "file_hash string, page_number int, text string")
    videos, segments = spark.createDataFrame([("v", 130.0, 25.0)], "video_hash string, duration double, fps double"), spark.createDataFrame([("v", 0, 1.0, 2.0, "hello")], "video_hash string, seg_idx int, start double, end double, text string")
    with CallLimit(spark, 2, host="127.0.0.1") as limit:
        assert process_pages(pages, X.StubModel, limit=limit.lease).collect()[0]["n_pages"] == 5
        assert limit.lent == 5
        assert process_videos(videos, segments, X.StubModel, "what", limit=limit.lease).collect()[0]["n_chunks"] == 3
        assert limit.lent == 5 + 3 + 1 and limit.peak <= 2
