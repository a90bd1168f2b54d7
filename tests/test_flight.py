"""Several model requests at a time: order, number of calls, pauses, bounds."""

import os
import subprocess
import sys
import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quiltgraph.models.clients import embed, replies
from quiltgraph.models.flight import Flight, TryAgain, by_requests, in_flight, patient

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


class Slow:
    """Replies after a while, and writes down each call."""

    def __init__(self, path, width, wait=0.25):
        self.path, self.wait, self.flight = path, wait, Flight(width=width)

    def generate(self, prompts):
        with open(self.path, "a") as f:
            f.write("".join(f"{p}\n" for p in prompts))
        time.sleep(self.wait)
        return [f"<{p}>" for p in prompts]


def test_eight_in_flight_take_an_eighth_of_the_time(spark, folder):
    df = spark.range(32).repartition(1).sortWithinPartitions("id").select(F.col("id").cast("string").alias("p"))

    def run(width):
        path = f"{folder}/{width}"
        made = df.select("p", replies(F.col("p"), lambda: Slow(path, width)).alias("r"))
        start = time.perf_counter()
        got = [tuple(r) for r in made.collect()]
        return got, time.perf_counter() - start, open(path).read().split()

    run(16)  # workers are up
    one, slow, calls_one = run(1)
    eight, fast, calls_eight = run(8)
    assert one == eight == [(str(i), f"<{i}>") for i in range(32)]
    assert sorted(calls_one) == sorted(calls_eight) == sorted(str(i) for i in range(32))
    assert slow >= 8.0 and fast < slow / 4  # 8 s and 1 s of waiting, and the job itself


def test_order_stays_and_the_window_is_bounded():
    taken, lock, running, most = [], threading.Lock(), [0], [0]

    def values():
        for i in range(60):
            taken.append(i)
            yield i

    def call(i):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.05 if i % 10 == 0 else 0.001)
        with lock:
            running[0] -= 1
        return i * i

    got = []
    for made in in_flight(values(), call, 4, ahead=2):
        got.append(made)
        assert len(taken) <= len(got) + 8  # never more than the window ahead of what came out
    assert got == [i * i for i in range(60)] and 1 < most[0] <= 4


def test_pauses_grow_and_the_last_failure_gives_no_reply():
    waited, tries = [], []

    def call(x):
        tries.append(x)
        if x == "late" and len(tries) < 4 or x == "never":
            raise TryAgain("busy", after=7 if len(tries) == 2 else None)
        return x

    ask = patient(call, Flight(attempts=5, pause=1, growth=3, longest=20), waited.append)
    assert ask("late") == "late" and waited == [1, 7, 9]
    tries.clear()
    waited.clear()
    assert ask("never") is None and waited == [1, 7, 9, 20] and len(tries) == 5
    with pytest.raises(ValueError):
        patient(lambda x: int(x), Flight())("no number")


def test_requests_of_several_prompts_go_over_the_ends_of_batches():
    sizes = []

    def call(prompts):
        sizes.append(len(prompts))
        return [p.upper() for p in prompts]

    batches = [["a", "b", "c"], [], ["d"], ["e", "f", "g", "h", "i"], []]
    assert list(by_requests(iter(batches), call, Flight(at_once=2), 1)) == [["A", "B", "C"], [], ["D"], ["E", "F", "G", "H", "I"], []]
    assert max(sizes) == 2 and sum(sizes) == 9


def test_an_executors_limit_is_shared_by_its_tasks():
    assert [Flight(width=8, per_executor=12).share(n) for n in (1, 2, 4, 100)] == [8, 6, 3, 1]


class Service:
    """An embedding service that is busy at every other call."""

    dim = 2

    def __init__(self):
        self.flight, self.calls = Flight(at_once=3, pause=0.001), 0
        self.lock = None

    def embed(self, texts):
        self.calls += 1
        if self.calls % 2:
            raise TryAgain
        return np.array([[len(t), 1.0] for t in texts])


def test_embedding_in_flight(spark):
    df = spark.createDataFrame(pd.DataFrame({"i": range(20), "t": ["x" * (i % 5) for i in range(20)]}))
    got = df.select("i", embed(F.col("t"), Service()).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == [[float(i % 5), 1.0] for i in range(20)]


def test_workers_need_no_copy_of_the_package(tmp_path):
    """A driver that has the package, and workers whose path does not: questions in one block are sent as they are."""
    script = tmp_path / "driver.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
spark.sparkContext.setCheckpointDir({str(tmp_path)!r})
from quiltgraph.operators.nearest import nearest
q = spark.createDataFrame([(1, [1.0, 0.0])], "q int, vector array<double>")
v = spark.createDataFrame([(5, [1.0, 1.0]), (6, [1.0, 0.0])], "v int, vector array<double>")
print([tuple(r) for r in nearest(q, v, "q", "v", 1).collect()])
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=300)
    assert "[(1, 6, 0.0, 1)]" in done.stdout, done.stderr[-2000:]
