"""Requests to a model service, several at a time, with replies in the order of the prompts."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any, TypeVar

from pyspark.sql import SparkSession

In, Out = TypeVar("In"), TypeVar("Out")


class TryAgain(Exception):
    """Raised by a client whose service is busy or out of reach; ``after`` is the pause that the service asks for.

    Any error with a true ``try_again`` counts: what travels to a worker may not be the class that a client's own module
    imports there.
    """

    try_again = True

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


@dataclass(frozen=True)
class Flight:
    """How requests are sent.

    A task keeps at most ``width`` requests in flight, and all tasks of an executor together at most ``per_executor``: each
    task takes its share. A request that raises ``TryAgain`` is sent again up to ``attempts`` times in all, after pauses
    that grow from ``pause`` by ``growth`` up to ``longest`` seconds; then its reply is None. ``ahead`` requests per place in
    flight may wait behind a slow one, so that it does not hold up the others; ``at_once`` prompts make one request.
    """

    width: int = 8
    per_executor: int = 64
    attempts: int = 4
    pause: float = 0.5
    growth: float = 2.0
    longest: float = 30.0
    ahead: int = 4
    at_once: int = 1

    def share(self, slots: int) -> int:
        return max(1, min(self.width, self.per_executor // max(1, slots)))

    def pauses(self) -> Iterator[float]:
        for k in range(self.attempts - 1):
            yield min(self.longest, self.pause * self.growth**k)


def task_slots(spark: SparkSession | None) -> int:
    """Tasks that one executor may run at a time; where that is not set, the tasks of the whole cluster."""
    if spark is None:
        return 1
    conf = spark.sparkContext.getConf()
    cores = conf.get("spark.executor.cores", None)
    local = spark.sparkContext.master.startswith("local")
    total = spark.sparkContext.defaultParallelism if local or cores is None else int(cores)
    return max(1, total // int(conf.get("spark.task.cpus", "1")))


def patient(call: Callable[[In], Out], flight: Flight, sleep: Callable[[float], Any] = time.sleep) -> Callable[[In], Out | None]:
    """``call`` with retries; None when the last one failed too."""

    def ask(value: In) -> Out | None:
        pauses = flight.pauses()
        while True:
            try:
                return call(value)
            except Exception as problem:  # noqa: BLE001
                if not getattr(problem, "try_again", False):
                    raise
                wait = next(pauses, None)
                if wait is None:
                    return None
                sleep(max(wait, min(getattr(problem, "after", None) or 0.0, flight.longest)))

    return ask


def in_flight(values: Iterator[In], call: Callable[[In], Out], width: int, ahead: int = 4) -> Iterator[Out]:
    """``call`` of every value, ``width`` at a time, in the order of the values.

    At most ``width * ahead`` values are taken before their results are asked for, so a long input is never held.
    """
    if width <= 1:
        yield from map(call, values)
        return
    window: deque[Future] = deque()
    with ThreadPoolExecutor(width) as pool:
        try:
            for value in values:
                window.append(pool.submit(call, value))
                if len(window) >= width * max(1, ahead):
                    yield window.popleft().result()
            while window:
                yield window.popleft().result()
        finally:
            # A task that is stopped, or whose call failed, sends nothing more.
            for waiting in window:
                waiting.cancel()


def by_requests(batches: Iterator[list[In]], call: Callable[[list[In]], list[Out]], flight: Flight, slots: int) -> Iterator[list[Out]]:
    """One list of replies per list of prompts. Requests hold ``at_once`` prompts and go on over the ends of lists."""
    sizes: deque[int] = deque()

    def requests() -> Iterator[list[In]]:
        for batch in batches:
            sizes.append(len(batch))
            for at in range(0, len(batch), flight.at_once):
                yield batch[at : at + flight.at_once]

    ask = patient(call, flight)

    def answer(request: list[In]) -> list[Out | None]:
        made = ask(request)
        return [None] * len(request) if made is None else list(made)

    held: list[Out | None] = []
    for made in in_flight(requests(), answer, flight.share(slots), flight.ahead):
        held += made
        while sizes and len(held) >= sizes[0]:
            n = sizes.popleft()
            yield held[:n]
            held = held[n:]
    while sizes:  # empty lists at the end
        n = sizes.popleft()
        yield held[:n]
        held = held[n:]
