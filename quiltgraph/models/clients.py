"""Model interfaces. The engine only asks for texts in, texts or vectors out."""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.config import api_key
from quiltgraph.functions.sizes import cut_lineage, in_small_batches, join_lookup
from quiltgraph.models.flight import Flight, TryAgain, by_requests, task_slots
from quiltgraph.sources.lines import path_exists


class TextModel(Protocol):
    """A client may carry a ``flight``: how many of its requests go out at a time. Calls come from several threads."""

    def generate(self, prompts: list[str]) -> list[str | None]:
        """One reply per prompt; None where the call failed. ``TryAgain`` has the request sent again after a pause."""


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class _Slots(dict):
    """Slot of a word; those of words with a negative sign come ``dim`` later."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __reduce__(self):
        return _Slots, (self.dim,)

    def __missing__(self, word: str) -> int:
        digest = hashlib.md5(word.encode()).hexdigest()
        found = int(digest[:4], 16) % self.dim + (0 if int(digest[4], 16) < 8 else self.dim)
        if len(self) < 200_000:
            self[word] = found
        return found


class HashingEmbedder:
    """Deterministic stand-in for an embedding service: signed word counts per hash bucket.

    Entries are whole numbers, so dot products and norms are exact and every
    engine ranks the same way.
    """

    #: Texts whose words are counted at once, and their characters, unless one text alone has more.
    block = 512
    block_characters = 1 << 20

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._slots = _Slots(dim)

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        upto, at = np.cumsum([len(text or "") for text in texts]), 0
        while at < len(texts):
            most = (upto[at - 1] if at else 0) + self.block_characters
            end = min(at + self.block, max(at + 1, int(np.searchsorted(upto, most, "right"))))
            held = [(text or "").split() for text in texts[at:end]]
            n = np.array([len(w) for w in held])
            slots = np.fromiter(map(self._slots.__getitem__, chain.from_iterable(held)), np.int64, n.sum())
            cells = np.repeat(np.arange(len(held)) * (2 * self.dim), n) + slots
            counts = np.bincount(cells, minlength=len(held) * 2 * self.dim).reshape(len(held), 2, self.dim)
            out[at:end] = counts[:, 0] - counts[:, 1]
            at = end
        return out


class HttpTextModel:
    """Chat completion over HTTP; the key comes from the environment."""

    def __init__(
        self, url: str, model: str, max_tokens: int = 8192, temperature: float = 0.1, timeout: float = 300.0, flight: Flight = Flight()
    ):
        self.url, self.model, self.timeout, self.flight = url, model, timeout, flight
        self.options = {"max_tokens": max_tokens, "temperature": temperature}

    def _post(self, path: str, body: dict) -> dict:
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {api_key()}"}
        request = urllib.request.Request(f"{self.url.rstrip('/')}/{path}", json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                return json.load(reply)
        except urllib.error.HTTPError as problem:
            if problem.code == 429 or problem.code >= 500:
                raise TryAgain(str(problem), _seconds(problem.headers.get("Retry-After"))) from problem
            raise
        except (urllib.error.URLError, TimeoutError, ConnectionError) as problem:
            raise TryAgain(str(problem)) from problem

    def generate(self, prompts: list[str]) -> list[str | None]:
        replies: list[str | None] = []
        for prompt in prompts:
            body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], **self.options}
            try:
                replies.append(self._post("chat/completions", body)["choices"][0]["message"]["content"])
            except (OSError, KeyError, IndexError, ValueError):
                replies.append(None)
        return replies


def _seconds(value: str | None) -> float | None:
    """Seconds of a Retry-After header; None for a date."""
    try:
        return None if value is None else float(value)
    except ValueError:
        return None


class HttpEmbedder(HttpTextModel):
    def __init__(self, url: str, model: str, dim: int = 768, timeout: float = 300.0, flight: Flight = Flight(at_once=64)):
        super().__init__(url, model, timeout=timeout, flight=flight)
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.dim))
        data = self._post("embeddings", {"model": self.model, "input": texts})["data"]
        return np.array([d["embedding"] for d in sorted(data, key=lambda d: d["index"])])


def embed(text: Column, embedder: Embedder) -> Column:
    """Vector of a text column. An embedder with a ``flight`` gets several requests at a time, others an Arrow batch a call.

    A request that fails at every attempt fails the task, which Spark repeats: no row goes without a vector unseen.
    """
    spark, flight = SparkSession.getActiveSession(), getattr(embedder, "flight", None)
    slots = task_slots(spark)
    in_small_batches(spark)

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        texts = (batch.fillna("").tolist() for batch in batches)
        if flight is None:
            for batch in texts:
                yield pd.Series(list(embedder.embed(batch)), dtype=object)
            return
        for made in by_requests(texts, lambda request: list(embedder.embed(request)), flight, slots):
            if any(v is None for v in made):
                raise RuntimeError("the embedding service gave no reply")
            yield pd.Series(made, dtype=object)

    return vectors(text)


def replies(prompt: Column, model: Callable[[], TextModel]) -> Column:
    """Reply of a prompt column. The client is built once per task and keeps several requests in flight, in order.

    How many is said by the client's ``flight``, by default ``Flight()``.
    """
    slots = task_slots(SparkSession.getActiveSession())

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = model()
        flight = getattr(client, "flight", None) or Flight()
        for made in by_requests((batch.tolist() for batch in batches), client.generate, flight, slots):
            yield pd.Series(made, dtype=object)

    return ask.asNondeterministic()(prompt)


@dataclass(frozen=True)
class ReplyCache:
    """Accepted replies by the hash of their prompt, in folders by the first ``digits`` of the hash (16 ** digits at most)."""

    spark: SparkSession
    path: str
    digits: int = 2

    def known(self, keys: DataFrame) -> DataFrame:
        """``prompt_key, reply`` of those ``keys`` (prompt_key) that are stored; only the folders of their hashes are read."""
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], "prompt_key string, reply string")
        prefixes = [r[0] for r in keys.select(F.substring("prompt_key", 1, self.digits)).distinct().collect()]  # at most 16 ** digits
        stored = self.spark.read.schema("prompt_key string, reply string, prefix string").parquet(self.path).filter(F.col("prefix").isin(prefixes))
        wanted = join_lookup(stored.select("prompt_key", "reply"), keys.select("prompt_key").distinct(), ["prompt_key"], how="left_semi")
        return wanted.groupBy("prompt_key").agg(F.min("reply").alias("reply"))

    def add(self, rows: DataFrame) -> None:
        keyed = rows.select(F.sha2("prompt", 256).alias("prompt_key"), "reply").withColumn("prefix", F.substring("prompt_key", 1, self.digits))
        keyed.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(self.path)


def ask_with_retries(
    rows: DataFrame, model: Callable[[], TextModel], accept: Column, attempts: int, cache: ReplyCache | None = None
) -> tuple[DataFrame, DataFrame]:
    """Ask for ``prompt`` until ``accept`` holds on ``reply``: (accepted rows, rows that never passed).

    Each attempt is written out before it is judged, so a model is never asked
    twice for one answer, and only the rows that failed go on to the next attempt.
    With a ``cache`` known prompts are not asked, and equal ones only once.
    """
    accepted, pending = None, rows
    passed = F.coalesce(accept, F.lit(False))
    if cache is not None:
        keyed = cut_lineage(rows.withColumn("prompt_key", F.sha2("prompt", 256)))
        met = cut_lineage(keyed.join(cache.known(keyed), "prompt_key", "left").drop("prompt_key"))
        hit = F.col("reply").isNotNull() & passed
        accepted, pending = met.filter(hit), met.filter(~hit).drop("reply")
        if pending.isEmpty():
            return accepted, pending
    for attempt in range(attempts):
        if cache is None:
            asked = cut_lineage(pending.withColumn("reply", replies(F.col("prompt"), model)))
        else:
            told = cut_lineage(pending.select("prompt").distinct().withColumn("reply", replies(F.col("prompt"), model)))
            asked = cut_lineage(pending.join(told, "prompt", "left"))
        good = asked.filter(passed)
        if cache is not None:
            cache.add(good.select("prompt", "reply").distinct())
        accepted = good.select(*asked.columns) if accepted is None else accepted.unionByName(good)
        pending = asked.filter(~passed).drop("reply")
        if attempt + 1 < attempts and pending.isEmpty():
            break
    return accepted, pending
