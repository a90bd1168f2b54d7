"""Exact nearest vectors and texts for a batch of questions.

Up to one block of questions, proven by a bounded count, is sent to every task as one matrix; each task keeps its best
``k`` rows per question, and the vector table is never shuffled. More questions are numbered in blocks by Spark, and so are
the items; every pair of blocks meets in one group of a shuffle, whose question block is held as a matrix while the items
pass by. A task holds one distance matrix of at most ``query_block_rows`` x ``SUB_BLOCK`` numbers (32 MB with the defaults,
about four of that size while it is made). Nothing of a question table beyond one block goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.config import Settings
from quiltgraph.functions.shared import Shared
from quiltgraph.functions.sizes import cut_lineage, in_small_batches, join_lookup
from quiltgraph.functions.text import words
from quiltgraph.operators.ranking import top_k

DEFAULT = Settings()
SUB_BLOCK = 1024
#: Meetings of a word of an item with a question that a task holds at once, unless one item alone has more.
MEETINGS = 1 << 20
#: Items of one block that a block of questions meets, where both sides are dealt out in blocks.
ITEM_BLOCK = 65_536


def _distances(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    dots = q @ v.T
    nq, nv = (q * q).sum(axis=1), (v * v).sum(axis=1)
    if metric == "l2":
        return np.maximum(nq[:, None] + nv[None, :] - 2.0 * dots, 0.0)
    if metric != "unit_l2":
        raise ValueError(f"unknown metric: {metric}")
    scale = np.sqrt(nq[:, None] * nv[None, :])
    cosine = np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)
    return 2.0 - 2.0 * cosine


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Best:
    """The ``k`` nearest items of each question of a block; of equally distant ones those with the smallest ids."""

    beyond = np.inf  # items this far are no results

    def __init__(self, q_ids: pa.Array, q: np.ndarray, k: int, metric: str):
        self.q_ids, self.q, self.k, self.metric = q_ids, q, k, metric
        self.rows, self.distances, self.ids = np.zeros(0, np.int64), np.zeros(0), []

    def add(self, ids: pa.Array, column: pa.Array) -> None:
        for at in range(0, len(ids), SUB_BLOCK):
            v = matrix(column.slice(at, SUB_BLOCK))
            self._take(ids.slice(at, SUB_BLOCK), lambda order, v=v: np.round(_distances(self.q, v[order], self.metric), 6) + 0.0)

    def _take(self, ids: pa.Array, distances: Callable[[np.ndarray], np.ndarray]) -> None:
        own = ids.to_numpy(zero_copy_only=False)
        order = np.argsort(own, kind="stable")
        d = distances(order)
        rows, cols = _first(d, self.k)
        rows, cols = (x[d[rows, cols] < self.beyond] for x in (rows, cols))
        self.rows, self.distances = np.concatenate([self.rows, rows]), np.concatenate([self.distances, d[rows, cols]])
        self.ids = np.concatenate([self.ids, own[order][cols]]) if len(self.ids) else own[order][cols]
        self._cut()

    def _cut(self) -> None:
        order = np.lexsort((np.argsort(np.argsort(self.ids, kind="stable"), kind="stable"), self.distances, self.rows))
        rows = self.rows[order]
        order = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k]
        self.rows, self.distances, self.ids = self.rows[order], self.distances[order], self.ids[order]

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [self.q_ids.take(pa.array(self.rows)), pa.array(self.ids if len(self.ids) else [], kind), pa.array(self.distances)], names=["_q", "_v", "distance"])


class BestByWords(Best):
    """The ``k`` items with the greatest inner product of word counts; the distance is its negative, and 0 is no result."""

    beyond = 0.0

    def __init__(self, q_ids: pa.Array, terms: pa.Array, k: int):
        super().__init__(q_ids, np.zeros((len(q_ids), 0)), k, "")
        flat = terms.flatten()
        word = flat.field("term").dictionary_encode()
        self.vocabulary = word.dictionary
        place, question = word.indices.to_numpy(), np.repeat(np.arange(len(q_ids)), terms.value_lengths().to_numpy())
        order = np.argsort(place, kind="stable")
        self.start = np.searchsorted(place[order], np.arange(len(self.vocabulary) + 1))
        self.question, self.weight = question[order], flat.field("weight").to_numpy(zero_copy_only=False).astype(np.float64)[order]

    def add(self, ids: pa.Array, column: pa.Array) -> None:
        step = max(1, (1 << 22) // max(1, len(self.q_ids)))
        for at in range(0, len(ids), min(step, SUB_BLOCK)):
            held = column.slice(at, min(step, SUB_BLOCK))
            n = held.value_lengths().fill_null(0).to_numpy()
            found = pc.index_in(held.flatten(), self.vocabulary).fill_null(-1).to_numpy()
            rows = np.repeat(np.arange(len(n)), n)[found >= 0]
            key, count = np.unique(rows * len(self.vocabulary) + found[found >= 0], return_counts=True)
            rows, words_ = key // max(1, len(self.vocabulary)), key % max(1, len(self.vocabulary))
            degree = self.start[words_ + 1] - self.start[words_]
            scores, upto = np.zeros(len(self.q_ids) * len(n)), np.cumsum(degree)
            a = 0
            while a < len(degree):  # a common word meets every question that holds it, so the meetings are made in parts
                z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + MEETINGS, "right")))
                part = degree[a:z]
                place = np.arange(part.sum()) + np.repeat(self.start[words_[a:z]] - (np.cumsum(part) - part), part)
                cell = self.question[place] * len(n) + np.repeat(rows[a:z], part)
                np.add.at(scores, cell, self.weight[place] * np.repeat(count[a:z], part))
                a = z
            scores = scores.reshape(len(self.q_ids), len(n))
            self._take(ids.slice(at, len(n)), lambda order, scores=scores: -scores[:, order])


def _first(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exactly the first ``k`` columns of each row by value, then place."""
    k = min(k, d.shape[1])
    cut = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    less, tied = d < cut, d == cut
    return np.nonzero(less | (tied & (np.cumsum(tied, axis=1) <= k - less.sum(axis=1, keepdims=True))))


def _one(column: pa.ChunkedArray) -> pa.Array:
    made = column.combine_chunks()
    return made if isinstance(made, pa.Array) else (made.chunk(0) if made.num_chunks else pa.array([], made.type))


def _result_kind(q: DataFrame, v: DataFrame) -> str:
    return f"_q {q.schema['_q'].dataType.simpleString()}, _v {v.schema['_v'].dataType.simpleString()}, distance double"


def nearest(
    questions: DataFrame, vectors: DataFrame, question: str, item: str, k: int,
    metric: str = "l2", settings: Settings = DEFAULT,
) -> DataFrame:
    """``question, item, distance, rank``; both inputs carry their id and ``vector``.

    Distances are rounded to six digits, equal ones are ordered by item. Rows without a vector are left out; vectors have
    one length. A question id stands for one vector.
    """
    q = questions.filter(F.col("vector").isNotNull()).select(F.col(question).alias("_q"), F.col("vector").cast("array<double>").alias("vector"))
    v = vectors.filter(F.col("vector").isNotNull()).select(F.col(item).alias("_v"), F.col("vector").cast("array<double>").alias("vector"))
    block = one_block(q, settings)
    if block is not None:
        found = _scan_all(block, v, lambda ids, column: Best(ids, matrix(column), k, metric), _result_kind(q, v))
    else:
        found = meet(in_one_group(cut_lineage(q)), in_one_group(cut_lineage(v)), k, metric, settings)
    ranked = top_k(found, "_q", [F.asc("distance"), F.asc("_v")], k)
    return ranked.select(F.col("_q").alias(question), F.col("_v").alias(item), "distance", "rank")


def in_one_group(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_g", F.lit(0).cast("bigint"))


def one_block(q: DataFrame, settings: Settings) -> pa.Table | None:
    """The questions, if a bounded fetch shows that they are one block; else None."""
    fetched = q.limit(settings.query_block_rows + 1).toArrow()
    return fetched if fetched.num_rows <= settings.query_block_rows else None


def _scan_all(block: pa.Table, v: DataFrame, start: Callable[[pa.Array, pa.Array], Any], out: str) -> DataFrame:
    """The best of every task for one block of questions, which every task gets."""
    shared = Shared(v.sparkSession, (_one(block.column(0)), _one(block.column(1))) if block.num_rows else None)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = None, None
        for batch in batches:
            if shared.value is None or not batch.num_rows:
                continue
            best = best or start(*shared.value)
            kind = batch.column(0).type
            best.add(batch.column(0), batch.column(1))
        if best is not None:
            yield best.batch(kind)

    return v.mapInArrow(scan, out)


def blocks(rows: DataFrame, group: str, size: int, settings: Settings, own: str, parts: str) -> DataFrame:
    """Rows read from files with the number of their block ``own`` among the ``parts`` blocks of their group.

    Rows are dealt by their number in the files, so equal rows go to different blocks as well.
    """
    sized = rows.groupBy(group).agg(F.ceil(F.count("*") / size).cast("int").alias(parts))
    numbered = rows.withColumn("_no", F.xxhash64(F.monotonically_increasing_id()))
    return join_lookup(numbered, sized, [group], settings).withColumn(own, F.pmod("_no", F.col(parts)).cast("int")).drop("_no")


def meet(q: DataFrame, v: DataFrame, k: int, metric: str, settings: Settings = DEFAULT, item_block: int = ITEM_BLOCK) -> DataFrame:
    """``_q, _v, distance``: the best of every pair of blocks within each group ``_g``; both sides are read from files.

    A group's questions and items are dealt out in blocks of about ``query_block_rows`` and ``item_block``; every question
    block meets every item block in a task of its own.
    """
    return _meet_blocks(q, v, "vector", "vector", lambda ids, column: Best(ids, matrix(column), k, metric), settings, item_block)


def _meet_blocks(
    q: DataFrame, v: DataFrame, asked: str, held: str, start: Callable[[pa.Array, pa.Array], Any], settings: Settings, item_block: int = ITEM_BLOCK
) -> DataFrame:
    """As ``meet``, for the columns ``asked`` of the questions and ``held`` of the items."""
    q = blocks(q, "_g", settings.query_block_rows, settings, "_a", "_na")
    v = blocks(v, "_g", item_block, settings, "_b", "_nb")
    sides = q.select("_g", "_na").distinct(), v.select("_g", "_nb").distinct()
    q = join_lookup(q, sides[1], ["_g"], settings).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    v = join_lookup(v, sides[0], ["_g"], settings).withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("_na") - 1)))
    none = lambda side, c, name: F.lit(None).cast(side.schema[c].dataType).alias(name)
    both = q.select("_g", "_a", "_b", F.lit(0).alias("_side"), "_q", none(v, "_v", "_v"), F.col(asked).alias("_asked"), none(v, held, "_held")).unionByName(
        v.select("_g", "_a", "_b", F.lit(1).alias("_side"), none(q, "_q", "_q"), "_v", none(q, asked, "_asked"), F.col(held).alias("_held")))
    return both.repartition("_g", "_a", "_b").sortWithinPartitions("_g", "_a", "_b", "_side").mapInArrow(_meeting(start), _result_kind(q, v))


def _meeting(start: Callable[[pa.Array, pa.Array], Any]):
    def runs(batches: Iterator[pa.RecordBatch]):
        """(key, side, rows) of consecutive rows of one side of one pair of blocks."""
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                yield tuple(keys[a, :3]), keys[a, 3], batch.slice(a, z - a)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, best, kind = None, [], None, None
        for key, side, rows in runs(batches):
            if key != now:
                if best is not None:
                    yield best.batch(kind)
                now, waiting, best, kind = key, [], None, rows.column(5).type
            if side == 0:
                waiting.append(rows)
                continue
            if best is None and waiting:
                held = pa.Table.from_batches(waiting)
                best, waiting = start(_one(held.column(4)), _one(held.column(6))), []
            if best is not None:
                best.add(rows.column(5), rows.column(7))
        if best is not None:
            yield best.batch(kind)

    return scan


def sparse_nearest(
    question_terms: DataFrame, docs: DataFrame, question: str, item: str, k: int, text: str = "text", settings: Settings = DEFAULT
) -> DataFrame:
    """Top ``k`` items by inner product of word counts: question terms are (question, term, weight) rows, items are texts.

    Every text is counted against a block of questions, sent or met as in ``nearest``; a task keeps ``k`` items per question.
    Where postings are stored and the questions hold rare words, ``operators.postings`` reads less. Items that share no word
    with a question are not its results; equal scores are ordered by item. Each row of ``docs`` is an item of its own.
    """
    asked = question_terms.filter("term is not null").select(F.col(question).alias("_q"), F.struct("term", F.col("weight").cast("double").alias("weight")).alias("t"))
    q = asked.groupBy("_q").agg(F.collect_list("t").alias("terms"))
    in_small_batches(docs.sparkSession)
    v = docs.select(F.col(item).alias("_v"), words(F.lower(F.col(text))).alias("words")).filter("_v is not null and words is not null")
    start = lambda ids, column: BestByWords(ids, column, k)
    block = one_block(q, settings)
    if block is not None:
        found = _scan_all(block, v, start, _result_kind(q, v))
    else:
        found = _meet_blocks(in_one_group(cut_lineage(q)), in_one_group(cut_lineage(v)), "terms", "words", start, settings)
    kind = question_terms.schema["weight"].dataType
    ranked = top_k(found, "_q", [F.asc("distance"), F.asc("_v")], k)
    score = -F.col("distance")
    return ranked.select(F.col("_q").alias(question), F.col("_v").alias(item), (score if kind.typeName() in ("double", "float") else score.cast("bigint")).alias("score"), "rank")


def terms(docs: DataFrame, item: str, text: str = "text") -> DataFrame:
    """Sparse vector of a text as rows: one unit weight per occurrence of a lower-case word."""
    return docs.select(item, F.explode_outer(words(F.lower(F.col(text)))).alias("term"), F.lit(1).alias("weight")).filter("term is not null")
