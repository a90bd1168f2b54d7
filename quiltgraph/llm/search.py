"""Ranked lexical search, reversed: the items' inverted index goes to the documents, not the documents into an index.

1. The items become postings (item, term, occurrences), counted in Spark. Blocks of at most about ``POSTINGS`` of them are
   broadcast, one after the other; a usual set of items is one block.
2. One pass over the documents counts them, their terms, and how many hold each term of the block. A task sends on sums.
3. A second pass streams each document's term counts through the block's index. A task keeps a heap of the ``k`` best
   documents for every item: only documents that beat the heap's last entry are added, and heaps are cut to ``k``.
4. Heaps are merged in two steps, so that no task meets one item's rows of all tasks.

Terms are compared by 64 bits of hash; scores are whole numbers throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.functions.shared import Shared
from quiltgraph.functions.sizes import cut_lineage
from quiltgraph.llm.texts import LOWER, U, byte_class, in_small_batches, lists, slices, word_hashes, words
from quiltgraph.operators.ranking import top_k

#: Terms ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``.
TERM = byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)], inverted=True)
BEST = 10
#: Most postings of a block of items, which is broadcast (about 24 bytes each).
POSTINGS = 2_000_000
#: Most sums of a part of documents, and most postings that are added up at once.
CELLS = 1 << 20
MERGE_PARTS = 32


def _counted(rows: np.ndarray, terms: np.ndarray, width: int):
    """Distinct (row, term) pairs of some places, with their counts."""
    key, tf = np.unique(rows * width + terms, return_counts=True)
    return key // width, key % width, tf


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, offsets in slices(batch.column(1)):
            starts, ends, first = words(data, offsets, TERM)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(offsets) - 1), lists(word_hashes(data, starts, ends, LOWER).view(np.int64), np.diff(first))],
                names=["item_id", "terms"])


def postings(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term (hash), n: how often each item holds each of its terms; rows with one id are one item."""
    kind = items.schema[key].dataType.simpleString()
    held = in_small_batches(items).select(F.col(key).alias("item_id"), F.col(text).alias("_text")).mapInArrow(
        _item_terms, f"item_id {kind}, terms array<bigint>")
    return held.select("item_id", F.explode("terms").alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n"))


class Index:
    """Postings of a block of items in the order of its sorted terms, as plain arrays."""

    def __init__(self, block: pa.Table):
        names = block.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        self.items = names.dictionary
        item = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        term, n = block.column("term").to_numpy().view(U), block.column("n").to_numpy()
        order = np.lexsort((item, term))
        self.terms, start = np.unique(term[order], return_index=True)
        self.start = np.append(start, len(order)).astype(np.int64)
        self.item, self.n = item[order], n[order]

    def places(self, data: np.ndarray, offsets: np.ndarray):
        """Row and number of each term of the block in some texts, and how many terms of any kind each row has."""
        starts, ends, first = words(data, offsets, TERM)
        hashes, n = word_hashes(data, starts, ends, LOWER), np.diff(first)
        if not len(self.terms) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), n
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == hashes)
        return np.repeat(np.arange(len(n)), n)[hit], at[hit], n


def _statistics(shared):
    """Per task: documents with each term of the block, and under -1 and -2 documents with a term and all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        width = len(index.terms)
        df, documents, total = np.zeros(width, np.int64), 0, 0
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                rows, terms, n = index.places(data, offsets)
                df += np.bincount(np.unique(rows * max(width, 1) + terms) % max(width, 1), minlength=width)[:width]
                documents, total = documents + int((n > 0).sum()), total + int(n.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([held, [-1, -2]])), pa.array(np.concatenate([df[held], [documents, total]]))], names=["term", "n"])

    return run


class Heaps:
    """The ``k`` best (score, document) of every item; equal scores by ascending document."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.least = np.zeros(items, np.int64)  # to enter: a greater score, or an equal one with a smaller document
        self.last = np.full(items, np.iinfo(np.int64).min)
        self.held = [np.zeros(0, np.int64)] * 3
        self.new, self.waiting = [], 0

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """``scores`` is documents by items."""
        row, item = np.nonzero((scores > self.least) | ((scores == self.least) & (docs[:, None] < self.last)))
        if len(row):
            self.new.append((item, scores[row, item], docs[row]))
            self.waiting += len(row)
        if self.waiting > 4 * self.k * len(self.least) + 1024:
            self.settle()

    def settle(self) -> None:
        item, score, doc = (np.concatenate([h, *n]) for h, n in zip(self.held, zip(*self.new, strict=True), strict=True)) if self.new else self.held
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        full = place == self.k - 1
        self.least[item[full]], self.last[item[full]] = score[full], doc[full]
        kept = place < self.k
        self.held, self.new, self.waiting = [item[kept], score[kept], doc[kept]], [], 0


def _score(index: Index, weights: np.ndarray, rows: np.ndarray, terms: np.ndarray, tf: np.ndarray, m: np.ndarray, docs: np.ndarray, heaps: Heaps) -> None:
    """Add the scores of some documents, given as sorted (row, term, tf), to the heaps."""
    value = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[rows]))
    degree = index.start[terms + 1] - index.start[terms]
    items = len(index.items)
    at = 0
    while at < len(rows):
        # As many documents as fit; one document at least.
        last = min(rows[at] + max(1, CELLS // items), rows[-1] + 1)
        most = int(np.searchsorted(np.cumsum(degree[at:]), CELLS, "right")) + at
        end = int(np.searchsorted(rows, last))
        if most < end:
            end = max(int(np.searchsorted(rows, rows[most])), int(np.searchsorted(rows, rows[at], "right")))
        of, own = np.unique(rows[at:end], return_inverse=True)
        n = degree[at:end]
        place = np.arange(n.sum()) + np.repeat(index.start[terms[at:end]] - (np.cumsum(n) - n), n)
        sums = np.zeros(len(of) * items, np.int64)
        np.add.at(sums, np.repeat(own, n) * items + index.item[place], np.repeat(value[at:end], n) * index.n[place])
        heaps.add(sums.reshape(len(of), items), docs[of])
        at = end


def _rank(shared, documents: int, total: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weights = shared.value
        heaps, width = Heaps(len(index.items), k), max(len(index.terms), 1)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, data, offsets in slices(batch.column(1)):
                rows, terms, n = index.places(data, offsets)
                if len(rows):
                    # Python's whole numbers: the product may pass 64 bits.
                    m = np.array([25 + 75 * int(x) * documents // total for x in n], np.int64)
                    _score(index, weights, *_counted(rows, terms, width), m, ids[at : at + len(n)], heaps)
        heaps.settle()
        item, score, doc = heaps.held
        yield pa.RecordBatch.from_arrays([index.items.take(pa.array(item)), pa.array(doc), pa.array(score)], names=["item_id", "doc_id", "score"])

    return run


def search(
    docs: DataFrame, items: DataFrame, k: int = BEST, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    most_postings: int = POSTINGS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item, with a score above 0.

    Terms are runs of letters, digits and characters beyond ASCII, with A-Z in lower case. Equal scores are ordered by
    ``key``, which has to be an integer; documents without one count in the statistics and are never returned. Each row is
    a document of its own, also when ids or whole rows repeat. Rows of one ``item_key`` are one item whose terms are added
    up (a null key is a key like another). Null and empty texts have no terms: such items have no rows, such documents no
    rank. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    held = cut_lineage(postings(items, item_key, item_text))
    count = held.count()
    blocks = max(1, -(-count // most_postings))
    own = in_small_batches(docs).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("_text"))
    kind = held.schema["item_id"].dataType.simpleString()
    found = None
    for block in range(blocks if count else 0):
        # At most about ``most_postings`` rows: a share of a count by a hash of the item.
        mine = held if blocks == 1 else held.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        index = Index(mine.toArrow())
        if not len(index.items):
            continue
        first = Shared(spark, index)
        sums = own.select("_text").mapInArrow(_statistics(first), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        number = dict(zip(sums.column("term").to_pylist(), sums.column("n").to_pylist(), strict=True))  # the block's terms and two more
        documents, total = number.get(-1, 0), number.get(-2, 0)
        first.destroy()
        if not documents:
            break
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * number.get(t, 0) + 1))) for t in range(len(index.terms))], np.int64)
        second = Shared(spark, (index, weights))
        best = own.filter("doc_id is not null").mapInArrow(_rank(second, documents, total, k), f"item_id {kind}, doc_id bigint, score bigint")
        order = [F.desc("score"), F.asc("doc_id")]
        parts = top_k(best.withColumn("_part", F.spark_partition_id() % MERGE_PARTS), ["item_id", "_part"], order, k, "_place")
        made = cut_lineage(top_k(parts.drop("_part", "_place"), "item_id", order, k))
        second.destroy()
        found = made if found is None else found.unionByName(made)
    if found is None:
        found = spark.createDataFrame([], f"item_id {kind}, doc_id bigint, score bigint, rank int")
    return found.select(F.col("item_id").alias(item_key), "rank", F.col("doc_id").cast(docs.schema[key].dataType).alias(key), "score")
