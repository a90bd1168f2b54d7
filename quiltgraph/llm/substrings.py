"""Removal of passages that documents with smaller ids already hold: seed and extend on winnowed anchors.

A window of ``window`` consecutive words always selects one anchor: the least hash among its word runs of ``SEED`` words
(winnowing). Equal windows select equal anchors, so a window can repeat only where its anchor does. The steps:

1. one pass over the texts: anchors of each document and a hash of its whole word sequence;
2. documents with one and the same sequence are settled by it; only the first of them goes on;
3. anchors that occur in two documents are the seeds; around them, in the documents that have some, every window that
   selected the seed is taken: the seed extended both ways as far as a repeat can reach;
4. a window's smallest document is an aggregate combined before its shuffle, so a passage that a third of all documents
   share costs one row in each task; adjoining covered windows are the maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.functions.sizes import cut_lineage, proven_small, salted_join
from quiltgraph.llm.texts import grams, in_small_batches, lists, mix, sequence_hashes, slices, word_hashes, words

WINDOW = 50
SEED = 8
SALTS = 16
#: Most ids of documents that are broadcast to pick their texts; beyond it the texts are shuffled.
BROADCAST_IDS = 1_000_000


def winnow(hashes: np.ndarray, first: np.ndarray, window: int, seed: int):
    """Window starts that fit in their row, the place of the anchor each selects, and the hashes of all seeds."""
    found = grams(hashes, seed)
    ends = np.repeat(first[1:], np.diff(first))
    starts = np.flatnonzero(np.arange(len(hashes)) + window <= ends)
    if not len(starts):
        return starts, starts, found
    at, least, width, want = np.arange(len(found)), found, 1, window - seed + 1
    while width < want:
        step = min(width, want - width)
        right = least[step:] <= least[:-step]  # of equal hashes the last
        at = np.where(right, at[step:], at[:-step])
        least = np.minimum(least[step:], least[:-step])
        width += step
    return starts, at[starts], found


def _scan(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in slices(batch.column(2)):
                n = len(offsets) - 1
                starts, ends, first = words(data, offsets)
                hashes = word_hashes(data, starts, ends)
                _, owners, found = winnow(hashes, first, window, seed)
                new = np.ones(len(owners), bool)
                new[1:] = owners[1:] != owners[:-1]
                owners = owners[new]
                per_row = np.diff(np.searchsorted(owners, first))
                whole = data.tobytes()
                shas = [hashlib.sha256(b" ".join(whole[a:b].split())).hexdigest() for a, b in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, n), batch.column(1).slice(at, n),
                    *(pa.array(sequence_hashes(hashes, first, s).view(np.int64)) for s in (11, 12)),
                    pa.array(np.diff(first).astype(np.int64)), pa.array(shas), lists(found[owners].view(np.int64), per_row),
                ], names=["_id", "_text_hash", "_s1", "_s2", "n_words", "_sha", "_anchors"])

    return run


def _windows(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            allowed = batch.column(3).to_pylist()
            for at, data, offsets in slices(batch.column(2)):
                n = len(offsets) - 1
                starts, ends, first = words(data, offsets)
                hashes = word_hashes(data, starts, ends)
                begin, owners, found = winnow(hashes, first, window, seed)
                taken = np.zeros(len(begin), bool)
                for row, (low, high) in enumerate(zip(np.searchsorted(begin, first[:-1]), np.searchsorted(begin, first[1:]), strict=True)):
                    wanted = np.array(allowed[at + row] or [], np.int64).view(np.uint64)
                    taken[low:high] = np.isin(found[owners[low:high]], wanted)
                begin = begin[taken]
                per_row = np.diff(np.searchsorted(begin, first))
                place = begin - np.repeat(first[:-1], per_row)
                one, two = grams(hashes, window, 3), grams(mix(hashes, 9), window, 4)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, n), batch.column(1).slice(at, n), lists(place.astype(np.int32), per_row),
                    lists(one[begin].view(np.int64), per_row), lists((two[begin] >> np.uint64(33)).astype(np.int32), per_row),
                ], names=["_id", "_text_hash", "_places", "_w1", "_w2"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas = [], []
            for text, places in zip(batch.column(2), batch.column(3), strict=True):
                parts = (text.as_py() or "").encode().split()  # of bytes: only the six ASCII spaces separate
                edge = np.zeros(len(parts) + 1, np.int64)
                covered = np.array(places.as_py(), np.int64)
                np.add.at(edge, covered, 1)
                np.add.at(edge, covered + window, -1)
                keep = np.cumsum(edge[:-1]) == 0
                removed.append(len(parts) - int(keep.sum()))
                shas.append(hashlib.sha256(b" ".join(compress(parts, keep))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string())],
                names=["_id", "_text_hash", "n_removed", "kept_sha256"])

    return run


def _texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Texts of the documents in ``chosen`` (_id, _text_hash, more columns), with those columns."""
    if proven_small(chosen, BROADCAST_IDS):
        docs = docs.join(F.broadcast(chosen.select("_id", "_text_hash")), ["_id", "_text_hash"], "left_semi")
    return docs.join(chosen, ["_id", "_text_hash"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_words, n_removed, kept_sha256: one row per input row.

    A word goes when a window of ``window`` words of its document covers it and the same words also start somewhere in a
    document with a smaller ``key``. Windows are judged on the input. Null texts have no words; rows with a null key lose
    nothing and remove nothing. Rows with equal keys never remove each other's words, and each gets its own row. Other
    columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    own = in_small_batches(docs).select(F.col(key).alias("_id"), F.xxhash64(text).alias("_text_hash"), F.col(text).alias("_text"))
    head = f"_id {kind}, _text_hash bigint"
    scanned = cut_lineage(own.mapInArrow(
        _scan(window, seed), f"{head}, _s1 bigint, _s2 bigint, n_words bigint, _sha string, _anchors array<bigint>"))
    long = scanned.filter((F.col("n_words") >= window) & F.col("_id").isNotNull())

    same = long.groupBy("_s1", "_s2").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).filter("_least < _most")
    settled = salted_join(long.select("_id", "_text_hash", "_s1", "_s2"), same, ["_s1", "_s2"], SALTS).filter(
        "_id > _least").select("_id", "_text_hash").distinct()
    settled = cut_lineage(settled)
    rest = long.join(settled, ["_id", "_text_hash"], "left_anti").select("_id", "_text_hash", "_anchors").dropDuplicates(["_id", "_text_hash"])

    seeds = rest.select("_id", "_text_hash", F.explode(F.array_distinct("_anchors")).alias("_seed"))
    # Written, so that the joins below have plain exchanges on both sides and a hot seed or window can be split.
    repeated = cut_lineage(seeds.groupBy("_seed").agg(F.min("_id").alias("_a"), F.max("_id").alias("_z")).filter("_a < _z").select("_seed"))
    active = cut_lineage(seeds.join(repeated, "_seed", "left_semi").groupBy("_id", "_text_hash").agg(F.collect_list("_seed").alias("_seeds")))

    placed = _texts_of(own, active).select("_id", "_text_hash", "_text", "_seeds").mapInArrow(
        _windows(window, seed), f"{head}, _places array<int>, _w1 array<bigint>, _w2 array<int>")
    placed = cut_lineage(placed)
    each = placed.select("_id", "_text_hash", F.explode(F.arrays_zip("_places", "_w1", "_w2")).alias("w")).select(
        "_id", "_text_hash", "w.*")
    least = each.groupBy("_w1", "_w2").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).filter("_least < _most")
    covered = each.join(cut_lineage(least.drop("_most")), ["_w1", "_w2"]).filter("_id > _least").groupBy("_id", "_text_hash").agg(
        F.collect_list("_places").alias("_covered"))
    cut = _texts_of(own, cut_lineage(covered)).select("_id", "_text_hash", "_text", "_covered").mapInArrow(
        _cut(window), f"{head}, n_removed bigint, kept_sha256 string").dropDuplicates(["_id", "_text_hash"])

    nothing = hashlib.sha256(b"").hexdigest()
    changed = settled.select("_id", "_text_hash", F.lit(None).cast("bigint").alias("n_removed"), F.lit(nothing).alias("kept_sha256")).unionByName(cut)
    out = scanned.select("_id", "_text_hash", "n_words", "_sha").join(changed, ["_id", "_text_hash"], "left")
    whole = F.col("kept_sha256").isNotNull() & F.col("n_removed").isNull()
    return out.select(
        F.col("_id").alias(key), "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.coalesce("kept_sha256", "_sha").alias("kept_sha256"))
