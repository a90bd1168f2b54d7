"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of hashed character n-grams, of the same over character classes (upper and lower letters, digits,
other signs as they are), and of a few terms for its shape (length, repeated words). Labelled rows,
at most ``per_label`` for each label, give the term weights and a truncated singular value decomposition, which one task
makes; the projection and the projected labelled vectors come back and are broadcast, their size bounded by these
parameters. Every document is projected in blocks and its exact cosines to all labelled vectors are computed; the nearest
vote with their similarity as weight. Cosines count in steps of 0.00001; of equal ones the labelled document with the
smaller id is nearer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltgraph.functions.shared import Shared
from quiltgraph.functions.sizes import cut_lineage
from quiltgraph.llm.texts import character_classes, code_points, gram_ids, in_small_batches, lists, slices, word_hashes, words

GRAMS = 1 << 11
SHAPES = 64
ORDERS = (1, 2)
CLASS_ORDERS = (2, 3, 4)
SHAPE = 2 * GRAMS
PER_LABEL = 2048
RANK = 64
NEIGHBOURS = 15
THRESHOLD = 0.3
#: Power of a neighbour's cosine in its vote.
SHARPNESS = 8
#: Texts and bytes that are counted at once: each text takes an array of all terms.
ROWS, BYTES = 512, 1 << 20
#: Cosines are compared in steps of one part of this.
STEP = 100_000


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term counts of some texts: hashed character grams, then terms for length and repeated words."""
    n, dim = len(offsets) - 1, GRAMS + 1
    points, ends = code_points(data, offsets)
    rows = np.repeat(np.arange(n, dtype=np.int64) * dim, np.diff(ends))
    out = np.zeros((n, 2 * GRAMS + SHAPES), np.float32)
    for at, signs, orders in ((0, points, ORDERS), (GRAMS, character_classes()[points], CLASS_ORDERS)):
        found = sum(np.bincount(rows + gram_ids(signs, ends, k, GRAMS), minlength=n * dim) for k in orders)
        out[:, at : at + GRAMS] = found.reshape(n, dim)[:, :GRAMS]
    starts, stops, first = words(data, offsets)
    hashes = word_hashes(data, starts, stops)
    of = np.repeat(np.arange(n), np.diff(first))
    total = np.diff(first)
    order = np.lexsort((hashes, of))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=n)
    again = np.zeros(len(of), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    repeats = np.bincount(of[again], minlength=n)
    share = lambda a: np.minimum((10 * a / np.maximum(total, 1)).astype(int), 9)
    at = np.arange(n)
    out[at, SHAPE + np.minimum(np.log2(total + 1).astype(int), 19)] = 1
    out[at, SHAPE + 20 + share(total - distinct) + 10 * (total > 63)] = 1
    out[at, SHAPE + 40 + share(repeats)] = 1
    return out


class Model:
    def __init__(self, weights: np.ndarray, projection: np.ndarray, vectors: np.ndarray, labels: np.ndarray, neighbours: int):
        self.weights, self.projection, self.vectors, self.labels, self.neighbours = weights, projection, vectors, labels, neighbours

    def weigh(self, x: np.ndarray) -> np.ndarray:
        """Logarithmic counts times term weights, in place; grams, class grams and shape terms each have length 1."""
        np.log1p(x, out=x)
        x *= self.weights
        for part in (slice(0, GRAMS), slice(GRAMS, SHAPE), slice(SHAPE, None)):
            x[:, part] /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x[:, part], x[:, part]))[:, None], 1e-9)
        return x

    def project(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors of weighted counts."""
        v = x @ self.projection
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of good labels among the votes, for counts (which are overwritten)."""
        m = len(self.labels)
        if not m:
            return np.full(len(x), 0.5)
        # A step's number and, below it, the place of the labelled vector: no two keys are equal.
        key = np.rint(self.project(self.weigh(x)) @ self.vectors.T * STEP).astype(np.int64)
        key *= m
        key += np.arange(m)[::-1]
        k = min(self.neighbours, m)
        key.partition(m - k, axis=1)
        near = np.sort(key[:, m - k :], axis=1)
        weight = np.maximum(near // m / STEP, 1e-6) ** SHARPNESS
        return np.clip((weight * self.labels[m - 1 - near % m]).sum(1) / weight.sum(1), 0, 1)


def sample(labels: DataFrame, per_label: int, label: str) -> DataFrame:
    """At most ``per_label`` labelled ids of each label, those with the smallest hashes; disagreeing ids are left out."""
    agreed = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(
        F.min(label).alias("y"), F.max(label).alias("_top")
    ).filter("y = _top")
    first = [agreed.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    return first[0].unionByName(first[1]).select(F.col("doc_id").alias("_id"), F.col("y").cast("int").alias("_y"))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", per_label: int = PER_LABEL,
    rank: int = RANK, neighbours: int = NEIGHBOURS,
) -> Model:
    """Learn from at most ``per_label`` documents of each label. Null ids and labels are skipped.

    Of several rows with one id one is used, that with the smallest hash of its counts. Counts travel to the one task that
    decomposes them as lists of the terms that occur.
    """

    parts_of = ["weights", "projection", "vectors", "labels"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in slices(batch.column(2), BYTES, ROWS):
                x = counts(data, offsets)
                rows, terms = np.nonzero(x)
                held = np.bincount(rows, minlength=len(x))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, len(x)) for i in (0, 1)), lists(terms.astype(np.int32), held), lists(x[rows, terms], held)],
                    names=["id", "y", "terms", "n"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, labelled, n = np.zeros((2 * per_label, SHAPE + SHAPES), np.float32), np.zeros(2 * per_label), 0
        for batch in batches:  # in order of id
            _fill(x[n : n + batch.num_rows], batch.column(2), batch.column(3))
            labelled[n : n + batch.num_rows] = batch.column(1).to_numpy()
            n += batch.num_rows
        if not n:
            return
        x, labelled = x[:n], labelled[:n]
        weights = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + 1
        model = Model(weights, np.zeros((x.shape[1], 0), np.float32), np.zeros((0, 0), np.float32), labelled, neighbours)
        x = model.weigh(x)
        model.projection = _decompose(x, rank)
        model.vectors = model.project(x)
        made = {**vars(model), "labels": labelled}
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(made[c]).tobytes()], pa.binary()) for c in parts_of], names=parts_of)

    chosen = F.broadcast(sample(labels, per_label, label))  # at most 2 x per_label rows
    rows = in_small_batches(docs).select("doc_id", F.col(text).alias("_text")).join(chosen, F.col("doc_id") == F.col("_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = cut_lineage(rows.select("doc_id", "_y", "_text").mapInArrow(count, f"id {kind}, y int, terms array<int>, n array<float>"))
    one = found.groupBy("id", "y").agg(F.min_by(F.struct("terms", "n"), F.xxhash64("terms", "n")).alias("r")).select("id", "y", "r.terms", "r.n")
    row = one.repartition(1).sortWithinPartitions("id", "y").mapInArrow(
        learn, ", ".join(f"{c} binary" for c in parts_of)).first()
    if row is None:
        return Model(np.zeros(SHAPE + SHAPES, np.float32), np.zeros((SHAPE + SHAPES, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0), neighbours)
    labelled = np.frombuffer(row["labels"])
    shaped = lambda c, n: np.frombuffer(row[c], np.float32).reshape(n, -1)
    return Model(np.frombuffer(row["weights"], np.float32), shaped("projection", SHAPE + SHAPES), shaped("vectors", len(labelled)), labelled, neighbours)


def _fill(x: np.ndarray, terms: pa.Array, n: pa.Array) -> None:
    """Write the counts of some rows, given as lists of terms and numbers, into zeros."""
    held = terms.value_lengths().to_numpy(zero_copy_only=False)
    x[np.repeat(np.arange(len(held)), held), terms.flatten().to_numpy()] = n.flatten().to_numpy()


def _decompose(x: np.ndarray, rank: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(0).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank]


def predict(
    docs: DataFrame, model: Model, keep: dict[str, Column] | None = None, text: str = "text", threshold: float = THRESHOLD,
    kept_text: str | None = None,
) -> DataFrame:
    """Columns ``keep`` (by default doc_id), score and predicted (1 where score >= threshold).

    ``kept_text`` names the one of ``keep`` that is the text, so that it is not sent twice.

    Null texts count as empty; an empty text has its shape terms and is scored like any other. Without labelled rows every
    score is 0.5. One row per input row; other columns are not read.
    """
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.score(counts(d, o)) for _, d, o in slices(batch.column(at), BYTES, ROWS)]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=[*batch.schema.names[:width], "score", "predicted"],
            )

    keep = keep or {"doc_id": F.col("doc_id")}
    width = len(keep)
    at = width if kept_text is None else list(keep).index(kept_text)
    extra = [F.col(text).alias("_text")] if kept_text is None else []
    picked = in_small_batches(docs).select(*(c.alias(n) for n, c in keep.items()), *extra)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:width])
    return picked.mapInArrow(run, f"{kinds}, score double, predicted int")
