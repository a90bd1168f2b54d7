"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts grams in the tasks that read the texts and sends one row per language, bucket and task; the summed counts
become a matrix of log-probabilities (languages x buckets, whatever the number of documents), which is broadcast. A text
is scored by summing the matrix rows of its grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltgraph.functions.shared import Shared
from quiltgraph.llm.texts import code_points, gram_ids, in_small_batches, letters, slices

DIM = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
UNKNOWN = "und"


class Model:
    """Sorted languages, and log-probabilities by language and bucket, the last bucket being worth nothing."""

    def __init__(self, languages: list[str], logs: np.ndarray, priors: np.ndarray, orders: tuple[int, ...], dim: int):
        self.languages, self.logs, self.priors, self.orders, self.dim = languages, logs, priors, orders, dim


def fit(
    labelled: DataFrame, text: str = "text", lang: str = "lang", orders: tuple[int, ...] = ORDERS, dim: int = DIM,
    smoothing: float = SMOOTHING,
) -> Model:
    """Learn from all rows with a language; rows without one are skipped, null texts count as empty.

    The counts reach the driver summed: at most ``dim`` + 1 numbers for each language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = letters(), {}
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            for at, data, offsets in slices(batch.column(0)):
                points, ends = code_points(data, offsets)
                points = table[points]
                rows = names[at : at + len(offsets) - 1]
                kinds, which = np.unique(rows.astype(str), return_inverse=True)
                by_point = np.repeat(which, np.diff(ends)).astype(np.int64) * (dim + 1)
                total = np.zeros(len(kinds) * (dim + 1), np.int64)
                for n in orders:
                    total += np.bincount(by_point + gram_ids(points, ends, n, dim), minlength=len(total))
                total = total.reshape(len(kinds), dim + 1)
                total[:, dim] = np.bincount(which, minlength=len(kinds))  # its place holds the number of texts
                for kind, row in zip(kinds, total, strict=True):
                    sums[str(kind)] = sums.get(str(kind), 0) + row
        for kind, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])],
                names=["kind", "bucket", "n"],
            )

    rows = in_small_batches(labelled).select(F.col(text).alias("t"), F.col(lang).alias("l")).filter("l is not null")
    counted = rows.mapInArrow(count, "kind string, bucket int, n bigint").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    languages = sorted(found.kind.unique())
    counts = np.zeros((len(languages), dim + 1))
    counts[np.searchsorted(languages, found.kind.to_numpy(str)) if len(found) else [], found.bucket] = found.n
    texts, counts[:, dim] = counts[:, dim].copy(), 0
    logs = np.log(counts + smoothing) - np.log(counts.sum(1, keepdims=True) + smoothing * dim)
    logs[:, dim] = 0
    return Model(languages, logs, np.log(texts / max(texts.sum(), 1)) if len(texts) else texts, orders, dim)


def predict(docs: DataFrame, model: Model, keep: dict[str, Column] | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep`` (by default doc_id), lang_pred and score (posterior probability of the predicted language).

    Null texts and texts without a letter give ``und`` and 0, as does a model that learned nothing. Ties go to the
    language that sorts first. One row per input row; other columns are not read.
    """
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = shared.value, letters()
        for batch in batches:
            names, scores = [], []
            for _, data, offsets in slices(batch.column(batch.num_columns - 1)):
                points, ends = code_points(data, offsets)
                points = table[points]
                full = np.flatnonzero(np.diff(ends))
                found = np.zeros((len(offsets) - 1, len(m.languages)))
                for n in m.orders if len(full) else ():
                    ids = gram_ids(points, ends, n, m.dim)
                    for k in range(len(m.languages)):
                        found[full, k] += np.add.reduceat(m.logs[k][ids], ends[full])
                lettered = np.zeros(len(offsets) - 1, bool)
                if len(full):
                    lettered[full] = np.maximum.reduceat(points != 32, ends[full])
                if m.languages:
                    found += m.priors
                    best = found.argmax(1)
                    top = 1 / np.exp(found - found.max(1, keepdims=True)).sum(1)
                    names += [m.languages[b] if k else UNKNOWN for b, k in zip(best, lettered, strict=True)]
                    scores.append(np.where(lettered, top, 0.0))
                else:
                    names += [UNKNOWN] * len(lettered)
                    scores.append(np.zeros(len(lettered)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    keep = keep or {"doc_id": F.col("doc_id")}
    picked = in_small_batches(docs).select(*(c.alias(n) for n, c in keep.items()), F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def remainder(ident: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(ident).cast("string").cast("binary")) % modulus
