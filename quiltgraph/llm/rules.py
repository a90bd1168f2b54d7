"""Quality rules with risk-controlled thresholds.

One pass measures every text. Besides two fixed rules, each rule compares a whole number from 0 to ``TOP`` (hundredths, cut
off above) with a cutoff of its stratum. Cutoffs are chosen on a labelled holdout. For each stratum and rule they are
tested from the most lenient on: the hypothesis "more than ``risk / rules`` of the good documents of this stratum are
rejected" is given up at a cutoff when the exact binomial tail of the rejections seen, among the stratum's good
documents, is at most ``error / (strata x rules)``. Testing stops at the first cutoff that fails (fixed sequence), and
strata and rules share the error (Bonferroni). So with probability ``1 - error`` all certified cutoffs together reject at
most ``risk`` of the good documents of every stratum. Of the certified ones the cutoff is used that catches the most bad
documents less the good ones lost; a rule without a certified cutoff, or without a catch, rejects nothing there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltgraph.functions.sizes import cut_lineage, join_lookup
from quiltgraph.llm.texts import NOT_SPACE, byte_class, grams, in_small_batches, slices, word_hashes, words

SYMBOLS = byte_class([(ord(c), ord(c)) for c in "#*$%&|<>"])
CAPITALS = byte_class([(65, 90)])
EXCLAMATIONS = byte_class([(33, 33)])
WINDOW = 8
TOP = 101
#: Name, numerator and denominator of each rule: it rejects where 100 * numerator / denominator, rounded down, is above the cutoff.
RULES = (
    ("symbols", "n_symbols", "n_words"), ("capitals", "n_capitals", "word_chars"), ("exclamations", "n_exclamations", "n_words"),
    ("duplicate_lines", "n_dup_lines", "n_lines"), ("repeated_words", "n_repeat_words", "n_words"),
)
RISK = 0.05
ERROR = 0.05
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclamations")


def _per_row(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the sorted places lie in each row."""
    return np.diff(np.searchsorted(places, offsets))


def _repeated(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Flags of the entries whose value occurs twice or more in their row, and order numbers of the later ones."""
    order = np.lexsort((values, rows))
    same = (rows[order][1:] == rows[order][:-1]) & (values[order][1:] == values[order][:-1])
    again, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    again[order[1:][same]] = later[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again, later


def counts(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """The numbers of ``COUNTS`` for some texts."""
    n = len(offsets) - 1
    starts, ends, first = words(data, offsets)
    n_words = np.diff(first)
    points = np.flatnonzero(NOT_SPACE[data] & ((data & 0xC0) != 0x80))
    breaks = np.flatnonzero(data == 10)
    # The i-th line starts after the i-th start of a row or break, and ends before the i-th break or end of a row.
    line, stop = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offsets[1:]]))
    inside = np.searchsorted(starts, stop) > np.searchsorted(starts, line)
    line, stop = line[inside], stop[inside]
    of_line = np.searchsorted(offsets, line, "right") - 1
    _, later = _repeated(of_line, word_hashes(data, line, stop))
    hashes = word_hashes(data, starts, ends)
    of = np.repeat(np.arange(n), n_words)
    at = np.flatnonzero(np.arange(len(hashes)) + window <= first[1:][of]) if len(hashes) else np.zeros(0, np.int64)
    twice, _ = _repeated(of[at], grams(hashes, window, 41)[at]) if len(at) else (np.zeros(0, bool), None)
    step = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + window, -1)
    covered = np.flatnonzero(np.cumsum(step)[:-1] > 0)
    return [
        n_words, _per_row(points, offsets), _per_row(np.flatnonzero(SYMBOLS[data]), offsets), np.bincount(of_line[later], minlength=n),
        np.bincount(of[covered], minlength=n), np.bincount(of_line, minlength=n), _per_row(np.flatnonzero(CAPITALS[data]), offsets),
        _per_row(np.flatnonzero(EXCLAMATIONS[data]), offsets)]


def measure(docs: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """Columns ``keep``, the numbers of ``COUNTS``, and base_failed. A null text has no words and fails."""
    picked = in_small_batches(docs).select(*(c.alias(n) for n, c in keep.items()), F.col(text).alias("_text"))
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in slices(batch.column(width)):
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, n) for i in range(width)), *(pa.array(c.astype(np.int64)) for c in counts(data, offsets))],
                    names=[*batch.schema.names[:width], *COUNTS])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:width])
    measured = picked.mapInArrow(run, f"{kinds}, " + ", ".join(f"{c} bigint" for c in COUNTS))
    return measured.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def value(rule: tuple[str, str, str]) -> Column:
    _, above, below = rule
    return F.least(F.lit(TOP), F.coalesce(F.expr(f"(100 * {above}) div nullif({below}, 0)"), F.lit(0))).cast("int")


def binomial_tail(k: int, n: int, p: float) -> float:
    """Probability of at most ``k`` successes of ``n`` at ``p``: a regularised incomplete beta function by its continued fraction."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 100_000):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + step * d, 1 + step / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(p))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, p) / b


def certify(good: np.ndarray, bad: np.ndarray, risk: float, error: float) -> tuple[int | None, int]:
    """(cutoff or None, good documents above it) from the numbers of good and bad documents at each value from 0 to ``TOP``."""
    lost = np.append(np.cumsum(good[::-1])[::-1], 0)[1:]  # above each cutoff
    caught = np.append(np.cumsum(bad[::-1])[::-1], 0)[1:]
    best, gain = None, 0
    for cutoff in range(TOP - 1, -1, -1):
        if binomial_tail(int(lost[cutoff]), int(good.sum()), risk) > error:
            break
        if caught[cutoff] - lost[cutoff] > gain:
            best, gain = cutoff, caught[cutoff] - lost[cutoff]
    return best, 0 if best is None else int(lost[best])


def calibrate(labelled: DataFrame, rules=RULES, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum, rule, cutoff, n_good, n_lost, risk, error: the cutoffs in use, one row for each stratum and rule that has one.

    ``labelled`` holds measured rows with ``stratum`` and ``y`` (1 good, 0 bad). Only numbers per stratum, rule, value and
    label leave the tasks; a stratum's cutoffs are chosen from at most ``2 (TOP + 1)`` rows a rule.
    """
    each = F.explode(F.array(*(F.struct(F.lit(r[0]).alias("rule"), value(r).alias("value")) for r in rules))).alias("r")
    held = cut_lineage(labelled.select("stratum", "y", each).groupBy("stratum", F.col("r.rule").alias("rule"), F.col("r.value").alias("value"), "y").agg(
        F.count("*").alias("n")))
    strata = held.select("stratum").distinct().count()
    share, level = risk / len(rules), error / max(1, strata * len(rules))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        good, bad = (np.bincount(p["value"], p["n"], TOP + 1).astype(np.int64) for p in (group[group.y == 1], group[group.y == 0]))
        cutoff, lost = certify(good, bad, share, level)
        rows = [] if cutoff is None else [(group["stratum"].iloc[0], group["rule"].iloc[0], cutoff, int(good.sum()), lost, share, level)]
        return pd.DataFrame(rows, columns=["stratum", "rule", "cutoff", "n_good", "n_lost", "risk", "error"])

    return cut_lineage(held.groupBy("stratum", "rule").applyInPandas(
        choose, "stratum string, rule string, cutoff int, n_good bigint, n_lost bigint, risk double, error double"))


def judge(measured: DataFrame, cutoffs: DataFrame, rules=RULES) -> DataFrame:
    """``measured`` (with ``stratum``) and ``kept``: neither base_failed nor above a cutoff of its stratum."""
    wide = cutoffs.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r[0], F.col("cutoff"))).alias(f"_cut_{r[0]}") for r in rules))
    met = join_lookup(measured, wide, ["stratum"], how="left")
    above = reduce(lambda a, b: a | b, (F.coalesce(value(r) > F.col(f"_cut_{r[0]}"), F.lit(False)) for r in rules))
    return met.withColumn("kept", ~F.col("base_failed") & ~above).drop(*(f"_cut_{r[0]}" for r in rules))


def filter_quality(
    docs: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", stratum: str = "lang", label: str = "quality",
    rules=RULES, risk: float = RISK, error: float = ERROR,
) -> DataFrame:
    """``keys``, stratum, the numbers of ``COUNTS``, base_failed, kept: one row per input row.

    ``labels`` (doc_id, ``label`` 1 or 0) is the holdout; rows with nulls and ids with different labels are left out of it.
    Rows without an id are judged and never part of the holdout; every row of a labelled id counts there. A null stratum
    is the empty string. Null and empty texts have no words and are not kept. Without labels only the fixed rules reject.
    Other columns are not read.
    """
    names = {f"_k{i}": F.col(f"`{k}`") for i, k in enumerate(keys)}
    own = {"_id": F.col("doc_id"), "stratum": F.coalesce(F.col(stratum).cast("string"), F.lit(""))}
    measured = cut_lineage(measure(docs, {**names, **own}, text))
    agreed = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(
        F.min(label).cast("int").alias("y"), F.max(label).alias("_most")).filter("y = _most").select("_id", "y")
    cutoffs = calibrate(join_lookup(measured, agreed, ["_id"]), rules, risk, error)
    plain = [F.col(n).alias(k) for n, k in zip(names, keys, strict=True)]
    return judge(measured, cutoffs, rules).select(*plain, "stratum", *COUNTS, "base_failed", "kept")
