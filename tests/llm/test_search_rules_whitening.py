"""Lexical search, whitening and quality rules against plain versions, and their unusual inputs."""

import math
import os
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute
from quiltgraph.llm import rules, search, whitening
from quiltgraph.llm.queries import QUERIES

DATA = os.environ.get("QUILTGRAPH_TESTDATA", "/root/testdata/sf0.001")
TEXTS = [
    (1, "Alpha beta, gamma! alpha ALPHA"), (2, "beta beta delta"), (3, None), (4, ""), (5, "?! \x00 ..."), (6, "alpha beta gamma delta é"), (6, "alpha beta gamma delta é"),
    (7, "É é 漢字 漢字、alpha"), (None, "alpha alpha alpha"), (8, "gamma " * 3000 + "delta"), (9, "a1_b2 A1 b2"),
]
ITEMS = [(1, "alpha beta"), (2, "delta delta gamma"), (2, "beta"), (3, None), (4, "?"), (5, "unknown words only"), (None, "é 漢字"), (6, "a1 b2 b2")]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_search_is_what_a_full_ranking_gives(spark, most):
    docs = frame(spark, [(i, t, "x", "y") for i, t in TEXTS], "doc_id long, text string, item_id string, score string")
    items = frame(spark, [(i, t, "z") for i, t in ITEMS], "item_id long, text string, doc_id string")
    for k in (2, 10):
        got = search.search(docs, items, k, most_postings=most)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute.search(TEXTS, ITEMS, k), key=key)


def test_search_of_empty_tables(spark):
    docs, items = frame(spark, TEXTS, "doc_id long, text string"), frame(spark, ITEMS, "item_id long, text string")
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).count() == 0
    assert search.search(docs.filter("doc_id in (3, 4, 5)"), items).count() == 0


def test_search_keeps_ties_in_order_over_many_tasks(spark):
    rows = [(i, "one two three") for i in range(500, 0, -1)] + [(i, f"one two w{i}") for i in range(501, 900)]
    got = search.search(frame(spark, rows, "doc_id int, text string").repartition(7), frame(spark, [(1, "one three")], "item_id int, text string"))
    assert [tuple(r) for r in got.orderBy("rank").collect()] == brute.search(rows, [(1, "one three")])


def vectors_of(spark, rows):
    table = pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32())), "label": pa.array(["x"] * len(rows))})
    return spark.createDataFrame(table)


def check_whitening(spark, rows, components=16):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    df = vectors_of(spark, rows).repartition(5)
    model = whitening.fit(df, components)
    got = whitening.whiten(df, model).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in good)
    width = max(len(v) for _, v in good)
    full = {i: brute.on_grid([*np.float32(v).astype(float), *[0.0] * (width - len(v))]) for i, v in good}
    x, values, directions, trace = brute.whitened([[(c - 1_000_000) / 64 for c in v] for v in full.values()], components)
    n, sums = len(x), [sum(int(c) for c in column) for column in x.T]
    assert model.n == n and model.sums == sums and model.identity_error <= 1e-9
    kept = len(model.values)
    assert np.allclose(model.values, values[:kept], rtol=1e-9) and (values[kept:] <= 1e-9 * max(values[0], 1)).all()
    assert np.allclose(model.explained, values[:kept] / trace, rtol=1e-9) if kept else True
    y = {i: np.array(v) - np.array([s / n for s in sums]) for i, v in full.items()}
    for r in got:
        assert r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(full[r["vec_id"]], sums, strict=True))
        assert np.allclose(np.array(r["whitened"]) * np.sqrt(model.values), model.directions @ y[r["vec_id"]], atol=1e-8)
    assert np.abs(model.directions @ model.directions.T - np.eye(kept)).max(initial=0) < 1e-12
    return model, values, directions


def test_whitening_of_plain_vectors(spark):
    rng = np.random.default_rng(3)
    scale = np.linspace(4, 1, 24)
    rows = [(i, list(map(float, rng.standard_normal(24) * scale))) for i in range(700)]
    model, _, directions = check_whitening(spark, rows + rows[:50] + [(i + 5000, rows[i][1]) for i in range(300)])
    assert np.allclose(np.abs(np.einsum("ij,ij->i", model.directions, directions)), 1, atol=1e-9)


def test_whitening_of_unusual_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0, 2.0]), (2, [0.5, 1.0]), (2, [0.5, 1.0]), (3, None), (4, [1.0, None, 0.0]), (5, [nan, 0.0, 0.0]), (6, [0.0, -inf, 0.0]), (7, []), (None, [2.0, 1.0, -1.0])]
    check_whitening(spark, rows)
    check_whitening(spark, [(1, [0.25, 0.5])] * 3)  # one distinct vector: no spread, no component
    check_whitening(spark, [(i, [float(i), 3.0]) for i in range(9)])  # a constant dimension
    check_whitening(spark, [(i, [1.0 if j == i else 0.0 for j in range(20)]) for i in range(20)])  # equal eigenvalues
    far = whitening.Whitening(1 << 40, [0, 0], np.ones(1), np.eye(2)[:1], np.ones(1), 0.0)
    assert whitening.deviations(np.array([[3, 4], [1 << 20, 0]]), far) == [None, None]
    assert whitening.deviations(np.array([[3, 4]]), whitening.Whitening(1 << 30, [0, 0], np.ones(1), np.eye(2)[:1], np.ones(1), 0.0)) == [None]
    empty = vectors_of(spark, rows).filter("vec_id in (3, 4)")
    assert whitening.fit(empty) is None and whitening.whiten(empty, None).count() == 0


@pytest.mark.parametrize("kind", ["plain", "graded", "equal", "close", "rank", "split"])
def test_the_solver_finds_values_and_orthogonal_directions(kind):
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    close = np.r_[np.full(8, 2.0), 2 * (1 + 1e-9), np.ones(31)]
    y = {
        "plain": rng.standard_normal((300, 40)), "graded": rng.standard_normal((300, 40)) * 10.0 ** -np.linspace(0, 10, 40), "equal": q * 3,
        "close": (np.linalg.qr(rng.standard_normal((90, 40)))[0] * close) @ q, "rank": rng.standard_normal((90, 5)) @ rng.standard_normal((5, 40)),
        "split": np.kron(np.eye(2), rng.standard_normal((50, 20))),
    }[kind]
    squares, v, total = whitening.solve(np.linalg.qr(y, mode="r"), 16)
    want = np.linalg.svd(y, compute_uv=False) ** 2
    assert len(squares) == min(16, (want > 1e-20 * want[0]).sum()) and np.allclose(squares, want[: len(squares)], rtol=1e-12) and math.isclose(total, want.sum(), rel_tol=1e-12)
    assert np.abs(v @ v.T - np.eye(len(v))).max() < 1e-12
    assert np.abs(y.T @ (y @ v.T) - v.T * squares).max() < 1e-12 * want[0]


def test_dqds_is_accurate_for_small_values_too():
    a, b = 10.0 ** -np.arange(0.0, 16, 2), 10.0 ** -np.arange(1.0, 15, 2)
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    got = whitening.dqds(a, b)
    d, e = [Decimal(float(x)) ** 2 for x in a], [Decimal(float(x)) ** 2 for x in b]
    for value in got:
        # The number of eigenvalues below a value, by exact counts of negative pivots just left and right of it.
        def below(shift):
            n, p = 0, d[0] - shift
            for i in range(len(e)):
                n += p < 0
                p = d[i + 1] + e[i] - d[i] * e[i] / p - shift
            return n + (p < 0)

        assert below(Decimal(float(value)) * (1 + Decimal(10) ** -13)) - below(Decimal(float(value)) * (1 - Decimal(10) ** -13)) == 1


def test_op12_on_the_given_table(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    got = QUERIES["op12_embedding_whitening"](spark, DATA).collect()
    x, values, directions, trace = brute.whitened([r["embedding"] for r in rows])
    assert len(got) == 16 * len(rows) and {r["n"] for r in got} == {len(x)} and {r["identity_error"] <= 1e-4 for r in got} == {True}
    mean = x.mean(0)
    of = {r["vec_id"]: np.array(brute.on_grid(r["embedding"])) - mean for r in rows}
    w = np.array([[r["whitened"] for r in sorted(got, key=lambda r: r["vec_id"]) if r["component"] == c] for c in range(1, 17)])
    want = np.array([[d @ of[i] / math.sqrt(v) for i in sorted(of)] for v, d in zip(values, directions, strict=True)])
    signs = np.sign((w * want).sum(1))
    assert np.allclose(w * signs[:, None], want, atol=1e-7)
    assert all(math.isclose(r["explained"], values[r["component"] - 1] / trace, rel_tol=1e-9) for r in got)


ODD = [None, "", " \t\n ", "a b", "x y\nx y\nx  y\n\nx y", "w " * 40, "one two three four five six seven eight nine ten " * 3, "\n\nq\nq\n", "AB! é漢 #$\r\n<>|&%* \x0b\x0c z", "u　v w x",
       " ".join(map(str, range(100))) + "\n" + " ".join(map(str, range(50, 58)))]


def test_quality_counts(spark):
    docs = frame(spark, [(i, t, 9) for i, t in enumerate(ODD)], "doc_id long, text string, n_words int")
    from pyspark.sql import functions as F

    got = {r["id"]: tuple(r[c] for c in rules.COUNTS) for r in rules.measure(docs, {"id": F.col("doc_id")}).collect()}
    assert got == {i: brute.quality_counts(t) for i, t in enumerate(ODD)}


def test_binomial_tails():
    for k, n, p in ((0, 10, 0.01), (3, 50, 0.05), (7, 900, 0.01), (40, 60, 0.5), (9, 9, 0.2), (0, 4000, 0.002)):
        assert math.isclose(rules.binomial_tail(k, n, p), brute.binomial_tail(k, n, p), rel_tol=1e-9)


def test_cutoffs_are_certified_by_plain_counting():
    rng = np.random.default_rng(2)
    for _ in range(6):
        good, bad = (np.bincount(np.minimum(rng.geometric(p, size), rules.TOP), minlength=rules.TOP + 1) for p, size in ((0.4, rng.integers(50, 900)), (0.04, 200)))
        cutoff, lost = rules.certify(good, bad, 0.02, 0.01)
        best, gain = None, 0
        for c in range(rules.TOP - 1, -1, -1):
            above = int(good[c + 1 :].sum())
            if brute.binomial_tail(above, int(good.sum()), 0.02) > 0.01:
                break
            if bad[c + 1 :].sum() - above > gain:
                best, gain = c, bad[c + 1 :].sum() - above
        assert cutoff == best and lost == (0 if best is None else good[best + 1 :].sum())


def test_false_rejections_stay_below_the_risk(spark):
    """Many labelled draws from one source: the share of good documents lost passes the risk less often than the error allows."""
    rng, over = np.random.default_rng(11), 0
    probabilities = 0.5 ** np.arange(1, rules.TOP + 2)
    probabilities /= probabilities.sum()
    for _ in range(150):
        good, bad = rng.multinomial(400, probabilities), rng.multinomial(300, probabilities[::-1])
        cutoff, _ = rules.certify(good, bad, 0.05, 0.05)
        over += cutoff is not None and probabilities[cutoff + 1 :].sum() > 0.05
    assert over <= 0.05 * 150 + 3 * math.sqrt(0.05 * 0.95 * 150)


def test_filter_quality_on_unusual_tables(spark):
    prose = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(i, prose(i), "a") for i in range(900)] + [(1000 + i, " ".join(f"s{i}x{j}###" for j in range(40)), "a") for i in range(100)]
    rows += [(2000, None, None), (2001, "", "a"), (None, prose(7), None), (3, prose(3), "a"), (2002, "x### " + prose(1), "b"), (2003, " ".join(f"t{j}###" for j in range(40)), "b")]
    docs = frame(spark, [(*r, "k", "y") for r in rows], "doc_id long, text string, lang string, kept string, y string")
    labels = frame(spark, [(i, 1) for i in range(900)] + [(1000 + i, 0) for i in range(100)] + [(2003, 1), (2003, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = rules.filter_quality(docs, labels)
    assert got.count() == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert all(kept[i] for i in range(900)) and not any(kept[1000 + i] for i in range(100))
    assert not kept[2000] and not kept[2001] and kept[None] and kept[2002] and kept[2003]  # stratum b has no certified cutoff
    assert rules.filter_quality(docs.limit(0), labels).count() == 0
    unlabelled = rules.filter_quality(docs, labels.limit(0))
    assert unlabelled.filter("kept = base_failed").count() == 0


def test_op13_counts_on_the_given_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in QUERIES["op13_quality_rules"](spark, DATA).collect():
        n, chars, symbols, dup, repeats, *_ = brute.quality_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeats)
        assert r["base_failed"] == (n < 20 or 100 * repeats > 30 * n) and not (r["kept"] and r["base_failed"])
