"""Links that blocks have to keep, exact ways beyond forests, texts that share an id, votes and Markov spans against plain versions."""

import math
import os
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute
import corpus_pipeline
from quiltgraph.llm import quality, vectors


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def test_blocks_keep_every_spanning_link():
    """A-C and B-C link, A-B does not: each row's first hit alone would lose B."""
    c = np.array([1.0, 0.0])
    a, b = (np.array([math.cos(t), math.sin(t)]) for t in (0.4, -0.4))
    x = np.array([a, b, c])
    for leaf in (3, 2, 1):
        links = [pair for one, two in vectors._blocks(x, np.array([7, 8, 9]), 0.9, leaf) for pair in zip(one.tolist(), two.tolist())]
        assert set(brute.components([7, 8, 9], links).values()) == {7}
    rng = np.random.default_rng(1)
    for _ in range(30):
        x = unit(rng.standard_normal((12, 1, 6)) + 0.28 * rng.standard_normal((12, 8, 6))).reshape(-1, 6)
        ids = rng.permutation(len(x)) + 100
        near = x @ x.T >= 0.9
        want = brute.components(ids.tolist(), [(int(ids[i]), int(ids[j])) for i, j in np.argwhere(near) if i < j])
        links = [pair for one, two in vectors._blocks(x, ids, 0.9, 17) for pair in zip(one.tolist(), two.tolist())]
        assert brute.components(ids.tolist(), links) == want


@pytest.mark.parametrize("way", ["no forest", "nodes that do not split"])
def test_the_exact_ways_find_every_link(spark, way, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate([unit(b + 0.1 * rng.standard_normal((40, 12))) for b in rng.standard_normal((8, 12))] + [unit(rng.standard_normal((80, 12)))])
    sizes = {"forests": 0, "block": 50}
    if way != "no forest":
        monkeypatch.setattr(vectors, "MOST_ROUNDS", 1)
        sizes = {"task_rows": 30, "sample": 60, "sample_leaf": 400, "leaf": 16, "block": 50, "forests": 1}
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x))), "embedding": pa.array(list(x))}))
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    component = brute.components(range(len(x)), [tuple(map(int, p)) for p in np.argwhere(near)])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df, **sizes).collect()}
    assert got == {i: (int(near[i].sum()), component[i]) for i in range(len(x))}


def test_a_forest_of_few_trees_leaves_no_table_behind(spark):
    import glob

    from quiltgraph.functions.sizes import shared_folder

    x = unit(np.random.default_rng(2).standard_normal((3000, 32)))
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x))), "embedding": pa.array(list(x))}))
    folder = shared_folder(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(f) for f in glob.glob(f"{folder}/**/*.parquet", recursive=True))
    before = size()
    vectors.near_duplicates(df, task_rows=400, sample=1000, sample_leaf=100, leaf=64).count()
    assert size() - before < 3 * x.nbytes  # the distinct vectors, and links


def test_unlike_texts_of_one_id_are_both_kept(spark, folder):
    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(5, prose(1)), (5, prose(2)), (5, prose(2)), (6, prose(3)), (6, prose(1) + " more"), (7, prose(2) + " more"), (7, None), (None, prose(1)), (3, prose(4)), (9, prose(4))]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, extra int")
    got = sorted(((r["doc_id"], r["text"], r["extra"]) for r in corpus_pipeline.one_of_each_group(spark, docs, folder).collect()), key=str)
    want = [(5, prose(1), 0), (5, prose(2), 1), (6, prose(3), 3), (7, None, 6), (None, prose(1), 7), (3, prose(4), 8)]
    assert got == sorted(want, key=str)


def test_items_of_few_words_are_listed_and_drop_nothing(spark, folder):
    spark.createDataFrame([(1, "alpha beta"), (2, "one two three four five six")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "so alpha beta it is"), (2, "x one two three four five six y"), (3, "nothing")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.without_benchmarks(spark, docs, folder).collect()) == [1, 3]
    assert [tuple(r) for r in corpus_pipeline.short_item_places(spark, docs, folder).collect()] == [(1, 1, 2)]
    assert sorted(r["doc_id"] for r in corpus_pipeline.without_benchmarks(spark, docs, folder, least_item_words=1).collect()) == [3]


def test_votes_are_those_of_a_full_sort():
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["alpha", "beta", "GAMMA", "###", "d1", "e"], rng.integers(1, 30))) for _ in range(120)]
    column = pa.array(texts)
    from quiltgraph.llm.texts import slices

    x = np.concatenate([quality.counts(d, o) for _, d, o in slices(column)])
    weights = np.log((1 + 60) / (1 + np.count_nonzero(x[:60], axis=0))).astype(np.float32) + 1
    model = quality.Model(weights, np.zeros((x.shape[1], 0), np.float32), np.zeros((0, 0), np.float32), rng.integers(0, 2, 60).astype(float), 7)
    known = model.weigh(x[:60].copy())
    model.projection = quality._decompose(known, 8)
    model.vectors = model.project(known)
    model.vectors[30:40] = model.vectors[3]  # ties
    got = model.score(x.copy())
    place = model.project(model.weigh(x.copy())) @ model.vectors.T
    for row, score in zip(place, got, strict=True):
        steps = [round(float(c) * quality.STEP) for c in row]
        near = sorted(range(60), key=lambda i: (-steps[i], i))[:7]
        votes = [max(steps[i] / quality.STEP, 1e-6) ** quality.SHARPNESS for i in near]
        assert math.isclose(score, sum(v * model.labels[i] for v, i in zip(votes, near, strict=True)) / sum(votes), abs_tol=2e-3)


def test_slices_are_bounded_in_rows():
    from quiltgraph.llm.texts import slices

    sizes = [len(o) - 1 for _, _, o in slices(pa.array([""] * 1300 + ["a" * 50]), 1 << 20, 512)]
    assert sizes == [512, 512, 277]
