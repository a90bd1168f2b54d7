import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltgraph.config import Settings
from quiltgraph.functions import vectors
from quiltgraph.functions.sizes import join_lookup
from quiltgraph.operators import nearest, ranking
from quiltgraph.operators.cells import build_cells, search_cells
from quiltgraph.operators.postings import build_postings, search_postings
from conftest import rows


def fuse(spark, lists):
    data = [("q", d, n, r) for n, one in enumerate(lists) for r, d in enumerate(one, 1)]
    df = spark.createDataFrame(data, "q string, doc string, list_no int, rank int")
    return [(r["doc"], r["score"]) for r in ranking.fuse_rankings(df, "q", "doc").orderBy("rank").collect()]


def test_rrf_golden(spark):
    assert [d for d, _ in fuse(spark, [["doc1", "doc2"], ["doc2", "doc3"]])] == ["doc2", "doc1", "doc3"]
    assert fuse(spark, [["doc1"], []]) == [("doc1", pytest.approx(1 / 61))]
    assert fuse(spark, [[], []]) == []


def test_rrf_ignores_input_order(spark):
    lists = [[f"d{i}" for i in random.Random(1).sample(range(30), 20)], [f"d{i}" for i in random.Random(2).sample(range(30), 20)]]
    data = [("q", d, n, r) for n, one in enumerate(lists) for r, d in enumerate(one, 1)]
    random.Random(3).shuffle(data)
    df = spark.createDataFrame(data, "q string, doc string, list_no int, rank int")
    got = [r["doc"] for r in ranking.fuse_rankings(df, "q", "doc").orderBy("rank").collect()]
    assert got == [d for d, _ in fuse(spark, lists)]


def test_first_and_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "k string, o int, v string")
    assert rows(ranking.first_by(df, "k", F.col("o"), ["v"])) == [("a", "x"), ("b", "z")]
    assert rows(ranking.last_by(df, "k", F.col("o"), ["v"])) == [("a", "y"), ("b", "z")]


def test_cosine_golden(spark):
    df = spark.createDataFrame(
        [("q", [1.0, 0.0, 0.0], "B", [0.5, 0.866, 0.0]), ("q", [1.0, 0.0, 0.0], "C", [0.866, 0.5, 0.0])],
        "q string, a array<float>, n string, b array<float>",
    )
    top = ranking.top_k(df.withColumn("c", vectors.cosine(F.col("a"), F.col("b"))), "q", [F.desc("c")], 1)
    assert [r["n"] for r in top.collect()] == ["C"]
    zero = spark.createDataFrame([([0.0], [1.0]), (None, [1.0]), ([], [])], "a array<float>, b array<float>")
    assert [r[0] for r in zero.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("metric", ["l2", "unit_l2"])
@pytest.mark.parametrize("settings", [Settings(), Settings(query_block_rows=3)])
def test_nearest_against_brute_force(spark, metric, settings):
    rng = np.random.default_rng(5)
    q = rng.integers(-3, 4, (10, 6)).astype(float)
    v = rng.integers(-3, 4, (60, 6)).astype(float)
    v[0] = 0
    qs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "question_id int, vector array<double>")
    vs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item int, vector array<double>").repartition(5)
    got = rows(nearest.nearest(qs, vs, "question_id", "item", 4, metric, settings), "question_id", "rank", "item")
    want = []
    for i, a in enumerate(q):
        def far(b):
            if metric == "l2":
                return round(float(((a - b) ** 2).sum()), 6)
            n = np.sqrt((a @ a) * (b @ b))
            return round(2 - 2 * (a @ b / n if n else 0.0), 6)
        best = sorted((far(b), j) for j, b in enumerate(v))[:4]
        want += [(i, r, j) for r, (_, j) in enumerate(best, 1)]
    assert got == sorted(want)


def test_nearest_without_questions(spark):
    empty = spark.createDataFrame([], "question_id int, vector array<double>")
    vs = spark.createDataFrame([(1, [1.0])], "item int, vector array<double>")
    assert nearest.nearest(empty, vs, "question_id", "item", 3).count() == 0


@pytest.mark.parametrize("limit", [1000, 1])
@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_lookup_join_same_beyond_the_size_check(spark, limit, how):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(300)], "i int, k string")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    got = join_lookup(big, small if how == "inner" else small.select("k"), ["k"], Settings(broadcast_rows=limit, salts=4), how)
    assert rows(got, "i") == rows(big.join(small, "k", how), "i")


def clustered(rows_, centres=40, dim=8, seed=9):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((centres, dim))[rng.integers(0, centres, rows_)] * 6 + rng.standard_normal((rows_, dim)) * 0.3


def vector_frame(spark, x, name):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} int, vector array<double>")


def test_blocks_of_both_sides_meet_each_pair_once(spark):
    """Three blocks of questions, several of items, a third of the items equal: the same as one block."""
    x = clustered(900)
    x[:300] = x[0]
    qs, vs = vector_frame(spark, clustered(30, seed=4), "question_id"), vector_frame(spark, x, "item").repartition(5)
    one = rows(nearest.nearest(qs, vs, "question_id", "item", 7), "question_id", "rank", "item", "distance")
    assert one == rows(nearest.nearest(qs, vs, "question_id", "item", 7, settings=Settings(query_block_rows=10)), "question_id", "rank", "item", "distance")
    group = F.lit(0).cast("bigint").alias("_g")
    from quiltgraph.functions.sizes import cut_lineage

    q, v = (cut_lineage(df.withColumnRenamed(c, n)).select(n, "vector", group) for df, c, n in ((qs, "question_id", "_q"), (vs, "item", "_v")))
    met = nearest.meet(q, v, 7, "l2", Settings(query_block_rows=10), item_block=100)
    assert met.groupBy("_q").count().filter("count < 7 * 5").count() == 0  # several blocks of items gave their best
    assert rows(ranking.top_k(met, "_q", [F.asc("distance"), F.asc("_v")], 7), "_q", "rank", "_v", "distance") == one
    source = open(nearest.__file__).read()
    assert "toLocalIterator" not in source and "collect()" not in source


@pytest.mark.parametrize("metric", ["l2", "unit_l2"])
def test_cells_give_what_nearest_gives_and_read_less(spark, metric):
    x = clustered(4000)
    x[:5] = 0
    x[100:140] = x[100]
    q = np.concatenate([clustered(25, seed=3), x[100:102], np.zeros((1, 8))])
    qs, vs = vector_frame(spark, q, "question_id"), vector_frame(spark, x, "item").repartition(4)
    cells = build_cells(vs, "item", metric, cell_items=50)
    best, read = search_cells(qs, cells, "question_id", "item", 10)
    columns = ("question_id", "rank", "item", "distance")
    assert rows(best, *columns) == rows(nearest.nearest(qs, vs, "question_id", "item", 10, metric), *columns)
    share = {r["question_id"]: r["n_read"] / r["n_items"] for r in read.collect()}
    assert len(share) == len(q) and np.median(list(share.values())) < 0.25
    if metric == "unit_l2":
        assert share[len(q) - 1] == 1  # everything is at the same distance of a zero vector


def test_cells_of_few_or_no_items(spark):
    qs = vector_frame(spark, clustered(3), "question_id")
    few = vector_frame(spark, clustered(4), "item")
    best, read = search_cells(qs, build_cells(few, "item"), "question_id", "item", 10)
    assert rows(best, "question_id", "rank", "item") == rows(nearest.nearest(qs, few, "question_id", "item", 10), "question_id", "rank", "item")
    assert {(r["n_read"], r["n_items"]) for r in read.collect()} == {(4, 4)}
    best, read = search_cells(qs, build_cells(few.limit(0), "item"), "question_id", "item", 10)
    assert best.count() == 0 and {(r["n_read"], r["n_items"]) for r in read.collect()} == {(0, 0)}


def test_postings_leave_out_what_cannot_win(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [(i, "the of and " * rng.randint(1, 3) + " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(400)], k=30))) for i in range(1500)]
    texts += [(1500, None), (1501, ""), (1502, "THE The the")]
    asked = [(q, t, w) for q in range(8) for t, w in [("the", 1), ("of", 1), ("and", 1), ("nothing", 2), *((v, 3) for v in rng.sample(vocabulary[50:], 4))]]
    docs, terms = spark.createDataFrame(texts, "item int, text string"), spark.createDataFrame(asked, "question_id int, term string, weight int")
    best, read = search_postings(terms, build_postings(docs, "item"), "question_id", 5)
    want = []
    for q in range(8):
        weights = {t: w for i, t, w in asked if i == q}
        scores = sorted((-sum(weights.get(w, 0) for w in (t or "").lower().split()), i) for i, t in texts)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:5], 1) if s]
    assert rows(best, "question_id", "rank", "item", "score") == sorted(want)
    scored = [r["n_scored"] for r in read.collect()]
    assert len(scored) == 8 and sum(scored) < 0.4 * 8 * len(texts)


@pytest.mark.parametrize("block", [4096, 3])
def test_word_counts_against_plain_counting(spark, block):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 12)))) for i in range(200)] + [(200, None), (201, "A a A")]
    asked = [(q, t, rng.randint(1, 3)) for q in range(7) for t in rng.sample("abcdxyz", 3)]
    docs, terms = spark.createDataFrame(texts, "item int, text string").repartition(4), spark.createDataFrame(asked, "question_id int, term string, weight int")
    got = rows(nearest.sparse_nearest(terms, docs, "question_id", "item", 6, settings=Settings(query_block_rows=block)), "question_id", "rank", "item", "score")
    want = []
    for q in range(7):
        weights = {t: w for i, t, w in asked if i == q}
        scores = sorted((-sum(weights.get(w, 0) for w in (t or "").lower().split()), i) for i, t in texts)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:6], 1) if s]
    assert got == sorted(want)


def test_postings_deal_texts_once(spark, monkeypatch):
    """Words are counted and lengths summed where the item's text was dealt to, by one shuffle."""
    from quiltgraph.operators import postings

    plans, written = [], postings.cut_lineage
    monkeypatch.setattr(postings, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df))
    docs = spark.createDataFrame([(1, "a b b"), (1, "b c"), (2, None), (None, "a"), (3, "")], "doc_id int, text string")
    stored = postings.build_postings(docs, "doc_id")
    assert plans[0].count("Exchange") == 1
    assert rows(stored.rows, "term", "length", "item", "weight") == [("a", 2, 1, 1), ("b", 2, 1, 3), ("c", 2, 1, 1)]


def test_candidates_are_completed_by_terms_left_out(spark):
    """The last step adds what the left-out terms of an item's class give, and reads no other postings."""
    from quiltgraph.config import Settings
    from quiltgraph.operators import postings

    stored = postings.Postings(spark.createDataFrame(
        [("rare", 3, 1, 2), ("the", 3, 1, 5), ("of", 3, 1, 4), ("the", 4, 2, 9), ("rare", 4, 2, 1)], "term string, length int, item int, weight long"), None, None)
    candidates = spark.createDataFrame([("q", 3, 1, 20), ("q", 4, 2, 10), ("r", 4, 2, 7)], "q string, length int, item int, part long")
    left_out = spark.createDataFrame([("q", 3, "the", 1), ("q", 3, "of", 2), ("r", 4, "the", 3)], "q string, length int, term string, qw long")
    got = postings._completed(stored, candidates, left_out, Settings())
    assert rows(got, "q", "item", "score") == [("q", 1, 33), ("q", 2, 10), ("r", 2, 34)]


def test_word_search_and_embedder_hold_bounded_arrays():
    """Words that all questions share, and long texts, are worked off in parts; the results are those of one part."""
    import tracemalloc

    import pyarrow as pa

    from quiltgraph.models.clients import HashingEmbedder

    shared = [{"term": f"w{i}", "weight": float(i % 7 + 1)} for i in range(50)]
    q_ids, n = pa.array(range(300)), 1024
    best = nearest.BestByWords(q_ids, pa.array([shared] * 300), 3)
    items = pa.array([[f"w{(i * j) % 60}" for j in range(50)] for i in range(n)])
    tracemalloc.start()
    best.add(pa.array(range(n)), items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    HashingEmbedder().embed([f"a{i % 50} " * 10_000 for i in range(200)])
    peak_embed = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and peak_embed < 60e6, (peak, peak_embed)
    weights = {t["term"]: t["weight"] for t in shared}
    scores = sorted(((-sum(weights.get(w, 0) for w in words), i) for i, words in enumerate(items.to_pylist())))[:3]
    assert best.ids[:3].tolist() == [i for _, i in scores] and best.distances[:3].tolist() == [s for s, _ in scores]
