from pyspark.sql import functions as F

from quiltgraph.operators.linking import RuleScorer
from quiltgraph.operators import graph, linking
from quiltgraph.config import Settings
from conftest import rows


def entities(spark, *more):
    data = [("d1_a", "d1", "a", "sa", True), ("d1_b", "d1", "b", "sb", True), ("d2_a", "d2", "a", "sa2", True), *more]
    return spark.createDataFrame(data, "entity_id string, doc_id string, name string, summary string, is_named_entity boolean")


def edges(spark):
    return spark.createDataFrame([("d1_a", "d1_0", "d1"), ("d1_a", "d1_1", "d1"), ("d1_b", "d1_0", "d1"), ("d2_a", "d2_0", "d2")],
                                 "entity_id string, chunk_id string, doc_id string")


def test_metadata(spark):
    docs = spark.createDataFrame([("d1", "s1"), ("d2", "s2"), ("d3", None)], "doc_id string, summary string")
    meta = graph.document_metadata(docs, edges(spark), entities(spark))
    assert rows(meta) == [("d1", "s1", ["a", "b"]), ("d2", "s2", ["a"]), ("d3", None, [])]
    ids = spark.createDataFrame([(0, "d2"), (1, "nope"), (2, "d2")], "position int, doc_id string")
    assert rows(graph.metadata_for(ids, meta), "position", "doc_id", "entities") == [(0, "d2", ["a"]), (1, "nope", []), (2, "d2", ["a"])]


def test_recall_and_summaries(spark):
    names = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "a"), ("r", "zzz")], "question_id string, name string")
    got = graph.documents_by_names(names, entities(spark), 10)
    assert rows(got, "question_id", "rank", "doc_id", "score") == [("q", 1, "d1", 2), ("q", 2, "d2", 1)]
    wanted = spark.createDataFrame([("d1", "a")], "doc_id string, name string")
    assert graph.summaries_by_name(wanted, entities(spark), edges(spark)).count() == 1
    assert graph.summaries_by_name(wanted, entities(spark), edges(spark), per_chunk=True).count() == 2
    assert rows(graph.summaries_by_id(spark.createDataFrame([("d2_a",)], "entity_id string"), entities(spark))) == [("d2_a", "a", "sa2")]


def test_links_both_ways(spark):
    e = entities(spark)
    same = spark.createDataFrame([("d1_a", "d2_a", 9.0), ("d1_a", "d1_b", 8.0)], "entity_1_id string, entity_2_id string, score double")
    got = graph.linked_entities(e.select("entity_id", "doc_id"), same, e)
    assert rows(got, "doc_id", "linked_id") == [("d1", "d2_a"), ("d2", "d1_a")]


def test_upserts(spark):
    old = spark.createDataFrame([("k", "old", 1), ("m", "keep", 1)], "k string, v string, seq int")
    new = spark.createDataFrame([("k", "mid", 2), ("k", "new", 3)], "k string, v string, seq int")
    once = graph.upsert(old, new, ["k"])
    assert rows(once) == [("k", "new", 3), ("m", "keep", 1)] == rows(graph.upsert(once, new, ["k"]))
    r = "source_entity_id string, target_entity_id string, description string, seq int"
    got = graph.upsert_relations(spark.createDataFrame([], r), spark.createDataFrame([("d1_a", "d1_b", "x", 1), ("d1_a", "d1_b", "y", 2), ("d1_a", "gone", "z", 3)], r), entities(spark))
    assert rows(got) == [("d1_a", "d1_b", "y", 2)]


def test_same_as_times(spark):
    t = lambda x: F.lit(x).cast("timestamp")
    none = spark.createDataFrame([], "entity_1_id string, entity_2_id string, score double, created_at timestamp, updated_at timestamp")
    link = spark.createDataFrame([("x", "y", 7.5)], "entity_1_id string, entity_2_id string, score double")
    first = graph.merge_same_as(none, link, t("2024-01-01"))
    second = graph.merge_same_as(first, link.withColumn("score", F.lit(9.0)), t("2024-01-02")).first()
    assert first.first()["updated_at"] is None and second["score"] == 9.0
    assert second["created_at"].day == 1 and second["updated_at"].day == 2


def test_supplement(spark):
    old = spark.createDataFrame([("d", "a", "one", True)], "doc_id string, name string, summary string, is_named_entity boolean")
    new = spark.createDataFrame([("d", "a", "two", True, 1), ("d", "b", "new", False, 2), ("d", "b", "more", True, 3)],
                                "doc_id string, name string, description string, is_named_entity boolean, seen_at long")
    once = graph.supplement_entities(old, new)
    texts = {r["name"]: r["summary"] for r in once.collect()}
    assert texts == {"a": "one\n\n--- (追加描述) ---\ntwo", "b": "new\n\n--- (追加描述) ---\nmore"}
    again = graph.supplement_entities(once.drop("created"), new)
    assert {r["name"]: r["summary"] for r in again.collect()} == texts
    twice = graph.supplement_entities(once.drop("created"), new, repeat=True)
    assert {r["name"]: r["summary"] for r in twice.collect()}["a"].count("two") == 2


def test_deletes(spark):
    e = entities(spark)
    same = spark.createDataFrame([("d1_a", "d2_a", 9.0)], "entity_1_id string, entity_2_id string, score double")
    left = graph.delete_documents({"entities": e, "sourced_from": edges(spark), "same_as": same}, spark.createDataFrame([("d2",)], "doc_id string"))
    assert left["entities"].count() == 2 and left["sourced_from"].count() == 3 and left["same_as"].count() == 0
    kept, counts = graph.delete_entities(e, spark.createDataFrame([("d1", "a")], "doc_id string, name string"))
    assert kept.count() == 2 and rows(counts) == [("d1", 1)]


def test_groups_and_pairs(spark):
    more = [(f"x{i:02d}_{n}", f"x{i:02d}", n, "s", True) for n, size in (("ten", 10), ("eleven", 11), ("hot", 500), ("one", 1)) for i in range(size)]
    e = entities(spark, *more, ("z_b", "z", "b", "s", False))
    groups = linking.candidate_groups(e)
    assert rows(groups, "name", "n_entities") == [("a", 2), ("ten", 10)]
    pairs = linking.candidate_pairs(groups)
    assert pairs.count() == 1 + 45
    assert pairs.filter(F.col("a.entity_id") >= F.col("b.entity_id")).count() == 0
    assert linking.linking_cost(e).first()["pairs"] == 46
    assert linking.fast_links(e).count() == 46


class Judge:
    def generate(self, prompts):
        return ['so {"score": "9", "reasoning": "same"}' if "sa2" in p else "no idea" if "plain" in p else '{"score": "7.5"}' for p in prompts]


def judge():
    return Judge()


def test_model_scores(spark):
    data = [("1", "n1", [1.0, 0.0], "sa"), ("2", "n1", [1.0, 0.0], "sa2"), ("3", "n2", [1.0, 0.0], "plain"), ("4", "n2", [0.0, 1.0], "x"),
            ("5", "n3", [1.0, 0.0], "x"), ("6", "n3", [1.0, 0.0], "y"), ("7", "n4", [1.0, 0.0], "x"), ("8", "n4", None, "y")]
    e = spark.createDataFrame([(i, f"d{i}", n, s, True, v) for i, n, v, s in data], "entity_id string, doc_id string, name string, summary string, is_named_entity boolean, vector array<double>")
    got = linking.link_entities(e.drop("vector"), e.select("entity_id", "vector"), linking.ModelScorer(judge))
    # n3 has no usable score and n4 lacks a vector.
    assert rows(got, "entity_1_id", "llm_score", "llm_reasoning", "is_linked") == [("1", 9, "same", True), ("3", 0, "", False)]
    assert rows(linking.relink(got, 1.0, 0.0, 9.0), "entity_1_id", "score") == [("1", 9.0)]


def test_python_rounding(spark):
    df = spark.createDataFrame([(2.675,), (7.125,), (6.995,)], "x double")
    assert [r[0] for r in df.select(linking.python_round(F.col("x"), 2)).collect()] == [round(x, 2) for x in (2.675, 7.125, 6.995)]


def test_sweep_counts(spark):
    d = spark.createDataFrame([(10, 1.0), (5, 0.5), (0, 0.0)], "llm_score int, embedding_score double")
    got = {(r["model_weight"], r["threshold"]): r["n_links"] for r in linking.sweep(d, [0.5, 1.0], [5.0, 9.0]).collect()}
    assert got == {(0.5, 5.0): 2, (0.5, 9.0): 1, (1.0, 5.0): 2, (1.0, 9.0): 1}


def test_threshold_uses_settings(spark):
    pairs = linking.candidate_groups(entities(spark), Settings(min_docs=2, max_docs=1))
    assert pairs.count() == 0


class Counted(RuleScorer):
    """Writes down how many pairs it scores."""

    def score(self, pairs):
        seen.append(pairs.count())
        return super().score(pairs)


seen = []


def test_linking_by_change_equals_linking_anew(spark, folder):
    """Names that come to two, pass ten, shrink back, change their text or their flag; repeated batches change nothing."""
    from quiltgraph.plans.link import link, link_batch
    from quiltgraph.sources.store import Store

    def entity(doc, name, text="w x y", named=True):
        return (f"{doc}_{name}", doc, name, named, f"{text} {name}", [1.0, float(len(text))])

    def frame(made):
        return spark.createDataFrame(made, "entity_id string, doc_id string, name string, is_named_entity boolean, summary string, vector array<double>")

    batches = [
        ([], [entity(f"d{i}", "many") for i in range(10)] + [entity("d1", "one"), entity("d1", "two"), entity("d2", "two"), entity("d3", "flag"), entity("d4", "flag", named=False)]),
        ([], [entity("e1", "one"), entity("e1", "many"), entity("e2", "two", "w x z")]),
        (["d0", "d3"], [entity("f1", "flag"), entity("f2", "flag")]),
        (["d2"], [entity("d2", "two", "new words here"), entity("d4", "flag")]),
    ]
    store = Store(spark, folder)
    for number, (gone, made) in enumerate(batches, 1):
        for _ in range(2):
            if gone:
                store.delete_documents(spark.createDataFrame([(i,) for i in gone], "doc_id string"), number)
            store.put("entities", frame(made), number)
            link_batch(store, number, Counted())
            links, details = link(store.read("entities"))
            columns = ("entity_1_id", "entity_2_id", "llm_score", "final_score", "is_linked")
            assert rows(store.read("link_details"), *columns) == rows(details, *columns)
            assert rows(store.read("same_as"), "entity_1_id", "entity_2_id", "score") == rows(links, "entity_1_id", "entity_2_id", "score")
    # 45 + 1; then "one" and two of "two" while "many" goes; then 36 come back and "flag"; then what changed of "two" and "flag".
    assert seen[::2] == seen[1::2] == [46, 3, 37, 4]


def test_summaries_by_name_without_edges(spark):
    """Entities that carry their chunks are met by name alone, in every document, and no table of edges is needed."""
    held = entities(spark).join(edges(spark).groupBy("entity_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("source_chunk_ids")), "entity_id")
    named = spark.createDataFrame([("q", "a"), ("r", "a"), ("r", "zzz")], "question_id string, name string")
    got = graph.summaries_by_name(named, held, per_chunk=True)
    assert rows(got, "question_id", "doc_id", "chunk_id") == [(q, d, c) for q in "qr" for d, c in (("d1", "d1_0"), ("d1", "d1_1"), ("d2", "d2_0"))]
    assert graph.summaries_by_name(named, held).count() == 4


def test_metadata_in_order_takes_up_asked_documents_only(spark, monkeypatch):
    """Documents that no id asks for are neither cut nor summarised; the others read as among all documents."""
    from quiltgraph.plans import base, queries_graph

    data, taken = "/root/testdata/sf0.001", []
    whole = base.stored(spark, data)
    ids = whole.documents.select("doc_id").orderBy("doc_id").limit(3)
    some = base.stored(spark, data, ids.unionByName(ids).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) doc_id")))
    asked = [r[0] for r in ids.collect()]
    assert rows(some.documents) == rows(whole.documents.filter(F.col("doc_id").isin(asked)))
    assert rows(some.chunks.select("doc_id").distinct()) == [(i,) for i in asked]
    held = base.stored
    monkeypatch.setattr(base, "stored", lambda *a: taken.append(a) or held(*a))
    queries_graph.metadata_in_order(spark, data)
    assert len(taken[0]) == 3
