from pyspark.sql import functions as F

from quiltgraph.config import Settings
from quiltgraph.operators import fusion, merging
from conftest import rows

M = "doc_id string, chunk_id string, chunk_order_index int, position int, name string, description string, is_named_entity boolean"
R = "doc_id string, chunk_id string, chunk_order_index int, position int, source string, target string, description string, strength double, keywords array<string>"


def data(spark):
    m = spark.createDataFrame([
        ("d", "d_1", 1, 0, "rag", "second", True), ("d", "d_0", 0, 0, "rag", "first", True), ("d", "d_0", 0, 1, "mixed", "x", True),
        ("d", "d_0", 0, 2, "mixed", "", False), ("d", "d_0", 0, 3, "never", "y", False), ("d", "d_0", 0, 4, "bare", " ", True)], M)
    r = spark.createDataFrame([
        ("d", "d_0", 0, 0, "rag", "mixed", "b", None, ["k2"]), ("d", "d_1", 1, 0, "rag", "mixed", "a", 8.0, ["k1", "k2"]),
        ("d", "d_0", 0, 1, "rag", "rag", "self", 2.0, None), ("d", "d_0", 0, 2, "rag", "never", "gone", 2.0, [])], R)
    return m, r


def test_votes_and_sources(spark):
    m, _ = data(spark)
    e = fusion.fuse_entities(m)
    assert rows(e, "entity_id", "is_named_entity", "n_mentions") == [("d_bare", True, 1), ("d_mixed", False, 2), ("d_rag", True, 2)]
    ids = fusion.source_chunk_ids(fusion.sourced_from(m, e))
    assert {r["entity_id"]: r["source_chunk_ids"] for r in ids.collect()}["d_rag"] == ["d_0", "d_1"]


def test_relations(spark):
    m, r = data(spark)
    e = fusion.fuse_entities(m)
    fused = {(x["source_entity_id"], x["target_entity_id"]): x for x in fusion.final_relations(r, e).collect()}
    assert set(fused) == {("d_rag", "d_mixed"), ("d_rag", "d_rag")}
    x = fused[("d_rag", "d_mixed")]
    assert (x["description"], x["strength"], x["keywords"]) == ("a | b", 6.5, ["k1", "k2"])
    last = {(x["source_entity_id"], x["target_entity_id"]): x for x in fusion.final_relations(r, e, fused=False).collect()}
    assert (last[("d_rag", "d_mixed")]["description"], last[("d_rag", "d_mixed")]["strength"]) == ("a", 5.0)


def test_contexts_and_summaries(spark):
    m, r = data(spark)
    contexts = fusion.entity_contexts(m, r)
    plain = fusion.fuse_entities(m)
    same = ["entity_id", "is_named_entity", "n_mentions", "first_seen"]
    assert rows(contexts, *same) == rows(plain, *same)
    texts = {x["name"]: x["summary"] for x in fusion.summarize_entities(contexts).collect()}
    assert texts["rag"] == "first\nsecond\n\n关系:\nrag -> mixed: b | a\nrag -> rag: self\nrag -> never: gone\nrag -> rag: self"
    assert texts["mixed"] == "x\n\n关系:\nrag -> mixed: b | a"
    assert texts["bare"] == "实体 'bare' 在文档 'd' 中被提及，但无详细上下文。"
    short = Settings(short_context_tokens=3)
    long = {x["name"]: x["summary"] for x in fusion.summarize_entities(contexts, settings=short).collect()}
    assert long["rag"].startswith("Context of ")


class Summaries:
    def generate(self, prompts):
        return [None if "mixed" in p.split("\n")[0] else " short " for p in prompts]


def summaries():
    return Summaries()


def test_model_summaries_fall_back(spark):
    m, r = data(spark)
    got = fusion.summarize_entities(fusion.entity_contexts(m, r), fusion.ModelSummarizer(summaries), Settings(short_context_tokens=1))
    texts = {x["name"]: x["summary"] for x in got.collect()}
    assert texts["rag"] == "short" and texts["mixed"].startswith("x\n\n")


def test_document_summaries(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",), ("e",), ("d",)], "doc_id string")
    chunks = spark.createDataFrame([("b", False), ("c", True), ("d", True), ("e", True)], "doc_id string, meaningful boolean")
    m, r = data(spark)
    extra = spark.createDataFrame([("e", "e_0", 0, 0, "low", "z", False)], M)
    m = m.unionByName(extra)
    e = fusion.summarize_entities(fusion.entity_contexts(m, r))
    got = {x["doc_id"]: (x["summary"], x["placeholder"]) for x in fusion.document_summaries(docs, chunks, m, e).collect()}
    assert got["a"][0] == fusion.NO_CHUNKS and got["b"][0] == fusion.NO_MEANINGFUL_CHUNKS
    assert got["c"][0] == fusion.NO_ENTITIES and got["e"][0] == fusion.NO_NAMED_ENTITIES
    assert got["d"] == ("Document about 2 named entities: rag, bare", False)


def test_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 2, 6), ("g", 3, 1), ("h", 1, 11)], "g string, o int, n int")
    assert rows(fusion.within_budget(df, "g", "o", "n", 10), "g", "o") == [("g", 1)]


def test_fusion_is_idempotent_on_copies(spark):
    m, r = data(spark)
    once, twice = fusion.fuse_relations(r), fusion.fuse_relations(r.unionByName(r))
    keep = ["source", "target", "description", "strength"]
    assert rows(once, *keep) == rows(twice, *keep)


def test_nodes_and_edges_across_documents(spark):
    n = spark.createDataFrame([("a", "x", "t1", "s1", 2), ("a", "y", "t2", "s2", 1), ("a", "y", "t2", "s3", 5), ("b", "x", "t", "s1", 9), ("b", "y", "u", "s1", 3)],
                              "name string, entity_type string, description string, source_id string, order long")
    got = {x["name"]: x for x in merging.merge_nodes(n).collect()}
    assert (got["a"]["entity_type"], got["a"]["n_fragments"], got["a"]["n_sources"], got["a"]["description"]) == ("y", 2, 3, "t1<SEP>t2")
    assert got["b"]["entity_type"] == "y"
    e = spark.createDataFrame([("b", "a", "d1", 2.0, "k, j"), ("a", "b", "d2", 3.0, "k"), ("a", "a", "self", 9.0, "z")],
                              "source string, target string, description string, weight double, keywords string")
    x = merging.merge_edges(e).collect()
    assert len(x) == 1 and (x[0]["src_id"], x[0]["tgt_id"], x[0]["weight"], x[0]["keywords"], x[0]["description"]) == ("a", "b", 5.0, "j,k", "d1<SEP>d2")
    assert rows(merging.missing_endpoints(merging.merge_edges(e), n.filter("name = 'a'"))) == [("b", "UNKNOWN")]


def test_many_fragments_are_summarised_in_blocks(spark):
    f = spark.createDataFrame([("hot", f"t{i:03d}") for i in range(200)] + [("cold", "a"), ("cold", "b")], "name string, description string")
    seen = []

    def summarize(blocks):
        seen.append(blocks.agg(F.max(F.size(F.split("text", merging.FRAGMENT_SEP)))).first()[0])
        return blocks.withColumn("summary", F.md5("text"))

    got = {x["name"]: x["description"] for x in merging.summarize_fragments(f, summarize).collect()}
    assert got["cold"] == "a<SEP>b" and got["hot"] and max(seen) < 40 and len(seen) > 1


def test_contexts_shuffle_the_text_once(spark):
    """Mentions and relations are dealt by document once; a name that only relations hold gives no entity."""
    from pyspark.sql import functions as F

    from quiltgraph.operators.fusion import entity_contexts, summarize_entities

    m = spark.createDataFrame(
        [(1, "c", 0, 2, "ann", "Ann went", True), (1, "c", 0, 0, "ann", "", False), (1, "c", 1, 0, "bob", "Bob", True)],
        "doc_id long, chunk_id string, chunk_order_index int, position int, name string, description string, is_named_entity boolean")
    r = spark.createDataFrame(
        [(1, "c", 0, 1, "ann", "bob", "x"), (1, "c", 0, 0, "ann", "bob", "y"), (1, "c", 0, 2, "bob", "eve", "z"), (1, "c", 0, 3, "ann", "eve", "")],
        "doc_id long, chunk_id string, chunk_order_index int, position int, source string, target string, description string")
    told = entity_contexts(m, r)
    assert told._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {x["entity_id"]: (x["is_named_entity"], x["n_mentions"], x["first_seen"], x["context"]) for x in told.collect()} == {
        "1_ann": (False, 2, 0, "Ann went\n\n关系:\nann -> bob: y | x"),
        "1_bob": (True, 1, 1 << 32, "Bob\n\n关系:\nbob -> eve: z\nann -> bob: y | x")}
    short = told.select("entity_id", "doc_id", "name", "descriptions", "relation_lines", F.repeat(F.lit("w "), F.lit(300)).alias("context"))
    assert all(x["summary"] == "w " * 300 for x in summarize_entities(short).collect())


def test_contexts_of_some_names_are_whole(spark):
    """Entities of the asked names get the summaries they have among all entities, with the chunks that mention them."""
    from quiltgraph.plans import base
    from quiltgraph.operators import fusion

    data = "/root/testdata/sf0.001"
    m, r = base.extracted(spark, data)
    names = m.select("name").distinct().orderBy("name").limit(5)
    asked = [x[0] for x in names.collect()]
    kept, related = fusion.of_names(m, r, names)
    assert 0 < kept.count() < m.count() and 0 < related.count() < r.count()
    told = fusion.summarize_entities(fusion.entity_contexts(kept, related, with_chunks=True))
    whole = fusion.summarize_entities(fusion.entity_contexts(m, r)).filter(F.col("name").isin(asked))
    same = ["entity_id", "n_mentions", "is_named_entity", "first_seen", "summary"]
    assert rows(told, *same) == rows(whole, *same)
    chunks = fusion.source_chunk_ids(fusion.sourced_from(m, fusion.fuse_entities(m).filter(F.col("name").isin(asked))))
    assert rows(told, "entity_id", "source_chunk_ids") == rows(chunks, "entity_id", "source_chunk_ids")


def test_edges_meet_their_descriptions_in_place(spark, monkeypatch):
    """Weights, keywords and descriptions of an edge are joined where they are made; what is left reads one table."""
    r = spark.createDataFrame([
        ("a", "b", "x", 1.0, "k1, k2"), ("b", "a", "x", 2.0, "k2,k3"), ("a", "b", "y", 4.0, None), ("a", "c", "", 8.0, ""),
        ("a", "a", "self", 1.0, "k"), ("c", "d", "z", 0.5, " , k")], "source string, target string, description string, weight double, keywords string")
    made = merging.merge_edges(r)
    expected = [("a", "b", 7.0, 2, "k1,k2,k3", "x<SEP>y"), ("a", "c", 8.0, None, None, None), ("c", "d", 0.5, 1, "k", "z")]
    assert [tuple(x) for x in sorted(made.collect())] == expected
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    many = spark.createDataFrame([("a", "b", f"t{i % 40:02d}", 1.0, f"k{i % 3}") for i in range(120)] + [("a", "c", "x", 1.0, "k")], r.schema)
    got = {x["tgt_id"]: x for x in merging.merge_edges(many, few=3).collect()}
    assert (got["b"]["weight"], got["b"]["n_fragments"], got["b"]["keywords"]) == (120.0, 40, "k0,k1,k2") and got["b"]["description"]
    assert (got["c"]["weight"], got["c"]["n_fragments"], got["c"]["description"]) == (1.0, 1, "x")
