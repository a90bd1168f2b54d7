from pyspark.sql import functions as F

from quiltgraph.config import Settings
from quiltgraph.functions import sizes
from quiltgraph.functions.sizes import cut_lineage, join_lookup
from quiltgraph.llm import neardup
from quiltgraph.operators import linking, merging


def _broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_a_side_too_large_to_be_broadcast_is_not_broadcast_by_the_size_of_its_files(spark):
    """Sixteen repetitions of a table that is small as a file only went through the driver."""
    big, small = cut_lineage(spark.range(1000).withColumn("x", F.col("id") * 2)), cut_lineage(spark.range(500).withColumn("y", F.col("id") * 3))
    for how, rows in (("inner", 500), ("left", 1000), ("left_semi", 500)):
        met = join_lookup(big, small, ["id"], Settings(broadcast_rows=100), how)
        assert _broadcasts(met) == 0
        assert met.count() == met.distinct().count() == rows
    assert _broadcasts(join_lookup(big, small, ["id"], Settings(broadcast_rows=500))) == 1


def _repeated_broadcasts(df):
    """How many broadcasts of the plan hold the repetition of a salted join."""
    lines, found = df._jdf.queryExecution().executedPlan().toString().splitlines(), 0
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = lines[i + 1 :]
            end = next((k for k, x in enumerate(below) if depth(x) <= depth(line)), len(below))
            found += any("Generate explode" in x for x in below[:end])
    return found


def test_near_duplicate_classes_are_not_broadcast_repeated(spark):
    texts = ["one two three four five six seven eight nine ten", "eleven twelve thirteen fourteen fifteen sixteen", "one two three four five six seven eight nine ten"]
    got = neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert _repeated_broadcasts(got) == 0
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(0, 0), (1, 1), (2, 0)]


def test_edges_with_many_fragments_are_not_broadcast_repeated(spark, monkeypatch):
    monkeypatch.setattr(sizes, "proven_small", lambda df, most: False)
    rows = [("a", "b", f"text {i}", 1.0, "k") for i in range(9)] + [("c", "d", "one", 2.0, None)]
    got = merging.merge_edges(spark.createDataFrame(rows, "source string, target string, description string, weight double, keywords string"), few=3)
    assert _repeated_broadcasts(got) == 0
    assert sorted((r["src_id"], r["weight"], r["n_fragments"]) for r in got.collect()) == [("a", 9.0, 9), ("c", 2.0, 1)]


def test_links_of_changed_names_are_not_broadcast_repeated(spark, monkeypatch):
    monkeypatch.setattr(sizes, "proven_small", lambda df, most: False)
    entities = cut_lineage(spark.createDataFrame([("1_a", 1, "a", True), ("2_a", 2, "a", True)], "entity_id string, doc_id long, name string, is_named_entity boolean"))
    vectors = lambda ids: ids.withColumn("summary", F.lit("s")).withColumn("vector", F.array(F.lit(1.0)))
    changed = cut_lineage(spark.createDataFrame([("2_a", "a"), ("3_a", "a")], "entity_id string, name string"))
    details = cut_lineage(spark.createDataFrame([("1_a", "3_a", "a")], "entity_1_id string, entity_2_id string, entity_1_name string"))
    got = linking.link_changes(entities, vectors, changed, details)
    assert _repeated_broadcasts(got.withdrawn) == 0
    assert [tuple(r) for r in got.withdrawn.collect()] == [("1_a", "3_a")]
    assert [(r["entity_1_id"], r["entity_2_id"]) for r in got.scored.collect()] == [("1_a", "2_a")]
