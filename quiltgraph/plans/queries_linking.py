"""Entity linking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiltgraph.functions.sizes import cut_lineage
from quiltgraph.models.clients import embed
from quiltgraph.operators import graph, linking
from quiltgraph.plans import base
from quiltgraph.plans.base import SQL_CHUNKS, SQL_CONTEXTS, SQL_ENTITIES, SQL_GROUPS, SQL_MENTIONS, SQL_RELATIONS, with_
from quiltgraph.plans.link import link_batch
from quiltgraph.plans.queries_store import new_store
from quiltgraph.plans.registry import query

ENT = (SQL_CHUNKS, SQL_MENTIONS, SQL_ENTITIES, SQL_GROUPS)
SCORED = (SQL_CHUNKS, SQL_MENTIONS, SQL_RELATIONS, SQL_ENTITIES, SQL_CONTEXTS, SQL_GROUPS, """
grouped AS (SELECT s.entity_id, s.summary FROM summarized s WHERE s.entity_id IN (SELECT entity_id FROM candidates))""",
base.sql_vectors("sv", "grouped", "entity_id", "summary"), f"""
pair_words AS (
  SELECT p.*, list_distinct({base.words('a.summary')}) AS wa, list_distinct({base.words('b.summary')}) AS wb
  FROM candidate_pairs p JOIN grouped a ON a.entity_id = id_a JOIN grouped b ON b.entity_id = id_b),
pair_dots AS (
  SELECT p.id_a, p.id_b, sum(x.v * y.v) AS dot FROM candidate_pairs p JOIN sv x ON x.entity_id = p.id_a
  JOIN sv y ON y.entity_id = p.id_b AND y.slot = x.slot GROUP BY ALL),
pair_parts AS (
  SELECT name, w.id_a, w.id_b, len(list_intersect(wa, wb)) AS shared, len(list_distinct(list_concat(wa, wb))) AS total,
    CASE WHEN na.nn * nb.nn > 0 THEN coalesce(dot, 0) / sqrt(na.nn * nb.nn) ELSE 0 END AS cos
  FROM pair_words w JOIN sv_norm na ON na.entity_id = w.id_a JOIN sv_norm nb ON nb.entity_id = w.id_b
  LEFT JOIN pair_dots d ON d.id_a = w.id_a AND d.id_b = w.id_b),
details AS (SELECT *, (shared * 10 // total)::INT AS llm_score, (shared * 10 // total) * 0.7::DOUBLE + cos * 10 * 0.3::DOUBLE AS score FROM pair_parts)
""")


def details(spark, d):
    """Scored pairs; every entity carries the vector of its own summary."""
    told = cut_lineage(base.summarized(spark, d))
    return linking.link_entities(told, lambda rows: rows.withColumn("vector", embed(F.col("summary"), base.EMBEDDER)))


@query("candidate_groups", with_(*ENT) + """
SELECT g.name, g.n_entities::INT AS n_entities, string_agg(c.entity_id, ',' ORDER BY c.entity_id) AS members
FROM candidate_groups g JOIN candidates c USING (name) GROUP BY ALL""")
def candidate_groups(spark, d):
    groups = linking.candidate_groups(base.entities(spark, d))
    return groups.select("name", "n_entities", F.array_join(F.transform("members", lambda m: m["entity_id"]), ",").alias("members"))


@query("candidate_pairs", with_(*ENT) + "SELECT name, id_a AS entity_1_id, id_b AS entity_2_id FROM candidate_pairs")
def candidate_pairs(spark, d):
    pairs = linking.candidate_pairs(linking.candidate_groups(base.entities(spark, d)))
    return pairs.select("name", F.col("a.entity_id").alias("entity_1_id"), F.col("b.entity_id").alias("entity_2_id"))


@query("fast_links", with_(*ENT) + "SELECT id_a AS entity_1_id, id_b AS entity_2_id, 10.0::DOUBLE AS score FROM candidate_pairs")
def fast_links(spark, d):
    return linking.fast_links(base.entities(spark, d))


@query("name_histogram", with_(*ENT) + """
, per_name AS (SELECT name, count(*) AS doc_count FROM entities WHERE is_named_entity GROUP BY name)
SELECT doc_count, count(*) AS name_count, (doc_count * (doc_count - 1) // 2 * count(*))::BIGINT AS pair_count FROM per_name GROUP BY doc_count""")
def name_histogram(spark, d):
    return linking.name_histogram(base.entities(spark, d))


@query("linking_cost", with_(*ENT) + """
SELECT count(*) AS names, sum(n_entities * (n_entities - 1) // 2)::BIGINT AS pairs,
  round(sum(n_entities * (n_entities - 1) // 2)::DOUBLE * 2 / 60, 6) AS minutes_1,
  round(sum(n_entities * (n_entities - 1) // 2)::DOUBLE * 2 / 60 / 8, 6) AS minutes_8 FROM candidate_groups""")
def linking_cost(spark, d):
    cost = linking.linking_cost(base.entities(spark, d))
    return cost.select("names", "pairs", F.round("minutes_1", 6).alias("minutes_1"), F.round("minutes_8", 6).alias("minutes_8"))


@query("pairs_in_two_documents", with_(*ENT) + """
SELECT count(*) AS names, coalesce(sum(n_entities * (n_entities - 1) // 2), 0)::BIGINT AS pairs FROM candidate_groups WHERE n_entities = 2""")
def pairs_in_two_documents(spark, d):
    from quiltgraph.config import Settings

    return linking.linking_cost(base.entities(spark, d), Settings(min_docs=2, max_docs=2)).select("names", "pairs")


@query("link_scores", with_(*SCORED) + """
SELECT id_a AS entity_1_id, id_b AS entity_2_id, name, llm_score, shared || ' shared words' AS llm_reasoning,
  round(cos, 4) + 0.0 AS embedding_score, round(score, 6) AS final_score, score >= 7.0 AS is_linked FROM details""")
def link_scores(spark, d):
    return details(spark, d).select(
        "entity_1_id", "entity_2_id", F.col("entity_1_name").alias("name"), "llm_score", "llm_reasoning",
        (F.round("embedding_score", 4) + 0.0).alias("embedding_score"), F.round("final_score", 6).alias("final_score"), "is_linked",
    )


@query("relink", with_(*SCORED) + """
SELECT id_a AS entity_1_id, id_b AS entity_2_id, round(llm_score * 0.5::DOUBLE + round(cos, 4) * 10 * 0.5::DOUBLE, 6) AS score
FROM details WHERE llm_score * 0.5::DOUBLE + round(cos, 4) * 10 * 0.5::DOUBLE >= 4.00001""")
def relink(spark, d):
    """Links from the stored (rounded) parts under other weights and another threshold."""
    stored = details(spark, d).withColumn("embedding_score", F.round("embedding_score", 4))
    return linking.relink(stored, 0.5, 0.5, 4.00001).withColumn("score", F.round("score", 6))


MODEL_WEIGHTS = [0.4, 0.5, 0.7, 0.8, 0.9, 1.0]
THRESHOLDS = [6.5, 7.0, 7.5, 8.0, 8.5, 9.0]


@query("relink_sweep", with_(*SCORED) + f"""
, grid AS (SELECT w::DOUBLE AS w, t::DOUBLE AS t FROM (SELECT unnest({MODEL_WEIGHTS}) AS w) CROSS JOIN (SELECT unnest({THRESHOLDS}) AS t))
SELECT w AS model_weight, t AS threshold, count(*) AS n_pairs,
  count(*) FILTER (round(llm_score * w + round(cos, 4) * 10.0::DOUBLE * (1.0::DOUBLE - w), 9) >= t) AS n_links FROM details CROSS JOIN grid GROUP BY w, t""")
def relink_sweep(spark, d):
    stored = details(spark, d).withColumn("embedding_score", F.round("embedding_score", 4))
    return linking.sweep(stored, MODEL_WEIGHTS, THRESHOLDS)


@query("same_as_neighbours", with_(*ENT) + """
, both_ways AS (SELECT id_a AS a, id_b AS b FROM candidate_pairs UNION ALL SELECT id_b, id_a FROM candidate_pairs)
SELECT DISTINCT a AS source_id, b AS linked_id, y.doc_id AS linked_doc_id, y.name AS linked_name
FROM both_ways JOIN entities x ON x.entity_id = a JOIN entities y ON y.entity_id = b WHERE x.doc_id <> y.doc_id""")
def same_as_neighbours(spark, d):
    """Linked entities of every entity, in both directions, other documents only."""
    e = cut_lineage(base.entities(spark, d).withColumn("summary", F.lit("")))
    sources = e.select(F.col("entity_id").alias("source_id"), "entity_id", "doc_id")
    found = graph.linked_entities(sources, linking.fast_links(e), e)
    return found.select("source_id", "linked_id", "linked_doc_id", "linked_name")


@query("same_as_merge", with_(*SCORED) + """
, first_run AS (SELECT id_a, id_b, 10.0::DOUBLE AS score FROM candidate_pairs),
second_run AS (SELECT id_a, id_b, score FROM details WHERE score >= 7.0)
SELECT f.id_a AS entity_1_id, f.id_b AS entity_2_id, round(coalesce(s.score, f.score), 6) AS score,
  TIMESTAMP '2024-01-01 00:00:00' AS created_at, CASE WHEN s.score IS NOT NULL THEN TIMESTAMP '2024-01-02 00:00:00' END AS updated_at
FROM first_run f LEFT JOIN second_run s USING (id_a, id_b)""")
def same_as_merge(spark, d):
    """Fast links stored first, scored links merged a day later."""
    first = F.lit("2024-01-01 00:00:00").cast("timestamp")
    second = F.lit("2024-01-02 00:00:00").cast("timestamp")
    stored = linking.fast_links(base.entities(spark, d)).withColumn("created_at", first).withColumn("updated_at", F.lit(None).cast("timestamp"))
    merged = graph.merge_same_as(stored, linking.accepted_links(details(spark, d)), second)
    return merged.withColumn("score", F.round("score", 6))


@query("link_by_change", with_(SCORED[0].replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id % 5 <> 1)"), *SCORED[1:]) + """
SELECT id_a AS entity_1_id, id_b AS entity_2_id, name, llm_score, round(score, 6) AS final_score, score >= 7.0 AS is_linked FROM details""")
def link_by_change(spark, d):
    """Two thirds of the documents linked in one batch; the next adds the rest, deletes every fifth document and links by change."""
    store, told = new_store(spark), cut_lineage(base.summarized(spark, d))
    for batch, rows in ((1, told.filter("doc_id % 3 <> 0")), (2, told.filter("doc_id % 3 = 0 and doc_id % 5 <> 1"))):
        if batch == 2:
            store.delete_documents(told.select("doc_id").filter("doc_id % 5 = 1").distinct(), batch)
        store.put("entities", rows, batch)
        link_batch(store, batch, vectors=lambda rows: rows.withColumn("vector", embed(F.col("summary"), base.EMBEDDER)))
    return store.read("link_details").select(
        "entity_1_id", "entity_2_id", F.col("entity_1_name").alias("name"), "llm_score", F.round("final_score", 6).alias("final_score"), "is_linked")
