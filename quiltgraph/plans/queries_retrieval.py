"""Vector search, routing, evidence and answering queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quiltgraph.functions.sizes import cut_lineage, join_lookup
from quiltgraph.functions.vectors import squared_norm, unit
from quiltgraph.operators import evidence, nearest
from quiltgraph.operators.cells import build_cells, search_cells
from quiltgraph.operators.postings import build_postings, search_postings
from quiltgraph.operators.reasoning import RuleReasoner
from quiltgraph.plans import base
from quiltgraph.plans.answer import answer
from quiltgraph.plans.base import (
    EMBEDDER, SQL_CHUNKS, SQL_CONTEXTS, SQL_EDGES, SQL_ENTITIES, SQL_GROUPS, SQL_MENTIONS, SQL_QUESTIONS, SQL_RELATIONS,
    SQL_SUMMARIES, sql_distances, sql_vectors, with_,
)
from quiltgraph.plans.registry import query
from quiltgraph.sources.tables import documents, table
from quiltgraph.models.clients import embed

RULES = RuleReasoner()
DOC = (SQL_CHUNKS, SQL_MENTIONS, SQL_RELATIONS, SQL_ENTITIES, SQL_CONTEXTS, SQL_SUMMARIES)
QV = sql_vectors("qv", "(SELECT item_id AS question_id, text FROM benchmark)", "question_id", "text")
ROUTE = (
    *DOC, SQL_QUESTIONS, QV,
    sql_vectors("sv", "(SELECT * FROM summaries WHERE NOT placeholder)", "doc_id", "summary"),
    sql_distances("sd", "qv", "question_id", "sv", "doc_id"),
    """
graph_count AS (SELECT question_id, doc_id, count(*) AS score FROM q_names JOIN entities USING (name) GROUP BY ALL),
recalls AS (
  SELECT question_id, doc_id, 0 AS list_no, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM graph_count
  UNION ALL SELECT question_id, doc_id, 1, row_number() OVER (PARTITION BY question_id ORDER BY distance, doc_id) FROM sd),
fused_recalls AS (
  SELECT question_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list_no * 4294967296 + rank) AS place
  FROM recalls WHERE rank <= 10 GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, place, doc_id)::INT AS rank FROM fused_recalls),
routed AS (SELECT * FROM placed WHERE rank <= 5)
""")


def _route(spark, d):
    know = base.knowledge(spark, d, links=False)
    asked = base.embedded_questions(spark, d)
    names = RULES.names(asked)
    return cut_lineage(evidence.route(asked, names, know)), asked, names, know


@query("vector_norms", """
SELECT vec_id, len(embedding)::INT AS dim, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS norm2,
  1.0::DOUBLE AS unit_norm2, label FROM embeddings""")
def vector_norms(spark, d):
    v = table(spark, d, "embeddings")
    return v.select(
        "vec_id", F.size("embedding").alias("dim"), F.round(squared_norm(F.col("embedding")), 6).alias("norm2"),
        F.round(squared_norm(unit(F.col("embedding"))), 6).alias("unit_norm2"), "label",
    )


@query("vector_recall_topk", """
WITH d AS (
  SELECT b.item_id AS question_id, v.vec_id AS doc_id,
    round(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) + list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])
      - 2 * list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS distance
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings v),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, doc_id)::INT AS rank FROM d)
SELECT question_id, doc_id, abs(distance) AS distance, rank FROM r WHERE rank <= 10""")
def vector_recall_topk(spark, d):
    """Every question against every stored vector by squared distance."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = base.questions(spark, d).join(v.withColumnRenamed("doc_id", "question_id"), "question_id")
    return nearest.nearest(q, v, "question_id", "doc_id", 10)


@query("summary_recall_topk", with_(*DOC, QV, sql_vectors("sv", "(SELECT * FROM summaries WHERE NOT placeholder)", "doc_id", "summary"),
                                    sql_distances("sd", "qv", "question_id", "sv", "doc_id")) + """
, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, doc_id)::INT AS rank FROM sd)
SELECT question_id, doc_id, distance, rank FROM r WHERE rank <= 10""")
def summary_recall_topk(spark, d):
    s = base.summaries(spark, d).filter(~F.col("placeholder")).withColumn("vector", embed(F.col("summary"), EMBEDDER))
    return nearest.nearest(base.embedded_questions(spark, d), s, "question_id", "doc_id", 10, "unit_l2")


@query("entity_recall_topk", with_(*DOC[:5], QV, sql_vectors("ev", "summarized", "entity_id", "summary"),
                                   sql_distances("ed", "qv", "question_id", "ev", "entity_id")) + """
, r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, entity_id)::INT AS rank FROM ed)
SELECT question_id, entity_id, distance, rank FROM r WHERE rank <= 10""")
def entity_recall_topk(spark, d):
    """Nearest entity summaries of every question, through stored cells: exact, but not every cell is read."""
    e = base.summarized(spark, d).withColumn("vector", embed(F.col("summary"), EMBEDDER))
    best, _ = search_cells(base.embedded_questions(spark, d), build_cells(e, "entity_id", "unit_l2"), "question_id", "entity_id", 10)
    return best


@query("sparse_recall_topk", f"""
WITH t AS (SELECT doc_id, unnest({base.words('lower(text)')}) AS term FROM documents),
q AS (SELECT question_id, term, count(*) AS w FROM (SELECT item_id AS question_id, unnest({base.words('lower(text)')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT question_id, doc_id, sum(w)::BIGINT AS score FROM t JOIN q USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id)::INT AS rank FROM s)
SELECT question_id, doc_id, score, rank FROM r WHERE rank <= 10""")
def sparse_recall_topk(spark, d):
    """Inner product of word-count vectors."""
    return nearest.sparse_nearest(_question_terms(spark, d), documents(spark, d), "question_id", "doc_id", 10)


@query("rare_term_topk", f"""
WITH t AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({base.words('lower(text)')}) AS term FROM documents) GROUP BY ALL),
df AS (SELECT term, (SELECT count(*) FROM documents) // count(*) AS w FROM t GROUP BY term),
q AS (SELECT question_id, term, count(*) AS m FROM (SELECT item_id AS question_id, unnest({base.words('lower(text)')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT question_id, doc_id, sum(m * w * n)::BIGINT AS score FROM q JOIN df USING (term) JOIN t USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id)::INT AS rank FROM s)
SELECT question_id, doc_id, score, rank FROM r WHERE rank <= 10""")
def rare_term_topk(spark, d):
    """Word counts weighed by rarity, through stored postings with upper bounds: texts that cannot win are not scored."""
    docs = documents(spark, d)
    stored, n = build_postings(docs, "doc_id"), docs.count()
    weighed = join_lookup(_question_terms(spark, d), stored.terms, ["term"]).select(
        "question_id", "term", (F.col("weight") * F.expr(f"{n} div df")).alias("weight"))
    best, _ = search_postings(weighed, stored, "question_id", 10)
    return best.select("question_id", F.col("item").alias("doc_id"), "score", "rank")


def _question_terms(spark, d):
    q = nearest.terms(base.questions(spark, d), "question_id", "question")
    return q.groupBy("question_id", "term").agg(F.count("*").alias("weight"))


@query("hybrid_search", with_(QV, sql_vectors("tv", "documents", "doc_id", "text"), sql_distances("td", "qv", "question_id", "tv", "doc_id"), f"""
t AS (SELECT doc_id, unnest({base.words('lower(text)')}) AS term FROM documents),
q AS (SELECT question_id, term, count(*) AS w FROM (SELECT item_id AS question_id, unnest({base.words('lower(text)')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT question_id, doc_id, sum(w)::BIGINT AS score FROM t JOIN q USING (term) GROUP BY ALL),
recalls AS (
  SELECT question_id, doc_id, 0 AS list_no, row_number() OVER (PARTITION BY question_id ORDER BY distance, doc_id) AS rank FROM td
  UNION ALL SELECT question_id, doc_id, 1, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) FROM s),
f AS (
  SELECT question_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list_no * 4294967296 + rank) AS place
  FROM recalls WHERE rank <= 10 GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 12) DESC, place, doc_id)::INT AS rank FROM f)
""") + """
SELECT question_id, p.doc_id, round(score, 9) AS rerank_score, rank, lang, source, n_chars FROM p JOIN documents d ON d.doc_id = p.doc_id WHERE rank <= 10""")
def hybrid_search(spark, d):
    """Dense and sparse legs over whole texts, fused, rows fetched again with the fused score."""
    docs = documents(spark, d)
    dense = nearest.nearest(
        base.embedded_questions(spark, d), docs.withColumn("vector", embed(F.col("text"), EMBEDDER)), "question_id", "doc_id", 10, "unit_l2"
    )
    sparse = nearest.sparse_nearest(_question_terms(spark, d), docs, "question_id", "doc_id", 10)
    lists = dense.select("question_id", "doc_id", F.lit(0).alias("list_no"), "rank").unionByName(
        sparse.select("question_id", "doc_id", F.lit(1).alias("list_no"), "rank")
    )
    fused = evidence.fuse_rankings(lists, "question_id", "doc_id", keep=10)
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return rows.join(fused, "doc_id").select(
        "question_id", "doc_id", F.round("score", 9).alias("rerank_score"), "rank", "lang", "source", "n_chars"
    )


@query("rrf_route", with_(*ROUTE) + "SELECT question_id, doc_id, round(score, 9) AS score, rank FROM routed")
def rrf_route(spark, d):
    """Best five documents of every question, by names in the graph and by summary vectors."""
    know = base.knowledge(spark, d, links=False)
    asked = base.embedded_questions(spark, d)
    routed = evidence.route(asked, RULES.names(asked), know)
    return routed.select("question_id", "doc_id", F.round("score", 9).alias("score"), "rank")


PLAN = (*ROUTE, SQL_EDGES, SQL_GROUPS, """
shared AS (
  SELECT r.question_id, r.doc_id, e.name FROM routed r JOIN q_names n USING (question_id) JOIN entities e ON e.doc_id = r.doc_id AND e.name = n.name)
""")
DOC_ENTITIES = """
doc_names AS (SELECT doc_id, string_agg(DISTINCT name, '|' ORDER BY name) AS names FROM edges GROUP BY doc_id)
"""


@query("planning_context", with_(*PLAN, DOC_ENTITIES) + """
SELECT question_id, string_agg('- Document ID: ' || r.doc_id || chr(10) || '  Summary: ' || summary || chr(10) || '  Entities: ['
  || coalesce('''' || replace(names, '|', ''', ''') || '''', '') || ']', chr(10) || chr(10) ORDER BY rank) AS context
FROM routed r JOIN summaries USING (doc_id) LEFT JOIN doc_names USING (doc_id) WHERE summary <> '' GROUP BY question_id""")
def planning_context(spark, d):
    routed, _, _, know = _route(spark, d)
    return evidence.planning_context(routed, know)


@query("retrieval_plan", with_(*PLAN) + """
SELECT r.question_id, r.doc_id, r.rank AS position, CASE WHEN r.rank <= 2 THEN 'main' ELSE 'assist' END AS role,
  coalesce(string_agg(s.name, ',' ORDER BY s.name), '') AS names
FROM routed r LEFT JOIN shared s ON s.question_id = r.question_id AND s.doc_id = r.doc_id GROUP BY r.question_id, r.doc_id, r.rank""")
def retrieval_plan(spark, d):
    routed, asked, names, know = _route(spark, d)
    return RULES.plan(asked, routed, names, know).withColumn("names", F.array_join("names", ","))


EXPANSION = (
    "linked AS (SELECT id_a AS a, id_b AS b FROM candidate_pairs UNION ALL SELECT id_b, id_a FROM candidate_pairs)",
    """
expand_pairs AS (
  SELECT DISTINCT s.question_id, s.doc_id, l.b AS linked_id FROM shared s JOIN routed r ON r.question_id = s.question_id AND r.doc_id = s.doc_id AND r.rank <= 2
  JOIN entities e ON e.doc_id = s.doc_id AND e.name = s.name JOIN linked l ON l.a = e.entity_id)
""",
    "expand_src AS (SELECT DISTINCT linked_id, summary FROM expand_pairs JOIN summarized ON entity_id = linked_id)",
    sql_vectors("xv", "expand_src", "linked_id", "summary"),
    """
expand_dot AS (SELECT question_id, linked_id, sum(x.v * y.v) AS d FROM qv x JOIN xv y USING (slot) GROUP BY ALL),
expand_score AS (
  SELECT p.question_id, p.doc_id, p.linked_id,
    round(CASE WHEN q.nn * x.nn > 0 THEN coalesce(d, 0) / sqrt(q.nn * x.nn) ELSE 0 END, 9) + 0.0 AS similarity
  FROM expand_pairs p JOIN qv_norm q USING (question_id) JOIN xv_norm x USING (linked_id)
  LEFT JOIN expand_dot z ON z.question_id = p.question_id AND z.linked_id = p.linked_id),
expanded AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY similarity DESC, linked_id)::INT AS rank FROM expand_score)
  WHERE rank <= 5)
""")


@query("same_as_expand", with_(*PLAN, *EXPANSION) + "SELECT question_id, doc_id, linked_id, similarity, rank FROM expanded")
def same_as_expand(spark, d):
    """Linked entities of the names selected in main documents, nearest to the question."""
    routed, asked, names, know = _route(spark, d)
    plan = RULES.plan(asked, routed, names, know)
    selected = RULES.select(asked, plan.filter("role = 'main'"), names, know)
    found = evidence.expand(selected, asked, know)
    return found.select("question_id", "doc_id", "linked_id", (F.col("similarity") + 0.0).alias("similarity"), "rank")


BEST_CHUNKS = (
    "chunk_src2 AS (SELECT chunk_id, content FROM chunks WHERE doc_id IN (SELECT doc_id FROM routed))",
    sql_vectors("cv", "chunk_src2", "chunk_id", "content"),
    """
chunk_dot AS (SELECT question_id, chunk_id, sum(x.v * y.v) AS d FROM qv x JOIN cv y USING (slot) GROUP BY ALL),
chunk_score AS (
  SELECT r.question_id, r.doc_id, c.chunk_id, c.content, r.rank AS doc_rank,
    round(2.0 - 2.0 * CASE WHEN q.nn * v.nn > 0 THEN coalesce(d, 0) / sqrt(q.nn * v.nn) ELSE 0 END, 6) AS distance
  FROM routed r JOIN chunks c USING (doc_id) JOIN qv_norm q USING (question_id) JOIN cv_norm v USING (chunk_id)
  LEFT JOIN chunk_dot z ON z.question_id = r.question_id AND z.chunk_id = c.chunk_id),
best_chunks AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY distance, chunk_id)::INT AS rank FROM chunk_score) WHERE rank <= 2)
""")


@query("chunk_topk_per_doc", with_(*PLAN, *BEST_CHUNKS) + "SELECT question_id, doc_id, chunk_id, distance, rank FROM best_chunks")
def chunk_topk_per_doc(spark, d):
    """Two nearest chunks inside each routed document."""
    routed, asked, _, know = _route(spark, d)
    return evidence.best_chunks(routed, asked, know.chunks, 2, know.embed_chunks).select("question_id", "doc_id", "chunk_id", "distance", "rank")


@query("chunk_limit_sweep", with_(*PLAN, *BEST_CHUNKS) + """
, r AS (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY distance, chunk_id) AS rank FROM chunk_score)
SELECT l AS chunk_limit, count(*) AS n_chunks, round(avg(distance), 6) AS mean_distance
FROM r JOIN (SELECT unnest([1, 2, 3, 4]) AS l) ON rank <= l GROUP BY l""")
def chunk_limit_sweep(spark, d):
    """Evidence chunks per limit of chunks and document, all limits in one pass."""
    routed, asked, _, know = _route(spark, d)
    best = evidence.best_chunks(routed, asked, know.chunks, 4, know.embed_chunks)
    limits = F.explode(F.sequence(F.col("rank"), F.lit(4))).alias("chunk_limit")
    return best.select("distance", limits).groupBy("chunk_limit").agg(
        F.count("*").alias("n_chunks"), F.round(F.avg("distance"), 6).alias("mean_distance")
    )


@query("expansion_sweep", with_(*PLAN, *EXPANSION) + """
, r AS (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id ORDER BY similarity DESC, linked_id) AS rank FROM expand_score)
SELECT l AS expansion_limit, count(*) AS n_entities, count(DISTINCT linked_id) AS n_distinct
FROM r JOIN (SELECT unnest([2, 4, 5, 6]) AS l) ON rank <= l GROUP BY l""")
def expansion_sweep(spark, d):
    """Linked entities per expansion limit, all limits in one pass."""
    from quiltgraph.config import Settings

    routed, asked, names, know = _route(spark, d)
    plan = RULES.plan(asked, routed, names, know)
    selected = RULES.select(asked, plan.filter("role = 'main'"), names, know)
    best = evidence.expand(selected, asked, know, Settings(expansion_limit=6))
    limits = F.explode(F.filter(F.array(*[F.lit(x) for x in (2, 4, 5, 6)]), lambda x: x >= F.col("rank"))).alias("expansion_limit")
    return best.select("linked_id", limits).groupBy("expansion_limit").agg(
        F.count("*").alias("n_entities"), F.countDistinct("linked_id").alias("n_distinct")
    )


EVIDENCE = (*PLAN, *EXPANSION, *BEST_CHUNKS, """
own_lines AS (
  SELECT s.question_id, s.doc_id, 0 AS part, e.entity_id AS key, '- ' || e.name || ': ' || e.summary AS line
  FROM shared s JOIN summarized e ON e.doc_id = s.doc_id AND e.name = s.name),
linked_lines AS (
  SELECT x.question_id, x.doc_id, 1, lpad(rank::VARCHAR, 6, '0'), '- ' || e.name || ': ' || e.summary FROM expanded x JOIN summarized e ON e.entity_id = x.linked_id),
summary_lines AS (
  SELECT question_id, doc_id, string_agg(line, chr(10) ORDER BY part, key) AS t FROM (SELECT * FROM own_lines UNION ALL SELECT * FROM linked_lines) GROUP BY ALL),
chunk_lines AS (
  SELECT question_id, doc_id, string_agg('- "' || content || '"', chr(10) ORDER BY rank) AS t FROM best_chunks b
  WHERE EXISTS (SELECT 1 FROM shared s WHERE s.question_id = b.question_id AND s.doc_id = b.doc_id) GROUP BY ALL),
main_text AS (
  SELECT r.question_id, r.doc_id, r.rank AS position, 'Source: Document ' || r.doc_id
    || coalesce(chr(10) || 'Relevant Entity Summaries:' || chr(10) || s.t, '') || coalesce(chr(10) || 'Relevant Document Chunks:' || chr(10) || c.t, '') AS text
  FROM routed r LEFT JOIN summary_lines s ON s.question_id = r.question_id AND s.doc_id = r.doc_id
  LEFT JOIN chunk_lines c ON c.question_id = r.question_id AND c.doc_id = r.doc_id WHERE r.rank <= 2),
assist_lines AS (
  SELECT s.question_id, s.doc_id, string_agg('- Entity: ' || e.name || chr(10) || '  Summary: ' || e.summary, chr(10) ORDER BY e.name) AS t
  FROM shared s JOIN summarized e ON e.doc_id = s.doc_id AND e.name = s.name GROUP BY ALL),
assist_text AS (
  SELECT r.question_id, r.doc_id, r.rank AS position, CASE WHEN t IS NULL THEN '' ELSE 'Source: Document ' || r.doc_id || chr(10) || t END AS text
  FROM routed r LEFT JOIN assist_lines a ON a.question_id = r.question_id AND a.doc_id = r.doc_id WHERE r.rank > 2)
""")


@query("main_evidence", with_(*EVIDENCE) + "SELECT * FROM main_text")
def main_evidence(spark, d):
    routed, asked, names, know = _route(spark, d)
    main = RULES.plan(asked, routed, names, know).filter("role = 'main'")
    return evidence.main_evidence(main, RULES.select(asked, main, names, know), asked, know)


@query("assist_evidence", with_(*EVIDENCE) + "SELECT * FROM assist_text")
def assist_evidence(spark, d):
    routed, asked, names, know = _route(spark, d)
    return evidence.assist_evidence(RULES.plan(asked, routed, names, know).filter("role = 'assist'"), know)


@query("first_turn", with_(*EVIDENCE) + """
, gathered AS (
  SELECT question_id, string_agg(text, chr(10) || chr(10) ORDER BY position) AS evidence, count(*) AS n
  FROM (SELECT * FROM main_text UNION ALL SELECT * FROM assist_text) GROUP BY question_id)
SELECT b.item_id AS question_id, CASE WHEN contains(evidence, 'Relevant Entity Summaries:' || chr(10)) THEN 'ANSWER' ELSE 'SUB_QUESTION' END AS decision,
  CASE WHEN contains(evidence, 'Relevant Entity Summaries:' || chr(10)) THEN 'Answered from evidence ' || md5(evidence)
    ELSE regexp_replace(text, '^\\S+\\s*', '') END AS content, coalesce(n, 0) || ' pieces of evidence' AS summary
FROM benchmark b LEFT JOIN gathered g ON g.question_id = b.item_id""".replace("\\\\", "\\"))
def first_turn(spark, d):
    """Decision of every question after one turn."""
    from quiltgraph.config import Settings
    from quiltgraph.plans.answer import turn

    asked = base.questions(spark, d).withColumn("history", F.lit(""))
    return turn(asked, base.knowledge(spark, d, links=False), RULES, EMBEDDER, Settings()).select("question_id", "decision", "content", "summary")


PER_TURN = (
    SQL_QUESTIONS, QV, sql_distances("sd", "qv", "question_id", "sv", "doc_id"), ROUTE[-1], PLAN[-1], *EXPANSION, *BEST_CHUNKS, EVIDENCE[-1], """
gathered AS (
  SELECT question_id, string_agg(text, chr(10) || chr(10) ORDER BY position) AS evidence, count(*) AS n
  FROM (SELECT * FROM main_text UNION ALL SELECT * FROM assist_text) GROUP BY question_id),
decided AS (
  SELECT b.item_id, b.original, b.text, b.history, b.main_docs, b.planned_docs, coalesce(contains(evidence, 'Relevant Entity Summaries:' || chr(10)), false) AS answered,
    CASE WHEN contains(evidence, 'Relevant Entity Summaries:' || chr(10)) THEN 'Answered from evidence ' || md5(evidence)
      ELSE regexp_replace(b.text, '^\\S+\\s*', '') END AS content, coalesce(n, 0) || ' pieces of evidence' AS summary
  FROM benchmark b LEFT JOIN gathered g ON g.question_id = b.item_id),
told AS (
  SELECT d.item_id, d.original, d.answered, d.content,
    CASE WHEN history = '' THEN '' ELSE history || chr(10) END || 'User Question: ' || d.text || chr(10) || 'LLM Summary: ' || summary AS history,
    list_sort(list_distinct(main_docs || coalesce(r.docs, []))) AS main_docs, list_sort(list_distinct(planned_docs || coalesce(r.docs, []))) AS planned_docs
  FROM decided d LEFT JOIN (SELECT question_id, list(DISTINCT doc_id) AS docs FROM routed GROUP BY question_id) r ON r.question_id = d.item_id)
""")
SHARED = (*DOC, SQL_EDGES, SQL_GROUPS, sql_vectors("sv", "(SELECT * FROM summaries WHERE NOT placeholder)", "doc_id", "summary"))


def sql_turns(turns: int = 3) -> str:
    """The loop unrolled: the tables of a turn are named after it, and its questions are those still open."""
    block = ",\n".join(p.strip() for p in PER_TURN)
    names = sorted(set(re.findall(r"^(\w+) AS (?:MATERIALIZED )?\(", block, re.M)), key=len, reverse=True)
    parts = ["asked_1 AS (SELECT item_id, text, text AS original, '' AS history, []::BIGINT[] AS main_docs, []::BIGINT[] AS planned_docs FROM benchmark)"]
    for k in range(1, turns + 1):
        one = re.sub(rf"\b({'|'.join(names)})\b", rf"\1_{k}", block)
        parts.append(re.sub(r"\bbenchmark\b", f"asked_{k}", one))
        parts.append(f"""asked_{k + 1} AS (
  SELECT item_id, content AS text, original, history, main_docs, planned_docs FROM told_{k} WHERE NOT answered)""")
    ended = " UNION ALL ".join(
        f"SELECT *, {k} AS turns FROM told_{k}" + (" WHERE answered" if k < turns else "") for k in range(1, turns + 1))
    return with_(*SHARED, *parts) + f"""
SELECT item_id AS question_id, original AS question, content AS answer, turns, array_to_string(main_docs, ',') AS main_documents,
  array_to_string(planned_docs, ',') AS planned_documents, history AS conversation_history FROM ({ended})"""


@query("turn_loop", sql_turns())
def turn_loop(spark, d):
    """Answers of every question after at most three turns."""
    done = answer(base.questions(spark, d), base.knowledge(spark, d))
    docs = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("main_documents", "planned_documents")]
    return done.select("question_id", "question", "answer", "turns", *docs, "conversation_history")
