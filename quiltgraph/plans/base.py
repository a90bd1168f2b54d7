"""Derived tables that many queries start from, and the same steps as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.functions.sizes import cut_lineage, join_lookup
from quiltgraph.functions.text import WS
from quiltgraph.models.clients import HashingEmbedder, embed
from quiltgraph.operators.chunking import chunk_documents
from quiltgraph.operators.evidence import Knowledge
from quiltgraph.operators.extract import RuleExtractor
from quiltgraph.operators.fusion import (
    document_summaries, entity_contexts, fuse_entities, sourced_from, summarize_entities,
)
from quiltgraph.operators.linking import fast_links
from quiltgraph.sources.tables import documents, spread, table

EXTRACTOR = RuleExtractor()
EMBEDDER = HashingEmbedder()


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk_documents(documents(spark, d))


def useful(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).filter("meaningful")


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return EXTRACTOR.mentions(EXTRACTOR.annotate(useful(spark, d)))


def relations(spark: SparkSession, d: str) -> DataFrame:
    return EXTRACTOR.relations(EXTRACTOR.annotate(useful(spark, d)))


def extracted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Mentions and relations from one reading of the text, for queries that need both or read them often."""
    return EXTRACTOR.extract(chunks(spark, d))[:2]


def entities(spark: SparkSession, d: str) -> DataFrame:
    return fuse_entities(mentions(spark, d))


def summarized(spark: SparkSession, d: str) -> DataFrame:
    return summarize_entities(entity_contexts(*extracted(spark, d)))


def edges(spark: SparkSession, d: str) -> DataFrame:
    m = extracted(spark, d)[0]
    return sourced_from(m, fuse_entities(m))


def summaries(spark: SparkSession, d: str) -> DataFrame:
    text = cut_lineage(chunks(spark, d))
    m, r = EXTRACTOR.extract(text)[:2]
    return document_summaries(documents(spark, d), text, m, summarize_entities(entity_contexts(m, r)))


def questions(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark")
    return items.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def embedded_questions(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).withColumn("vector", embed(F.col("question"), EMBEDDER))


def stored(spark: SparkSession, d: str, ids: DataFrame | None = None) -> Knowledge:
    """Knowledge tables without vectors; chunks, extraction and entity summaries are written once.

    With ``ids`` (doc_id) only these documents are taken up; what is known of a document comes from its own text.
    """
    docs = documents(spark, d)
    if ids is not None:
        asked = cut_lineage(ids.select("doc_id").filter("doc_id is not null").distinct())
        docs = cut_lineage(join_lookup(docs, asked, ["doc_id"], how="left_semi"))
        docs = spread(docs, "doc_id")
    text = cut_lineage(chunk_documents(docs))
    m, r = EXTRACTOR.extract(text)[:2]
    told = cut_lineage(summarize_entities(entity_contexts(m, r)))
    return Knowledge(
        documents=document_summaries(docs, text, m, told),
        chunks=text,
        entities=told,
        sourced_from=sourced_from(m, told),
        same_as=fast_links(told),
    )


def knowledge(spark: SparkSession, d: str, links: bool = True) -> Knowledge:
    """Knowledge tables with vectors. Every document has its vector made once, as routing compares all of them.

    Vectors of chunks and entities are columns yet to be made: what reads them first keeps the documents or entities it
    needs, and only for these are texts sent to the embedder. Edges are made by those who read them; links are written for
    several turns, and ``links=False`` leaves them to a query that reads them once or not at all.
    """
    know = stored(spark, d)
    chunk_vectors = lambda rows: rows.withColumn("vector", embed(F.col("content"), EMBEDDER))
    entity_vectors = lambda rows: rows.withColumn("vector", embed(F.col("summary"), EMBEDDER))
    return Knowledge(
        documents=cut_lineage(know.documents.withColumn("vector", embed(F.col("summary"), EMBEDDER))),
        chunks=chunk_vectors(know.chunks),
        entities=entity_vectors(know.entities),
        sourced_from=know.sourced_from,
        same_as=cut_lineage(know.same_as) if links else know.same_as,
        embed_chunks=chunk_vectors,
        embed_entities=entity_vectors,
    )


# SQL side. Each constant is a list of common table expressions without "WITH".

TRIM = "regexp_replace(regexp_replace({0}, '^" + WS + "+', ''), '" + WS + "+$', '')"
WORDS = "list_filter(regexp_split_to_array({0}, '" + WS + "+'), lambda x: x <> '')"


def trim(x: str) -> str:
    return TRIM.replace("{0}", x)


def words(x: str) -> str:
    return WORDS.replace("{0}", x)


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


SQL_CHUNKS = rf"""
chunk_src AS (SELECT doc_id, text, {words('text')} AS toks FROM documents),
chunk_win AS (
  SELECT doc_id, text, toks, unnest(range(0, len(toks), 480)) AS s FROM chunk_src WHERE len(toks) > 512
  UNION ALL SELECT doc_id, text, toks, 0 FROM chunk_src WHERE len(toks) BETWEEN 1 AND 512),
chunk_raw AS (
  SELECT doc_id, (s // 480)::INT AS idx,
    CASE WHEN len(toks) > 512 THEN len(toks[s+1:s+512]) ELSE len(toks) END AS tokens,
    CASE WHEN len(toks) > 512 THEN array_to_string(toks[s+1:s+512], ' ') ELSE {trim('text')} END AS content
  FROM chunk_win),
chunk_ord AS (
  SELECT *, lead(tokens) OVER w AS nt, lead(content) OVER w AS nc, count(*) OVER (PARTITION BY doc_id) AS n
  FROM chunk_raw WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
chunk_join AS (
  SELECT doc_id, idx, tokens, idx = n - 2 AND nt < 300 AS joined,
    CASE WHEN idx = n - 2 AND nt < 300 THEN content || '\n\n' || nc ELSE content END AS content
  FROM chunk_ord WHERE NOT (n > 1 AND idx = n - 1 AND tokens < 300)),
chunks AS (
  SELECT doc_id || '_' || idx AS chunk_id, doc_id, idx AS chunk_order_index,
    CASE WHEN joined THEN len({words('content')}) ELSE tokens END::INT AS tokens, content,
    (CASE WHEN joined THEN len({words('content')}) ELSE tokens END) > 10 AS meaningful
  FROM chunk_join)
"""

SQL_MENTIONS = r"""
chunk_tok AS (
  SELECT doc_id, chunk_id, chunk_order_index, regexp_split_to_array(content, '[^A-Za-z0-9]+') AS t FROM chunks WHERE meaningful),
chunk_pos AS (SELECT *, unnest(range(1, len(t) + 1)) AS p FROM chunk_tok),
hits AS (SELECT * FROM chunk_pos WHERE regexp_matches(t[p], '^[A-Z][a-z]{3,}$')),
mentions AS (
  SELECT doc_id, chunk_id, chunk_order_index, (p - 1)::INT AS position, lower(t[p]) AS name,
    trim(array_to_string(t[p:p+2], ' ')) AS description, p > 1 AS is_named_entity,
    chunk_order_index::BIGINT * 4294967296 + p - 1 AS seen
  FROM hits)
"""

SQL_RELATIONS = r"""
hit_pairs AS (
  SELECT *, lead(p) OVER w AS np, lead(t[p]) OVER w AS nname, row_number() OVER w - 1 AS rn
  FROM hits WINDOW w AS (PARTITION BY chunk_id ORDER BY p)),
relations AS (
  SELECT doc_id, chunk_id, chunk_order_index, rn::INT AS position, lower(t[p]) AS source, lower(nname) AS target,
    array_to_string(t[p:np], ' ') AS description, (1 + (length(t[p]) + length(nname)) % 10)::DOUBLE AS strength,
    [lower(t[p][1:4]), lower(nname[1:4])] AS keywords, chunk_order_index::BIGINT * 4294967296 + rn AS seen
  FROM hit_pairs WHERE np IS NOT NULL)
"""

SQL_ENTITIES = """
entities AS (
  SELECT doc_id || '_' || name AS entity_id, doc_id, name, bool_and(is_named_entity) AS is_named_entity,
    count(*) AS n_mentions, min(seen) AS first_seen
  FROM mentions GROUP BY doc_id, name HAVING bool_or(is_named_entity))
"""

SQL_CONTEXTS = f"""
edge_text AS (
  SELECT doc_id, source, target, min(seen) AS seen, string_agg(description, ' | ' ORDER BY seen) AS text
  FROM relations GROUP BY doc_id, source, target),
context_lines AS (
  SELECT doc_id, name, 0 AS kind, seen, description AS line FROM mentions
  UNION ALL SELECT doc_id, source, 1, seen, source || ' -> ' || target || ': ' || text FROM edge_text
  UNION ALL SELECT doc_id, target, 2, seen, source || ' -> ' || target || ': ' || text FROM edge_text),
contexts AS (
  SELECT doc_id, name, string_agg(line, chr(10) ORDER BY seen) FILTER (kind = 0) AS d,
    string_agg(line, chr(10) ORDER BY kind, seen) FILTER (kind > 0) AS r
  FROM context_lines GROUP BY doc_id, name),
context_text AS (
  SELECT e.*, c.d || coalesce(chr(10) || chr(10) || '关系:' || chr(10) || c.r, '') AS context
  FROM entities e JOIN contexts c USING (doc_id, name)),
summarized AS (
  SELECT * EXCLUDE (context), CASE WHEN len({words('context')}) <= 300 THEN context
    ELSE 'Context of ' || len({words('context')}) || ' words, digest ' || md5(context) END AS summary
  FROM context_text)
"""

SQL_SUMMARIES = f"""
entry_sizes AS (
  SELECT doc_id, name, first_seen, len({words("'- ' || name || ': ' || summary")}) AS tokens FROM summarized WHERE is_named_entity),
entry_used AS (
  SELECT *, sum(tokens) OVER (PARTITION BY doc_id ORDER BY first_seen ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM entry_sizes),
entry_lists AS (
  SELECT doc_id, count(*) AS n, string_agg(name, ', ' ORDER BY first_seen) AS names FROM entry_used WHERE used <= 20000 GROUP BY doc_id),
chunk_stats AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (meaningful) AS n_useful FROM chunks GROUP BY doc_id),
mention_stats AS (SELECT doc_id, count(*) AS n_mentions FROM mentions GROUP BY doc_id),
summary_state AS (
  SELECT x.doc_id, n, names, n_chunks, n_useful, n_mentions FROM documents x LEFT JOIN chunk_stats USING (doc_id)
  LEFT JOIN mention_stats USING (doc_id) LEFT JOIN entry_lists USING (doc_id)),
summary_text AS (
  SELECT doc_id, 'Document about ' || n || ' named entities: ' || names AS long_text,
    CASE WHEN n_chunks IS NULL THEN 'Document is empty or could not be chunked.'
      WHEN n_useful = 0 THEN 'Document contains no meaningful chunks after filtering.'
      WHEN n_mentions IS NULL THEN 'No entities were extracted from the document.'
      WHEN n IS NULL THEN 'No named entities found to generate a summary.' END AS fixed
  FROM summary_state),
summaries AS (
  SELECT doc_id, coalesce(fixed, long_text) AS summary, fixed IS NOT NULL AS placeholder FROM summary_text)
"""

SQL_EDGES = """
edges AS (
  SELECT DISTINCT m.doc_id || '_' || m.name AS entity_id, m.chunk_id, m.doc_id, m.name
  FROM mentions m SEMI JOIN entities e ON m.doc_id = e.doc_id AND m.name = e.name)
"""

SQL_QUESTIONS = """
q_names AS (
  SELECT DISTINCT question_id, lower(x) AS name FROM (
    SELECT item_id AS question_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9]+')) AS x FROM benchmark)
  WHERE regexp_matches(x, '^[A-Z][a-z]{3,}$'))
"""

SQL_GROUPS = """
candidate_groups AS (
  SELECT name, count(*) AS n_entities FROM entities WHERE is_named_entity GROUP BY name HAVING count(*) BETWEEN 2 AND 10),
candidates AS (SELECT e.* FROM entities e JOIN candidate_groups g USING (name) WHERE e.is_named_entity),
candidate_pairs AS (
  SELECT a.name, a.entity_id AS id_a, b.entity_id AS id_b, a.doc_id AS doc_a, b.doc_id AS doc_b
  FROM candidates a JOIN candidates b ON a.name = b.name AND a.entity_id < b.entity_id)
"""


def sql_vectors(name: str, source: str, key: str, text: str) -> str:
    """Hashed word counts of a text: ``name`` is (key, slot, v) and ``name_norm`` is (key, nn)."""
    return f"""
{name}_word AS (SELECT {key}, unnest({words(text)}) AS w FROM {source}),
{name}_hash AS (SELECT {key}, md5(w) AS h FROM {name}_word),
{name} AS (
  SELECT {key}, ('0x' || h[1:4])::INT % 64 AS slot, sum(CASE WHEN h[5] < '8' THEN 1 ELSE -1 END)::DOUBLE AS v
  FROM {name}_hash GROUP BY ALL),
{name}_norm AS (SELECT {key}, sum(v * v) AS nn FROM {name} GROUP BY {key})
"""


def sql_distances(name: str, a: str, a_key: str, b: str, b_key: str) -> str:
    """Squared distance of unit vectors for every pair, zero vectors at 2."""
    return f"""
{name}_dot AS (SELECT {a_key}, {b_key}, sum(x.v * y.v) AS d FROM {a} x JOIN {b} y USING (slot) GROUP BY ALL),
{name} AS (
  SELECT p.{a_key}, q.{b_key},
    round(2.0 - 2.0 * CASE WHEN p.nn * q.nn > 0 THEN coalesce(d, 0) / sqrt(p.nn * q.nn) ELSE 0 END, 6) AS distance
  FROM {a}_norm p CROSS JOIN {b}_norm q LEFT JOIN {name}_dot z ON z.{a_key} = p.{a_key} AND z.{b_key} = q.{b_key})
"""
