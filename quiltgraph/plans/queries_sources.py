"""Sources, sinks and cleaning rules over files that Spark writes from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quiltgraph.config import Settings
from quiltgraph.functions.replies import plain_json
from quiltgraph.functions.sizes import shared_folder
from quiltgraph.functions.text import ScriptTokens, name_from_file
from quiltgraph.operators import chunking, extract, fusion, prep
from quiltgraph.plans import base
from quiltgraph.plans.base import SQL_CHUNKS, SQL_CONTEXTS, SQL_ENTITIES, SQL_MENTIONS, SQL_RELATIONS, with_
from quiltgraph.plans.queries_store import new_store
from quiltgraph.plans.registry import query
from quiltgraph.sources import lines
from quiltgraph.sources.store import write_jsonl
from quiltgraph.sources.tables import documents, table


def new_path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def conversation_lines(spark, d):
    """Turns as questions with one paragraph per line of text, ampersands escaped."""
    c = table(spark, d, "conversations").withColumn("q", F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    told = F.replace("text", F.lit(","), F.lit("&#44;"))
    paragraphs = F.transform(F.split(told, "\n"), lambda t, i: F.struct(F.concat_ws("_", F.col("q"), i.cast("string")).alias("id"), t.alias("text")))
    order = F.col("conv_id") * 1_000_000 + F.col("turn")
    return c.select(order.alias("position"), F.to_json(F.struct(F.col("q").alias("id"), paragraphs.alias("paragraphs"))).alias("value"))


@query("unescaped_paragraphs", f"""
WITH c AS (SELECT conv_id || '_' || turn AS q, string_split(text, chr(10)) AS l FROM conversations ORDER BY conv_id, turn LIMIT 40),
p AS (SELECT q, l, unnest(range(1, len(l) + 1)) AS i FROM c)
SELECT q || '_' || (i - 1) AS id, {base.trim('l[i]')} AS text FROM p WHERE {base.trim('l[i]')} <> ''""")
def unescaped_paragraphs(spark, d):
    """Paragraphs of the first 40 questions, their character references resolved."""
    return lines.paragraphs_from_lines(conversation_lines(spark, d), limit=40, unescape=True)


@query("document_lines_repeated", f"""
SELECT lang AS id, {base.trim('text')} AS text FROM documents WHERE {base.trim('text')} <> ''""")
def document_lines_repeated(spark, d):
    """Documents under repeated ids; without the first-wins rule every line stays."""
    docs = table(spark, d, "documents")
    body = F.to_json(F.struct(F.col("lang").alias("id"), "text"))
    return lines.documents_from_lines(docs.select(F.col("doc_id").alias("position"), body.alias("value")), distinct=False)


@query("multihop_rows", """
SELECT 'q' || lpad(o_orderkey::VARCHAR, 9, '0') AS id, o_orderpriority AS question, o_orderstatus AS answer FROM orders ORDER BY o_orderkey LIMIT 37""")
def multihop_rows(spark, d):
    """The first 37 rows of a Parquet dataset of multi-hop questions."""
    o = table(spark, d, "orders")
    rows = o.select(
        F.concat(F.lit("q"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("id"), F.col("o_orderpriority").alias("question"),
        F.col("o_orderstatus").alias("answer"), F.lit("compare").alias("type"),
        F.struct(F.array(F.lit("t")).alias("title")).alias("supporting_facts"),
        F.struct(F.array(F.lit("t")).alias("title"), F.array(F.array(F.lit("s"))).alias("sentences")).alias("context"))
    path = new_path(spark, "multihop")
    rows.repartitionByRange("id").sortWithinPartitions("id").write.parquet(path)
    return lines.read_multihop(spark, path, limit=37).select("id", "question", "answer")


@query("processed_log", "SELECT DISTINCT lang AS doc_id FROM documents WHERE lang <> ''")
def processed_log(spark, d):
    """Distinct ids of a line log with repeated and blank lines."""
    path = new_path(spark, "log")
    value = F.when(F.col("doc_id") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.coalesce("lang", F.lit(""))))
    table(spark, d, "documents").select(value.alias("value")).write.text(path)
    return lines.read_log(spark, path)


@query("answered_ids", "SELECT item_id::VARCHAR AS id FROM benchmark WHERE item_id % 4 <> 3")
def answered_ids(spark, d):
    """Ids of an answer log that was appended to twice and holds broken lines."""
    path, items = new_path(spark, "answers"), base.questions(spark, d)
    for part in (0, 1):
        told = items.filter(F.col("question_id") % 4 == part).select(F.col("question_id").cast("string").alias("id"), F.col("question").alias("LLM_answer"))
        write_jsonl(told, path, append=True)
    cut = F.concat(F.lit('{"id": "'), F.col("question_id").cast("string"), F.lit('", "LLM'))
    items.filter("question_id % 4 = 3").select(cut.alias("value")).write.mode("append").text(path)
    items.filter("question_id % 4 = 2").select(F.to_json(F.struct(F.col("question_id").cast("string").alias("id"))).alias("value")).write.mode("append").text(path)
    return lines.read_answered(spark, path)


@query("stored_document_ids", "SELECT doc_id FROM documents ORDER BY doc_id")
def stored_document_ids(spark, d):
    """Sorted distinct ids of a stored table written in two overlapping batches."""
    store, docs = new_store(spark), documents(spark, d).select("doc_id")
    store.put("documents", docs.filter("doc_id % 3 <> 0"), 1)
    store.put("documents", docs.filter("doc_id % 2 = 0 or doc_id % 3 = 0"), 2)
    return store.ids()


RAW_NAME = """CASE p_partkey % 5 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '  ' WHEN 2 THEN upper(p_name) || ' #1!' WHEN 3 THEN p_name || '  ' || p_size ELSE '''' END"""


@query("clean_mentions", rf"""
WITH r AS (SELECT p_partkey AS doc_id, {RAW_NAME} AS raw, p_name, p_size FROM part),
n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9\s-]', '', 'g'), '\s+', ' ', 'g')) AS name, p_name, p_size FROM r
  WHERE trim(raw) <> '' AND NOT regexp_matches(trim(raw), '^[0-9]+$'))
SELECT doc_id, name, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END AS description FROM n WHERE name <> ''""")
def clean_mentions(spark, d):
    """Names that are digits, blank or signs only are dropped, the rest normalised; the fixed "no description" is blanked."""
    p, key = table(spark, d, "part"), F.col("p_partkey") % 5
    size = F.col("p_size").cast("string")
    raw = (F.when(key == 0, size).when(key == 1, "  ").when(key == 2, F.concat(F.upper("p_name"), F.lit(" #1!")))
           .when(key == 3, F.concat("p_name", F.lit("  "), size)).otherwise("'"))
    told = F.when(F.col("p_size") % 2 == 0, F.lit(" No description available in the text. ")).otherwise(F.col("p_name"))
    rows = p.select(F.col("p_partkey").alias("doc_id"), F.lit("c").alias("chunk_id"), F.lit(0).alias("chunk_order_index"), F.lit(0).alias("position"),
                    raw.alias("raw_name"), told.alias("description"), F.lit(True).alias("is_named_entity"))
    return extract.clean_mentions(rows).select("doc_id", "name", "description")


@query("clean_relations", """
SELECT c_custkey AS doc_id, lower(regexp_replace(c_name, '#', '')) AS source, lower(c_mktsegment) AS target FROM customer
WHERE c_custkey % 3 <> 0 AND c_custkey % 7 <> 0""")
def clean_relations(spark, d):
    """Relations without a target or description are dropped, both names normalised."""
    c = table(spark, d, "customer")
    rows = c.select(
        F.col("c_custkey").alias("doc_id"), F.lit("c").alias("chunk_id"), F.lit(0).alias("chunk_order_index"), F.lit(0).alias("position"),
        F.col("c_name").alias("source"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("target"),
        F.when(F.col("c_custkey") % 7 == 0, "").otherwise("told").alias("description"), F.lit(1.0).alias("strength"), F.array(F.lit("k")).alias("keywords"))
    return extract.clean_relations(rows).select("doc_id", "source", "target")


@query("plain_json_replies", "SELECT event_id, event_type <> 'error' AND event_type <> 'view' AS parses FROM events")
def plain_json_replies(spark, d):
    """Replies that are JSON as they stand; fenced ones and plain text are not."""
    kind = F.col("event_type")
    reply = F.when(kind == "error", "no json {").when(kind == "view", '```json\n{"a": 1}\n```').otherwise('{"a": 1}')
    return table(spark, d, "events").select("event_id", plain_json(reply).isNotNull().alias("parses"))


@query("names_from_log_files", "SELECT p_partkey, p_name FROM part")
def names_from_log_files(spark, d):
    """Document names back from log file names."""
    files = F.concat(F.lit("log_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".jsonl"))
    return table(spark, d, "part").select("p_partkey", name_from_file(files, "log_", r"\.jsonl").alias("p_name"))


@query("entities_without_context", with_(SQL_CHUNKS, SQL_MENTIONS, SQL_RELATIONS, SQL_ENTITIES, SQL_CONTEXTS) + """
SELECT entity_id, CASE WHEN doc_id % 2 = 0 THEN '实体 ''' || name || ''' 在文档 ''' || doc_id || ''' 中被提及，但无详细上下文。' ELSE summary END AS summary FROM summarized""")
def entities_without_context(spark, d):
    """Entities of every second document lose their context and get the fixed sentence."""
    contexts = fusion.entity_contexts(*base.extracted(spark, d))
    blank = contexts.withColumn("context", F.when(F.col("doc_id") % 2 != 0, F.col("context")))
    return fusion.summarize_entities(blank).select("entity_id", "summary")


@query("successful_documents", with_(SQL_CHUNKS) + """
SELECT DISTINCT doc_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM chunks WHERE NOT meaningful)""")
def successful_documents(spark, d):
    """Documents with chunks, less those of which a chunk failed."""
    chunks = base.chunks(spark, d)
    failed = chunks.filter("not meaningful").select("doc_id")
    return prep.not_done(chunks.select("doc_id").distinct(), failed, "doc_id")


SCRIPT = Settings(chunk_tokens=200, chunk_overlap=40)


@query("chunk_script_tokens", r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(replace(text, ' ', '知'), '[\x09-\x0D\x1C-\x20]*(?:[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[^\x09-\x0D\x1C-\x20\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]+)') AS toks FROM documents),
w AS (SELECT doc_id, toks, unnest(range(0, len(toks), 160)) AS s FROM t)
SELECT doc_id, (s // 160)::INT AS chunk_order_index, len(toks[s+1:s+200])::INT AS tokens, trim(array_to_string(toks[s+1:s+200], ''), chr(9) || chr(10) || chr(13) || ' ') AS content FROM w""")
def chunk_script_tokens(spark, d):
    """Windows over texts whose spaces became characters of a script without spaces."""
    docs = documents(spark, d).select("doc_id", F.replace("text", F.lit(" "), F.lit("知")).alias("text"))
    return chunking.token_windows(docs, SCRIPT, ScriptTokens())
