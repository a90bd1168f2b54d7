"""Reply parsing, question-set preparation, resume, alternative fusion and status queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiltgraph import schemas
from quiltgraph.functions import prompts
from quiltgraph.functions.replies import braces_json, lenient_json, similarity_score, strict_json
from quiltgraph.operators import merging, prep
from quiltgraph.operators.fusion import seen_at
from quiltgraph.plans import base
from quiltgraph.plans.base import SQL_CHUNKS, SQL_MENTIONS, SQL_RELATIONS, with_
from quiltgraph.plans.registry import query
from quiltgraph.sources.lines import documents_from_lines, paragraphs_from_lines, questions_from_lines
from quiltgraph.sources.tables import documents, table

# Model replies derived from the event properties: plain, fenced, cut off, in prose, nested.
SQL_REPLIES = """
replies AS (SELECT event_id, props, CASE event_type WHEN 'click' THEN props
  WHEN 'view' THEN 'Here it is: ```json' || chr(10) || props || chr(10) || '``` done'
  WHEN 'error' THEN props[1:length(props) - 1]
  WHEN 'purchase' THEN 'The answer is ' || props || ' as asked.'
  ELSE 'Nested {"outer": ' || props || '} end' END AS reply FROM events)
"""


def _replies(spark, d):
    kind, props = F.col("event_type"), F.col("props")
    reply = (
        F.when(kind == "click", props)
        .when(kind == "view", F.concat(F.lit("Here it is: ```json\n"), props, F.lit("\n``` done")))
        .when(kind == "error", F.substring(props, F.lit(1), F.length(props) - 1))
        .when(kind == "purchase", F.concat(F.lit("The answer is "), props, F.lit(" as asked.")))
        .otherwise(F.concat(F.lit('Nested {"outer": '), props, F.lit("} end")))
    )
    return table(spark, d, "events").select("event_id", "props", "event_type", "value", reply.alias("reply"))


VALID = "CASE WHEN json_valid({0}) THEN {0} END"


def _valid(x):
    return VALID.replace("{0}", x)


@query("strict_json", with_(SQL_REPLIES) + rf"""
, parts AS (SELECT event_id, reply, regexp_extract(reply, '(?is)```(?:json)?\s*(.*?)\s*```', 1) AS fenced FROM replies),
inner_text AS (SELECT *, CASE WHEN fenced <> '' THEN fenced ELSE reply END AS body FROM parts)
SELECT event_id, coalesce({_valid('reply')}, {_valid('body')}, {_valid("regexp_extract(body, '(?s)[{].*[}]')")}) AS json FROM inner_text""")
def strict_json_query(spark, d):
    return _replies(spark, d).select("event_id", strict_json(F.col("reply")).alias("json"))


@query("lenient_json", with_(SQL_REPLIES) + rf"""
, parts AS (SELECT event_id, reply, regexp_extract(reply, '(?s)```(?:json)?\s*\n([{{].*?[}}])\n\s*```', 1) AS fenced,
  regexp_extract(reply, '(?s)[{{].*[}}]') AS outermost FROM replies)
SELECT event_id, CASE WHEN fenced <> '' THEN {_valid('fenced')} ELSE {_valid('outermost')} END AS json FROM parts""")
def lenient_json_query(spark, d):
    return _replies(spark, d).select("event_id", lenient_json(F.col("reply")).alias("json"))


@query("innermost_json", with_(SQL_REPLIES) + rf"""
, parts AS (SELECT event_id, reply, regexp_extract(reply, '(?s)```(?:json)?\s*\n([{{].*?[}}])\n\s*```', 1) AS fenced,
  regexp_extract(reply, '(?s)[{{][^{{]*[}}][^{{]*$') AS tail FROM replies)
SELECT event_id, CASE WHEN fenced <> '' THEN {_valid('fenced')} ELSE {_valid("regexp_extract(tail, '(?s)[{].*[}]')")} END AS json FROM parts""")
def innermost_json_query(spark, d):
    """The reading that starts at the last opening brace."""
    return _replies(spark, d).select("event_id", lenient_json(F.col("reply"), innermost=True).alias("json"))


@query("braces_json", with_(SQL_REPLIES) + f"""
SELECT event_id, (regexp_extract(reply, '(?s)[{{].*[}}]')::JSON ->> '$.k')::BIGINT AS k
FROM replies WHERE json_valid(regexp_extract(reply, '(?s)[{{].*[}}]'))""")
def braces_json_query(spark, d):
    json = braces_json(F.col("reply"))
    rows = _replies(spark, d).select("event_id", json.alias("json")).filter("json is not null")
    return rows.select("event_id", F.get_json_object("json", "$.k").cast("bigint").alias("k"))


@query("score_coercion", """
SELECT event_id, CASE event_type WHEN 'click' THEN trunc(value)::INT WHEN 'view' THEN trunc(value)::INT WHEN 'purchase' THEN NULL ELSE 0 END AS score FROM events""")
def score_coercion(spark, d):
    """Numbers truncate, whole-number strings count, fractional strings drop the pair, null and missing are 0."""
    kind, value = F.col("event_type"), F.col("value").cast("string")
    whole = F.col("value").cast("int").cast("string")
    reply = (
        F.when(kind == "click", F.concat(F.lit('{"score": '), value, F.lit("}")))
        .when(kind == "view", F.concat(F.lit('{"score": "'), whole, F.lit('"}')))
        .when(kind == "purchase", F.concat(F.lit('{"score": "'), value, F.lit('x"}')))
        .when(kind == "error", F.lit('{"score": null}')).otherwise('{"reasoning": "none"}')
    )
    return table(spark, d, "events").select("event_id", similarity_score(reply).alias("score"))


@query("document_lines", """
SELECT doc_id::VARCHAR AS id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS text FROM documents""")
def document_lines(spark, d):
    """JSON lines with broken lines and repeats: broken ones skipped, the first of an id kept."""
    docs = documents(spark, d)
    good = docs.select((F.col("doc_id") * 2).alias("position"), F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "text")).alias("value"))
    again = docs.select((F.col("doc_id") * 2 + 1).alias("position"), F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.lit("later").alias("text"))).alias("value"))
    broken = table(spark, d, "pages").select((F.col("page_id") * 2 + 1).alias("position"), F.col("html").alias("value"))
    return documents_from_lines(good.unionByName(again).unionByName(broken))


@query("nested_paragraphs", """
WITH c AS (SELECT conv_id || '_' || turn AS q, string_split(text, chr(10)) AS l FROM conversations),
p AS (SELECT q, l, unnest(range(1, len(l) + 1)) AS i FROM c)
SELECT q || '_' || (i - 1) AS id, l[i] AS text FROM p WHERE l[i] <> ''""")
def nested_paragraphs(spark, d):
    """Questions with paragraph lists as JSON lines, exploded to documents; a paragraph without text is left out."""
    c = table(spark, d, "conversations").withColumn("q", F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    paragraphs = F.transform(F.split("text", "\n"), lambda t, i: F.struct(
        F.concat_ws("_", F.col("q"), i.cast("string")).alias("id"), F.when(t != "", t).alias("text")))
    order = F.col("conv_id") * 1_000_000 + F.col("turn")
    lines = c.select(order.alias("position"), F.to_json(F.struct(F.col("q").alias("id"), paragraphs.alias("paragraphs"))).alias("value"))
    return paragraphs_from_lines(lines)


@query("question_lines", """
WITH n AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS p FROM conversations)
SELECT CASE WHEN turn > 0 THEN conv_id || '_' || turn ELSE '2wiki_q_' || p END AS id, text AS question, role AS answer
FROM n WHERE p < 50 AND role <> 'assistant'""")
def question_lines(spark, d):
    """First 50 raw lines, then those that have every field; a missing id is made from the line number."""
    c = table(spark, d, "conversations")
    ids = F.when(F.col("turn") > 0, F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    body = F.struct(ids.alias("id"), F.col("text").alias("question"), F.when(F.col("role") != "assistant", F.col("role")).alias("answer"), F.array(F.lit("d")).alias("ids"))
    lines = c.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("position"), F.to_json(body).alias("value"))
    return questions_from_lines(lines, limit=50, id_prefix="2wiki_q_").select("id", "question", "answer")


PARTS = "avail AS (SELECT p_partkey FROM part WHERE p_size <= 45), need AS (SELECT l_orderkey, l_partkey FROM lineitem)"


def _sets(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), "o_orderpriority")
    need = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_partkey").alias("doc_id"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_size", "p_name")
    return orders, need, parts


@query("required_docs_all", with_(PARTS) + """
SELECT o_orderkey AS question_id, o_orderpriority FROM orders WHERE NOT EXISTS (
  SELECT 1 FROM need n ANTI JOIN avail a ON a.p_partkey = n.l_partkey WHERE n.l_orderkey = o_orderkey)""")
def required_docs_all(spark, d):
    """Orders all of whose parts are available; an order without parts stays."""
    orders, need, parts = _sets(spark, d)
    return prep.fully_covered(orders, need, parts.filter("p_size <= 45"), "question_id", "doc_id", empty_ok=True)


@query("required_docs_all_nonempty", with_(PARTS) + """
SELECT o_orderkey AS question_id, o_orderpriority FROM orders WHERE o_orderkey IN (
  SELECT l_orderkey FROM need LEFT JOIN avail ON p_partkey = l_partkey GROUP BY l_orderkey HAVING count(*) = count(p_partkey))""")
def required_docs_all_nonempty(spark, d):
    orders, need, parts = _sets(spark, d)
    return prep.fully_covered(orders, need, parts.filter("p_size <= 45"), "question_id", "doc_id", empty_ok=False)


@query("failed_docs_any", with_(PARTS) + """
SELECT o_orderkey AS question_id, o_orderpriority FROM orders WHERE o_orderkey NOT IN (
  SELECT l_orderkey FROM need JOIN part ON p_partkey = l_partkey WHERE p_size > 48)""")
def failed_docs_any(spark, d):
    orders, need, parts = _sets(spark, d)
    return prep.without_failed(orders, need, parts.filter("p_size > 48"), "question_id", "doc_id")


@query("required_documents", "SELECT p_partkey AS doc_id, p_size, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def required_documents(spark, d):
    _, need, parts = _sets(spark, d)
    return prep.required_documents(parts, need, "doc_id")


@query("resume_anti", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def resume_anti(spark, d):
    return prep.not_done(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("processed_union", "SELECT doc_id FROM labels UNION SELECT vec_id FROM embeddings")
def processed_union(spark, d):
    return prep.done_ids(table(spark, d, "labels").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")))


@query("stale_documents", "SELECT doc_id FROM (SELECT doc_id FROM labels UNION SELECT vec_id FROM embeddings) ANTI JOIN (SELECT item_id AS doc_id FROM benchmark) USING (doc_id)")
def stale_documents(spark, d):
    """Processed documents that the question set does not refer to."""
    done = processed_union(spark, d)
    return prep.stale_documents(done, table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id")


@query("top_questions", """
SELECT o_orderkey AS question_id, count(l_partkey) AS n_documents FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY o_orderkey ORDER BY n_documents, question_id LIMIT 150""")
def top_questions(spark, d):
    """The 150 orders with the fewest parts."""
    orders, need, _ = _sets(spark, d)
    sizes = need.groupBy("question_id").agg(F.count("*").alias("n"))
    counted = orders.join(sizes, "question_id", "left").select("question_id", F.coalesce("n", F.lit(0)).alias("n"))
    return prep.fewest_documents(counted, F.col("n"), "question_id", 150).select("question_id", "n_documents")


@query("documents_per_question", """
WITH n AS (SELECT o_orderkey, count(l_partkey) AS n_documents FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT n_documents, count(*) AS n_questions FROM n GROUP BY n_documents""")
def documents_per_question(spark, d):
    orders, need, _ = _sets(spark, d)
    sizes = need.groupBy("question_id").agg(F.count("*").alias("n"))
    counted = orders.join(sizes, "question_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return prep.documents_per_question(counted, F.col("n"))


@query("duplicate_texts", "SELECT md5(text) AS text_md5, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark, d):
    return prep.duplicates(documents(spark, d).select(F.md5("text").alias("text_md5")), ["text_md5"])


@query("distinct_titles", "SELECT DISTINCT p_name AS title FROM part JOIN lineitem ON l_partkey = p_partkey ORDER BY title")
def distinct_titles(spark, d):
    """Sorted distinct names in the lists of parts that orders hold."""
    _, need, parts = _sets(spark, d)
    named = need.join(parts, "doc_id").groupBy("question_id").agg(F.collect_list(F.struct(F.col("p_name").alias("title"))).alias("context"))
    return prep.distinct_titles(named, "context")


@query("routed_document_union", """
SELECT l_orderkey AS question_id, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS documents FROM lineitem GROUP BY l_orderkey""")
def routed_document_union(spark, d):
    """Documents of every question over its turns: lists of one turn each, united."""
    turns = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("question_id"), "l_returnflag").agg(
        F.collect_list(F.col("l_partkey").cast("string")).alias("documents"))
    return prep.united(turns, "question_id", "documents").select("question_id", F.array_join("documents", ",").alias("documents"))


@query("prompt_cache_keys", with_(SQL_CHUNKS) + "SELECT chunk_id, sha256('" + prompts.TEMPLATES["entities"].split("{{")[0].replace("'", "''") + "' || content) AS prompt_key FROM chunks")
def prompt_cache_keys(spark, d):
    """Keys of the reply cache: hash of the rendered extraction prompt."""
    return base.chunks(spark, d).select("chunk_id", F.sha2(prompts.entities(F.col("content")), 256).alias("prompt_key"))


@query("delimited_records", with_(SQL_CHUNKS, SQL_MENTIONS, SQL_RELATIONS) + """
SELECT chunk_id, 'entity' AS kind, name AS a, '' AS b, description, 1.0::DOUBLE AS weight FROM mentions
UNION ALL SELECT chunk_id, 'relationship', source, target, description, strength FROM relations""")
def delimited_records(spark, d):
    """Mentions and relations written as record replies per chunk and read back."""
    m, told = base.extracted(spark, d)
    e = m.select("chunk_id", F.concat(
        F.lit('("entity"<|>"'), "name", F.lit('"<|>"word"<|>"'), "description", F.lit('")')).alias("record"))
    r = told.select("chunk_id", F.concat(
        F.lit('("relationship"<|>"'), "source", F.lit('"<|>"'), "target", F.lit('"<|>"'), "description", F.lit('"<|>"'),
        F.array_join("keywords", ","), F.lit('"<|>'), F.col("strength").cast("string"), F.lit(")")).alias("record"))
    reply = e.unionByName(r).groupBy("chunk_id").agg(F.concat(F.array_join(F.collect_list("record"), "##"), F.lit("<|COMPLETE|>")).alias("reply"))
    entities, relations = merging.parse_records(reply, ["chunk_id"])
    return entities.select("chunk_id", F.lit("entity").alias("kind"), F.col("name").alias("a"), F.lit("").alias("b"), "description", F.lit(1.0).alias("weight")).unionByName(
        relations.select("chunk_id", F.lit("relationship").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), "description", "weight")
    )


def sql_described(fragments: str, key: str, few: int = 6, rounds: int = 12) -> str:
    """``described`` (key, description) from distinct fragments: rounds of block summaries until fewer than ``few`` are left."""
    parts = [f"f0 AS MATERIALIZED ({fragments})"]
    for k in range(rounds):
        parts.append(f"""s{k} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM f{k}),
b{k} AS (
  SELECT {key}, ('0x' || md5(description)[1:8])::BIGINT % ceil(n / {few}.0)::BIGINT AS b, string_agg(description, '<SEP>' ORDER BY description) AS text
  FROM s{k} WHERE n >= {few} GROUP BY ALL),
f{k + 1} AS MATERIALIZED (
  SELECT DISTINCT {key}, len(string_split(text, '<SEP>')) || ' fragments from ' || string_split(text, '<SEP>')[1] || ' to ' || string_split(text, '<SEP>')[-1] AS description
  FROM b{k})""")
    few_left = " UNION ALL ".join(f"SELECT * FROM s{k} WHERE n < {few}" for k in range(rounds))
    parts.append(f"described AS (SELECT {key}, string_agg(description, '<SEP>' ORDER BY description) AS description FROM ({few_left}) GROUP BY {key})")
    return ",\n".join(parts)


@query("node_merge", with_(SQL_CHUNKS, SQL_MENTIONS) + """
, m AS (SELECT name, lang AS entity_type, description, source, doc_id * 1000000000000 + seen // 4294967296 * 1000000 + seen % 4294967296 AS o FROM mentions JOIN documents USING (doc_id)),
t AS (SELECT name, entity_type, count(*) AS n, min(o) AS f FROM m GROUP BY ALL),
k AS (SELECT name, arg_max(entity_type, n * 1e18::DOUBLE - f) AS entity_type FROM t GROUP BY name),
best AS (SELECT name, entity_type FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, f) AS r FROM t) WHERE r = 1),
c AS (SELECT name, count(DISTINCT description) AS n_fragments, count(DISTINCT source) AS n_sources FROM m GROUP BY name),
""" + sql_described("SELECT DISTINCT name, description FROM m", "name") + """
SELECT name, entity_type, n_fragments, n_sources, description FROM best JOIN c USING (name) JOIN described USING (name)""")
def node_merge(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    order = F.col("doc_id") * 1_000_000_000_000 + F.col("chunk_order_index") * 1_000_000 + F.col("position")
    m = base.extracted(spark, d)[0].join(docs, "doc_id").select(
        "name", F.col("lang").alias("entity_type"), "description", F.col("source").alias("source_id"), order.alias("order")
    )
    return merging.merge_nodes(m)


SQL_EDGE_MERGE = """
pairs AS (SELECT least(source, target) AS src_id, greatest(source, target) AS tgt_id, description, strength, keywords FROM relations WHERE source <> target),
weights AS (SELECT src_id, tgt_id, sum(strength) AS weight, count(DISTINCT description) AS n_fragments FROM pairs GROUP BY ALL),
words AS (SELECT src_id, tgt_id, string_agg(DISTINCT k, ',' ORDER BY k) AS keywords FROM (SELECT src_id, tgt_id, unnest(keywords) AS k FROM pairs) GROUP BY ALL)
"""


def _edges(spark, d, few=merging.SUMMARY_AT):
    r = base.relations(spark, d).withColumn("keywords", F.array_join("keywords", ", ")).withColumnRenamed("strength", "weight")
    return merging.merge_edges(r, few=few)


@query("edge_merge", with_(SQL_CHUNKS, SQL_MENTIONS, SQL_RELATIONS, SQL_EDGE_MERGE) + ", " + sql_described(
    "SELECT DISTINCT src_id, tgt_id, description FROM pairs", "src_id, tgt_id", 3) + """
SELECT src_id, tgt_id, weight, n_fragments, keywords, description FROM weights JOIN words USING (src_id, tgt_id) JOIN described USING (src_id, tgt_id)""")
def edge_merge(spark, d):
    """Three fragments are already many here, so that edges of the tables are summarised too."""
    return _edges(spark, d, few=3)


@query("missing_endpoints", with_(SQL_CHUNKS, SQL_MENTIONS, SQL_RELATIONS, SQL_EDGE_MERGE) + """
, ends AS (SELECT src_id AS name FROM pairs UNION SELECT tgt_id FROM pairs)
SELECT name, 'UNKNOWN' AS entity_type FROM ends ANTI JOIN (SELECT DISTINCT name FROM mentions JOIN labels USING (doc_id)) USING (name)""")
def missing_endpoints(spark, d):
    """Edge names that no labelled document mentions."""
    nodes = base.mentions(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("name").distinct()
    return merging.missing_endpoints(_edges(spark, d), nodes)


@query("document_index", with_(SQL_CHUNKS, SQL_MENTIONS, SQL_RELATIONS) + """
, n AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS entity_names, count(DISTINCT name)::INT AS n_names FROM mentions GROUP BY doc_id),
p AS (SELECT doc_id, count(DISTINCT least(source, target) || ' ' || greatest(source, target))::INT AS n_pairs FROM relations WHERE source <> target GROUP BY doc_id)
SELECT doc_id, entity_names, n_names, n_pairs FROM n LEFT JOIN p USING (doc_id)""")
def document_index(spark, d):
    names, pairs = merging.document_index(*base.extracted(spark, d))
    left = names.select("doc_id", F.array_join("entity_names", ",").alias("entity_names"), F.col("count").alias("n_names"))
    return left.join(pairs.select("doc_id", F.col("count").alias("n_pairs")), "doc_id", "left")


@query("status_queue", """
SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'PENDING' WHEN toxic = 1 THEN 'FAILED' WHEN quality = 0 THEN 'PROCESSING' END AS status
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT coalesce(quality = 1 AND toxic = 0, false)""")
def status_queue(spark, d):
    """Documents to be processed next: new, failed or interrupted ones."""
    from quiltgraph.streaming.status import queue

    labels = table(spark, d, "labels")
    state = F.when(F.col("toxic") == 1, "FAILED").when(F.col("quality") == 0, "PROCESSING").otherwise("PROCESSED")
    return queue(table(spark, d, "documents").select("doc_id"), labels.select("doc_id", state.alias("status"))).select("doc_id", "status")
