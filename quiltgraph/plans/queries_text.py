"""Chunking, extraction and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiltgraph.config import Settings
from quiltgraph.functions.text import (
    file_stem, normalize_name, safe_file_name, truncate_words, unescape_html, word_count, words,
)
from quiltgraph.operators import chunking
from quiltgraph.plans import base
from quiltgraph.plans.base import SQL_CHUNKS, SQL_MENTIONS, SQL_RELATIONS, with_
from quiltgraph.plans.registry import query
from quiltgraph.sources.tables import documents, table

LINES = Settings(separator="\n")


@query("chunk_windows", rf"""
WITH t AS (SELECT doc_id, {base.words('text')} AS toks FROM documents),
w AS (SELECT doc_id, toks, unnest(range(0, len(toks), 480)) AS s FROM t)
SELECT doc_id, (s // 480)::INT AS chunk_order_index, len(toks[s+1:s+512])::INT AS tokens,
  array_to_string(toks[s+1:s+512], ' ') AS content FROM w""")
def chunk_windows(spark, d):
    return chunking.token_windows(documents(spark, d))


@query("chunk_documents", with_(SQL_CHUNKS) + "SELECT chunk_id, doc_id, chunk_order_index, tokens, content FROM chunks")
def chunk_documents(spark, d):
    return base.chunks(spark, d).drop("meaningful")


def _sql_pieces(windows: bool) -> str:
    cut = """
pw AS (
  SELECT doc_id, i, raw, toks, unnest(range(0, len(toks), 480)) AS s FROM pieces WHERE len(toks) > 512
  UNION ALL SELECT doc_id, i, raw, toks, 0 FROM pieces WHERE len(toks) <= 512),""" if windows else """
pw AS (SELECT doc_id, i, raw, toks, 0 AS s FROM pieces),"""
    big = "len(toks) > 512" if windows else "false"
    return rf"""
lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
cut AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, l FROM lines),
pieces AS (SELECT doc_id, i, l[i] AS raw, {base.words('l[i]')} AS toks FROM cut WHERE {base.trim('l[i]')} <> ''),{cut}
numbered AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, s) - 1 AS idx,
    CASE WHEN {big} THEN len(toks[s+1:s+512]) ELSE len(toks) END AS tokens,
    CASE WHEN {big} THEN array_to_string(toks[s+1:s+512], ' ') ELSE {base.trim('raw')} END AS content
  FROM pw),
ordered AS (
  SELECT *, lead(tokens) OVER w AS nt, lead(content) OVER w AS nc, count(*) OVER (PARTITION BY doc_id) AS n
  FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
folded AS (
  SELECT doc_id, idx, tokens, idx = n - 2 AND nt < 300 AS joined,
    CASE WHEN idx = n - 2 AND nt < 300 THEN content || '\n\n' || nc ELSE content END AS content
  FROM ordered WHERE NOT (n > 1 AND idx = n - 1 AND tokens < 300)),
sized AS (SELECT doc_id, idx, CASE WHEN joined THEN len({base.words('content')}) ELSE tokens END AS tokens, content FROM folded)
"""


@query("chunk_by_separator", with_(_sql_pieces(True)) + """
SELECT doc_id || '_' || idx AS chunk_id, doc_id, idx::INT AS chunk_order_index, tokens::INT AS tokens, content FROM sized""")
def chunk_by_separator(spark, d):
    return chunking.chunk_documents(documents(spark, d), LINES).drop("meaningful")


@query("chunk_separator_only", with_(_sql_pieces(False)) + """
SELECT doc_id || '_' || idx AS chunk_id, doc_id, idx::INT AS chunk_order_index, tokens::INT AS tokens, content FROM sized""")
def chunk_separator_only(spark, d):
    return chunking.chunk_documents(documents(spark, d), LINES, separator_only=True, hard_truncate=False).drop("meaningful")


@query("chunk_hard_truncate", f"""
WITH t AS (SELECT doc_id, text, {base.words('text')} AS toks FROM documents WHERE {base.trim('text')} <> '')
SELECT doc_id || '_0' AS chunk_id, doc_id, 0 AS chunk_order_index, len(toks)::INT AS tokens,
  CASE WHEN len(toks) > 912 THEN array_to_string(toks[1:512], ' ') ELSE {base.trim('text')} END AS content FROM t""")
def chunk_hard_truncate(spark, d):
    """Unsplittable text: whole documents as single pieces, cut only beyond the slack."""
    return chunking.chunk_documents(documents(spark, d), separator_only=True).drop("meaningful")


@query("chunk_meaningful", with_(SQL_CHUNKS) + """
SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (meaningful) AS n_meaningful, sum(tokens)::BIGINT AS tokens
FROM chunks GROUP BY doc_id""")
def chunk_meaningful(spark, d):
    return base.chunks(spark, d).groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.sum(F.col("meaningful").cast("long")).alias("n_meaningful"), F.sum("tokens").alias("tokens")
    )


@query("chunk_size_audit", with_(SQL_CHUNKS) + """
SELECT chunk_id, doc_id, chunk_order_index, length(content)::INT AS characters FROM chunks ORDER BY characters DESC, chunk_id LIMIT 1""")
def chunk_size_audit(spark, d):
    return chunking.largest_chunk(base.chunks(spark, d))


@query("chunk_halves", with_(SQL_CHUNKS) + """
SELECT chunk_id AS parent_chunk_id, chunk_id || '_p1' AS chunk_id, content[1:(length(content) // 2)] AS content FROM chunks
UNION ALL SELECT chunk_id, chunk_id || '_p2', content[(length(content) // 2 + 1):] FROM chunks""")
def chunk_halves(spark, d):
    return chunking.halve_chunks(base.chunks(spark, d)).select("parent_chunk_id", "chunk_id", "content")


@query("chunk_hash_ids", with_(SQL_CHUNKS) + """
SELECT doc_id, 'chunk-' || md5(content) AS chunk_id, min(chunk_order_index) AS chunk_order_index,
  arg_min(tokens, chunk_order_index) AS tokens FROM chunks GROUP BY 1, 2""")
def chunk_hash_ids(spark, d):
    return chunking.content_hash_ids(base.chunks(spark, d)).drop("content")


@query("mentions", with_(SQL_CHUNKS, SQL_MENTIONS) + """
SELECT doc_id, chunk_id, chunk_order_index, position, name, description, is_named_entity FROM mentions""")
def mentions(spark, d):
    return base.mentions(spark, d)


@query("raw_relations", with_(SQL_CHUNKS, SQL_MENTIONS, SQL_RELATIONS) + """
SELECT doc_id, chunk_id, position, source, target, description, strength, array_to_string(keywords, ',') AS keywords FROM relations""")
def raw_relations(spark, d):
    r = base.relations(spark, d)
    return r.select("doc_id", "chunk_id", "position", "source", "target", "description", "strength", F.array_join("keywords", ",").alias("keywords"))


@query("normalize_names", rf"""
WITH w AS (SELECT unnest({base.words('text')}) AS word FROM documents),
c AS (SELECT word, count(*) AS n FROM w GROUP BY word),
k AS (SELECT trim(regexp_replace(regexp_replace(lower(word), '[^a-z0-9ıſ\x09-\x0D\x1C-\x20\x85\p{{Z}}-]', '', 'g'), '{base.WS}+', ' ', 'g')) AS name, n FROM c)
SELECT name, sum(n)::BIGINT AS n_words, count(*) AS n_forms FROM k WHERE name <> '' GROUP BY name""")
def normalize_names(spark, d):
    forms = documents(spark, d).select(F.explode_outer(words(F.col("text"))).alias("word")).filter("word is not null")
    counted = forms.groupBy("word").agg(F.count("*").alias("n"))
    named = counted.select(normalize_name(F.col("word")).alias("name"), "n").filter("name <> ''")
    return named.groupBy("name").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_forms"))


@query("word_counts", f"SELECT doc_id, len({base.words('text')})::INT AS n_words FROM documents")
def word_counts(spark, d):
    return documents(spark, d).select("doc_id", word_count(F.col("text")).alias("n_words"))


@query("article_filter", f"""
SELECT doc_id, len({base.words('text')})::INT AS n_words FROM documents
WHERE len({base.words('text')}) BETWEEN 100 AND 2000 AND NOT regexp_matches(doc_id::VARCHAR, '[''"]')""")
def article_filter(spark, d):
    from quiltgraph.operators.prep import article_filter as keep

    return keep(documents(spark, d), "doc_id", "text").select("doc_id", "n_words")


@query("distinct_words_in_order", f"""
WITH t AS (SELECT conv_id, turn, {base.words('text')} AS w FROM conversations),
u AS (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM t),
f AS (SELECT conv_id, turn, w[i] AS x, min(i) AS i FROM u GROUP BY ALL)
SELECT conv_id, turn, string_agg(x, ' ' ORDER BY i) AS text FROM f GROUP BY ALL""")
def distinct_words_in_order(spark, d):
    """Ordered list dedup: first occurrences stay in place."""
    t = table(spark, d, "conversations").filter(word_count(F.col("text")) > 0)
    return t.select("conv_id", "turn", F.array_join(F.array_distinct(words(F.col("text"))), " ").alias("text"))


@query("truncated_texts", f"""
WITH t AS (SELECT doc_id, text, {base.words('text')} AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) > 2048 THEN array_to_string(w[1:2048], ' ') ELSE text END AS text FROM t""")
def truncated_texts(spark, d):
    """Token truncation before embedding."""
    return documents(spark, d).select("doc_id", truncate_words(F.col("text"), 2048).alias("text"))


@query("page_names", r"""
SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$'), '^(.+)\.[^.]+$', '\1') AS stem,
  regexp_replace(replace(url, ' ', '_'), '[\\/*?:"<>|]', '', 'g') AS file_name FROM pages""")
def page_names(spark, d):
    return table(spark, d, "pages").select(
        "page_id", file_stem(F.col("url")).alias("stem"), safe_file_name(F.col("url")).alias("file_name")
    )


@query("unescaped_pages", """
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'),
  '&middot;', '·'), '&nbsp;', chr(160)), '&amp;', '&') AS html FROM pages""")
def unescaped_pages(spark, d):
    """Closed references only: titles of pages may be cut inside one (``&amp``), which stays as it is."""
    return unescape_html(table(spark, d, "pages").select("page_id", "html"), "html", closed=True)
