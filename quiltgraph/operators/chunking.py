"""Documents to chunks. One document row becomes its chunk rows without a shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltgraph.config import Settings
from quiltgraph.functions.rows import unnest
from quiltgraph.functions.text import Words, strip

DEFAULT = Settings()
WORDS = Words()


def _windows(tokens: Column, size: int, step: int, tokenizer=WORDS) -> Column:
    """Overlapping token windows; the last one may lie inside its predecessor."""
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(step))).otherwise(F.array())
    cut = F.transform(starts, lambda s: F.slice(tokens, s + 1, size))
    return F.transform(cut, lambda w: F.struct(F.size(w).alias("tokens"), tokenizer.joined(w).alias("content")))


def token_windows(docs: DataFrame, settings: Settings = DEFAULT, tokenizer=WORDS) -> DataFrame:
    """Sliding windows over whole documents: ``doc_id, chunk_order_index, tokens, content``."""
    tokens = docs.select("doc_id", tokenizer.tokens(F.col("text")).alias("_t"))
    windows = _windows(F.col("_t"), settings.chunk_tokens, settings.chunk_step, tokenizer)
    return unnest(tokens, ["doc_id"], windows, "chunk_order_index")


def _merge_tail(chunks: Column, settings: Settings, joiner: str, tokenizer=WORDS) -> Column:
    """Fold a last chunk with too few tokens into the one before it, once."""
    last, prev = F.element_at(chunks, -1), F.element_at(chunks, -2)
    joined = F.concat(prev["content"], F.lit(joiner), last["content"])
    merged = F.struct(F.size(tokenizer.tokens(joined)).alias("tokens"), joined.alias("content"))
    small = (F.size(chunks) > 1) & (F.try_element_at(chunks, F.lit(-1))["tokens"] < settings.min_tail_tokens)
    return F.when(small, F.concat(F.slice(chunks, F.lit(1), F.size(chunks) - 2), F.array(merged))).otherwise(chunks)


def chunk_documents(
    docs: DataFrame,
    settings: Settings = DEFAULT,
    separator_only: bool = False,
    hard_truncate: bool = True,
    tokenizer=WORDS,
) -> DataFrame:
    """Separator pieces, windows over oversize pieces, tail merge, ids.

    Output: ``chunk_id, doc_id, chunk_order_index, tokens, content, meaningful``.
    Every step works on arrays inside the document's own row. ``tokenizer`` says what a
    token is and how a window is joined (``Words``, ``ScriptTokens``, or the like).
    """
    size, step = settings.chunk_tokens, settings.chunk_step
    if settings.separator:
        raw = F.split("text", re.escape(settings.separator))
        raw = F.filter(raw, lambda p: strip(p) != "")
        pieces = F.transform(raw, lambda p: F.struct(p.alias("raw"), tokenizer.tokens(p).alias("toks")))
    else:
        pieces = F.array(F.struct(F.col("text").alias("raw"), tokenizer.tokens(F.col("text")).alias("toks")))

    def expand(p):
        whole = F.array(F.struct(F.size(p["toks"]).alias("tokens"), strip(p["raw"]).alias("content")))
        if separator_only and settings.separator:
            return whole
        sliding = _windows(p["toks"], size, step, tokenizer)
        if not settings.separator:
            return sliding
        return F.when(F.size(p["toks"]) > size, sliding).otherwise(whole)

    cut = docs.select("doc_id", F.flatten(F.transform(pieces, expand)).alias("_c"))
    merged = cut.select("doc_id", _merge_tail(F.col("_c"), settings, "\\n\\n", tokenizer).alias("_c"))
    rows = unnest(merged, ["doc_id"], F.col("_c"), "chunk_order_index")
    content, tokens = F.col("content"), F.col("tokens")
    if hard_truncate:
        # Trimming keeps the words, so the recorded count is the count of the content.
        content = F.when(tokens > size + settings.hard_slack_tokens, tokenizer.joined(F.slice(tokenizer.tokens(content), 1, size))).otherwise(content)
    return rows.select(
        F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_order_index").cast("string")).alias("chunk_id"),
        "doc_id",
        "chunk_order_index",
        "tokens",
        content.alias("content"),
        (tokens > settings.meaningful_tokens).alias("meaningful"),
    )


def halve_chunks(chunks: DataFrame) -> DataFrame:
    """Split each chunk at its middle character; halves remember their parent."""
    half = F.floor(F.length("content") / 2).cast("int")
    parts = F.array(
        F.struct(F.lit("_p1").alias("suffix"), F.substring("content", F.lit(1), half).alias("content")),
        F.struct(F.lit("_p2").alias("suffix"), F.substring("content", half + 1, F.length("content")).alias("content")),
    )
    return (
        chunks.withColumn("_h", F.explode(parts))
        .withColumn("parent_chunk_id", F.col("chunk_id"))
        .withColumn("chunk_id", F.concat("chunk_id", "_h.suffix"))
        .withColumn("content", F.col("_h.content"))
        .drop("_h")
    )


def content_hash_ids(chunks: DataFrame) -> DataFrame:
    """Chunk ids from content; equal chunks of one document collapse to the first."""
    keyed = chunks.withColumn("chunk_id", F.concat(F.lit("chunk-"), F.md5("content")))
    first = F.min_by(F.struct("chunk_order_index", "tokens", "content"), F.col("chunk_order_index"))
    return keyed.groupBy("doc_id", "chunk_id").agg(first.alias("_f")).select("doc_id", "chunk_id", "_f.*")


def largest_chunk(chunks: DataFrame) -> DataFrame:
    """The chunk with most characters over all documents, lowest id on a tie."""
    size = F.length("content").alias("characters")
    return chunks.select("chunk_id", "doc_id", "chunk_order_index", size).orderBy(F.desc("characters"), "chunk_id").limit(1)
