"""Mentions and relations of a document to its entities, edges and summaries.

Every group here lies inside one document. A document is one input row, so a
group never holds more than that row's words.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltgraph.config import Settings
from quiltgraph.functions import prompts
from quiltgraph.functions.sizes import cut_lineage, join_lookup
from quiltgraph.functions.text import sorted_join, strip, truncate_words, word_count
from quiltgraph.models.clients import TextModel, replies
from quiltgraph.operators.extract import DEFAULT_STRENGTH, known_endpoints

DEFAULT = Settings()

# Sentences and headings stored in summaries.
RELATION_HEADING = "关系:"
ENTITY_WITHOUT_CONTEXT = ("实体 '", "' 在文档 '", "' 中被提及，但无详细上下文。")
ENTITY_TYPE = "named_entity"
NO_CHUNKS = "Document is empty or could not be chunked."
NO_MEANINGFUL_CHUNKS = "Document contains no meaningful chunks after filtering."
NO_ENTITIES = "No entities were extracted from the document."
NO_NAMED_ENTITIES = "No named entities found to generate a summary."


def seen_at() -> Column:
    """Order of a mention or relation inside its document as one number."""
    return F.col("chunk_order_index").cast("long") * F.lit(1 << 32) + F.col("position")


def entity_id(doc: str = "doc_id", name: str = "name") -> Column:
    return F.concat_ws("_", F.col(doc).cast("string"), F.col(name))


def fuse_entities(mentions: DataFrame, with_chunks: bool = False) -> DataFrame:
    """One entity per (document, name): kept when any vote is true, named when all are.

    ``with_chunks`` adds the sorted ids of the chunks that mention it.
    """
    chunks = [F.array_sort(F.collect_set("chunk_id")).alias("source_chunk_ids")] if with_chunks else []
    votes = mentions.groupBy("doc_id", "name").agg(
        F.max(F.col("is_named_entity").cast("int")).alias("_any"),
        F.min(F.col("is_named_entity").cast("int")).alias("_all"),
        F.count("*").alias("n_mentions"),
        F.min(seen_at()).alias("first_seen"),
        *chunks,
    )
    return votes.filter("_any = 1").select(
        entity_id().alias("entity_id"), "doc_id", "name", F.lit(ENTITY_TYPE).alias("type"),
        (F.col("_all") == 1).alias("is_named_entity"), "n_mentions", "first_seen", *(["source_chunk_ids"] if with_chunks else []),
    )


def sourced_from(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct entity-to-chunk edges of the kept entities."""
    edges = mentions.groupBy("doc_id", "name", "chunk_id").agg(F.min("chunk_order_index").alias("chunk_order_index"))
    kept = edges.join(entities.select("doc_id", "name"), ["doc_id", "name"], "left_semi")
    return kept.select(entity_id().alias("entity_id"), "chunk_id", "doc_id", "name", "chunk_order_index")


def source_chunk_ids(edges: DataFrame) -> DataFrame:
    return edges.groupBy("entity_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("source_chunk_ids"))


def _with_ids(relations: DataFrame) -> DataFrame:
    return relations.select(
        entity_id("doc_id", "source").alias("source_entity_id"), entity_id("doc_id", "target").alias("target_entity_id"),
        F.col("source").alias("source_entity_name"), F.col("target").alias("target_entity_name"),
        "description", "strength", "keywords", "doc_id",
    )


def fuse_relations(relations: DataFrame) -> DataFrame:
    """One row per directed pair: joined distinct texts, mean strength, keyword union."""
    return relations.groupBy("doc_id", "source", "target").agg(
        sorted_join(F.collect_set("description")).alias("description"),
        F.avg(F.coalesce("strength", F.lit(DEFAULT_STRENGTH))).alias("strength"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("keywords", F.array().cast("array<string>")))))).alias("keywords"),
        F.count("*").alias("n_relations"),
    )


def final_relations(relations: DataFrame, entities: DataFrame, fused: bool = True) -> DataFrame:
    """Relations between kept entities.

    ``fused=False`` keeps what the last raw relation of a pair says, with the
    default strength and no keywords.
    """
    if fused:
        merged = fuse_relations(relations)
    else:
        last = F.max_by("description", seen_at())
        merged = relations.groupBy("doc_id", "source", "target").agg(last.alias("description")).select(
            "*", F.lit(DEFAULT_STRENGTH).alias("strength"), F.array().cast("array<string>").alias("keywords")
        )
    return _with_ids(known_endpoints(merged, entities, ["doc_id"]))


def entity_contexts(mentions: DataFrame, relations: DataFrame, with_chunks: bool = False) -> DataFrame:
    """Fused entities with their texts: descriptions, then lines where the entity is the source, then the target.

    Votes and texts come from one aggregation, so the result equals
    ``fuse_entities`` plus ``descriptions``, ``relation_lines`` and ``context``.
    ``with_chunks`` adds the sorted ids of the chunks that mention an entity.
    """
    chunk = lambda c: [c.alias("chunk")] if with_chunks else []
    line = F.when(strip(F.col("description")) != "", F.col("description")).alias("line")
    described = mentions.select(
        "doc_id", F.lit(0).alias("kind"), F.col("name").alias("a"), F.lit(None).cast("string").alias("b"), seen_at().alias("at"), line,
        F.col("is_named_entity").cast("int").alias("vote"), *chunk(F.col("chunk_id")),
    )
    related = relations.filter(F.col("description") != "").select(
        "doc_id", F.lit(1).alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), seen_at().alias("at"),
        F.col("description").alias("line"), F.lit(None).cast("int").alias("vote"), *chunk(F.lit(None).cast("string")),
    )
    # Dealt by document once: both aggregations below find their groups in place, and no text is shuffled again.
    rows = described.unionByName(related).repartition("doc_id")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    pieces = rows.groupBy("doc_id", "kind", "a", "b").agg(
        F.max("vote").alias("_any"), F.min("vote").alias("_all"), F.count("vote").alias("_n"), F.min("at").alias("at"), ordered.alias("_l"),
        *([F.array_sort(F.collect_set("chunk")).alias("chunk")] if with_chunks else []))
    told = F.concat("a", F.lit(" -> "), "b", F.lit(": "), F.array_join("_l", " | "))
    end = lambda kind, name, text: F.struct(F.lit(kind).alias("kind"), F.col(name).alias("name"), text.alias("line"))
    ends = F.when(F.col("kind") == 0, F.array(end(0, "a", F.array_join("_l", "\n")))).otherwise(F.array(end(1, "a", told), end(2, "b", told)))
    kept_chunks = ["chunk"] if with_chunks else []
    placed = pieces.select("doc_id", "_any", "_all", "_n", "at", *kept_chunks, F.explode(ends).alias("e")).select(
        "doc_id", "_any", "_all", "_n", "at", *kept_chunks, "e.*")
    own, edge = F.col("kind") == 0, (F.col("kind") > 0) & F.col("line").isNotNull()
    groups = placed.groupBy("doc_id", "name").agg(
        F.max("_any").alias("_any"), F.min("_all").alias("_all"), F.sum("_n").alias("n_mentions"), F.min(F.when(own, F.col("at"))).alias("first_seen"),
        F.max(F.when(own, F.col("line"))).alias("descriptions"),
        F.sort_array(F.collect_list(F.when(edge, F.struct("kind", "at", "line")))).alias("_p"),
        *([F.max(F.when(own, F.col("chunk"))).alias("source_chunk_ids")] if with_chunks else []),
    )

    kept = groups.filter("_any = 1").select(
        entity_id().alias("entity_id"), "doc_id", "name", F.lit(ENTITY_TYPE).alias("type"),
        (F.col("_all") == 1).alias("is_named_entity"), "n_mentions", "first_seen",
        "descriptions", F.array_join(F.transform("_p", lambda x: x["line"]), "\n").alias("relation_lines"),
        *(["source_chunk_ids"] if with_chunks else []),
    )
    combined = F.concat(
        "descriptions",
        F.when(F.col("relation_lines") != "", F.concat(F.lit(f"\n\n{RELATION_HEADING}\n"), "relation_lines")).otherwise(""),
    )
    return kept.withColumn("context", strip(combined))


def of_names(mentions: DataFrame, relations: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mentions and relations that entities of ``names`` (name) are made of; their contexts stay whole.

    A relation stays if either end is among the names. The other end has no mentions left and becomes no entity.
    """
    known = names.select("name").filter("name is not null").distinct()
    kept = join_lookup(mentions, known, ["name"], how="left_semi")
    for end in ("source", "target"):
        relations = join_lookup(relations, known.select(F.col("name").alias(end), F.lit(True).alias(f"_{end}")), [end], how="left")
    return kept, relations.filter("_source or _target").drop("_source", "_target")


@dataclass(frozen=True)
class RuleSummarizer:
    """Deterministic summaries: sizes and digests of the text to be summarised."""

    in_spark = True
    reads_entries = False

    def entity(self, rows: DataFrame) -> DataFrame:
        words = word_count(F.col("context")).cast("string")
        return rows.withColumn("summary", F.concat(F.lit("Context of "), words, F.lit(" words, digest "), F.md5("context")))

    def document(self, rows: DataFrame) -> DataFrame:
        count = F.col("n_entities").cast("string")
        names = F.array_join("entity_names", ", ")
        return rows.withColumn("summary", F.concat(F.lit("Document about "), count, F.lit(" named entities: "), names))


@dataclass(frozen=True)
class ModelSummarizer:
    """Summaries by a text model; a failed call keeps the context, or gives an empty summary."""

    model: Callable[[], TextModel]
    in_spark = False
    reads_entries = True

    def entity(self, rows: DataFrame) -> DataFrame:
        relations = F.when(F.col("relation_lines") != "", F.col("relation_lines")).otherwise("none")
        prompt = prompts.render(
            prompts.TEMPLATES["entity_summary"], name=F.col("name"), descriptions=F.col("descriptions"), relations=relations
        )
        asked = rows.withColumn("_reply", replies(prompt, self.model))
        return asked.withColumn("summary", F.coalesce(strip(F.col("_reply")), F.col("context"))).drop("_reply")

    def document(self, rows: DataFrame) -> DataFrame:
        prompt = prompts.render(prompts.TEMPLATES["document_summary"], entities=F.col("entity_list"))
        return rows.withColumn("summary", F.coalesce(replies(prompt, self.model), F.lit("")))


def summarize_entities(contexts: DataFrame, summarizer=RuleSummarizer(), settings: Settings = DEFAULT) -> DataFrame:
    """Short contexts are their own summary; only long ones reach the summarizer.

    For a model the rows are written out and split: a condition does not keep a
    Python function from running on the other rows. A summarizer made of Spark
    expressions needs only the condition.
    """
    first, second, third = ENTITY_WITHOUT_CONTEXT
    nothing = F.concat(F.lit(first), "name", F.lit(second), F.col("doc_id").cast("string"), F.lit(third))
    own = F.when(F.coalesce("context", F.lit("")) == "", nothing).otherwise(F.col("context"))
    text = F.coalesce("context", F.lit(""))
    # n words take 2 n - 1 characters at least, so most contexts need no count.
    few = F.length(text) < 2 * settings.short_context_tokens + 1
    sized = contexts.withColumn("_short", F.when(few, True).otherwise(word_count(text) <= settings.short_context_tokens))
    short = F.col("_short")
    if summarizer.in_spark:
        written = summarizer.entity(sized).withColumn("summary", F.when(short, own).otherwise(F.col("summary")))
    else:
        sized = cut_lineage(sized)
        written = sized.filter(short).withColumn("summary", own).unionByName(summarizer.entity(sized.filter(~short)))
    return written.drop("_short", "context", "descriptions", "relation_lines")


def within_budget(entries: DataFrame, group: str, order: str, tokens: str, budget: int, free_entries: bool = True) -> DataFrame:
    """The longest prefix of each group, in order, whose tokens fit the budget.

    Of the entries with tokens a prefix holds at most ``budget``, so no more of them
    per group and task are shuffled; entries without tokens cost nothing and all stay
    until the first one that does not fit. ``free_entries=False`` says that there are none.
    """
    w = Window.partitionBy(group).orderBy(order)
    costly = entries.filter(F.col(tokens) > 0).withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= budget + 1).drop("_rank")
    near = costly.unionByName(entries.filter(F.coalesce(F.col(tokens), F.lit(0)) <= 0)) if free_entries else costly
    total = F.sum(F.coalesce(F.col(tokens), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("used_tokens", total).filter(F.col("used_tokens") <= budget)


def document_entries(entities: DataFrame, settings: Settings = DEFAULT, with_text: bool = True) -> DataFrame:
    """Named entities that fit the entity list of a document summary, with their lines if wanted."""
    entry = F.concat(F.lit("- "), "name", F.lit(": "), "summary", F.lit("\n"))
    lines = entities.filter("is_named_entity").select(
        "doc_id", "name", "first_seen", word_count(entry).alias("tokens"), *([entry.alias("entry")] if with_text else []))
    return within_budget(lines, "doc_id", "first_seen", "tokens", settings.entity_list_tokens, free_entries=False)


def document_summaries(
    docs: DataFrame, chunks: DataFrame, mentions: DataFrame, entities: DataFrame,
    summarizer=RuleSummarizer(), settings: Settings = DEFAULT,
) -> DataFrame:
    """``doc_id, summary, placeholder``; documents without usable content get a fixed sentence."""
    sizes = chunks.groupBy("doc_id").agg(F.count("*").alias("_chunks"), F.sum(F.col("meaningful").cast("int")).alias("_meaningful"))
    found = mentions.groupBy("doc_id").agg(F.count("*").alias("_mentions"))
    text = ["entry"] if summarizer.reads_entries else []
    ordered = F.array_sort(F.collect_list(F.struct("first_seen", "name", *text)))
    listed = [F.array_join(F.transform("_e", lambda x: x["entry"]), "").alias("entity_list")] if text else []
    lists = document_entries(entities, settings, bool(text)).groupBy("doc_id").agg(ordered.alias("_e")).select(
        "doc_id", F.size("_e").alias("n_entities"), F.transform("_e", lambda x: x["name"]).alias("entity_names"), *listed,
    )
    fixed = (
        F.when(F.col("_chunks").isNull(), NO_CHUNKS)
        .when(F.col("_meaningful") == 0, NO_MEANINGFUL_CHUNKS)
        .when(F.col("_mentions").isNull(), NO_ENTITIES)
        .when(F.col("n_entities").isNull(), NO_NAMED_ENTITIES)
    )
    state = docs.select("doc_id").join(sizes, "doc_id", "left").join(found, "doc_id", "left").join(lists, "doc_id", "left")
    state = state.withColumn("_fixed", fixed)
    if summarizer.in_spark:
        return summarizer.document(state).select(
            "doc_id", F.coalesce("_fixed", "summary").alias("summary"), F.col("_fixed").isNotNull().alias("placeholder")
        )
    state = cut_lineage(state)
    plain = state.filter(F.col("_fixed").isNotNull()).select("doc_id", F.col("_fixed").alias("summary"), F.lit(True).alias("placeholder"))
    written = summarizer.document(state.filter(F.col("_fixed").isNull()))
    return plain.unionByName(written.select("doc_id", "summary", F.lit(False).alias("placeholder")))
