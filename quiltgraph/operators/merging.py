"""Alternative fusion across documents: delimited records, typed nodes, undirected edges, reply cache.

A name may occur in a third of all rows. Counts and votes are aggregated before
the shuffle; texts are gathered only for names with few distinct fragments, and
many fragments are summarised block by block, so every name and edge gets a
description.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltgraph.functions.rows import unnest
from quiltgraph.functions.sizes import cut_lineage, join_lookup
from quiltgraph.functions.text import strip
from quiltgraph.models.clients import TextModel, replies

# The delimiters of a record reply and of stored fragments.
TUPLE, RECORD, COMPLETE = "<|>", "##", "<|COMPLETE|>"
FRAGMENT_SEP = "<SEP>"
UNKNOWN_TYPE = "UNKNOWN"
SUMMARY_AT = 6


def parse_records(rows: DataFrame, keep: list[str], reply: str = "reply") -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of record replies, in reply order with their position."""
    records = F.split(F.col(reply), r"##|<\|COMPLETE\|>")
    inner = F.transform(records, lambda r: F.regexp_extract(r, r"(?s)\((.*)\)", 1))
    parts = F.transform(inner, lambda r: F.struct(F.transform(F.split(r, r"<\|>"), lambda x: strip(x)).alias("f")))
    fields = unnest(rows, keep, parts, "position")
    clean = lambda i: F.btrim(F.col("f")[i], F.lit('"'))
    entities = fields.filter((F.size("f") >= 4) & F.col("f")[0].contains("entity")).select(
        *keep, "position", clean(1).alias("name"), clean(2).alias("entity_type"), clean(3).alias("description")
    )
    relations = fields.filter((F.size("f") >= 5) & F.col("f")[0].contains("relationship")).select(
        *keep, "position", clean(1).alias("source"), clean(2).alias("target"), clean(3).alias("description"), clean(4).alias("keywords"),
        F.coalesce(F.try_element_at("f", F.lit(-1)).try_cast("double"), F.lit(1.0)).alias("weight"),
    )
    return entities, relations


def digest_blocks(blocks: DataFrame) -> DataFrame:
    """Summary by rule of a block's ``text``: how many fragments it joins, the first and the last."""
    parts = F.split("text", FRAGMENT_SEP)
    return blocks.withColumn("summary", F.concat(
        F.size(parts).cast("string"), F.lit(" fragments from "), F.element_at(parts, 1), F.lit(" to "), F.element_at(parts, -1)))


def merge_nodes(
    mentions: DataFrame, summarize: Callable[[DataFrame], DataFrame] = digest_blocks, few: int = SUMMARY_AT
) -> DataFrame:
    """Per name: most frequent type (first seen on a tie), fragment and source counts, one description.

    ``mentions`` is (name, entity_type, description, source_id, order), read once:
    all four results roll up from the distinct combinations.
    """
    seen = cut_lineage(mentions.groupBy("name", "entity_type", "description", "source_id").agg(
        F.count("*").alias("n"), F.min("order").alias("first")))
    by_type = seen.groupBy("name", "entity_type").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    types = by_type.groupBy("name").agg(F.max_by("entity_type", F.struct("n", (-F.col("first")).alias("f"))).alias("entity_type"))
    sources = seen.select("name", "source_id").distinct().groupBy("name").agg(F.count("*").alias("n_sources"))
    described = summarize_fragments(seen.select("name", "description"), summarize, few, counted=True)
    return types.join(sources, "name").join(described, "name", "left").select("name", "entity_type", "n_fragments", "n_sources", "description")


def merge_edges(
    relations: DataFrame, summarize: Callable[[DataFrame], DataFrame] = digest_blocks, few: int = SUMMARY_AT
) -> DataFrame:
    """Undirected edges without self-loops: summed weight, keyword union, one description."""
    key = ["src_id", "tgt_id"]
    pairs = relations.filter(F.col("source") != F.col("target")).select(
        F.least("source", "target").alias("src_id"), F.greatest("source", "target").alias("tgt_id"),
        "description", "weight", "keywords",
    )
    seen = cut_lineage(pairs.groupBy(*key, "description", "keywords").agg(F.sum("weight").alias("weight")), "zstd")
    fragments = seen.filter(F.col("description") != "").select(*key, "description")
    # Weights travel with the first of a row's keywords, so that both roll up in one aggregation.
    split = F.posexplode_outer(F.split("keywords", ",")).alias("_at", "k")
    words = seen.select(*key, "weight", split).select(*key, F.trim("k").alias("k"), F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("weight")).alias("weight"))
    words = words.groupBy(*key, "k").agg(F.sum("weight").alias("weight"))
    kept = F.array_sort(F.collect_set(F.when(F.col("k") != "", F.col("k"))))
    rolled = words.groupBy(*key).agg(F.sum("weight").alias("weight"), F.when(F.size(kept) > 0, F.array_join(kept, ",")).alias("keywords"))
    described = summarize_fragments(fragments, summarize, few, key, counted=True, beside=rolled)
    return described.select(*key, "weight", "n_fragments", "keywords", "description")


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names used by edges but held by no node; they become nodes of unknown type."""
    ends = edges.select(F.explode(F.array("src_id", "tgt_id")).alias("name")).distinct()
    return ends.join(nodes.select("name"), "name", "left_anti").withColumn("entity_type", F.lit(UNKNOWN_TYPE))


def summarize_fragments(
    fragments: DataFrame, summarize: Callable[[DataFrame], DataFrame], few: int = SUMMARY_AT, key: list[str] | None = None, counted: bool = False,
    beside: DataFrame | None = None,
) -> DataFrame:
    """One description per ``key`` (by default name) from its distinct fragments, however many there are.

    Keys with fewer than ``few`` fragments, almost all of them, get these joined in one aggregate, which keeps about
    ``few`` of a key's fragments in each task. The fragments of the others are cut into blocks of about ``few`` by a hash,
    each block is summarised, and the summaries are the fragments of the next round. With ``counted`` there is n_fragments.
    Rows of ``beside``, one of each key, all stay and get the description and the count of their key, if it has any; they
    meet the first round's aggregate where that is made, so descriptions are not shuffled again.
    """
    key = key or ["name"]
    done, pending, counts, others = None, fragments.select(*key, "description"), None, None
    more = [c for c in beside.columns if c not in key] if beside is not None else []
    while True:
        # A fragment that comes twice keeps its rank, and the sets below hold it once.
        rank = F.dense_rank().over(Window.partitionBy(*key).orderBy(F.asc("description")))
        first = pending.withColumn("_place", rank).filter(F.col("_place") <= few)
        joined = F.array_join(F.array_sort(F.collect_set("description")), FRAGMENT_SEP).alias("description")
        near = first.groupBy(*key).agg(F.max("_place").alias("_n"), joined)
        near = cut_lineage(beside.join(near, key, "left") if counts is None and beside is not None else near, "zstd")
        few_left = F.coalesce(F.col("_n"), F.lit(0)) < few
        many = near.filter(~few_left).select(*key)
        some = not many.isEmpty()
        pending = cut_lineage(join_lookup(pending, many, key, how="left_semi").distinct()) if some else pending
        sized = cut_lineage(pending.groupBy(*key).agg(F.count("*").alias("_n"))) if some else None
        told = near.filter(few_left)
        if counts is None:
            done = told.select(*key, *more, "description", *([F.col("_n").cast("bigint").alias("n_fragments")] if counted else []))
            counts = sized.withColumnRenamed("_n", "n_fragments") if some else near.limit(0)
            others = near.filter(~few_left).select(*key, *more)
        else:
            told = join_lookup(told.select(*key, "description"), counts, key) if counted else told.select(*key, "description")
            done = done.unionByName(join_lookup(told, others, key) if more else told)
        if not some:
            return done
        place = F.conv(F.substring(F.md5("description"), 1, 8), 16, 10).cast("bigint")
        blocks = join_lookup(pending, sized, key).select(*key, "description", (place % F.ceil(F.col("_n") / few)).alias("_b")).groupBy(*key, "_b").agg(
            F.array_join(F.array_sort(F.collect_list("description")), FRAGMENT_SEP).alias("text"))
        pending = cut_lineage(summarize(blocks).select(*key, F.col("summary").alias("description")).distinct())


def document_index(mentions: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per document the distinct names and undirected pairs, each with its count."""
    names = mentions.groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("entity_names"))
    pair = F.struct(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    pairs = relations.filter(F.col("source") != F.col("target")).groupBy("doc_id").agg(F.array_sort(F.collect_set(pair)).alias("relation_pairs"))
    return names.withColumn("count", F.size("entity_names")), pairs.withColumn("count", F.size("relation_pairs"))


def cached_replies(rows: DataFrame, cache: DataFrame, model: Callable[[], TextModel]) -> tuple[DataFrame, DataFrame]:
    """(rows with replies, new cache rows). Equal prompts are asked once and known ones never.

    ``rows`` holds ``prompt``; ``cache`` is (prompt_key, reply).
    """
    keyed = rows.withColumn("prompt_key", F.sha2("prompt", 256))
    unknown = keyed.select("prompt_key", "prompt").join(cache.select("prompt_key"), "prompt_key", "left_anti")
    asked = unknown.groupBy("prompt_key").agg(F.first("prompt").alias("prompt"))
    fresh = cut_lineage(asked.withColumn("reply", replies(F.col("prompt"), model)).filter("reply is not null").select("prompt_key", "reply"))
    known = cache.select("prompt_key", "reply").unionByName(fresh)
    return keyed.join(known, "prompt_key", "left"), fresh
