"""Second tries for failed chunks, refreshed summaries and cleanup of unused documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.config import Settings
from quiltgraph.functions.sizes import cut_lineage, safe_unions
from quiltgraph.models.clients import Embedder, HashingEmbedder, embed
from quiltgraph.operators.fusion import RuleSummarizer, document_summaries, entity_id, seen_at, sourced_from
from quiltgraph.operators.graph import supplement_entities, supplement_relations
from quiltgraph.operators.prep import stale_documents


def refresh_summaries(
    documents: DataFrame, chunks: DataFrame, entities: DataFrame, changed: DataFrame,
    summarizer=RuleSummarizer(), embedder: Embedder | None = None, settings: Settings = Settings(),
) -> tuple[DataFrame, DataFrame]:
    """(documents, entities) of the changed ids with new summaries and vectors; other rows are not touched.

    ``entities`` carries ``first_seen``; ``changed`` is (doc_id).
    """
    embedder = embedder or HashingEmbedder()
    ids = safe_unions(changed).select("doc_id").distinct()
    pick = lambda df: df.join(ids, "doc_id", "left_semi")
    kept = pick(entities).drop("vector")
    docs = document_summaries(pick(documents).select("doc_id"), pick(chunks), kept, kept, summarizer, settings)
    return docs.withColumn("vector", embed(F.col("summary"), embedder)), kept.withColumn("vector", embed(F.col("summary"), embedder))


def retry_failed(
    failed: DataFrame, entities: DataFrame, extractor, relations: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(changed entities, repaired document ids, chunks that failed again, new source edges, changed relations).

    New descriptions are appended to stored entities, whose other columns stay as
    they are stored; vectors of changed summaries are left for ``refresh_summaries``.
    With the stored ``relations`` those of the repaired chunks are appended too. A document counts as repaired only when
    none of its chunks failed again.
    """
    mentions, found, again = extractor.extract(safe_unions(failed).withColumn("meaningful", F.lit(True)))
    mentions, again = cut_lineage(mentions), cut_lineage(again)
    touched = mentions.select("doc_id").distinct()
    stored = entities.join(touched, "doc_id", "left_semi")
    merged = supplement_entities(
        stored.select("doc_id", "name", "summary", "is_named_entity"), mentions.withColumn("seen_at", seen_at())
    )
    first = mentions.groupBy("doc_id", "name").agg(F.min(seen_at()).alias("_first"), F.count("*").alias("_new"))
    kept = [c for c in entities.columns if c not in ("entity_id", "summary", "is_named_entity", "first_seen", "n_mentions")]
    old = stored.select(*kept, *(c for c in ("first_seen", "n_mentions") if c in entities.columns))
    changed = merged.join(old, ["doc_id", "name"], "left").join(first, ["doc_id", "name"], "left")
    changed = changed.withColumn("first_seen", F.least("first_seen", "_first"))
    if "n_mentions" in entities.columns:
        changed = changed.withColumn("n_mentions", F.coalesce("n_mentions", F.lit(0)) + F.coalesce("_new", F.lit(0)))
    changed = cut_lineage(changed.withColumn("entity_id", entity_id()).drop("created", "_first", "_new"))
    repaired = failed.select("doc_id").distinct().join(again.select("doc_id").distinct(), "doc_id", "left_anti")
    edges = sourced_from(mentions, changed)
    if relations is None:
        return changed, repaired, again, edges, None
    return changed, repaired, again, edges, _linked(relations.join(touched, "doc_id", "left_semi"), found, entities, changed).select(*relations.columns)


def _linked(stored: DataFrame, found: DataFrame, entities: DataFrame, changed: DataFrame) -> DataFrame:
    """Stored relations with those of repaired chunks appended; strength and keywords stay, or are the first found."""
    ends = {"source": "source_entity_name", "target": "target_entity_name"}
    key = ["doc_id", "source", "target"]
    known = entities.select("doc_id", "name").unionByName(changed.select("doc_id", "name")).distinct()
    arrived = found.withColumn("seen_at", seen_at())
    old = stored.withColumnsRenamed({v: k for k, v in ends.items()})
    merged = supplement_relations(old.select(*key, "description"), arrived, known)
    extra = [c for c in ("strength", "keywords") if c in stored.columns]
    first = arrived.groupBy(*key).agg(F.min_by(F.struct(*extra), "seen_at").alias("_first")) if extra else None
    merged = merged.join(old.select(*key, *extra), key, "left")
    if first is not None:
        merged = merged.join(first, key, "left").withColumns({c: F.coalesce(c, F.col(f"_first.{c}")) for c in extra})
    ids = {f"{k}_entity_id": entity_id(name=k) for k in ends}
    return merged.withColumns(ids).withColumnsRenamed(ends)


def clean_up(store, referenced: DataFrame, batch: int) -> DataFrame:
    """Remove every document stored before this batch that the question set does not refer to; returns the removed ids."""
    stored = store.read("documents", before=batch).select("doc_id")
    gone = cut_lineage(stale_documents(stored, referenced, "doc_id"))
    store.delete_documents(gone, batch)
    return gone
