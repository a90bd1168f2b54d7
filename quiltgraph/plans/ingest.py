"""Documents to knowledge tables, and their storage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.config import Settings
from quiltgraph.functions.sizes import cut_lineage, safe_unions
from quiltgraph.models.clients import Embedder, HashingEmbedder, embed
from quiltgraph.functions.text import truncate_words
from quiltgraph.operators.chunking import chunk_documents
from quiltgraph.operators.evidence import Knowledge
from quiltgraph.operators.extract import RuleExtractor
from quiltgraph.operators.fusion import (
    RuleSummarizer, document_summaries, entity_contexts, final_relations, fuse_entities, sourced_from, summarize_entities,
)
from quiltgraph.sources.store import document_blobs


@dataclass(frozen=True)
class Ingested:
    documents: DataFrame
    chunks: DataFrame
    entities: DataFrame
    sourced_from: DataFrame
    relations: DataFrame
    failed_chunks: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(vars(self))

    def knowledge(self, same_as: DataFrame) -> Knowledge:
        return Knowledge(self.documents, self.chunks, self.entities, self.sourced_from, same_as)


def ingest(
    docs: DataFrame, extractor=RuleExtractor(), summarizer=RuleSummarizer(), embedder: Embedder | None = None,
    settings: Settings = Settings(), fused: bool = True,
) -> Ingested:
    """Chunk, extract, fuse, summarise and embed documents (doc_id, text).

    Everything that a model or embedder made is written once here, so every later
    reader, ``save`` included, sees the same texts and vectors and asks for nothing.
    """
    embedder = embedder or HashingEmbedder()
    chunks = cut_lineage(chunk_documents(safe_unions(docs), settings))
    mentions, relations, failed = extractor.extract(chunks)
    kept = fuse_entities(mentions)
    entities = cut_lineage(summarize_entities(entity_contexts(mentions, relations), summarizer, settings))
    documents = cut_lineage(document_summaries(docs, chunks, mentions, entities, summarizer, settings))
    told = truncate_words(F.col("summary"), settings.embedding_tokens)
    return Ingested(
        cut_lineage(documents.withColumn("vector", embed(told, embedder))),
        cut_lineage(chunks.withColumn("vector", embed(F.col("content"), embedder))),
        cut_lineage(entities.withColumn("vector", embed(F.col("summary"), embedder))),
        sourced_from(mentions, kept),
        final_relations(relations, kept, fused),
        failed,
    )


def save(ingested: Ingested, store, batch: int, rewrite: bool = False) -> None:
    """Write one batch to a store in a fixed order; blobs come after the tables, the processed log and the commit come last.

    Readers see the whole batch or nothing of it: a batch that stopped half-way stays hidden until it is repeated.
    ``rewrite`` first removes whatever earlier batches stored of the same documents.
    """
    tables = ingested.tables()
    store.begin(batch)
    if rewrite:
        store.delete_documents(ingested.documents, batch)
    for name in ("chunks", "entities", "documents", "sourced_from", "relations", "failed_chunks"):
        store.put(name, tables[name], batch)
    store.put("blobs", document_blobs(
        ingested.documents, ingested.chunks, ingested.entities, ingested.sourced_from, ingested.relations), batch)
    store.log_processed(ingested.documents.select("doc_id"), batch)
    store.commit(batch)
