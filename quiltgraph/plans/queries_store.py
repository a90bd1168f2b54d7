"""Queries that write knowledge tables to a store, change them and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.functions.sizes import cut_lineage, shared_folder
from quiltgraph.operators.fusion import sourced_from
from quiltgraph.plans import base
from quiltgraph.plans.base import SQL_CHUNKS, SQL_EDGES, SQL_ENTITIES, SQL_MENTIONS, with_
from quiltgraph.plans.registry import query
from quiltgraph.plans.repair import clean_up
from quiltgraph.sources.lines import read_failed_chunks
from quiltgraph.sources.store import Store, write_failed_chunks
from quiltgraph.sources.tables import documents, table

GRAPH = (SQL_CHUNKS, SQL_MENTIONS, SQL_ENTITIES, SQL_EDGES)


def new_store(spark) -> Store:
    return Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


def parts(spark, d) -> dict[str, DataFrame]:
    mentions = base.extracted(spark, d)[0]
    entities = cut_lineage(base.fuse_entities(mentions))
    return {"chunks": base.chunks(spark, d), "entities": entities, "sourced_from": sourced_from(mentions, entities),
            "documents": documents(spark, d).select("doc_id")}


def put(store: Store, made: dict[str, DataFrame], batch: int) -> None:
    for name, rows in made.items():
        store.put(name, rows, batch)


def stored_ids(store: Store) -> DataFrame:
    """Ids of all stored chunks, entities and documents."""
    named = [store.read(n).select(F.lit(n).alias("part"), F.col(k).cast("string").alias("id")) for n, k in (
        ("chunks", "chunk_id"), ("entities", "entity_id"), ("documents", "doc_id"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


SQL_IDS = """
SELECT 'chunks' AS part, chunk_id AS id FROM chunks WHERE {0} UNION ALL SELECT 'entities', entity_id FROM entities WHERE {0}
UNION ALL SELECT 'documents', doc_id::VARCHAR FROM documents WHERE {0}"""


@query("store_rewrite", with_(*GRAPH) + SQL_IDS.format("doc_id % 3 <> 0 OR chunk_order_index = 0").replace(
    "FROM entities WHERE doc_id % 3 <> 0 OR chunk_order_index = 0",
    "FROM entities e WHERE doc_id % 3 <> 0 OR entity_id IN (SELECT entity_id FROM edges WHERE chunk_id = edges.doc_id || '_0')").replace(
    "FROM documents WHERE doc_id % 3 <> 0 OR chunk_order_index = 0", "FROM documents"))
def store_rewrite(spark, d):
    """Every third document is stored again in a later batch with its first chunk only; nothing of its old form stays."""
    store, made = new_store(spark), parts(spark, d)
    put(store, made, 1)
    first = {n: rows.filter("doc_id % 3 = 0") for n, rows in made.items()}
    edges = cut_lineage(first["sourced_from"].filter(F.col("chunk_id") == F.concat(F.col("doc_id").cast("string"), F.lit("_0"))))
    first["sourced_from"], first["chunks"] = edges, first["chunks"].filter("chunk_order_index = 0")
    first["entities"] = first["entities"].join(edges.select("entity_id").distinct(), "entity_id", "left_semi").select(*made["entities"].columns)
    for _ in range(2):  # a repeated batch changes nothing
        store.delete_documents(first["documents"], 2)
        put(store, first, 2)
    return stored_ids(store)


@query("store_delete_repeat", with_(*GRAPH) + SQL_IDS.format("doc_id % 4 <> 1"))
def store_delete_repeat(spark, d):
    """Every fourth document is deleted, and the deletion repeated."""
    store = new_store(spark)
    put(store, parts(spark, d), 1)
    for _ in range(2):
        store.delete_documents(documents(spark, d).filter("doc_id % 4 = 1"), 2)
    return stored_ids(store)


@query("store_cleanup", with_(*GRAPH) + SQL_IDS.format("doc_id IN (SELECT doc_id FROM labels)"))
def store_cleanup(spark, d):
    """Documents that no label refers to are removed, and the cleanup repeated."""
    store, labels = new_store(spark), table(spark, d, "labels").select("doc_id")
    put(store, parts(spark, d), 1)
    for _ in range(2):
        clean_up(store, labels, 2)
    return stored_ids(store)


@query("store_filtered_read", with_(*GRAPH) + "SELECT chunk_id, doc_id, content FROM chunks WHERE doc_id = 7 OR doc_id = 8")
def store_filtered_read(spark, d):
    """Chunks of two documents, by a condition that reaches the files."""
    store = new_store(spark)
    chunks = base.chunks(spark, d)
    store.put("chunks", chunks, 1)
    store.put("chunks", chunks.filter("doc_id = 8"), 2)
    return store.read("chunks", F.col("chunk_id").rlike("^[78]_")).select("chunk_id", "doc_id", "content")


@query("failed_chunk_files", with_(SQL_CHUNKS) + """
SELECT doc_id AS file_doc_id, chunk_id, tokens, chunk_order_index, content FROM (SELECT *, doc_id::VARCHAR AS t FROM chunks) WHERE NOT meaningful OR chunk_order_index > 2""")
def failed_chunk_files(spark, d):
    """Chunks written as failed ones and read back."""
    path = f"{shared_folder(spark)}/failed-{uuid.uuid4().hex}"
    write_failed_chunks(base.chunks(spark, d).filter("not meaningful or chunk_order_index > 2"), path)
    return read_failed_chunks(spark, path).select(F.col("file_doc_id").cast("long").alias("file_doc_id"), "chunk_id", "tokens", "chunk_order_index", "content")


@query("processed_again", """
SELECT doc_id FROM documents WHERE doc_id % 5 <> 0""")
def processed_again(spark, d):
    """Ids in the processed log after some of their documents were deleted; those may be processed again."""
    store = new_store(spark)
    docs = documents(spark, d)
    store.log_processed(docs, 1)
    store.delete_documents(docs.filter("doc_id % 5 = 0"), 2)
    return store.processed().select(F.col("doc_id").cast("long").alias("doc_id"))


@query("store_commit_record", with_(*GRAPH) + """
SELECT state, part, id FROM (
  SELECT 'stopped' AS state, 'chunks' AS part, chunk_id AS id FROM chunks WHERE doc_id % 2 = 0 UNION ALL SELECT 'stopped', 'entities', entity_id FROM entities WHERE doc_id % 2 = 0
  UNION ALL SELECT 'stopped', 'documents', doc_id::VARCHAR FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT 'committed', 'chunks', chunk_id FROM chunks WHERE doc_id % 10 <> 4 UNION ALL SELECT 'committed', 'entities', entity_id FROM entities WHERE doc_id % 10 <> 4
  UNION ALL SELECT 'committed', 'documents', doc_id::VARCHAR FROM documents WHERE doc_id % 10 <> 4)""")
def store_commit_record(spark, d):
    """A batch that deletes, writes two of its tables and stops shows nothing; repeated and committed it shows whole."""
    store, made = new_store(spark), {n: cut_lineage(rows) for n, rows in parts(spark, d).items()}
    put(store, {n: rows.filter("doc_id % 2 = 0") for n, rows in made.items()}, 1)
    second = {n: rows.filter("doc_id % 2 = 1") for n, rows in made.items()}
    gone = documents(spark, d).filter("doc_id % 10 = 4")
    store.begin(2)
    store.delete_documents(gone, 2)
    put(store, {n: second[n] for n in ("chunks", "entities")}, 2)
    stopped = cut_lineage(stored_ids(store))
    store.begin(2)
    store.delete_documents(gone, 2)
    put(store, second, 2)
    store.commit(2)
    return stopped.select(F.lit("stopped").alias("state"), "part", "id").unionByName(stored_ids(store).select(F.lit("committed").alias("state"), "part", "id"))
