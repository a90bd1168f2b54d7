"""Cross-document linking as one verb."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.config import Settings
from quiltgraph.functions.sizes import cut_lineage, join_lookup, safe_unions
from quiltgraph.operators.linking import RuleScorer, accepted_links, changed_entities, entity_mark, fast_links, link_changes, link_entities


def link(
    entities: DataFrame, vectors: DataFrame | None = None, scorer=RuleScorer(), settings: Settings = Settings(), fast: bool = False
) -> tuple[DataFrame, DataFrame | None]:
    """(links, scored details). ``fast`` links every candidate pair and has no details.

    ``vectors`` defaults to the ``vector`` column of the entities.
    """
    safe_unions(entities)
    if fast:
        return fast_links(entities, settings), None
    if vectors is None:
        vectors = entities.select("entity_id", "vector")
    details = link_entities(entities.drop("vector"), vectors, scorer, settings)
    return accepted_links(details), details.withColumn("embedding_score", F.round("embedding_score", 4))


def link_batch(
    store, batch: int, scorer=RuleScorer(), settings: Settings = Settings(), vectors: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """Bring the stored links up to date with what one batch of a store put, rewrote or deleted.

    Reads the entities of the batch's documents as they were before and are now, and writes details and links of the names
    that changed, new ones as writes and those that hold no more as deletions of the same batch. Repeating it changes nothing.
    ``vectors`` adds ``vector`` to rows with a summary; by default it is a stored column. Summaries and vectors are read (or
    made) for members of pairs to be scored only.
    """
    seen = {"columns": ["name", "is_named_entity"], "made": {"mark": entity_mark()}}
    now = store.read("entities", **seen)
    if now is None:
        return
    now = cut_lineage(now)
    touched = cut_lineage(store.touched("entities", batch))
    was = store.read("entities", before=batch, **seen)
    of_batch = lambda rows: join_lookup(rows, touched, ["doc_id"], settings, "left_semi")
    changed = cut_lineage(changed_entities(of_batch(now if was is None else was).filter(F.lit(was is not None)), of_batch(now)))
    held = store.read("link_details", before=batch, columns=["entity_1_name"])
    if held is None:
        held = store.spark.createDataFrame([], "entity_1_id string, entity_2_id string, entity_1_name string")

    def told(ids: DataFrame) -> DataFrame:
        rows = store.read("entities", columns=["summary", *([] if vectors else ["vector"])], only=ids)
        return (vectors(rows) if vectors else rows).select("entity_id", "summary", "vector")

    change = link_changes(now, told, changed, held, scorer, settings)
    scored, gone = cut_lineage(change.scored), cut_lineage(change.withdrawn)
    for name, rows in (("link_details", scored), ("same_as", accepted_links(scored))):
        store.delete(name, gone, batch)
        store.put(name, rows, batch)
