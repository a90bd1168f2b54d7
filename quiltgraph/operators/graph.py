"""Graph reads and writes over vertex and edge tables.

Tables: documents(doc_id, summary), chunks(chunk_id, doc_id), entities(entity_id,
doc_id, name, summary, ...), sourced_from(entity_id, chunk_id, doc_id),
relations(source_entity_id, target_entity_id, ...), same_as(entity_1_id, entity_2_id, score, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltgraph.config import Settings
from quiltgraph.functions.sizes import join_lookup
from quiltgraph.operators.ranking import last_by, top_k

DEFAULT = Settings()

# What separates an appended description from the text before it.
APPENDED_ENTITY = "\n\n--- (追加描述) ---\n"
APPENDED_RELATION = " | "


def document_metadata(documents: DataFrame, sourced_from: DataFrame, entities: DataFrame) -> DataFrame:
    """Every document with its summary and the sorted distinct names reached through its chunks."""
    reached = sourced_from.select("doc_id", "entity_id").join(entities.select("doc_id", "entity_id", "name"), ["doc_id", "entity_id"])
    names = reached.groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("entities"))
    joined = documents.select("doc_id", "summary").join(names, "doc_id", "left")
    return joined.withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def metadata_for(ids: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata for listed ids: input order and repeats kept, unknown ids padded."""
    empty = F.array().cast("array<string>")
    return ids.join(metadata, "doc_id", "left").withColumn("entities", F.coalesce("entities", empty))


def documents_by_names(names: DataFrame, entities: DataFrame, k: int, settings: Settings = DEFAULT) -> DataFrame:
    """Top ``k`` documents per question by the number of distinct question names they hold.

    ``names`` is (question_id, name). The entity table is keyed by (document,
    name), so counting rows counts distinct names.
    """
    met = join_lookup(entities.select("doc_id", "name"), names.select("question_id", "name").distinct(), ["name"], settings)
    scores = met.groupBy("question_id", "doc_id").agg(F.count("*").alias("score"))
    return top_k(scores, "question_id", [F.desc("score"), F.asc("doc_id")], k)


def summaries_by_name(wanted: DataFrame, entities: DataFrame, sourced_from: DataFrame | None = None, per_chunk: bool = False) -> DataFrame:
    """Summaries of ``wanted`` (…, doc_id, name). ``per_chunk`` repeats an entity once per source chunk.

    Without ``sourced_from`` the entities carry their ``source_chunk_ids``, and ``wanted`` without doc_id means a name in
    every document: then no text is shuffled while the wanted names are few.
    """
    if sourced_from is None:
        listed = F.explode("source_chunk_ids").alias("chunk_id") if per_chunk else F.size("source_chunk_ids").alias("_chunks")
        held = entities.select("doc_id", "name", "entity_id", "summary", listed)
        held = held if per_chunk else held.filter("_chunks > 0").drop("_chunks")
        return join_lookup(held, wanted, [c for c in ("doc_id", "name") if c in wanted.columns])
    found = wanted.join(entities.select("doc_id", "name", "entity_id", "summary"), ["doc_id", "name"])
    if per_chunk:
        return found.join(sourced_from.select("doc_id", "entity_id", "chunk_id"), ["doc_id", "entity_id"])
    return found.join(sourced_from.select("doc_id", "entity_id"), ["doc_id", "entity_id"], "left_semi")


def summaries_by_id(ids: DataFrame, entities: DataFrame) -> DataFrame:
    return entities.join(ids, "entity_id", "left_semi").select("entity_id", "name", "summary")


def linked_entities(sources: DataFrame, same_as: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities of other documents linked to ``sources`` (…, entity_id, doc_id) in either direction."""
    keys = [c for c in sources.columns if c not in ("entity_id", "doc_id")]
    ways = F.explode(F.array(F.struct(F.col("entity_1_id").alias("a"), F.col("entity_2_id").alias("b")),
                             F.struct(F.col("entity_2_id").alias("a"), F.col("entity_1_id").alias("b")))).alias("_w")
    edges = same_as.select(ways).select(F.col("_w.a").alias("entity_id"), F.col("_w.b").alias("linked_id"))
    other = entities.select(
        F.col("entity_id").alias("linked_id"), F.col("doc_id").alias("linked_doc_id"),
        F.col("name").alias("linked_name"), F.col("summary").alias("linked_summary"),
    )
    met = sources.join(edges, "entity_id").join(other, "linked_id").filter(F.col("doc_id") != F.col("linked_doc_id"))
    return met.select(*keys, "doc_id", "linked_id", "linked_doc_id", "linked_name", "linked_summary").distinct()


def document_knowledge(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations whose both ends are stored entities of the relation's own document."""
    for end in ("source", "target"):
        ends = entities.select("doc_id", F.col("entity_id").alias(f"{end}_entity_id"))
        relations = relations.join(ends, ["doc_id", f"{end}_entity_id"], "left_semi")
    return relations


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], sequence: Column | str = "seq") -> DataFrame:
    """Keyed upsert: the row with the highest sequence wins. Both sides carry the sequence."""
    both = existing.unionByName(incoming)
    order = F.col(sequence) if isinstance(sequence, str) else sequence
    return last_by(both, key, order, [c for c in both.columns if c not in key])


def upsert_relations(existing: DataFrame, incoming: DataFrame, entities: DataFrame) -> DataFrame:
    """Relation upsert: both ends must exist, the last write of a pair sets all properties."""
    known = entities.select("entity_id")
    for end in ("source_entity_id", "target_entity_id"):
        incoming = incoming.join(known.withColumnRenamed("entity_id", end), end, "left_semi")
    return upsert(existing, incoming.select(*existing.columns), ["source_entity_id", "target_entity_id"])


def merge_same_as(existing: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Create new links with a creation time; update the score and time of known ones."""
    new = incoming.groupBy("entity_1_id", "entity_2_id").agg(F.max("score").alias("_score"))
    old = existing.withColumnRenamed("score", "_old")
    merged = old.join(new, ["entity_1_id", "entity_2_id"], "full_outer")
    touched = F.col("_score").isNotNull() & F.col("_old").isNotNull()
    return merged.select(
        "entity_1_id", "entity_2_id", F.coalesce("_score", "_old").alias("score"),
        F.coalesce("created_at", now).alias("created_at"),
        F.when(touched, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def _append(old: Column, new: Column, sep: str, repeat: bool) -> Column:
    joined = F.concat(old, F.lit(sep), new)
    if repeat:
        return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(joined)
    pieces = F.split(old, "\\Q" + sep + "\\E", -1)
    return F.when(old.isNull(), new).when(new.isNull() | F.array_contains(pieces, new), old).otherwise(joined)


def supplement_entities(existing: DataFrame, mentions: DataFrame, repeat: bool = False) -> DataFrame:
    """Insert new entities; append new descriptions to known ones.

    ``existing`` is (doc_id, name, summary, is_named_entity); ``mentions`` carries
    ``seen_at`` and arrives in that order. A text that is already one of the
    appended pieces is not appended again unless ``repeat``.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seen_at", "description", "is_named_entity")))
    arrived = mentions.groupBy("doc_id", "name").agg(ordered.alias("_a"))
    new = arrived.select(
        "doc_id", "name", F.transform("_a", lambda x: x["description"]).alias("_texts"),
        F.col("_a")[0]["is_named_entity"].alias("_named"),
    )
    merged = existing.join(new, ["doc_id", "name"], "full_outer")
    texts = F.coalesce("_texts", F.array().cast("array<string>"))
    return merged.select(
        "doc_id", "name",
        F.aggregate(texts, F.col("summary"), lambda acc, x: _append(acc, x, APPENDED_ENTITY, repeat)).alias("summary"),
        F.coalesce("is_named_entity", "_named").alias("is_named_entity"),
        F.col("summary").isNull().alias("created"),
    )


def supplement_relations(existing: DataFrame, relations: DataFrame, entities: DataFrame, repeat: bool = False) -> DataFrame:
    """The same for relations of stored entities: (doc_id, source, target, description)."""
    for end in ("source", "target"):
        relations = relations.join(entities.select("doc_id", F.col("name").alias(end)), ["doc_id", end], "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("seen_at", "description")))
    new = relations.groupBy("doc_id", "source", "target").agg(F.transform(ordered, lambda x: x["description"]).alias("_texts"))
    merged = existing.join(new, ["doc_id", "source", "target"], "full_outer")
    texts = F.coalesce("_texts", F.array().cast("array<string>"))
    return merged.select(
        "doc_id", "source", "target",
        F.aggregate(texts, F.col("description"), lambda acc, x: _append(acc, x, APPENDED_RELATION, repeat)).alias("description"),
    )


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Remove documents with their chunks, entities, edges and links from every table."""
    gone = ids.select("doc_id").distinct()
    left = {}
    for name, df in tables.items():
        if name == "same_as":
            lost = tables["entities"].join(gone, "doc_id", "left_semi").select("entity_id")
            for end in ("entity_1_id", "entity_2_id"):
                df = df.join(lost.withColumnRenamed("entity_id", end), end, "left_anti")
            left[name] = df
        else:
            left[name] = df.join(gone, "doc_id", "left_anti")
    return left


def delete_entities(entities: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept entities, deleted count per document) for targets (doc_id[, name])."""
    on = ["doc_id", "name"] if "name" in targets.columns else ["doc_id"]
    lost = entities.join(targets.select(*on).distinct(), on, "left_semi")
    return entities.join(targets.select(*on).distinct(), on, "left_anti"), lost.groupBy("doc_id").agg(F.count("*").alias("deleted"))
