"""Routing, planning context and evidence text for batches of questions.

A question batch is a table ``question_id, question``. Routed rows are
``question_id, rank, doc_id``; plan rows add ``role`` (main or assist) and the
``names`` to look up in an assist document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.config import Settings
from quiltgraph.functions.sizes import cut_lineage, join_lookup
from quiltgraph.functions.text import quoted_list
from quiltgraph.functions.vectors import cosine, dot, squared_norm
from quiltgraph.operators.graph import document_metadata, documents_by_names, linked_entities
from quiltgraph.operators.nearest import nearest
from quiltgraph.operators.ranking import fuse_rankings, top_k

DEFAULT = Settings()

# The layout of planning context and evidence.
SOURCE = "Source: Document "
SUMMARIES = "Relevant Entity Summaries:\n"
CHUNKS = "Relevant Document Chunks:\n"
NOT_FOUND = "\nError: Document metadata not found."
NOTHING_FOR = "\n- No information found for entities: "


@dataclass(frozen=True)
class Knowledge:
    """The tables that answering reads. Vectors are (…, vector) columns beside the text."""

    documents: DataFrame      # doc_id, summary, placeholder, vector
    chunks: DataFrame         # chunk_id, doc_id, chunk_order_index, content, vector
    entities: DataFrame       # entity_id, doc_id, name, summary, is_named_entity, vector
    sourced_from: DataFrame   # entity_id, chunk_id, doc_id
    same_as: DataFrame        # entity_1_id, entity_2_id, score
    #: Add ``vector`` to chunks and entities; then vectors are made for the rows that are read, else they are read as stored.
    embed_chunks: Callable[[DataFrame], DataFrame] | None = None
    embed_entities: Callable[[DataFrame], DataFrame] | None = None


def route(
    questions: DataFrame, names: DataFrame, know: Knowledge, settings: Settings = DEFAULT, top: int | None = None,
    placeholders: bool = False,
) -> DataFrame:
    """Graph recall and vector recall fused by reciprocal rank: best ``top`` documents per question.

    ``questions`` carries ``vector``; ``names`` is (question_id, name). Documents
    whose summary is a placeholder are not recalled by vector, unless ``placeholders``.
    """
    top = top or settings.route_top_k
    width = settings.recall_width(top)
    by_name = documents_by_names(names, know.entities, width, settings)
    summaries = know.documents.filter(F.lit(placeholders) | ~F.col("placeholder")).select("doc_id", "vector")
    by_vector = nearest(questions, summaries, "question_id", "doc_id", width, "unit_l2", settings)
    lists = by_name.select("question_id", "doc_id", F.lit(0).alias("list_no"), "rank").unionByName(
        by_vector.select("question_id", "doc_id", F.lit(1).alias("list_no"), "rank")
    )
    return fuse_rankings(lists, "question_id", "doc_id", settings.rrf_k, keep=top)


def planning_context(routed: DataFrame, know: Knowledge) -> DataFrame:
    """One text per question: id, summary and names of each routed document, best first."""
    meta = _metadata(routed, know)
    line = F.concat(
        F.lit("- Document ID: "), F.col("doc_id").cast("string"), F.lit("\n  Summary: "), "summary",
        F.lit("\n  Entities: "), quoted_list(F.col("entities")),
    )
    rows = meta.filter(F.coalesce("summary", F.lit("")) != "").select("question_id", "rank", line.alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return rows.groupBy("question_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("context"))


def _metadata(routed: DataFrame, know: Knowledge) -> DataFrame:
    """Summary and names of the routed documents only."""
    wanted = routed.select("doc_id").distinct()
    docs = know.documents.select("doc_id", "summary").join(wanted, "doc_id", "left_semi")
    edges = know.sourced_from.select("doc_id", "entity_id").join(wanted, "doc_id", "left_semi")
    meta = document_metadata(docs, edges, know.entities)
    return routed.select("question_id", "rank", "doc_id").join(meta, "doc_id", "left")


def shared_names(routed: DataFrame, names: DataFrame, know: Knowledge) -> DataFrame:
    """Question names that a routed document holds: (question_id, doc_id, rank, name)."""
    met = routed.select("question_id", "doc_id", "rank").join(names, "question_id")
    return join_lookup(know.entities.select("doc_id", "name"), met, ["doc_id", "name"])


def expand(selected: DataFrame, questions: DataFrame, know: Knowledge, settings: Settings = DEFAULT) -> DataFrame:
    """Entities linked to selected ones, nearest to the question first.

    ``selected`` is (question_id, doc_id, name). Only entities with a summary
    count; the best ``expansion_limit`` per question and document remain.
    """
    ids = cut_lineage(join_lookup(know.entities.select("doc_id", "name", "entity_id"), selected, ["doc_id", "name"], settings))
    # Links and entities are cut down to what the selected ones reach before texts move; few ids are sent to the texts.
    links, own = know.same_as.select("entity_1_id", "entity_2_id"), cut_lineage(ids.select("entity_id").distinct())
    for end in ("entity_1_id", "entity_2_id"):
        links = join_lookup(links, own.select(F.col("entity_id").alias(end), F.lit(True).alias(f"_{end}")), [end], settings, "left")
    links = cut_lineage(links.filter("_entity_1_id or _entity_2_id").select("entity_1_id", "entity_2_id"))
    ends = cut_lineage(links.select(F.explode(F.array("entity_1_id", "entity_2_id")).alias("entity_id")).distinct())
    reached = cut_lineage(join_lookup(know.entities.select("entity_id", "doc_id", "name", "summary"), ends, ["entity_id"], settings, "left_semi"))
    linked = linked_entities(ids.select("question_id", "doc_id", "entity_id"), links, reached)
    if know.embed_entities is None:
        needed = join_lookup(know.entities.select("entity_id", "vector"), ends, ["entity_id"], settings, "left_semi")
    else:
        needed = know.embed_entities(reached)
    vectors = needed.select(F.col("entity_id").alias("linked_id"), F.col("vector").alias("_ev"))
    near = linked.filter(F.coalesce("linked_summary", F.lit("")) != "").join(vectors, "linked_id")
    near = near.join(questions.select("question_id", F.col("vector").alias("_qv")), "question_id")
    scored = near.withColumn("similarity", F.round(cosine(F.col("_qv"), F.col("_ev")), 9)).drop("_ev", "_qv")
    return top_k(scored, ["question_id", "doc_id"], [F.desc("similarity"), F.asc("linked_id")], settings.expansion_limit)


def best_chunks(
    targets: DataFrame, questions: DataFrame, chunks: DataFrame, k: int, vectors: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The ``k`` nearest chunks to the question inside each target (question_id, doc_id).

    ``vectors`` adds ``vector`` to the chunks of the targets; by default it is a column of ``chunks``.
    """
    targets = cut_lineage(targets.select("question_id", "doc_id").distinct())
    wanted, held = targets.select("doc_id").distinct(), ["chunk_id", "doc_id", "chunk_order_index", "content"]
    if vectors is None:
        near = join_lookup(chunks.select(*held, "vector"), wanted, ["doc_id"], how="left_semi")
    else:
        near = vectors(cut_lineage(join_lookup(chunks.select(*held), wanted, ["doc_id"], how="left_semi")))
    met = near.select(*held, F.col("vector").alias("_cv")).join(targets, "doc_id")
    met = met.join(questions.select("question_id", F.col("vector").alias("_qv")), "question_id")
    cos = F.coalesce(F.try_divide(dot(F.col("_qv"), F.col("_cv")), F.sqrt(squared_norm(F.col("_qv")) * squared_norm(F.col("_cv")))), F.lit(0.0))
    scored = met.withColumn("distance", F.round(F.lit(2.0) - F.lit(2.0) * cos, 6)).drop("_cv", "_qv")
    return top_k(scored, ["question_id", "doc_id"], [F.asc("distance"), F.asc("chunk_id")], k)


def _joined(rows: DataFrame, order: list[str], sep: str, out: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(*order, "line")))
    return rows.groupBy("question_id", "doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), sep).alias(out))


def main_evidence(
    main: DataFrame, selected: DataFrame, questions: DataFrame, know: Knowledge,
    settings: Settings = DEFAULT, linked_summaries: bool = True, per_chunk: bool = False,
) -> DataFrame:
    """Evidence text of main documents: ``question_id, doc_id, position, text``.

    ``selected`` is (question_id, doc_id, name). Linked entities of other
    documents bring their own summaries; ``linked_summaries=False`` looks their
    names up in the same document, which adds nothing new. ``per_chunk`` repeats
    an entity once per source chunk. Chunks are read only where a name is relevant.
    """
    selected = cut_lineage(selected.select("question_id", "doc_id", "name"))
    expansion = cut_lineage(expand(selected, questions, know, settings))
    names = selected
    if not linked_summaries:
        names = names.unionByName(expansion.select("question_id", "doc_id", F.col("linked_name").alias("name")))
    names = cut_lineage(names.distinct())
    own = join_lookup(know.entities.select("doc_id", "name", "entity_id", "summary"), names, ["doc_id", "name"], settings)
    if per_chunk:
        own = own.join(know.sourced_from.select("doc_id", "entity_id"), ["doc_id", "entity_id"])
    line = F.concat(F.lit("- "), "name", F.lit(": "), "summary").alias("line")
    lines = own.select("question_id", "doc_id", F.lit(0).alias("part"), F.col("entity_id").alias("key"), line)
    if linked_summaries:
        other = F.concat(F.lit("- "), "linked_name", F.lit(": "), "linked_summary").alias("line")
        lines = lines.unionByName(
            expansion.select("question_id", "doc_id", F.lit(1).alias("part"), F.format_string("%06d", "rank").alias("key"), other)
        )
    summaries = _joined(lines, ["part", "key"], "\n", "summary_lines")
    picked = best_chunks(names, questions, know.chunks, settings.chunk_limit, know.embed_chunks)
    quote = F.concat(F.lit('- "'), "content", F.lit('"')).alias("line")
    chunk_lines = _joined(picked.select("question_id", "doc_id", "rank", quote), ["rank"], "\n", "chunk_lines")
    known = know.documents.select("doc_id", F.lit(True).alias("_known"))
    rows = main.select("question_id", "doc_id", "position").join(known, "doc_id", "left")
    rows = rows.join(summaries, ["question_id", "doc_id"], "left").join(chunk_lines, ["question_id", "doc_id"], "left")
    head = F.concat(F.lit(SOURCE), F.col("doc_id").cast("string"))
    text = F.concat(
        head,
        F.coalesce(F.concat(F.lit("\n" + SUMMARIES), "summary_lines"), F.lit("")),
        F.coalesce(F.concat(F.lit("\n" + CHUNKS), "chunk_lines"), F.lit("")),
    )
    full = F.when(F.col("_known").isNull(), F.concat(head, F.lit(NOT_FOUND))).otherwise(text)
    return rows.select("question_id", "doc_id", "position", full.alias("text"))


def assist_evidence(assist: DataFrame, know: Knowledge) -> DataFrame:
    """Evidence text of assist documents (question_id, doc_id, position, names)."""
    wanted = assist.select("question_id", "doc_id", F.explode("names").alias("name")).distinct()
    found = wanted.join(know.entities.select("doc_id", "name", "summary"), ["doc_id", "name"])
    line = F.concat(F.lit("- Entity: "), "name", F.lit("\n  Summary: "), "summary").alias("line")
    lines = _joined(found.select("question_id", "doc_id", "name", line), ["name"], "\n", "lines")
    rows = assist.join(lines, ["question_id", "doc_id"], "left")
    head = F.concat(F.lit(SOURCE), F.col("doc_id").cast("string"))
    text = (
        F.when(F.size("names") == 0, "")
        .when(F.col("lines").isNull(), F.concat(head, F.lit(NOTHING_FOR), quoted_list(F.col("names"))))
        .otherwise(F.concat(head, F.lit("\n"), "lines"))
    )
    return rows.select("question_id", "doc_id", "position", text.alias("text"))


def gather(evidence: DataFrame) -> DataFrame:
    """All evidence of a question in plan order, blank-line joined."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "text")))
    return evidence.groupBy("question_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("evidence"), F.count("*").alias("n_evidence")
    )
