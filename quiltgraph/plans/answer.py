"""Questions to answers: route, plan, gather evidence, decide, and ask again if needed."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph import schemas
from quiltgraph.config import Settings
from quiltgraph.functions.sizes import cut_lineage, safe_unions
from quiltgraph.models.clients import Embedder, HashingEmbedder, embed
from quiltgraph.operators.evidence import Knowledge, assist_evidence, gather, main_evidence, route
from quiltgraph.operators.prep import not_done
from quiltgraph.operators.reasoning import RuleReasoner
from quiltgraph.sources.lines import parsed, read_answered, read_lines
from quiltgraph.sources.store import write_jsonl

DEFAULT = Settings()


def turn(questions: DataFrame, know: Knowledge, reasoner, embedder: Embedder, settings: Settings) -> DataFrame:
    """One turn for every question: decision columns plus routed and planned documents."""
    asked = cut_lineage(questions.withColumn("vector", embed(F.col("question"), embedder)))
    names = cut_lineage(reasoner.names(asked))
    routed = cut_lineage(route(asked, names, know, settings))
    # Each of these is read several times below, so it is made once.
    plan = cut_lineage(reasoner.plan(asked, routed, names, know))
    main, assist = plan.filter("role = 'main'"), plan.filter("role = 'assist'")
    selected = cut_lineage(reasoner.select(asked, main, names, know))
    first = main_evidence(main, selected, asked, know, settings)
    second = assist_evidence(assist, know)
    # Main documents come first, each kind in plan order.
    rows = first.withColumn("position", F.struct(F.lit(0).alias("kind"), F.col("position"))).unionByName(
        second.withColumn("position", F.struct(F.lit(1).alias("kind"), F.col("position")))
    )
    docs = routed.groupBy("question_id").agg(F.array_sort(F.collect_set("doc_id")).alias("routed_documents"))
    planned = plan.groupBy("question_id").agg(F.array_sort(F.collect_set("doc_id")).alias("planned_documents"))
    state = asked.drop("vector").join(gather(rows), "question_id", "left").join(docs, "question_id", "left").join(planned, "question_id", "left")
    state = cut_lineage(state)
    return state.drop("history").join(reasoner.decide(state), "question_id").join(questions.select("question_id", "history"), "question_id")


def answer(
    questions: DataFrame, know: Knowledge, reasoner=RuleReasoner(), embedder: Embedder | None = None,
    settings: Settings = DEFAULT, sink: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """``question_id, question, answer, turns, main_documents, planned_documents, conversation_history``.

    ``sink`` gets the answers of every turn when it is done, so that they survive a later turn that stops.

    At most ``max_turns`` turns run, each over the questions still open. At the
    limit the answer is the last follow-up question. ``main_documents`` are all
    routed documents of all turns.
    """
    embedder = embedder or HashingEmbedder()
    safe_unions(questions)
    doc_list = F.array().cast(f"array<{know.documents.schema['doc_id'].dataType.simpleString()}>")
    open_rows = questions.select(
        "question_id", F.col("question").alias("original"), "question", F.lit("").alias("history"),
        doc_list.alias("main_documents"), doc_list.alias("all_planned"),
    )
    done = None
    for number in range(1, settings.max_turns + 1):
        result = turn(open_rows.select("question_id", "question", "history"), know, reasoner, embedder, settings)
        keep = open_rows.select("question_id", "original", "main_documents", "all_planned")
        line = F.concat(F.lit("User Question: "), "question", F.lit("\nLLM Summary: "), F.coalesce("summary", F.lit("None")))
        merged = result.join(keep, "question_id").select(
            "question_id", "original", "decision", "content",
            F.when(F.col("history") == "", line).otherwise(F.concat("history", F.lit("\n"), line)).alias("history"),
            F.array_sort(F.array_union("main_documents", F.coalesce("routed_documents", doc_list))).alias("main_documents"),
            F.array_sort(F.array_union("all_planned", F.coalesce("planned_documents", doc_list))).alias("all_planned"),
            F.lit(number).alias("turns"),
        )
        merged = cut_lineage(merged)
        last = number == settings.max_turns
        finished = _told(merged if last else merged.filter("decision = 'ANSWER'"))
        if sink is not None:
            sink(finished)
        done = finished if done is None else done.unionByName(finished)
        if last:
            break
        open_rows = merged.filter("decision <> 'ANSWER'").select(
            "question_id", "original", F.col("content").alias("question"), "history", "main_documents", "all_planned"
        )
        if open_rows.isEmpty():
            break
    return done


def _told(rows: DataFrame) -> DataFrame:
    return rows.select(
        "question_id", F.col("original").alias("question"), F.col("content").alias("answer"), "turns", "main_documents",
        F.col("all_planned").alias("planned_documents"), F.col("history").alias("conversation_history"),
    )


def answer_batches(
    questions: DataFrame, know: Knowledge, log: str, batch_size: int = 1000, reasoner=RuleReasoner(), embedder: Embedder | None = None,
    settings: Settings = DEFAULT,
) -> DataFrame:
    """Answer all questions (question_id, question) that ``log`` does not hold yet, batch by batch; returns the log's rows.

    The answers of every turn are appended when it is done, so a run that stops loses at most the turn it is in.
    """
    spark = questions.sparkSession
    done = read_answered(spark, log).select(F.col("id").alias("question_id"))
    rows = questions.withColumn("question_id", F.col("question_id").cast("string"))
    left = cut_lineage(not_done(rows, done, "question_id"))
    batches = math.ceil(left.count() / batch_size)

    def append(told: DataFrame) -> None:
        write_jsonl(told.select(
            F.col("question_id").alias("id"), "question", F.col("answer").alias("LLM_answer"),
            F.transform("main_documents", lambda d: d.cast("string")).alias("LLM_ids")), log, append=True)

    for number in range(batches):
        part = left.filter(F.pmod(F.xxhash64("question_id"), F.lit(batches)) == number)
        answer(part, know, reasoner, embedder, settings, sink=append)
    return parsed(read_lines(spark, log), schemas.ANSWER_LOG).filter("id is not null")
