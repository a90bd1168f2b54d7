import json

import pytest
from pyspark.sql import functions as F

from quiltgraph import answer, ingest
from quiltgraph.config import Settings
from quiltgraph.operators import evidence
from quiltgraph.operators.linking import fast_links
from quiltgraph.operators.reasoning import ModelReasoner, RuleReasoner

DOCS = [
    (1, "Here Alpha met Beta near Gamma while they walked and talked a lot today"),
    (2, "Later Alpha saw Delta near Omega while they walked and talked a lot today"),
    (3, "nothing with names but enough words to be read as one meaningful chunk here"),
]


@pytest.fixture(scope="module")
def know(spark):
    made = ingest(spark.createDataFrame(DOCS, "doc_id long, text string"))
    return made.knowledge(fast_links(made.entities))


def ask(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "question_id int, question string")


class Scripted:
    """Decides by the question: 'direct' answers at once, 'step' asks once more, anything else never ends."""

    def __init__(self, plan='{"main_documents": ["1"], "assist_documents": {"2": ["delta", "nobody"]}}'):
        self.plan = plan

    def generate(self, prompts):
        return [self.one(p) for p in prompts]

    def one(self, p):
        if p.startswith("Which entities does"):
            return json.dumps({"entities": ["Alpha", "Beta"]})
        if p.startswith("Choose the documents"):
            return self.plan
        if p.startswith("Which of these"):
            return '```json\n{"selected_entities": ["beta"]}\n```'
        question = p.split("Question: ")[1].split("\n")[0]
        if question.startswith("direct"):
            return json.dumps({"decision": "ANSWER", "content": "done", "summary": "s"})
        if question.startswith("step"):
            return json.dumps({"decision": "SUB_QUESTION", "content": "direct next", "summary": "more"})
        if question.startswith("bad"):
            return "{}"
        return json.dumps({"decision": "SUB_QUESTION", "content": "again " + question, "summary": None})


def scripted():
    return Scripted()


def broken_plan():
    return Scripted(plan="no plan")


def test_loop(spark, know):
    got = {r["question"]: r for r in answer(ask(spark, "direct q", "step q", "endless", "bad q"), know, ModelReasoner(scripted)).collect()}
    one = got["direct q"]
    assert (one["answer"], one["turns"]) == ("done", 1)
    assert one["conversation_history"] == "User Question: direct q\nLLM Summary: s"
    two = got["step q"]
    assert (two["answer"], two["turns"]) == ("done", 2) and "User Question: direct next" in two["conversation_history"]
    last = got["endless"]
    assert (last["answer"], last["turns"]) == ("again again again endless", 3)
    assert got["bad q"]["answer"] == "bad q" and got["bad q"]["turns"] == 3
    assert set(one["planned_documents"]) == {1, 2} and set(one["main_documents"]) >= {1, 2}


def test_plan_fallback(spark, know):
    from quiltgraph.models.clients import HashingEmbedder, embed

    q = ask(spark, "direct q").withColumn("vector", embed(F.col("question"), HashingEmbedder()))
    reasoner = ModelReasoner(broken_plan)
    names = reasoner.names(q)
    routed = evidence.route(q, names, know)
    plan = reasoner.plan(q, routed, names, know).collect()
    assert {r["role"] for r in plan} == {"main"} and {r["doc_id"] for r in plan} == {r["doc_id"] for r in routed.collect()}


def test_evidence_texts(spark, know):
    from quiltgraph.models.clients import HashingEmbedder, embed

    q = ask(spark, "x").withColumn("vector", embed(F.col("question"), HashingEmbedder()))
    main = spark.createDataFrame([(0, 1, 1), (0, 3, 2), (0, 77, 3)], "question_id int, doc_id long, position int")
    selected = spark.createDataFrame([(0, 1, "alpha")], "question_id int, doc_id long, name string")
    texts = {r["doc_id"]: r["text"] for r in evidence.main_evidence(main, selected, q, know).collect()}
    assert texts[1].startswith("Source: Document 1\nRelevant Entity Summaries:\n- alpha: ") and "Relevant Document Chunks:\n- \"Here" in texts[1]
    assert texts[1].count("- alpha: ") == 2, "the linked entity of document 2 brings its own summary"
    assert texts[3] == "Source: Document 3" and texts[77].endswith("Error: Document metadata not found.")
    same = {r["doc_id"]: r["text"] for r in evidence.main_evidence(main, selected, q, know, linked_summaries=False).collect()}
    assert same[1].count("- alpha: ") == 1
    assist = spark.createDataFrame([(0, 2, 1, ["delta"]), (0, 1, 2, ["nobody"]), (0, 3, 3, [])], "question_id int, doc_id long, position int, names array<string>")
    got = {r["doc_id"]: r["text"] for r in evidence.assist_evidence(assist, know).collect()}
    assert got[2].startswith("Source: Document 2\n- Entity: delta\n  Summary: ") and got[3] == ""
    assert got[1] == "Source: Document 1\n- No information found for entities: ['nobody']"


def test_rules_answer(spark, know):
    got = answer(ask(spark, "Who met Alpha and Beta?", "who?"), know, RuleReasoner(), settings=Settings(max_turns=2)).collect()
    by = {r["question"]: r for r in got}
    assert by["Who met Alpha and Beta?"]["turns"] == 1 and by["who?"]["turns"] == 2 and by["who?"]["answer"] == ""


def test_batches_are_taken_up_where_a_run_stopped(spark, know, folder):
    from quiltgraph.plans.answer import answer_batches

    log = f"{folder}/answers"
    first = answer_batches(ask(spark, "direct q", "step q"), know, log, 1, ModelReasoner(scripted))
    assert {r["id"]: r["LLM_answer"] for r in first.collect()} == {"0": "done", "1": "done"}
    more = answer_batches(ask(spark, "direct q", "step q", "endless"), know, log, 2, ModelReasoner(scripted))
    assert sorted(r["id"] for r in more.collect()) == ["0", "1", "2"] and more.filter("id = '0'").count() == 1


def test_placeholder_summaries_are_recalled_on_demand(spark, know):
    from dataclasses import replace

    from quiltgraph.models.clients import HashingEmbedder, embed

    hidden = replace(know, documents=know.documents.withColumn("placeholder", F.lit(True)))
    asked = ask(spark, "walked and talked").withColumn("vector", embed(F.col("question"), HashingEmbedder()))
    names = spark.createDataFrame([], "question_id int, name string")
    assert evidence.route(asked, names, hidden).count() == 0
    assert evidence.route(asked, names, hidden, placeholders=True).count() == 3


def test_evidence_embeds_the_chunks_and_entities_it_reads_only(spark, know):
    from dataclasses import replace

    from quiltgraph.models.clients import HashingEmbedder, embed

    seen = {"content": [], "summary": []}

    def made(column):
        def run(rows):
            seen[column] += [r["doc_id"] for r in rows.select("doc_id").collect()]
            return rows.withColumn("vector", embed(F.col(column), HashingEmbedder()))

        return run

    q = ask(spark, "x").withColumn("vector", embed(F.col("question"), HashingEmbedder()))
    main = spark.createDataFrame([(0, 1, 1), (0, 3, 2), (0, 77, 3)], "question_id int, doc_id long, position int")
    selected = spark.createDataFrame([(0, 1, "alpha"), (0, None, "alpha"), (0, 1, None)], "question_id int, doc_id long, name string")
    lazy = replace(know, embed_chunks=made("content"), embed_entities=made("summary"))
    want = sorted(map(tuple, evidence.main_evidence(main, selected, q, know).collect()))
    assert sorted(map(tuple, evidence.main_evidence(main, selected, q, lazy).collect())) == want and len(want) == 3
    assert set(seen["content"]) == {1}, "only document 1 has a selected name"
    assert set(seen["summary"]) == {1, 2} and len(seen["summary"]) == 2, "alpha of document 1 and what it is linked to"
