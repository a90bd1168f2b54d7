"""Question-side decisions: names, plan, entity selection and synthesis.

``RuleReasoner`` decides with Spark expressions; ``ModelReasoner`` asks a text
model and falls back as documented on each method.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph import schemas
from quiltgraph.functions import prompts
from quiltgraph.functions.replies import braces_json, lenient_json, plain_json
from quiltgraph.functions.sizes import cut_lineage
from quiltgraph.functions.text import normalize_name
from quiltgraph.models.clients import TextModel, replies
from quiltgraph.operators.evidence import SUMMARIES, Knowledge, _metadata, planning_context, shared_names
from quiltgraph.operators.extract import question_names


def _empty_names():
    return F.array().cast("array<string>")


@dataclass(frozen=True)
class RuleReasoner:
    """The two best documents are read in full, the others looked up for shared names."""

    main_documents: int = 2

    def names(self, questions: DataFrame) -> DataFrame:
        return questions.select("question_id", F.explode(question_names(F.col("question"))).alias("name"))

    def plan(self, questions: DataFrame, routed: DataFrame, names: DataFrame, know: Knowledge) -> DataFrame:
        shared = shared_names(routed, names, know).groupBy("question_id", "doc_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
        rows = routed.select("question_id", "doc_id", F.col("rank").alias("position")).join(shared, ["question_id", "doc_id"], "left")
        role = F.when(F.col("position") <= self.main_documents, "main").otherwise("assist")
        return rows.select("question_id", "doc_id", "position", role.alias("role"), F.coalesce("names", _empty_names()).alias("names"))

    def select(self, questions: DataFrame, main: DataFrame, names: DataFrame, know: Knowledge) -> DataFrame:
        return main.select("question_id", "doc_id", F.explode("names").alias("name"))

    def decide(self, turn: DataFrame) -> DataFrame:
        """Answer once a main document holds a relevant entity, else drop the question's first word."""
        found = F.coalesce(F.contains("evidence", F.lit(SUMMARIES)), F.lit(False))
        return turn.select(
            "question_id",
            F.when(found, "ANSWER").otherwise("SUB_QUESTION").alias("decision"),
            F.when(found, F.concat(F.lit("Answered from evidence "), F.md5("evidence")))
            .otherwise(F.regexp_replace("question", r"^\S+\s*", "")).alias("content"),
            F.concat(F.coalesce("n_evidence", F.lit(0)).cast("string"), F.lit(" pieces of evidence")).alias("summary"),
        )


@dataclass(frozen=True)
class ModelReasoner:
    """The same decisions by a text model. Replies are written out before they are read."""

    model: Callable[[], TextModel]
    innermost_json: bool = False

    def _ask(self, rows: DataFrame, template: str, **values) -> DataFrame:
        prompt = prompts.render(prompts.TEMPLATES[template], **values)
        return cut_lineage(rows.withColumn("reply", F.coalesce(replies(prompt, self.model), F.lit(""))))

    def names(self, questions: DataFrame) -> DataFrame:
        """No fallback: a reply that is not plain JSON names nothing."""
        asked = self._ask(questions.select("question_id", "question"), "question_entities", question=F.col("question"))
        found = F.from_json(plain_json(F.col("reply")), schemas.NAMES_REPLY).getField("entities")
        return asked.select("question_id", F.explode(found).alias("name")).select("question_id", normalize_name(F.col("name")).alias("name"))

    def plan(self, questions: DataFrame, routed: DataFrame, names: DataFrame, know: Knowledge) -> DataFrame:
        """A reply without usable JSON makes every routed document a main one."""
        rows = questions.select("question_id", "question").join(planning_context(routed, know), "question_id", "left")
        rows = rows.join(routed.select("question_id").distinct(), "question_id", "left_semi")
        asked = self._ask(rows, "retrieval_plan", question=F.col("question"), context=F.col("context"))
        parsed = asked.select("question_id", F.from_json(braces_json(F.col("reply")), schemas.PLAN_REPLY).alias("p"), braces_json(F.col("reply")).alias("j"))
        main = parsed.filter("j is not null").select(
            "question_id", F.posexplode(F.coalesce("p.main_documents", _empty_names())).alias("position", "doc_id"),
            F.lit("main").alias("role"), _empty_names().alias("names"),
        )
        entries = F.map_entries(F.coalesce("p.assist_documents", F.create_map().cast("map<string,array<string>>")))
        assist = parsed.filter("j is not null").select("question_id", F.posexplode(entries).alias("position", "e")).select(
            "question_id", (F.col("position") + 1_000_000).alias("position"), F.col("e.key").alias("doc_id"),
            F.lit("assist").alias("role"), F.coalesce("e.value", _empty_names()).alias("names"),
        )
        failed = parsed.filter("j is null").select("question_id")
        fallback = routed.join(failed, "question_id", "left_semi").select(
            "question_id", F.col("rank").alias("position"), F.col("doc_id").cast("string").alias("doc_id"),
            F.lit("main").alias("role"), _empty_names().alias("names"),
        )
        rows = main.unionByName(assist).unionByName(fallback)
        return rows.withColumn("doc_id", F.col("doc_id").cast(routed.schema["doc_id"].dataType))

    def select(self, questions: DataFrame, main: DataFrame, names: DataFrame, know: Knowledge) -> DataFrame:
        """Names chosen from a document's list; a bad reply chooses none."""
        meta = _metadata(main.select("question_id", F.col("position").alias("rank"), "doc_id"), know)
        rows = meta.filter(F.size("entities") > 0).join(questions.select("question_id", "question"), "question_id")
        asked = self._ask(rows, "entity_selection", question=F.col("question"), summary=F.col("summary"), names=F.to_json("entities"))
        json = lenient_json(F.col("reply"), self.innermost_json)
        chosen = F.from_json(json, schemas.SELECTION_REPLY).getField("selected_entities")
        return asked.select("question_id", "doc_id", F.explode(chosen).alias("name")).distinct()

    def decide(self, turn: DataFrame) -> DataFrame:
        """Any failure asks the same question again."""
        rows = turn.select("question_id", "question", "history", "evidence")
        asked = self._ask(rows, "synthesis", question=F.col("question"), history=F.col("history"), evidence=F.col("evidence"))
        json = lenient_json(F.col("reply"), self.innermost_json)
        d = F.from_json(json, schemas.DECISION_REPLY)
        usable = d.getField("decision").isNotNull() & d.getField("content").isNotNull()
        usable = F.coalesce(usable, F.lit(False))
        return asked.select(
            "question_id",
            F.when(usable, d.getField("decision")).otherwise("SUB_QUESTION").alias("decision"),
            F.when(usable, d.getField("content")).otherwise(F.col("question")).alias("content"),
            F.when(usable, d.getField("summary")).otherwise("Error: the reply held no valid decision").alias("summary"),
        )
