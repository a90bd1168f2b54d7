"""Links between equally named entities of different documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltgraph.config import Settings
from quiltgraph.functions import prompts
from quiltgraph.functions.replies import braces_json, similarity_score
from quiltgraph.functions.sizes import cut_lineage, join_lookup
from quiltgraph.functions.text import words
from quiltgraph.functions.vectors import cosine, link_score, linking_minutes, pair_count
from quiltgraph.models.clients import TextModel, replies
from quiltgraph.operators.ranking import top_k

DEFAULT = Settings()
FAST_SCORE = 10.0


def candidate_groups(entities: DataFrame, settings: Settings = DEFAULT, carry: list[str] | None = None) -> DataFrame:
    """Names held by ``min_docs`` to ``max_docs`` named entities: ``name, n_entities, members``.

    Keeping one entity more than ``max_docs`` per name tells a group that is too
    large, so no group ever holds more than that, however common its name is.
    """
    fields = ["entity_id", "doc_id", *(carry or [])]
    near = top_k(entities.filter("is_named_entity").select("name", *fields), "name", [F.asc("entity_id")], settings.max_docs + 1)
    groups = near.groupBy("name").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("members"))
    sized = groups.withColumn("n_entities", F.size("members"))
    return sized.filter(F.col("n_entities").between(settings.min_docs, settings.max_docs))


def candidate_pairs(groups: DataFrame) -> DataFrame:
    """Every pair of a group once, lower entity id first: ``name, a.*, b.*`` as structs ``a`` and ``b``."""
    pairs = F.flatten(F.transform("members", lambda a, i: F.transform(
        F.slice("members", i + 2, F.size("members")), lambda b: F.struct(a.alias("a"), b.alias("b"))
    )))
    return groups.select("name", F.explode(pairs).alias("_p")).select("name", "_p.a", "_p.b")


@dataclass(frozen=True)
class RuleScorer:
    """Shared words over all words of two summaries, scaled to 0-10."""

    def score(self, pairs: DataFrame) -> DataFrame:
        one, two = words(F.col("a.summary")), words(F.col("b.summary"))
        shared = F.size(F.array_intersect(one, two))
        ratio = F.try_divide(shared * 10, F.size(F.array_union(one, two)))
        score = F.coalesce(F.floor(ratio), F.lit(0)).cast("int")
        return pairs.withColumn("llm_score", score).withColumn("llm_reasoning", F.concat(shared.cast("string"), F.lit(" shared words")))


@dataclass(frozen=True)
class ModelScorer:
    """Score by a text model: no or broken JSON is 0, a score that is no number drops the pair."""

    model: Callable[[], TextModel]

    def score(self, pairs: DataFrame) -> DataFrame:
        prompt = prompts.render(
            prompts.TEMPLATES["similarity"], name_1=F.col("name"), summary_1=F.col("a.summary"),
            name_2=F.col("name"), summary_2=F.col("b.summary"),
        )
        asked = cut_lineage(pairs.withColumn("_reply", replies(prompt, self.model)))
        json = braces_json(F.coalesce("_reply", F.lit("")))
        scored = asked.withColumn("llm_score", F.when(json.isNull(), 0).otherwise(similarity_score(json)))
        reason = F.coalesce(F.get_json_object(json, "$.reasoning"), F.lit(""))
        return scored.withColumn("llm_reasoning", reason).drop("_reply").filter(F.col("llm_score").isNotNull())


def python_round(c: Column, digits: int) -> Column:
    """Round as Python does, half to even on the exact binary value."""

    @F.pandas_udf("double")
    def rounded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: round(x, digits), na_action="ignore")

    return rounded(c)


def score_pairs(pairs: DataFrame, scorer=RuleScorer(), settings: Settings = DEFAULT, threshold_rounded: bool = False) -> DataFrame:
    """Hybrid score of pairs whose entities both carry ``vector`` and ``summary``."""
    usable = pairs.filter(F.col("a.vector").isNotNull() & F.col("b.vector").isNotNull())
    scored = scorer.score(usable).withColumn("embedding_score", cosine(F.col("a.vector"), F.col("b.vector")))
    total = link_score(F.col("llm_score"), F.col("embedding_score"), settings.model_weight, settings.vector_weight)
    details = scored.select(
        F.col("a.entity_id").alias("entity_1_id"), F.col("b.entity_id").alias("entity_2_id"),
        F.col("name").alias("entity_1_name"), F.col("name").alias("entity_2_name"),
        "llm_score", "llm_reasoning", "embedding_score", total.alias("final_score"),
    )
    if threshold_rounded:
        details = details.withColumn("final_score", python_round(F.col("final_score"), 2))
    return details.withColumn("is_linked", F.col("final_score") >= settings.link_threshold)


def _with_members(pairs: DataFrame, entities: DataFrame, vectors: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (name, one, two) with summaries and vectors as structs ``a`` and ``b``; only entities of pairs are looked up.

    A lazy vector is made for those only: the entities are cut down before their vectors are joined. Each text goes to its
    name's group once, which holds at most ``max_docs`` of them, and the pairs are formed there.
    """
    members = pairs.select("name", F.explode(F.array("one", "two")).alias("entity_id")).distinct()
    if callable(vectors):
        told = members.join(vectors(members.select("entity_id")), "entity_id")
    else:
        told = members.join(entities.select("entity_id", "summary"), "entity_id").join(vectors.select("entity_id", "vector"), "entity_id", "left")
    full = told.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("entity_id", "summary", "vector"))).alias("members"))
    wanted = pairs.groupBy("name").agg(F.collect_set(F.struct("one", "two")).alias("_wanted"))
    held = F.array_contains("_wanted", F.struct(F.col("a.entity_id").alias("one"), F.col("b.entity_id").alias("two")))
    return candidate_pairs(full).join(wanted, "name").filter(held).select("name", "a", "b")


def link_entities(
    entities: DataFrame, vectors: DataFrame | Callable[[DataFrame], DataFrame], scorer=RuleScorer(), settings: Settings = DEFAULT
) -> DataFrame:
    """All scored pairs of candidate entities; ``vectors`` is (entity_id, vector), or adds ``vector`` to rows with a summary.

    Groups are formed on ids; summaries and vectors are joined to the members of
    surviving groups only, at most ``max_docs`` for each name, and made for these only.
    """
    groups = cut_lineage(candidate_groups(entities, settings))
    members = groups.select("name", F.explode("members").alias("m")).select("name", "m.entity_id")
    told = members.join(entities.select("entity_id", "summary"), "entity_id")
    told = vectors(told) if callable(vectors) else told.join(vectors.select("entity_id", "vector"), "entity_id", "left")
    full = told.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("entity_id", "summary", "vector"))).alias("members"))
    return score_pairs(candidate_pairs(full), scorer, settings)


def entity_mark() -> Column:
    """What linking reads of an entity, as one number."""
    return F.xxhash64("name", "is_named_entity", "summary")


def changed_entities(before: DataFrame, after: DataFrame) -> DataFrame:
    """``entity_id, name`` of entities that came, went, or changed in name, flag or summary; a changed name counts twice.

    A column ``mark`` of both sides stands for ``entity_mark``.
    """
    mark = entity_mark() if "mark" not in after.columns else F.col("mark")
    old, new = before.select("entity_id", F.col("name").alias("_was"), mark.alias("_old")), after.select("entity_id", "name", mark.alias("_new"))
    moved = old.join(new, "entity_id", "full").filter(~F.col("_old").eqNullSafe(F.col("_new")))
    return moved.select("entity_id", F.explode(F.array_distinct(F.array("_was", "name"))).alias("name")).filter("name is not null")


@dataclass(frozen=True)
class LinkChange:
    """``scored``: details to add or replace. ``withdrawn`` (entity_1_id, entity_2_id): stored details that hold no more."""

    scored: DataFrame
    withdrawn: DataFrame


def link_changes(
    entities: DataFrame, vectors: DataFrame | Callable[[DataFrame], DataFrame], changed: DataFrame, details: DataFrame, scorer=RuleScorer(),
    settings: Settings = DEFAULT,
) -> LinkChange:
    """What linking again would change in stored ``details``, from the ``changed`` (entity_id, name) alone.

    ``vectors`` is (entity_id, vector), or gives ``entity_id, summary, vector`` of the ids (entity_id) it is called with;
    then ``entities`` needs no summary.

    Only names of changed entities are looked at. Their groups are formed anew from all current ``entities``: a name may
    have come to two entities, grown past ``max_docs`` (all its links go) or shrunk back (all of them come). A pair that is
    stored, still holds and has no changed member is left as it is and not scored again.
    """
    names = cut_lineage(changed.select("name").distinct())
    moved = changed.select("entity_id").distinct()
    groups = candidate_groups(join_lookup(entities, names, ["name"], settings, "left_semi"), settings)
    pairs = cut_lineage(candidate_pairs(groups).select("name", F.col("a.entity_id").alias("one"), F.col("b.entity_id").alias("two")))
    held = join_lookup(details.select(F.col("entity_1_name").alias("name"), F.col("entity_1_id").alias("one"), F.col("entity_2_id").alias("two")),
                       names, ["name"], settings, "left_semi").drop("name")
    same = held
    for side in ("one", "two"):
        same = same.join(moved.withColumnRenamed("entity_id", side), side, "left_anti")
    stay = cut_lineage(same.join(pairs.select("one", "two"), ["one", "two"], "left_semi").distinct())
    fresh = pairs.join(stay, ["one", "two"], "left_anti")
    gone = held.join(stay, ["one", "two"], "left_anti").distinct()
    return LinkChange(
        score_pairs(_with_members(fresh, entities, vectors), scorer, settings),
        gone.select(F.col("one").alias("entity_1_id"), F.col("two").alias("entity_2_id")))


def fast_links(entities: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Every candidate pair linked with the full score, without asking a model."""
    pairs = candidate_pairs(candidate_groups(entities, settings))
    return pairs.select(F.col("a.entity_id").alias("entity_1_id"), F.col("b.entity_id").alias("entity_2_id"), F.lit(FAST_SCORE).alias("score"))


def accepted_links(details: DataFrame) -> DataFrame:
    return details.filter("is_linked").select("entity_1_id", "entity_2_id", F.col("final_score").alias("score"))


def relink(details: DataFrame, model_weight: float, vector_weight: float, threshold: float) -> DataFrame:
    """Links from stored scores under other weights; nothing is asked again."""
    score = link_score(F.col("llm_score"), F.col("embedding_score"), model_weight, vector_weight)
    rescored = details.withColumn("score", score).filter(F.col("score") >= threshold)
    return rescored.select("entity_1_id", "entity_2_id", "score")


def sweep(details: DataFrame, model_weights: list[float], thresholds: list[float]) -> DataFrame:
    """Links per weight and threshold in one pass over the details."""
    grid = F.array(*[F.struct(F.lit(w).alias("model_weight"), F.lit(t).alias("threshold")) for w in model_weights for t in thresholds])
    rows = details.select("llm_score", "embedding_score", F.explode(grid).alias("g")).select("llm_score", "embedding_score", "g.*")
    weight = F.col("model_weight")
    score = F.col("llm_score") * weight + F.col("embedding_score") * 10.0 * (F.lit(1.0) - weight)
    return rows.groupBy("model_weight", "threshold").agg(
        F.count("*").alias("n_pairs"), F.sum((F.round(score, 9) >= F.col("threshold")).cast("long")).alias("n_links")
    )


def name_histogram(entities: DataFrame) -> DataFrame:
    """How many names occur in how many named entities, with the pairs each class would give."""
    per_name = entities.filter("is_named_entity").groupBy("name").agg(F.count("*").alias("doc_count"))
    hist = per_name.groupBy("doc_count").agg(F.count("*").alias("name_count"))
    return hist.withColumn("pair_count", pair_count(F.col("doc_count")) * F.col("name_count"))


def linking_cost(entities: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Candidate names, pairs and the minutes a model would need for one and eight workers."""
    hist = name_histogram(entities).filter(F.col("doc_count").between(settings.min_docs, settings.max_docs))
    total = hist.agg(F.coalesce(F.sum("name_count"), F.lit(0)).alias("names"), F.coalesce(F.sum("pair_count"), F.lit(0)).alias("pairs"))
    return total.select(
        "names", "pairs", linking_minutes(F.col("pairs")).alias("minutes_1"), linking_minutes(F.col("pairs"), workers=8).alias("minutes_8")
    )
