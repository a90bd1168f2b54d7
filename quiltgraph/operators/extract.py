"""Chunks to mentions and relations.

``RuleExtractor`` reads capitalised words with Spark expressions and needs no
model. ``ModelExtractor`` asks a text model in three stages. Both give

* mentions: ``doc_id, chunk_id, chunk_order_index, position, name, description, is_named_entity``
* relations: ``doc_id, chunk_id, chunk_order_index, position, source, target, description, strength, keywords``
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltgraph import schemas
from quiltgraph.config import Settings
from quiltgraph.functions import prompts
from quiltgraph.functions.replies import is_object, strict_json
from quiltgraph.functions.rows import unnest
from quiltgraph.functions.sizes import cut_lineage
from quiltgraph.functions.text import clean_description, normalize_name, only_digits, strip
from quiltgraph.models.clients import ReplyCache, TextModel, ask_with_retries
from quiltgraph.operators.chunking import halve_chunks

KEYS = ["doc_id", "chunk_id", "chunk_order_index"]
DEFAULT_STRENGTH = 5.0

# Fixed values of the rule extractor: word boundaries and the shape of a name.
# \P{Alnum} is every character but A-Z, a-z and 0-9; the written-out class runs many times slower.
NOT_WORD = r"\P{Alnum}+"
NAME_SHAPE = "^[A-Z][a-z]{3,}$"
# The same among words with one space between: the place before a name, and a name at the start.
CUT_BEFORE_NAME = r"(?=[A-Z][a-z]{3,}+(?: |\z))(?<![^ ])"
OPENING_NAME = r"^[A-Z][a-z]{3,}+(?: |\z)"


def clean_mentions(raw: DataFrame) -> DataFrame:
    """Normalise names, drop empty and digit-only ones, blank out "no description"."""
    name = normalize_name(F.col("raw_name"))
    return (
        raw.filter((strip(F.col("raw_name")) != "") & ~only_digits(F.col("raw_name")))
        .select(
            *KEYS, "position", name.alias("name"), clean_description(F.col("description")).alias("description"),
            F.coalesce(F.col("is_named_entity"), F.lit(False)).alias("is_named_entity"),
        )
        .filter(F.col("name") != "")
    )


def clean_relations(raw: DataFrame) -> DataFrame:
    """Keep relations with source, target and description; normalise both names."""
    present = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return raw.filter(present("source") & present("target") & present("description")).select(
        *KEYS, "position",
        normalize_name(F.col("source")).alias("source"), normalize_name(F.col("target")).alias("target"),
        "description", "strength", "keywords",
    )


def known_endpoints(relations: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """Relations whose source and target are both among ``names`` under the same keys."""
    for end in ("source", "target"):
        relations = relations.join(names.select(*keys, F.col("name").alias(end)).distinct(), [*keys, end], "left_semi")
    return relations


def _is_name(token: Column) -> Column:
    # The comparison settles most tokens before the pattern runs.
    return (token >= "A") & (token < "[") & token.rlike(NAME_SHAPE)


def _words_before(first: Column, pieces: Column) -> Column:
    """How many words come before each piece, ``first`` before the first one; every piece but the last ends in a space."""
    spaces = lambda s: F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))
    start = F.struct(first.alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(
        pieces, start, lambda acc, s: F.struct((acc["at"] + spaces(s)).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
        lambda acc: acc["all"])


def _name_hits(chunks: DataFrame) -> DataFrame:
    """The words of each chunk cut before every name: ``_s`` starts with a name and goes up to the next; ``_at`` is its place."""
    plain = chunks.select(*KEYS, F.regexp_replace("content", NOT_WORD, " ").alias("_w"))
    cut = plain.select(*KEYS, "_w", F.split("_w", CUT_BEFORE_NAME).alias("_a"))
    opens = F.col("_a")[0].rlike(OPENING_NAME)
    cut = cut.select(*KEYS, "_w", F.when(opens, F.lit(0)).otherwise(F.size(F.split(F.col("_a")[0], " ")) - 1).alias("_first"),
                     F.when(opens, F.col("_a")).otherwise(F.slice("_a", F.lit(2), F.size("_a"))).alias("_s"))
    # Adding up copies the places found so far, so a text of very many names is numbered word by word.
    placed = F.filter(F.transform(F.split("_w", " "), lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda x: _is_name(x["t"]))
    at = F.when(F.size("_s") <= 4096, _words_before(F.col("_first"), F.col("_s"))).otherwise(F.transform(placed, lambda x: x["i"]))
    return cut.select(*KEYS, "_s", at.alias("_at"))


def question_names(text: Column) -> Column:
    """Distinct names of a question by the same rule, sorted."""
    hits = F.filter(F.split(text, NOT_WORD), _is_name)
    return F.array_sort(F.array_distinct(F.transform(hits, lambda t: F.lower(t))))


@dataclass(frozen=True)
class RuleExtractor:
    """Capitalised words are names; a name opening its chunk is not voted a named entity."""

    def annotate(self, chunks: DataFrame) -> DataFrame:
        """Per chunk the arrays ``found`` (names) and ``told`` (consecutive names and the words between)."""
        name = lambda s: F.substring_index(s, " ", 1)
        piece = lambda i: F.coalesce(F.get("_s", i), F.lit(""))
        found = F.transform("_s", lambda s, i: F.struct(
            F.get("_at", i).alias("position"), name(s).alias("raw_name"),
            F.substring_index(F.concat(s, piece(i + 1), piece(i + 2)), " ", 3).alias("description"),
            (F.get("_at", i) > 0).alias("is_named_entity"),
        ))

        def relate(a, b):
            return F.struct(
                name(a).alias("source"), name(b).alias("target"), F.concat(a, name(b)).alias("description"),
                (F.lit(1.0) + (F.length(name(a)) + F.length(name(b))) % 10).alias("strength"),
                F.array(F.lower(F.left(a, F.lit(4))), F.lower(F.left(b, F.lit(4)))).alias("keywords"),
            )

        told = F.transform(F.slice("_s", F.lit(2), F.size("_s")), lambda s, i: relate(F.get("_s", i), s))
        return _name_hits(chunks).select(*KEYS, found.alias("found"), told.alias("told"))

    # A name is four or more of A-Z and a-z and a description words of A-Z, a-z and 0-9, so that ``clean_mentions`` and
    # ``clean_relations`` would lower and trim them and drop nothing.

    def mentions(self, annotated: DataFrame) -> DataFrame:
        return unnest(annotated, KEYS, F.col("found")).select(
            *KEYS, "position", F.lower("raw_name").alias("name"), F.trim("description").alias("description"), "is_named_entity")

    def relations(self, annotated: DataFrame) -> DataFrame:
        return unnest(annotated, KEYS, F.col("told"), "position").select(
            *KEYS, "position", F.lower("source").alias("source"), F.lower("target").alias("target"), "description", "strength", "keywords")

    def extract(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The text is read once; mentions and relations both come from the written arrays."""
        chunks = chunks.filter("meaningful")
        annotated = cut_lineage(self.annotate(chunks))
        return self.mentions(annotated), self.relations(annotated), chunks.limit(0)


def _relation_rows(staged: DataFrame) -> DataFrame:
    return unnest(staged, KEYS, F.col("items"), "position").select(
        *KEYS, "position", F.col("source_entity").alias("source"), F.col("target_entity").alias("target"),
        F.col("relationship_description").alias("description"), F.col("relationship_strength").alias("strength"),
        F.col("relationship_keywords").alias("keywords"),
    )


@dataclass(frozen=True)
class ModelExtractor:
    """Entities, then missed entities, then relations; a failed chunk is halved once.

    Missed entities are asked for in at most ``gleans`` rounds; with ``ask_more`` a chunk
    goes to the next round only while the model says that something is still missing.
    """

    model: Callable[[], TextModel]
    settings: Settings = field(default_factory=Settings)
    relations_required: bool = False
    gleans: int = 1
    ask_more: bool = False
    cache: ReplyCache | None = None

    def _stage(self, chunks: DataFrame, prompt: Column, schema, reply_field: str, required: bool):
        value = F.from_json(F.col("json"), schema).getField(reply_field)
        json = strict_json(F.col("reply"))
        parsed = F.from_json(json, schema).getField(reply_field)
        accept = is_object(json)
        if required:
            accept = accept & (F.coalesce(F.size(parsed), F.lit(0)) > 0)
        good, failed = ask_with_retries(chunks.withColumn("prompt", prompt), self.model, accept, self.settings.model_attempts, self.cache)
        done = good.withColumn("json", json).withColumn("items", F.coalesce(value, F.from_json(F.lit("[]"), schema[reply_field].dataType)))
        return done.drop("prompt", "reply", "json"), failed.drop("prompt")

    def _mentions(self, staged: DataFrame) -> DataFrame:
        rows = unnest(staged, KEYS, F.col("items"), "position")
        flag = F.col("is_named_entity").isin("true")
        return clean_mentions(rows.select(
            *KEYS, "position", F.coalesce("entity_name", F.lit("")).alias("raw_name"),
            F.col("entity_description").alias("description"), flag.alias("is_named_entity"),
        ))

    def _names(self, mentions: DataFrame, alias: str) -> DataFrame:
        # At most one chunk's mentions per group, so the list is bounded by the chunk size.
        ordered = F.array_sort(F.collect_list(F.struct("position", "name")))
        return mentions.groupBy("chunk_id").agg(F.to_json(F.transform(ordered, lambda x: x["name"])).alias(alias))

    def _once(self, chunks: DataFrame):
        first, failed_1 = self._stage(chunks, prompts.entities(F.col("content")), schemas.ENTITY_REPLY, "entities", True)
        known = self._mentions(first)
        base = first.drop("items")
        left, lost = base, []
        for number in range(1, self.gleans + 1):
            prior = F.coalesce(F.col("known"), F.lit("[]"))
            asked = left.join(self._names(known, "known"), "chunk_id", "left")
            gleaned, failed_2 = self._stage(asked, prompts.missed_entities(F.col("content"), prior), schemas.ENTITY_REPLY, "entities", False)
            lost.append(failed_2.select("chunk_id"))
            extra = self._mentions(gleaned).withColumn("position", F.col("position") + F.lit(1_000_000 * number))
            extra = extra.join(known.select("chunk_id", "name").distinct(), ["chunk_id", "name"], "left_anti")
            first_seen = F.min_by(F.struct("position", "description", "is_named_entity"), F.col("position"))
            extra = extra.groupBy(*KEYS, "name").agg(first_seen.alias("_f")).select(*KEYS, "name", "_f.*")
            known = cut_lineage(known.unionByName(extra))
            left = gleaned.drop("items", "known")
            if number == self.gleans:
                break
            if self.ask_more:
                names = left.join(self._names(known, "known"), "chunk_id", "left")
                names = names.withColumn("prompt", prompts.more_entities(F.col("content"), F.coalesce("known", F.lit("[]"))))
                told, _ = ask_with_retries(names, self.model, F.col("reply").isNotNull(), self.settings.model_attempts, self.cache)
                left = told.filter(F.upper(F.trim("reply")).startswith("YES")).drop("prompt", "reply", "known")
            if left.isEmpty():
                break
        missed = lost[0]
        for ids in lost[1:]:
            missed = missed.unionByName(ids)
        reached = base.join(missed, "chunk_id", "left_anti")
        mentions = known.join(reached.select("chunk_id"), "chunk_id", "left_semi")

        asked = reached.join(self._names(mentions, "names"), "chunk_id")
        related, failed_3 = self._stage(
            asked, prompts.relations(F.col("content"), F.col("names")), schemas.RELATION_REPLY, "relationships",
            self.relations_required,
        )
        relations = known_endpoints(clean_relations(_relation_rows(related)), mentions, ["chunk_id"])
        failed_ids = failed_1.select("chunk_id").unionByName(missed).unionByName(failed_3.select("chunk_id"))
        mentions = mentions.join(failed_ids, "chunk_id", "left_anti")
        return mentions.select(*KEYS, "position", "name", "description", "is_named_entity"), relations.select(
            *KEYS, "position", "source", "target", "description", "strength", "keywords"
        ), failed_ids

    def extract(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(mentions, relations, failed chunks); results of halves belong to the parent chunk."""
        chunks = chunks.filter("meaningful")
        mentions, relations, failed_ids = self._once(chunks)
        failed = chunks.join(failed_ids, "chunk_id", "left_semi")
        if failed.isEmpty():
            return mentions, relations, failed
        halves = halve_chunks(failed)
        parents = halves.select("chunk_id", "parent_chunk_id")
        half_mentions, half_relations, failed_halves = self._once(halves.drop("parent_chunk_id"))
        lost = parents.join(failed_halves, "chunk_id", "left_semi").select(F.col("parent_chunk_id").alias("chunk_id")).distinct()

        def to_parent(df):
            offset = F.when(F.col("chunk_id").endswith("_p2"), 10_000_000).otherwise(0)
            moved = df.withColumn("position", F.col("position") + offset).join(parents, "chunk_id")
            moved = moved.withColumn("chunk_id", F.col("parent_chunk_id")).drop("parent_chunk_id")
            return moved.join(lost, "chunk_id", "left_anti")

        return (
            mentions.unionByName(to_parent(half_mentions)),
            relations.unionByName(to_parent(half_relations)),
            chunks.join(lost, "chunk_id", "left_semi"),
        )


@dataclass(frozen=True)
class OnePassExtractor:
    """Entities, relations and content keywords of a chunk from one reply; a chunk whose reply names no entity failed."""

    model: Callable[[], TextModel]
    settings: Settings = field(default_factory=Settings)
    cache: ReplyCache | None = None

    def read(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(chunks with the parsed reply, failed chunks)."""
        parsed = F.from_json(strict_json(F.col("reply")), schemas.ONE_PASS_REPLY)
        accept = F.coalesce(F.size(parsed["entities"]), F.lit(0)) > 0
        asked = chunks.withColumn("prompt", prompts.one_pass(F.col("content")))
        good, failed = ask_with_retries(asked, self.model, accept, self.settings.model_attempts, self.cache)
        return good.withColumn("found", parsed).drop("prompt", "reply"), failed.drop("prompt")

    def extract(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        good, failed = self.read(chunks.filter("meaningful"))
        stages = ModelExtractor(self.model, self.settings)
        mentions = stages._mentions(good.withColumn("items", F.col("found.entities")))
        told = F.coalesce("found.relationships", F.from_json(F.lit("[]"), schemas.ONE_PASS_REPLY["relationships"].dataType))
        relations = known_endpoints(clean_relations(_relation_rows(good.withColumn("items", told))), mentions, ["chunk_id"])
        return mentions.select(*KEYS, "position", "name", "description", "is_named_entity"), relations.select(
            *KEYS, "position", "source", "target", "description", "strength", "keywords"), failed

    def keywords(self, chunks: DataFrame) -> DataFrame:
        """Content keywords of each chunk."""
        return self.read(chunks.filter("meaningful"))[0].select("doc_id", "chunk_id", F.col("found.content_keywords").alias("keywords"))
