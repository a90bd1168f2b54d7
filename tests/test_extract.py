import json
import re

from pyspark.sql import functions as F

from quiltgraph.config import Settings
from quiltgraph.functions.text import ScriptTokens
from quiltgraph.models.clients import ReplyCache
from quiltgraph.operators.chunking import chunk_documents
from quiltgraph.operators.extract import ModelExtractor, OnePassExtractor, RuleExtractor, clean_mentions, question_names
from quiltgraph.operators.merging import cached_replies, parse_records
from conftest import rows


class Scripted:
    """Replies by rule: names are words in capitals; chosen words make it fail."""

    def generate(self, prompts):
        return [self.one(p) for p in prompts]

    def one(self, prompt):
        text = prompt.split("Passage:\n")[1]
        if "BROKEN" in text:
            return "sorry"
        names = re.findall(r"\b[A-Z]{2,}\b", text)
        if prompt.startswith("List the entities"):
            items = [{"entity_name": n, "entity_description": f"about {n}", "is_named_entity": True} for n in names]
            return "```json\n" + json.dumps({"entities": items}) + "\n```"
        if prompt.startswith("These entities"):
            return json.dumps({"entities": [
                {"entity_name": names[0], "entity_description": "again", "is_named_entity": True},
                {"entity_name": "Extra One", "entity_description": "late", "is_named_entity": "yes"},
                {"entity_name": "2020", "entity_description": "year", "is_named_entity": True}]})
        return json.dumps({"relationships": [
            {"source_entity": names[0], "target_entity": names[-1], "relationship_description": "meets", "relationship_strength": 8, "relationship_keywords": ["k"]},
            {"source_entity": names[0], "target_entity": "Unknown", "relationship_description": "lost"}]})


def model():
    return Scripted()


LONG = Settings(meaningful_tokens=2)


def test_three_stages(spark):
    docs = spark.createDataFrame([(1, "we met ALPHA and BETA today")], "doc_id long, text string")
    mentions, relations, failed = ModelExtractor(model, LONG).extract(chunk_documents(docs, LONG))
    assert rows(mentions, "name", "description", "is_named_entity") == [
        ("alpha", "about ALPHA", True), ("beta", "about BETA", True), ("extra one", "late", False)]
    assert rows(relations, "source", "target", "description", "strength") == [("alpha", "beta", "meets", 8.0)]
    assert failed.count() == 0


def test_failed_chunk_is_halved(spark):
    text = "we met ALPHA and BETA today and GAMMA too"
    docs = spark.createDataFrame([(1, text), (2, "all BROKEN here BROKEN there BROKEN"), (3, "ALPHA only here today")], "doc_id long, text string")
    mentions, _, failed = ModelExtractor(model, LONG).extract(chunk_documents(docs, LONG))
    assert rows(failed, "chunk_id") == [("2_0",)]
    assert {r["chunk_id"] for r in mentions.collect()} == {"1_0", "3_0"}


class OnlyShort(Scripted):
    def one(self, prompt):
        return "too long" if len(prompt.split("Passage:\n")[1]) > 30 else super().one(prompt)


def only_short():
    return OnlyShort()


def test_halves_belong_to_the_parent(spark):
    docs = spark.createDataFrame([(1, "we met ALPHA and BETA here  then GAMMA and DELTA came")], "doc_id long, text string")
    mentions, relations, failed = ModelExtractor(only_short, LONG).extract(chunk_documents(docs, LONG))
    assert failed.count() == 0
    assert {(r["chunk_id"], r["name"]) for r in mentions.collect()} >= {("1_0", "alpha"), ("1_0", "delta")}
    assert {r["chunk_id"] for r in relations.collect()} == {"1_0"}


def test_clean_mentions(spark):
    raw = [("1", "1_0", 0, 0, " 1999 ", "x", True), ("1", "1_0", 0, 1, "北京", "x", True), ("1", "1_0", 0, 2, "", "x", True),
           ("1", "1_0", 0, 3, "Neo4j", "No description available in the text.", None)]
    df = spark.createDataFrame(raw, "doc_id string, chunk_id string, chunk_order_index int, position int, raw_name string, description string, is_named_entity boolean")
    assert rows(clean_mentions(df), "name", "description", "is_named_entity") == [("neo4j", "", False)]


def test_rule_extractor(spark):
    docs = spark.createDataFrame([(1, "Alpha met Beta near Alpha, one two three four five six seven")], "doc_id long, text string")
    mentions, relations, _ = RuleExtractor().extract(chunk_documents(docs))
    assert rows(mentions, "position", "name", "is_named_entity", "description") == [
        (0, "alpha", False, "Alpha met Beta"), (2, "beta", True, "Beta near Alpha"), (4, "alpha", True, "Alpha one two")]
    assert rows(relations, "source", "target", "description") == [("alpha", "beta", "Alpha met Beta"), ("beta", "alpha", "Beta near Alpha")]
    q = spark.createDataFrame([("Who is Beta or Alpha or Beta?",)], "q string")
    assert q.select(question_names(F.col("q"))).first()[0] == ["alpha", "beta"]


def test_records(spark):
    reply = '("entity"<|>"A"<|>"person"<|>"tall")##noise##("relationship"<|>"A"<|>"B"<|>"knows"<|>"x, y"<|>2.5)##("relationship"<|>"A"<|>"C"<|>"d"<|>"k"<|>bad)<|COMPLETE|>'
    e, r = parse_records(spark.createDataFrame([("c", reply)], "chunk_id string, reply string"), ["chunk_id"])
    assert rows(e, "name", "entity_type", "description") == [("A", "person", "tall")]
    assert rows(r, "source", "target", "keywords", "weight") == [("A", "B", "x, y", 2.5), ("A", "C", "k", 1.0)]


class Echo:
    def generate(self, prompts):
        return [f"<{p}>" for p in prompts]


def echo():
    return Echo()


def test_reply_cache(spark):
    df = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "i int, prompt string")
    cache = df.filter("i = 3").select(F.sha2("prompt", 256).alias("prompt_key"), F.lit("known").alias("reply"))
    got, fresh = cached_replies(df, cache, echo)
    assert rows(got, "i", "reply") == [(1, "<p>"), (2, "<p>"), (3, "known")] and fresh.count() == 1


class Gleaner(Scripted):
    """Finds one more name in each round and says so until three are found."""

    def one(self, prompt):
        if prompt.startswith("These entities were found"):
            return "NO" if "third" in prompt.split("\n")[0] else "YES, more"
        if prompt.startswith("These entities"):
            known = prompt.split("\n")[0]
            name = "Third" if "second" in known else "Second"
            return json.dumps({"entities": [{"entity_name": name, "entity_description": "late", "is_named_entity": True}]})
        if prompt.startswith("List at most 15"):
            return "no idea" if "BROKEN" in prompt else json.dumps({
                "entities": [{"entity_name": n, "entity_description": "d", "is_named_entity": True} for n in ("ALPHA", "BETA")],
                "relationships": [{"source_entity": "ALPHA", "target_entity": "BETA", "relationship_description": "meets"}],
                "content_keywords": ["meeting"]})
        return super().one(prompt)


def gleaner():
    return Gleaner()


class Counting(Gleaner):
    def __init__(self, path):
        self.path = path

    def generate(self, prompts):
        import os
        import uuid

        for _ in prompts:
            open(os.path.join(self.path, uuid.uuid4().hex), "w").close()
        return super().generate(prompts)


def test_gleaning_until_the_model_says_done(spark):
    docs = spark.createDataFrame([(1, "we met ALPHA and BETA today")], "doc_id long, text string")
    chunks = chunk_documents(docs, LONG)
    names = lambda **k: [r[0] for r in rows(ModelExtractor(gleaner, LONG, **k).extract(chunks)[0], "name")]
    assert names() == ["alpha", "beta", "second"]
    assert names(gleans=5, ask_more=True) == ["alpha", "beta", "second", "third"]


def test_one_pass(spark):
    docs = spark.createDataFrame([(1, "we met ALPHA and BETA today"), (2, "all BROKEN here and there")], "doc_id long, text string")
    chunks = chunk_documents(docs, LONG)
    one = OnePassExtractor(gleaner, LONG)
    mentions, relations, failed = one.extract(chunks)
    assert rows(mentions, "name") == [("alpha",), ("beta",)] and rows(relations, "source", "target") == [("alpha", "beta")]
    assert rows(failed, "chunk_id") == [("2_0",)] and rows(one.keywords(chunks), "chunk_id", "keywords") == [("1_0", ["meeting"])]


def test_cached_prompts_are_not_asked_again(spark, folder):
    import os
    from functools import partial

    os.makedirs(f"{folder}/calls")
    docs = spark.createDataFrame([(1, "we met ALPHA and BETA today"), (2, "we met ALPHA and BETA today")], "doc_id long, text string")
    chunks = chunk_documents(docs, LONG)
    one = OnePassExtractor(partial(Counting, f"{folder}/calls"), LONG, ReplyCache(spark, f"{folder}/cache"))
    first = rows(one.extract(chunks)[0], "chunk_id", "name")
    assert len(first) == 4 and len(os.listdir(f"{folder}/calls")) == 1
    assert rows(one.extract(chunks)[0], "chunk_id", "name") == first and len(os.listdir(f"{folder}/calls")) == 1


def test_text_without_spaces_is_cut(spark):
    text = "知识图谱" * 300
    docs = spark.createDataFrame([(1, text), (2, "plain words 和 more 图")], "doc_id long, text string")
    got = {r["chunk_id"]: r for r in chunk_documents(docs, tokenizer=ScriptTokens()).collect()}
    assert [got[f"1_{i}"]["tokens"] for i in (0, 1)] == [512, 753] and "".join(got["1_0"]["content"]) == text[:512]
    assert got["2_0"]["content"] == "plain words 和 more 图" and got["2_0"]["tokens"] == 5
    assert chunk_documents(docs.filter("doc_id = 1")).count() == 1  # one single word


def test_places_of_names_with_and_without_words_between(spark):
    """Names are found and numbered as in the plain list of words, in a chunk of more names than are added up too."""
    import re

    from quiltgraph.operators.extract import RuleExtractor

    texts = ["Anna met Bert.", "  Anna Bert", "x, Anna", "", "none", "Anna,Bert;Carl d", "éAnna Bertö Annab1 1Anna ANNA Ann", "Anna " * 5000, " Zoey!?"]
    df = spark.createDataFrame([(i, str(i), 0, t) for i, t in enumerate(texts)], "doc_id int, chunk_id string, chunk_order_index int, content string")
    found = RuleExtractor().annotate(df)
    got = {r["doc_id"]: r for r in found.collect()}
    for i, t in enumerate(texts):
        words = re.split("[^A-Za-z0-9]+", t)
        at = [p for p, w in enumerate(words) if re.fullmatch("[A-Z][a-z]{3,}", w)]
        assert [(x["position"], x["raw_name"], x["description"].strip(), x["is_named_entity"]) for x in got[i]["found"]] == [
            (p, words[p], " ".join(words[p:p + 3]).strip(), p > 0) for p in at]
        assert [x["description"] for x in got[i]["told"]] == [" ".join(words[a:b + 1]) for a, b in zip(at, at[1:])]
