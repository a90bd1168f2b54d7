import json
import os

import pytest
from pyspark.sql import functions as F

from quiltgraph import ingest, link, save
from quiltgraph.config import Settings
from quiltgraph.sources import lines
from quiltgraph.sources.store import Store, document_blobs, write_failed_chunks, write_jsonl
from quiltgraph.streaming import status
from conftest import rows


def write(path, *items):
    with open(path, "w", encoding="utf-8") as f:
        f.writelines((i if isinstance(i, str) else json.dumps(i)) + "\n" for i in items)
    return path


def test_documents(spark, folder):
    p = write(f"{folder}/d.jsonl", {"id": " a ", "text": " x "}, "{broken", {"id": "a", "text": "later"}, {"id": "b", "text": " "}, {"id": "c&amp;", "text": "y"}, {"text": "z"})
    assert rows(lines.read_documents(spark, p), "id", "text") == [("a", "x"), ("c&amp;", "y")]
    assert rows(lines.read_documents(spark, p, unescape=True, distinct=False), "id", "text") == [("a", "later"), ("a", "x"), ("c&", "y")]


def test_first_wins_over_many_splits(spark, folder):
    p = write(f"{folder}/d.jsonl", *[{"id": f"k{i % 50}", "text": f"{i} " + "w" * 200} for i in range(2000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        got = lines.read_documents(spark, p)
        assert {r["id"]: int(r["text"].split()[0]) for r in got.collect()} == {f"k{i}": i for i in range(50)}
        q = write(f"{folder}/q.jsonl", *[{"question": f"q{i} " + "w" * 200, "answer": "a", "ids": ["d"]} for i in range(900)])
        numbered = lines.read_questions(spark, q, id_prefix="2wiki_q_")
        assert all(r["id"] == "2wiki_q_" + r["question"].split()[0][1:] for r in numbered.collect()) and numbered.count() == 900
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_questions_and_paragraphs(spark, folder):
    q = {"id": "1", "question": "q", "answer": "a", "ids": ["d"]}
    p = write(f"{folder}/q.jsonl", q, "broken", {"id": "2"}, {**q, "id": "3"})
    assert rows(lines.read_questions(spark, p), "id") == [("1",), ("3",)]
    assert rows(lines.read_questions(spark, p, limit=3), "id") == [("1",)]
    n = write(f"{folder}/n.jsonl", {"id": "1", "paragraphs": [{"id": "a", "text": "x"}, {"id": "b"}]}, {"id": "2", "paragraphs": [{"id": "a", "text": "later"}, {"id": "c", "text": "&lt;"}]})
    assert rows(lines.read_paragraphs(spark, n), "id", "text") == [("a", "x"), ("c", "&lt;")]
    assert rows(lines.read_paragraphs(spark, n, limit=1, unescape=True), "id", "text") == [("a", "x")]
    bad = write(f"{folder}/bad.jsonl", {"id": "1", "paragraphs": []}, "{oops")
    with pytest.raises(Exception, match="not a JSON object"):
        lines.read_paragraphs(spark, bad).collect()


def test_other_sources(spark, folder):
    os.makedirs(f"{folder}/md")
    write(f"{folder}/md/one.two.md", "# t", "body")
    write(f"{folder}/md/skip.txt", "no")
    assert rows(lines.read_markdown(spark, f"{folder}/md"), "id", "text") == [("one.two", "# t\nbody\n")]
    log = write(f"{folder}/log.txt", "a", " a ", "", "b")
    assert rows(lines.read_log(spark, log)) == [("a",), ("b",)] and lines.read_log(spark, f"{folder}/none").count() == 0
    pages = write(f"{folder}/pages.jsonl", {"query_title": "q", "title": "T", "content": "C", "url": "u"})
    assert rows(lines.read_pages(spark, pages)) == [("T", "C")]
    answers = write(f"{folder}/a.jsonl", {"id": "1", "LLM_answer": "x"}, "{cut")
    assert rows(lines.read_answered(spark, answers)) == [("1",)]
    chunk = {"tokens": 3, "content": "x", "chunk_order_index": 0, "chunk_id": "A B_0", "doc_id": "A B"}
    with open(f"{folder}/failed_chunks_A_B.json", "w") as f:
        json.dump([chunk, chunk], f)
    assert rows(lines.read_failed_chunks(spark, folder), "file_doc_id", "chunk_id") == [("A B", "A B_0")] * 2


DOCS = [(1, "Alpha met Beta near Gamma while they walked and talked a lot today"), (2, "Later Alpha met Beta near Gamma while they walked and talked a lot"), (3, "")]


def documents(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_ingest_save_delete(spark, folder):
    store = Store(spark, folder)
    made = ingest(documents(spark))
    save(made, store, 1)
    sizes = {n: store.count(n) for n in ("documents", "chunks", "entities", "relations", "failed_chunks")}
    assert sizes == {"documents": 3, "chunks": 2, "entities": 5, "relations": 3, "failed_chunks": 0}
    save(ingest(documents(spark)), store, 2)
    assert {n: store.count(n) for n in sizes} == sizes
    assert rows(store.processed()) == [("1",), ("2",), ("3",)]
    links, details = link(store.read("entities"), fast=True)
    store.put("same_as", links, 2)
    assert details is None and store.count("same_as") == 2
    scored = link(store.read("entities"))[1]
    assert scored.count() == 2 and scored.filter("embedding_score between -1 and 1").count() == 2
    gone = spark.createDataFrame([(2,), (99,)], "doc_id long")
    for _ in range(2):
        store.delete_documents(gone, 3)
        assert rows(store.ids()) == [(1,), (3,)] and store.count("same_as") == 0
        assert store.read("entities").filter("doc_id = 2").count() == 0
        assert store.blob(2) is None and json.loads(store.blob(1))["doc_id"] == 1
        assert rows(store.processed()) == [("1",), ("3",)]
    save(ingest(documents(spark).filter("doc_id = 2")), store, 4)
    assert store.count("entities") == 5 and store.count("same_as") == 0 and rows(store.processed()) == [("1",), ("2",), ("3",)]
    assert [store.delete_all("relations", 5) for _ in range(2)] == [3, 3] and store.count("relations") == 0 and store.read("missing") is None


def test_rewrite_and_order_inside_a_batch(spark, folder):
    store = Store(spark, folder)
    save(ingest(documents(spark)), store, 1)
    shorter = spark.createDataFrame([(1, "Alpha met nobody and walked on alone for the rest of the long day")], "doc_id long, text string")
    for _ in range(2):
        save(ingest(shorter), store, 2, rewrite=True)
        assert rows(store.read("entities").filter("doc_id = 1"), "name") == [("alpha",)] or store.read("entities").filter("doc_id = 1").count() <= 1
        assert store.count("documents") == 3 and rows(store.read("chunks", F.col("chunk_id") == "1_0"), "content") == [(shorter.first()["text"],)]
    chunk = store.read("chunks").filter("chunk_id = '1_0'")
    for _ in range(2):
        store.put("chunks", chunk, 3)
        store.delete("chunks", chunk, 3)
        assert store.count("chunks", F.col("chunk_id") == "1_0") == 1
    store.delete("chunks", chunk, 4)
    assert store.count("chunks", F.col("chunk_id") == "1_0") == 0


class CountingModel:
    """Summaries that differ from call to call."""

    in_spark = False
    reads_entries = False

    def __init__(self, inner, path):
        self.inner, self.path = inner, path

    def _marked(self, rows):
        path = self.path

        @F.udf("string")
        def mark(text):
            import uuid

            name = uuid.uuid4().hex
            open(f"{path}/{name}", "w").close()
            return f"{text} {name}"

        return rows.withColumn("summary", mark.asNondeterministic()("summary"))

    def entity(self, rows):
        return self._marked(self.inner.entity(rows))

    def document(self, rows):
        return self._marked(self.inner.document(rows))


def test_models_are_asked_once(spark, folder):
    from quiltgraph.operators.fusion import RuleSummarizer

    os.makedirs(f"{folder}/calls")
    made = ingest(documents(spark), summarizer=CountingModel(RuleSummarizer(), f"{folder}/calls"))
    asked = len(os.listdir(f"{folder}/calls"))
    store = Store(spark, f"{folder}/store")
    save(made, store, 1)
    link(made.entities)
    assert asked > 0 and len(os.listdir(f"{folder}/calls")) == asked
    assert rows(store.read("documents"), "doc_id", "summary") == rows(made.documents, "doc_id", "summary")


def test_sinks(spark, folder):
    made = ingest(documents(spark))
    blobs = document_blobs(made.documents, made.chunks, made.entities, made.sourced_from, made.relations)
    one = json.loads(blobs.filter("doc_id = 1").first()["blob"])
    assert [e["source_chunk_ids"] for e in one["entities"]] == [["1_0"]] * 2 and "vector" not in one["chunks"][0]
    write_jsonl(spark.createDataFrame([("1", "x")], "id string, LLM_answer string"), f"{folder}/log", append=True)
    write_jsonl(spark.createDataFrame([("2", "y")], "id string, LLM_answer string"), f"{folder}/log", append=True)
    assert rows(lines.read_answered(spark, f"{folder}/log")) == [("1",), ("2",)]
    write_failed_chunks(made.chunks, f"{folder}/failed")
    assert sorted(x for x in os.listdir(f"{folder}/failed") if "=" in x) == ["document=1", "document=2"]
    assert rows(lines.read_failed_chunks(spark, f"{folder}/failed"), "chunk_id", "content") == rows(made.chunks, "chunk_id", "content")


def test_repair_and_cleanup(spark, folder):
    from quiltgraph.operators.extract import RuleExtractor
    from quiltgraph.operators.prep import progress
    from quiltgraph.plans.repair import clean_up, refresh_summaries, retry_failed

    made = ingest(documents(spark))
    failed = spark.createDataFrame([(12, "and so Delta came to Beta at last with many words more", 7, "1_7", 1)], "tokens int, content string, chunk_order_index int, chunk_id string, doc_id long")
    changed, repaired, again, edges, relations = retry_failed(failed, made.entities, RuleExtractor(), made.relations)
    texts = {r["name"]: r["summary"] for r in changed.collect()}
    assert set(texts) == {"beta", "gamma", "delta"} and "追加描述" in texts["beta"] and texts["delta"] == "Delta came to"
    assert rows(repaired) == [(1,)] and again.count() == 0
    assert rows(edges, "entity_id", "chunk_id") == [("1_beta", "1_7"), ("1_delta", "1_7")]
    assert set(made.entities.columns) <= set(changed.columns) and changed.filter("name <> 'delta' and n_mentions is null").count() == 0
    assert ("delta", "beta") in {(r["source_entity_name"], r["target_entity_name"]) for r in relations.collect()} and relations.columns == made.relations.columns
    docs, entities = refresh_summaries(made.documents, made.chunks, changed, repaired)
    assert rows(docs, "doc_id", "summary") == [(1, "Document about 3 named entities: beta, gamma, delta")]
    assert entities.count() == 3 and entities.filter("size(vector) = 64").count() == 3
    store = Store(spark, folder)
    save(made, store, 1)
    store.put("blobs", document_blobs(made.documents, made.chunks, made.entities, made.sourced_from, made.relations), 1)
    assert json.loads(store.blob(1))["doc_id"] == 1 and store.blob(42) is None
    for _ in range(2):
        gone = clean_up(store, spark.createDataFrame([(1,)], "doc_id long"), 2)
        assert rows(gone) == [(2,), (3,)] and rows(store.ids()) == [(1,)] and {r["doc_id"] for r in store.read("chunks").collect()} == {1}
    store.create("chunks", "chunk_id string")
    store.drop()
    assert store.read("documents") is None
    log = spark.createDataFrame([(2.0,), (4.0,)], "duration double")
    assert progress(log, 5).first()["seconds_left"] == 9.0


def test_status_stream(spark, folder):
    documents(spark).filter("doc_id < 3").write.parquet(f"{folder}/in")
    store = Store(spark, f"{folder}/store")

    def run():
        stream = spark.readStream.schema("doc_id long, text string").parquet(f"{folder}/in")
        q = status.start(stream, lambda todo: {"chunks": ingest(todo).chunks}, store, f"{folder}/check")
        q.awaitTermination(120)

    run()
    assert store.count("chunks") == 2
    documents(spark).filter("doc_id < 3").write.mode("append").parquet(f"{folder}/in")
    run()
    log = store.read_log("status", "doc_id string, status string, seq long, error string")
    assert rows(status.latest(log), "doc_id", "status") == [("1", "PROCESSED"), ("2", "PROCESSED")] and log.filter("status = 'PROCESSING'").count() == 2
    todo = status.queue(documents(spark).select(F.col("doc_id").cast("string").alias("doc_id")), status.latest(log))
    assert rows(todo) == [("3", "PENDING")]


def test_one_bad_document_does_not_hold_up_a_stream(spark, folder):
    spark.createDataFrame([(i, f"Text number {i} with a Name in it and more words") for i in range(6)] + [(3, "second copy")], "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/in")
    store = Store(spark, f"{folder}/store")

    def ingest_or_fail(todo):
        if todo.filter("doc_id = 4").take(1):
            raise ValueError("bad document " + "x" * 900)
        return {"chunks": ingest(todo).chunks}

    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{folder}/in")
    status.start(stream, ingest_or_fail, store, f"{folder}/check").awaitTermination(240)
    log = status.latest(store.read_log("status", "doc_id string, status string, seq long, error string"))
    assert rows(log, "doc_id", "status") == [(str(i), "FAILED" if i == 4 else "PROCESSED") for i in range(6)]
    assert len(log.filter("doc_id = '4'").first()["error"]) > 900
    assert rows(store.read("chunks"), "doc_id") == [(i,) for i in range(6) if i != 4]
    assert store.read("chunks").filter("doc_id = 3").first()["content"].startswith("Text number 3")


def test_a_failed_document_recovers_without_arriving_again(spark, folder):
    """It fails twice, then goes through; one that never does is given up after three attempts."""
    store, tries = Store(spark, f"{folder}/store"), {1: 0, 2: 0}

    def flaky(todo):
        held = {r[0] for r in todo.select("doc_id").collect()}
        if len(held) == 1:
            for i in held & set(tries):
                tries[i] += 1
        if 2 in held or 1 in held and tries[1] < 3:
            raise ValueError("not now")
        return {"chunks": ingest(todo).chunks}

    for number in range(5):
        first = [(1, "Text number one with a Name in it"), (2, "Text number two with a Name in it")] if number == 0 else []
        made = first + [(10 + number, f"Text number {number} with a Name in it and more")]
        spark.createDataFrame(made, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("doc_id long, text string").parquet(f"{folder}/in")
        status.start(stream, flaky, store, f"{folder}/check").awaitTermination(240)
    log = status.latest(store.read_log("status", "doc_id string, status string, seq long, error string"))
    assert rows(log, "doc_id", "status") == sorted([("1", "PROCESSED"), ("2", "FAILED"), *((str(10 + n), "PROCESSED") for n in range(5))])
    assert tries == {1: 3, 2: 3} and rows(store.read("chunks"), "doc_id") == [(1,), *((10 + n,) for n in range(5))]


def test_settings():
    assert Settings().chunk_step == 480 and Settings().recall_width(5) == 10
    with pytest.raises(KeyError):
        Settings.from_mapping({"rerank_top": 10})


def test_a_batch_is_seen_whole_or_not_at_all(spark, folder):
    store = Store(spark, folder)
    docs = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id string, text string")
    store.put("documents", docs("a", "b"), 1)
    before = store.snapshot()
    store.begin(2)
    pinned = store.snapshot()
    store.delete_documents(docs("a"), 2)
    store.put("documents", docs("c"), 2)
    store.log_processed(docs("c"), 2)
    ids = lambda s: [r[0] for r in rows(s.read("documents"), "doc_id")]
    assert store.open_batches() == (2,) and ids(store) == ["a", "b"] and store.processed().count() == 0
    store.commit(2)
    assert ids(store) == ["b", "c"] and rows(store.processed()) == [("c",)] and ids(pinned) == ["a", "b"] and before.open_batches() == ()
    store.begin(2)  # repeated: hidden until it is whole again
    assert ids(store) == ["a", "b"]
    store.delete_documents(docs("a"), 2)
    store.put("documents", docs("c", "d"), 2)
    store.commit(2)
    assert ids(store) == ["b", "c", "d"]
    other = Store(spark, folder + "/new")
    other.begin(1)
    other.put("documents", docs("z"), 1)
    assert other.read("documents") is None and other.exists("documents")


def test_read_takes_keys_and_columns_before_versions_are_merged(spark, folder):
    """Wanted columns and keys give the same rows as a full read, deletions and newer versions included."""
    from pyspark.sql import functions as F

    store = Store(spark, folder)
    kind = "entity_id string, doc_id string, name string, summary string"
    store.put("entities", spark.createDataFrame([("a", "d1", "x", "old"), ("b", "d2", "y", "s"), ("c", "d3", "z", "t")], kind), 1)
    store.delete_documents(spark.createDataFrame([("d3",)], "doc_id string"), 2)
    store.put("entities", spark.createDataFrame([("a", "d1", "x", "new")], kind), 2)
    slim = store.read("entities", columns=["name"], made={"n": F.length("summary")})
    assert rows(slim, "entity_id", "doc_id", "name", "n") == [("a", "d1", "x", 3), ("b", "d2", "y", 1)]
    assert "summary" not in slim.columns
    some = store.read("entities", columns=["summary"], only=spark.createDataFrame([("a",), ("c",), ("q",)], "entity_id string"))
    assert rows(some, "entity_id", "summary") == [("a", "new")]


def test_multihop_rows_are_written_in_as_many_parts_as_the_session_shuffles(spark, folder, monkeypatch):
    """Sorting the rows is spread with the input: no fixed number of parts."""
    from quiltgraph.plans import queries_sources

    monkeypatch.setattr(queries_sources, "new_path", lambda spark, name: f"{folder}/{name}")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        queries_sources.multihop_rows(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len([f for f in os.listdir(f"{folder}/multihop") if f.startswith("part-")]) == 7
