import pytest
from pyspark.sql import functions as F

from quiltgraph.config import Settings
from quiltgraph.operators import chunking
from conftest import rows

SMALL = Settings(chunk_tokens=10, chunk_overlap=2, min_tail_tokens=4, hard_slack_tokens=5, meaningful_tokens=3, separator="||")


def brute(text, s, only=False):
    """Chunks of one document, step by step."""
    out = []
    for piece in text.split(s.separator) if s.separator else [text]:
        if s.separator and not piece.strip():
            continue
        tokens = piece.split()
        if s.separator and (only or len(tokens) <= s.chunk_tokens):
            out.append([len(tokens), piece.strip()])
            continue
        for start in range(0, len(tokens), s.chunk_step):
            w = tokens[start:start + s.chunk_tokens]
            out.append([len(w), " ".join(w)])
    if len(out) > 1 and out[-1][0] < s.min_tail_tokens:
        joined = out[-2][1] + "\\n\\n" + out[-1][1]
        out = out[:-2] + [[len(joined.split()), joined]]
    cut = s.chunk_tokens + s.hard_slack_tokens
    return [(n, " ".join(t.split()[:s.chunk_tokens]) if len(t.split()) > cut else t) for n, t in out]


def words(n):
    return " ".join(f"w{i}" for i in range(n))


@pytest.mark.parametrize("n", [0, 1, 8, 9, 10, 11, 12, 13, 16, 17, 18, 20, 40])
def test_lengths(spark, n):
    docs = spark.createDataFrame([(1, words(n))], "doc_id long, text string")
    for settings in (SMALL, Settings(**{**vars(SMALL), "separator": ""})):
        got = chunking.chunk_documents(docs, settings).orderBy("chunk_order_index").collect()
        assert [(r["tokens"], r["content"]) for r in got] == brute(words(n), settings)
        assert [r["chunk_id"] for r in got] == [f"1_{i}" for i in range(len(got))]


@pytest.mark.parametrize("n", [0, 1, 480, 481, 512, 513, 779, 780, 812, 1000])
def test_default_sizes(spark, n):
    docs = spark.createDataFrame([(1, words(n))], "doc_id long, text string")
    got = chunking.chunk_documents(docs).orderBy("chunk_order_index").collect()
    assert [(r["tokens"], r["content"]) for r in got] == brute(words(n), Settings())


def test_separators(spark):
    text = f" a b || ||{words(25)}||x y z w v||tail"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for only in (False, True):
        got = chunking.chunk_documents(docs, SMALL, separator_only=only).orderBy("chunk_order_index").collect()
        assert [(r["tokens"], r["content"]) for r in got] == brute(text, SMALL, only)


def test_blank_lines_do_not_split_by_default(spark):
    docs = spark.createDataFrame([(1, "a\n\nb"), (2, "a\\n\\nb")], "doc_id long, text string")
    assert rows(chunking.chunk_documents(docs).groupBy("doc_id").count()) == [(1, 1), (2, 1)]
    wide = Settings(min_tail_tokens=0)
    assert rows(chunking.chunk_documents(docs, wide).groupBy("doc_id").count()) == [(1, 1), (2, 2)]


def test_windows_cover_and_overlap(spark):
    docs = spark.createDataFrame([(1, words(103))], "doc_id long, text string")
    got = [r["content"].split() for r in chunking.token_windows(docs, SMALL).orderBy("chunk_order_index").collect()]
    assert set(sum(got, [])) == set(words(103).split())
    assert all(a[-2:] == b[:2] for a, b in zip(got, got[1:]) if len(a) == 10)


def test_halves_hash_ids_and_audit(spark):
    docs = spark.createDataFrame([(1, "abc def gh"), (2, "abc def gh")], "doc_id long, text string")
    chunks = chunking.chunk_documents(docs)
    halves = chunking.halve_chunks(chunks)
    assert rows(halves.filter("doc_id = 1"), "chunk_id", "content", "parent_chunk_id") == [("1_0_p1", "abc d", "1_0"), ("1_0_p2", "ef gh", "1_0")]
    assert chunking.content_hash_ids(chunks).select("chunk_id").distinct().count() == 1
    assert chunking.largest_chunk(chunks).first()["chunk_id"] == "1_0"


def test_no_shuffle(spark):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    assert "Exchange" not in chunking.chunk_documents(docs)._jdf.queryExecution().executedPlan().toString()
