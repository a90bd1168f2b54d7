import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiltgraph.functions import text
from quiltgraph.functions.text import unescape_html


def values(spark, make, inputs):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(inputs)], "i int, s string")
    return [r[0] for r in df.select(make(F.col("s")).alias("x"), "i").orderBy("i").collect()]


def test_normalize_names(spark):
    got = values(spark, text.normalize_name, ["Neo4j", "Milvus", "  Test Space  ", "北京", "Beyoncé", None, "a b", "X-1!", "ıſ"])
    assert got == ["neo4j", "milvus", "test space", "", "beyonc", "", "a b", "x-1", "ıſ"]


def test_normalize_matches_python(spark):
    """Random strings agree with the same rule in Python's regular expressions."""
    samples = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30))
    def collect(s):
        samples.append(s)

    collect()

    def python(s):
        kept = re.sub(r"[^a-z0-9\s-]", "", s.lower(), flags=re.I)
        return re.sub(r"\s+", " ", kept).strip()

    assert values(spark, text.normalize_name, samples) == [python(s) for s in samples]
    assert values(spark, lambda c: F.array_join(text.words(c), "|"), samples) == ["|".join(s.split()) for s in samples]
    assert values(spark, text.strip, samples) == [s.strip() for s in samples]


def test_only_digits(spark):
    assert values(spark, text.only_digits, ["1999", " 42 ", "1²", "٣", "4a", ""]) == [True, True, True, True, False, False]


def test_descriptions(spark):
    assert values(spark, text.clean_description, ["No description available in the text.", " x ", None]) == ["", "x", ""]


def test_file_names(spark):
    assert values(spark, text.file_stem, ["a/b/c.tar.gz", ".bashrc", "x.json", "dir/plain"]) == ["c.tar", ".bashrc", "x", "plain"]
    assert values(spark, text.safe_file_name, ['a b/c:"d"?']) == ["a_bcd"]
    name = lambda c: text.name_from_file(c, "failed_chunks_", r"\.json")
    assert values(spark, name, ["failed_chunks_Alex_Ferguson.json"]) == ["Alex Ferguson"]


def test_sorted_join_and_lists(spark):
    df = spark.createDataFrame([(["b", None, "", "a", "b"],)], "x array<string>")
    assert df.select(text.sorted_join(F.col("x"))).first()[0] == "a | b"
    assert df.select(text.quoted_list(F.array(F.lit("a"), F.lit("b")))).first()[0] == "['a', 'b']"


def test_unescape(spark):
    df = spark.createDataFrame([("1", "a &amp; b &eacute; &#x41;"), ("2", "plain"), ("3", None)], "id string, text string")
    got = {r["id"]: r["text"] for r in unescape_html(df, "id", "text").collect()}
    assert got == {"1": "a & b é A", "2": "plain", "3": None}


def test_truncate(spark):
    cut = lambda c: text.truncate_words(c, 2)
    assert values(spark, cut, ["a  b", "a b  c"]) == ["a  b", "a b"]


def test_unescape_closed_references(spark):
    """A reference that lost its semicolon stays; the others are resolved once, in one pass."""
    df = spark.createDataFrame([("and&amp</title>&amp;lt; &copy;&#233;&#x41; &ampx; &nope; &&&",), (None,)], "html string")
    got = [r[0] for r in unescape_html(df, "html", closed=True).collect()]
    assert sorted(got, key=str) == [None, "and&amp</title>&lt; ©éA &ampx; &nope; &&&"]
