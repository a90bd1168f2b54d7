import json

import pytest
from pyspark.sql import functions as F

from quiltgraph.functions import replies as r

CASES = [
    '{"a": 1}', 'x ```json\n{"a": 2}\n``` y', 'see {"a": {"b": 3}} end', "", '{"a": ', "[1, 2]", '{"a": 1} extra', "1,2", '1],[2',
    '```\n{"a": 1} tail\n```', "```JSON {\"a\": 5}```", '{"a": 1}}', "no json", '{"a": 1},"~end~"', "null", '"text"',
]


def values(spark, make):
    df = spark.createDataFrame(list(enumerate(CASES)), "i int, s string")
    return [x[0] for x in df.select(make(F.col("s")).alias("x"), "i").orderBy("i").collect()]


def loads(s):
    try:
        return True, json.loads(s)
    except (ValueError, TypeError):
        return False, None


def test_is_json_agrees_with_python(spark):
    assert values(spark, r.is_json) == [loads(s)[0] for s in CASES]


def test_strict_cascade(spark):
    got = values(spark, r.strict_json)
    want = [{"a": 1}, {"a": 2}, {"a": {"b": 3}}, None, None, [1, 2], {"a": 1}, None, None, {"a": 1}, {"a": 5}, None, None, {"a": 1}, None, "text"]
    assert [loads(x)[1] for x in got] == want


def test_lenient(spark):
    got = [loads(x)[1] for x in values(spark, r.lenient_json)]
    assert got[1] == {"a": 2} and got[2] == {"a": {"b": 3}} and got[5] is None and got[3] is None
    inner = [loads(x)[1] for x in values(spark, lambda c: r.lenient_json(c, innermost=True))]
    assert inner[0] == {"a": 1} and inner[2] is None


@pytest.mark.parametrize("reply,score", [
    ('{"score": 7.9}', 7), ('{"score": "7"}', 7), ('{"score": "7.9"}', None), ('{"score": null}', 0), ("{}", 0),
    (None, 0), ('{"score": true}', 1), ('{"score": -1.5}', -1), ('{"score": "high"}', None),
])
def test_scores(spark, reply, score):
    df = spark.createDataFrame([(reply,)], "s string")
    assert df.select(r.similarity_score(F.col("s"))).first()[0] == score
