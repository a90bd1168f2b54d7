"""Findings of a review: places where an operator did less than its whole job."""

import os
import re
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute
from quiltgraph.llm import decontamination, licenses, vectors


def hot_topic(rows, pairs, width=64, topic=0.75, seed=5):
    """Unit vectors, a third of them at ``topic`` to each other, and planted pairs in the topic at cosine 0.90 to 0.92."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((rows, width)))
    hot = rows // 3
    x[:hot] = unit(np.sqrt(topic) * unit(rng.standard_normal(width)) + np.sqrt(1 - topic) * x[:hot])
    u = rng.standard_normal((pairs, width))
    u = unit(u - np.einsum("ij,ij->i", u, x[:pairs])[:, None] * x[:pairs])
    cosine = rng.uniform(0.9001, 0.92, (pairs, 1))
    return np.concatenate([x, cosine * x[:pairs] + np.sqrt(1 - cosine**2) * u])


def found_pairs(spark, x, rows, pairs, **sizes):
    import pyarrow as pa

    df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x))), "embedding": pa.array(list(x))}))
    got = {r["vec_id"]: r["component_id"] for r in vectors.near_duplicates(df, **sizes).filter("component_id != vec_id").collect()}
    return sum(got.get(rows + i) == i for i in range(pairs)) / pairs


def test_forests_are_added_until_pairs_of_a_deep_hot_topic_are_found(spark):
    rows, pairs = 8000, 400
    x = hot_topic(rows, pairs)
    assert found_pairs(spark, x, rows, pairs, task_rows=600, sample=2000, sample_leaf=100, leaf=24) >= 0.93


def test_statements_wrapped_over_lines_are_found_and_scattered_words_are_not(spark):
    wrapped = lambda t: t if len(t) < 30 else "\n# ".join(re.findall(r".{1,30}(?:\s|$)", t))
    rows = [(i, f"# x y z\n# {wrapped(t)}\n# and more") for i, (t, _) in enumerate(licenses.TEMPLATES)]
    rows += [(100, " and ".join(w + " word" * 9 for w in licenses.TEMPLATES[2][0].split())), (101, None), (102, ""), (102, "Released under\r\nthe MIT License"),
             (103, "license " * 200 + "the mit\nlicense released\nunder"), (104, "x " * 40 + "All\n\nrights RESERVED" + " y" * 40), (None, "under the mit license, released")]
    frame = spark.createDataFrame([(*r, "n", 1.5) for r in rows], "doc_id int, text string, labels string, score double")
    got = sorted(map(tuple, licenses.scan(frame).collect()), key=str)
    assert got == sorted(((i, *brute.licenses(t, licenses.PHRASES, licenses.TEMPLATES, licenses.THRESHOLD)) for i, t in rows), key=str)
    found = {r[0]: r[6] for r in got if r[6] or r[0] != 102}
    assert all(label in found[i].split(",") for i, (_, label) in enumerate(licenses.TEMPLATES))
    assert found[100] == "" and found[102] == "mit" and found[104] == "reserved" and found[103] == "mit"
    assert licenses.scan(frame.limit(0)).count() == 0


def test_items_of_scripts_without_spaces_and_of_few_words_are_found(spark):
    items = [(1, "水在一个大气压下的沸点是多少摄氏度?"), (2, "富士山の高さは何メートルですか"), (3, "น้ำเดือดที่กี่องศา"), (4, "Capital of France"), (5, "𠀀𠀁𠀂𠀃𠀄𠀅"), (6, "?!")]
    rows = [(1, "前文。水在一个大气压下的沸点是多少摄氏度？后文"), (2, "abc富士山の高さは、何メートルですか。"), (3, "x น้ำเดือดที่กี่องศา y"), (4, "the CAPITAL, of\nFrance; capital of France"),
            (5, "z𠀀𠀁𠀂𠀃𠀄𠀅z"), (6, "水在一个大气压下的沸腾点是多少摄氏度"), (7, "capital of"), (8, "France 大气压下"), (9, None), (10, "capitals of France")]
    got = decontamination.find(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in got.collect()) == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 1, 1)]
    assert {r["last_word"] for r in got.filter("doc_id = 4").collect()} == {3}
