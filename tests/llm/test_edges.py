"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute
import corpus_pipeline
from quiltgraph.llm import (
    components, decontamination, languages, licenses, neardup, packing, quality, secrets, substrings, texts, urls, vectors,
)
from quiltgraph.llm.queries import URL_RULES, tokenizer_file

#: Names that operators use for their own columns.
CLASHES = ("score", "spans", "_text", "_id", "id", "text_hash", "labels", "n_words", "_row", "piece", "component_id", "node", "v", "l", "t", "_h")
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
NULLS = [(1, None), (2, ""), (3, " \n\t "), (None, "some words without an id"), (4, LONG)]


def documents(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in CLASHES if clash else ():
        df = df.withColumn(name, F.lit("x"))
    return df


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def by_id(df, *columns):
    out = {}
    for r in df.select("doc_id", *columns).collect():
        out.setdefault(r["doc_id"], []).append(tuple(r)[1:] if len(columns) > 1 else r[1])
    return out


def test_words_and_hashes_by_hand():
    import pyarrow as pa

    column = pa.array(["a bb c", None, "", "bb", " x\x0bA "])
    (at, data, offsets), = texts.slices(column)
    starts, ends, first = texts.words(data, offsets)
    found = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert at == 0 and found == ["a", "bb c", "bb", "x", "A"] and first.tolist() == [0, 2, 2, 2, 3, 5]
    hashes = texts.word_hashes(data, starts, ends, texts.LOWER)
    assert hashes[0] == hashes[4] and len(set(hashes.tolist())) == 4
    assert texts.grams(hashes, 2)[0] != texts.grams(hashes, 2)[1]
    assert [len(o) - 1 for _, _, o in texts.slices(pa.array(["aa", "b" * 50, "c"]), 10)] == [1, 1, 1]


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(500, 500), (None, 7), (9, None), (3, 2)]
    for one_task in (1000, 10):  # both forms of a star
        got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
        assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 160), 100)}
    assert components.connected(spark.createDataFrame([], "a string, b string")).collect() == []


def test_licenses(spark):
    rows = [*NULLS, (5, "CC BY CC by cc-by!"), (5, "CC BY CC by cc-by!"), (6, "cc\n\nby"), (7, "İ all RIGHTS reserved K"),
            (8, "the Version 2.0 Apache, license\nLicensed under"), (9, "version 2.0 of the apache license, licensed under")]
    want = sorted(((i, *brute.licenses(t, licenses.PHRASES, licenses.TEMPLATES, licenses.THRESHOLD)) for i, t in rows), key=str)
    assert tuples(licenses.scan(documents(spark, rows))) == want
    assert licenses.scan(documents(spark, [])).collect() == []


def test_languages(spark):
    known = [(i, f"{w} " * 20) for i, w in enumerate(["der und die", "the and of"] * 5)]
    train = documents(spark, known).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "de").otherwise("en"))
    train = train.unionByName(documents(spark, [(90, None), (91, "the")]).withColumn("lang", F.lit(None).cast("string")))
    model = languages.fit(train)
    assert model.languages == ["de", "en"]
    rows = [*NULLS, (5, "the of and"), (5, "the of and"), (6, "12 !?"), (7, "und der die"), (8, "\U0001f600")]
    got = by_id(languages.predict(documents(spark, rows), model), "lang_pred", "score")
    assert got[1] == got[2] == got[6] == got[8] == [("und", 0.0)]
    assert [g[0] for g in got[5]] == ["en", "en"] and got[7][0][0] == "de" and len(got[4]) == 1
    nothing = languages.fit(train.filter("false"))
    assert set(by_id(languages.predict(documents(spark, rows), nothing), "lang_pred")[5]) == {"und"}
    assert languages.predict(documents(spark, []), model).collect() == []


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [nan, 1.0]),
            (8, [inf, 0.0]), (9, []), (None, [1.0, 0.0]), (10, [-0.0, 1.0]), (11, [0.0, 1.0]), (12, [1e-30, 0.3e-30]), (13, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in CLASHES:
        df = df.withColumn(name, F.lit(1))
    got = tuples(vectors.near_duplicates(df))
    # 12 is at 16.7 degrees from the first group, 13 at 45 degrees from everything.
    group = [(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (3, 4, 1, False), (12, 4, 1, False)]
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 13)] + [(None, 0, None, True)]
    assert got == sorted([*group, *alone, (10, 1, 10, True), (11, 1, 10, False)], key=str)
    assert vectors.near_duplicates(df.filter("false")).collect() == []
    assert tuples(vectors.near_duplicates(df.filter("vec_id = 5"))) == [(5, 0, 5, True)]


def test_vector_nodes_are_split_again_and_blocks_agree(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([b + 0.12 * rng.standard_normal((30, 16)) for b in base])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    component = brute.components(range(len(x)), [tuple(map(int, p)) for p in np.argwhere(near)])
    for sizes in ({}, {"task_rows": 100, "sample": 200, "sample_leaf": 80, "leaf": 32, "block": 10}):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df, **sizes).collect()}
        same = sum(got[i] == (near[i].sum(), component[i]) for i in got)
        assert same >= 0.97 * len(x)


def test_decontamination(spark):
    item = "Alpha beta gamma, delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    edited = item.replace("delta", "other words").replace("kappa", "")
    rows = [*NULLS, (5, f"x {item.upper()} y"), (5, f"x {item.upper()} y"), (6, f"some {edited}"), (7, item.replace("a", "q")), (8, LONG + " " + item)]
    items = spark.createDataFrame([(1, item), (2, None), (None, item), (3, "of the"), (4, ""), (5, item)], "item_id long, text string")
    got = tuples(decontamination.find(documents(spark, rows), items).select("doc_id", "item_id", "distance"))
    assert got == sorted([(d, i, e) for d, e in ((5, 0), (5, 0), (6, 3), (8, 0)) for i in (1, 5)], key=str)
    assert decontamination.find(documents(spark, []), items).collect() == []
    assert decontamination.find(documents(spark, rows), items.filter("false")).collect() == []


def test_nearest_end_agrees_with_the_table():
    rng = np.random.default_rng(5)
    for _ in range(60):
        pattern, text = rng.integers(0, 4, rng.integers(1, 9)).tolist(), rng.integers(0, 4, 30).tolist()
        masks = {}
        for i, w in enumerate(pattern):
            masks[w] = masks.get(w, 0) | 1 << i
        assert decontamination.nearest_end(masks, len(pattern), text)[0] == brute.edit_distance(pattern, text)


SECRET = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


def test_secrets(spark):
    rows = [*NULLS, (5, f'token = "{SECRET}" AKIAABCDEFGHIJKL x'), (5, f'token = "{SECRET}" AKIAABCDEFGHIJKL x'),
            (6, "password=secret = abcdefghij PASSWD : short7 Api_Key='abcdefgh"), (7, "é\U0001f600 secret:12345678"),
            (8, "key mB7xQ2pLz9Kv4Rt8Yw3Nc6Jd1Hs5Gf0Ae thisisjustalongordinarysentence")]
    docs = documents(spark, rows)
    ordinary = [("thisisjustalong", False), ("ordinarysentence", False), ("withoutanydigits", False)] * 20
    random = [("mB7xQ2pLz9Kv4Rt8Yw3Nc6Jd1Hs5Gf0Ae", True), ("Zq8Wk3Vx6Tb1Mn4Rp9Ls2Dg7", True), (None, True), ("x", None)] * 20
    model = secrets.fit(spark.createDataFrame(ordinary + random, "token string, random boolean"))
    got = by_id(secrets.digest(secrets.spans(docs, model)), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    for ident, text in rows:
        spans = brute.secrets(text)
        for row in got[ident]:
            assert row[3] == brute.spans_digest(spans) and {f"{k}:{a}:{z}" for a, k, z in spans} <= set(row[4].split(",")) | {""}
    assert len(got[5]) == 2 and got[8][0][4] == "random:4:37" and got[1] == [(0, 0, 0, brute.spans_digest([]), "")]
    assert got[6][0][0] == 1
    masked = by_id(secrets.redact(docs, model), "text")
    assert masked[8] == ["key [SECRET] thisisjustalongordinarysentence"] and masked[1] == [None] and masked[4] == [LONG]
    assert masked[5] == ['[SECRET]" [SECRET] x'] * 2 and masked[7] == ["é\U0001f600 [SECRET]"]
    assert secrets.redact(docs, model).columns == docs.columns
    assert secrets.spans(documents(spark, []), secrets.fit(secrets.samples(documents(spark, [])))).collect() == []


def test_substrings(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [*NULLS, (10, f"a {passage} b"), (11, f"{passage} c\n{passage}"), (11, f"{passage} c\n{passage}"), (12, f"x {passage}  y"),
            (None, passage), (13, passage), (14, passage), (10, passage), (15, passage.upper())]
    got = tuples(substrings.remove_repeats(documents(spark, rows), window=8, seed=3))
    want = sorted(brute.without_repeats(rows, 8), key=str)
    assert got == want
    assert substrings.remove_repeats(documents(spark, [])).collect() == []
    assert tuples(substrings.remove_repeats(documents(spark, [(1, None)]))) == tuples(substrings.remove_repeats(documents(spark, [(1, "")])))


def test_substrings_on_random_texts(spark):
    rng = np.random.default_rng(11)
    rows = [(int(i), " ".join(rng.choice(["a", "b", "c"], rng.integers(0, 60)))) for i in rng.permutation(80)]
    assert tuples(substrings.remove_repeats(documents(spark, rows), window=6, seed=2)) == sorted(brute.without_repeats(rows, 6), key=str)


def test_urls(spark):
    link = '<link rel="canonical" href="%s">'
    rows = [(1, "http://A.net/x#f", link % "https://b.example.org/en/1?x=1"), (1, "http://A.net/x#f", None), (2, "https://a.net/x", None),
            (3, "http://c.net/?q=1", "<meta http-equiv='refresh' content='0; url=http://a.net/x'>"), (4, None, link % "/x"), (5, "nothing", ""),
            (6, "ftp://e.com/fr/1", link % "/zz"), (7, "http://e.com/zz", link % "http://com/de/"), (8, "http://org", ""), (9, "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in (*CLASHES, "host", "path", "rule", "verdict", "blocked"):
        pages = pages.withColumn(name, F.lit("x"))
    got = tuples(urls.decide(pages, URL_RULES).select("page_id", "rule", "verdict"))
    assert got == sorted([(1, None, "block"), (1, None, "block"), (2, None, "block"), (3, None, "block"), (4, None, "allow"), (5, None, "allow"),
                          (6, "com/fr/", "allow"), (7, None, "allow"), (8, None, "allow"), (9, None, "allow")], key=str)
    assert urls.decide(pages.filter("false"), URL_RULES).collect() == []
    assert {r["verdict"] for r in urls.decide(pages, []).collect()} == {"allow"}


def test_packing(spark):
    docs = documents(spark, [*NULLS, (5, "same text"), (5, "same text")])
    rows = packing.pack(docs, tokenizer_file(), with_ids=True).collect()
    length = {}
    for r in rows:
        length.setdefault(r["doc_id"], []).append(r["length"])
        assert len(r["ids"]) == r["length"] and (r["offset"] + r["length"]) <= 2048
    assert length[1] == length[2] == length[3] == [1] and len(length[5]) == 2 and len(length[4]) > 10 and set(length[4][:-1]) == {2048}
    assert packing.pack(documents(spark, []), tokenizer_file()).collect() == []


def test_bins_take_the_tightest_and_close_the_fullest():
    bins = packing.Bins(10, 2)
    assert bins.put(6) == (0, 0) and bins.put(7) == (1, 0)
    assert bins.put(3) == (1, 7)  # three places left fit tighter than four
    assert bins.put(9) == (2, 0) and bins.put(8) == (3, 0)  # two open: the one with one place left is closed
    assert bins.put(1) == (3, 8) and bins.put(10) == (4, 0) and bins.put(4) == (0, 6)


def test_word_ids_equal_the_tokenizer():
    ids = packing.WordIds(tokenizer_file())
    for text in ("İstanbul ΑΣ Σ", "a<|endoftext|>b x", "don't DON'T it's 'll", "éa Åx K", "日本語", "a b c\x0bd\x85e",
                 "́ x", "12,3 a1b2 ___ a_b", "Ǆ ß ẞ ŉ", "\U0001f600\U0001f600 a\U0001f600", "", "  \n\t ", "naïve,... façade!!! (x)"):
        assert np.frombuffer(ids.of(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def test_near_duplicates(spark):
    base = [f"w{i}" for i in range(100)]
    near = base[:50] + ["changed"] + base[51:]
    rows = [*NULLS[:3], (4, LONG), (10, " ".join(base)), (11, " ".join(near)), (12, " ".join(base).upper()), (13, "one two"), (14, "One  TWO"),
            (15, "one two three"), (16, " ".join(base[:60])), (20, " ".join(base[20:])), (21, " ".join(base[19:]))]
    got = tuples(neardup.classes(documents(spark, [*rows, (None, "one two"), (10, " ".join(base))])))
    want = [*brute.near_duplicates(rows), (None, 1, None)]
    assert got == sorted([*want, next(w for w in want if w[0] == 10)], key=str)
    assert neardup.classes(documents(spark, [])).collect() == []
    both = tuples(neardup.classes(documents(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (2, "u v w x y z"), (3, "u v w x y z")])))
    assert {c for _, _, c in both} == {1}


def test_near_duplicates_on_random_sets_and_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(240):
        words = [f"b{i % 6}_{j}" for j in range(40 + i % 6)]
        for _ in range(rng.integers(0, 3)):
            words[rng.integers(0, len(words))] = f"n{i}_{rng.integers(0, 3)}"
        rows.append((i, " ".join(words)))
    want = sorted(brute.near_duplicates(rows), key=str)
    assert tuples(neardup.classes(documents(spark, rows))) == want
    monkeypatch.setattr(neardup, "BLOCK", 7)
    assert tuples(neardup.classes(documents(spark, rows))) == want


def test_quality(spark):
    good = [(i, f"plain words of text number {i} and more of them") for i in range(30)]
    bad = [(100 + i, f"BUY!!! NOW!!! {i}### $$$ ***") for i in range(30)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (5, None), (7, 0), (999, 1)], "doc_id long, quality int")
    model = quality.fit(documents(spark, good + bad), labels, rank=8)
    rows = [*NULLS, (5, "other plain words of the text"), (5, "other plain words of the text"), (6, "SALE!!! ### $$$")]
    got = by_id(quality.predict(documents(spark, rows), model), "score", "predicted")
    assert got[5][0] == got[5][1] and got[5][0][1] == 1 and got[6][0][1] == 0 and got[1] == got[2]
    assert all(0 <= s <= 1 for g in got.values() for s, _ in g)
    nothing = quality.fit(documents(spark, good), labels.filter("false"))
    assert set(by_id(quality.predict(documents(spark, rows), nothing), "score")[5]) == {0.5}
    assert quality.predict(documents(spark, []), model).collect() == []


def test_pipeline_stages_on_nulls_and_nothing(spark, folder):
    data = f"{folder}/data"
    spark.createDataFrame([(5, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{data}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{data}/benchmark.parquet")
    rows = [*NULLS, (None, None), (5, "plain words here"), (5, "plain words here"), (6, "BAD!!! ###"), (7, "x one two three four five six seven eight nine ten y"),
            (8, f"token = {SECRET}")]
    docs = documents(spark, rows).withColumn("score", F.lit(1)).withColumn("predicted", F.lit("z"))
    for given in (docs, docs.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, given, data)
            found = made.collect()
            if name != "best_fit_packing":
                assert made.columns == docs.columns, name
            if given is docs and name == "ngram_jaccard_join":
                assert sorted(str(r["doc_id"]) for r in found) == sorted(["1", "2", "3", "4", "None", "None", "5", "6", "7", "8"])
            if given is docs and name == "benchmark_decontamination":
                assert 7 not in {r["doc_id"] for r in found} and len(found) == len(rows) - 1
            if given is docs and name == "secret_scans":
                assert {r["text"] for r in found if r["doc_id"] == 8} == {"[SECRET]"}
            if given is not docs:
                assert found == []


def test_unknown_columns_fail(spark):
    with pytest.raises(Exception, match="doc_id|cannot be resolved"):
        substrings.remove_repeats(spark.createDataFrame([("a",)], "text string"))
