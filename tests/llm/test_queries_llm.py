"""Every registered corpus query on the smallest tables, against SQL or the plain versions."""

import math
import os
import re
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute
import corpus_pipeline
from compare import duck, table_of
from quiltgraph.llm import licenses
from quiltgraph.llm.queries import ORACLE, QUERIES, tokenizer_file

DATA = os.environ.get("QUILTGRAPH_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name):
    return QUERIES[name](spark, DATA).collect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    cursor = duck(DATA).execute(ORACLE[name])
    df = QUERIES[name](spark, DATA)
    assert table_of(df.columns, [tuple(r) for r in df.collect()]) == table_of([c[0] for c in cursor.description], cursor.fetchall())


def test_thirteen_operators_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))


def test_op1(spark, texts):
    for r in run(spark, "op1_license_scans"):
        assert tuple(r)[1:] == brute.licenses(texts[r["doc_id"]], licenses.PHRASES, licenses.TEMPLATES, licenses.THRESHOLD)


def test_op2_on_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    rows = run(spark, "op2_language_id")
    assert len(rows) == len(lang) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_op3(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    ids = [r["vec_id"] for r in rows]
    component = brute.components(ids, [(ids[i], ids[j]) for i, j in np.argwhere(near)])
    want = sorted((ids[i], int(near[i].sum()), component[ids[i]], component[ids[i]] == ids[i]) for i in range(len(ids)))
    assert sorted(tuple(r) for r in run(spark, "op3_embedding_near_dedup")) == want


def test_op4_recall(spark, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    words = lambda t: re.findall(brute.PLACES, (t or "").translate(brute.UPPER))
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in run(spark, "op4_benchmark_decontamination")}
    want = {}
    for doc, text in texts.items():
        of_doc = words(text)
        for item, wanted in items.items():
            wanted = words(wanted)
            # Within 20 % of edits at least one word triple is left, which spares the full comparison of most pairs.
            triples = {tuple(wanted[i : i + 3]) for i in range(len(wanted) - 2)}
            if any(tuple(of_doc[i : i + 3]) in triples for i in range(len(of_doc) - 2)):
                distance = brute.edit_distance(wanted, of_doc)
                if distance <= int(0.2 * len(wanted) + 1e-9):
                    want[doc, item] = distance
    assert set(found) <= set(want) and len(found) >= 0.95 * len(want) and want
    assert all(found[k] == want[k] for k in found)


def test_op5(spark, texts):
    for r in run(spark, "op5_secret_scans"):
        spans = brute.secrets(texts[r["doc_id"]])
        kinds = [k for _, k, _ in spans]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds.count("assign"), kinds.count("access"), kinds.count("hex"))
        assert r["base_sha256"] == brute.spans_digest(spans)
        assert {f"{k}:{a}:{z}" for a, k, z in spans} <= set(r["spans"].split(","))


def test_op6(spark, texts):
    assert sorted(tuple(r) for r in run(spark, "op6_substring_dedup")) == sorted(brute.without_repeats(list(texts.items()), 50))


def test_op8_round_trip(spark, texts):
    from tokenizers import Tokenizer

    tokenizer, rows = Tokenizer.from_file(tokenizer_file()), run(spark, "op8_best_fit_packing")
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
        assert sorted(pieces[doc]) == want
    for held in sequences.values():
        ends = [0]
        for offset, length in sorted(held):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 2048
    assert len(sequences) <= 1.05 * math.ceil(sum(r["length"] for r in rows) / 2048) + 2


def test_op9(spark, texts):
    assert sorted(tuple(r) for r in run(spark, "op9_ngram_jaccard_join")) == sorted(brute.near_duplicates(list(texts.items())))


def test_op10_on_held_out_rows(spark):
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = run(spark, "op10_quality_classifier")
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    known = [r for r in rows if r["doc_id"] in quality and r["held_out"]]
    assert sum(r["predicted"] == quality[r["doc_id"]] for r in known) >= 0.85 * len(known)


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found, kept = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.cut_lineage(stage(spark, kept, DATA))
        found[name] = made
        if name != "best_fit_packing":
            assert made.columns == docs.columns
            kept = made
    groups = brute.near_duplicates([tuple(r) for r in found["quality_classifier"].select("doc_id", "text").collect()])
    assert sorted(r["doc_id"] for r in found["ngram_jaccard_join"].collect()) == sorted(i for i, _, c in groups if i == c)
    assert all(not brute.secrets(r["text"]) for r in found["secret_scans"].collect())
    last = {r["doc_id"] for r in found["best_fit_packing"].collect()}
    assert last == {r["doc_id"] for r in found["secret_scans"].collect()} and 0 < len(last) < len(texts)
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, DATA).count() == found["best_fit_packing"].count()
