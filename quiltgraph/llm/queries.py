"""One query per operator: production parameters, whole tables, the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.llm import decontamination, languages, licenses, neardup, quality, rules, search, secrets, sql, substrings, urls, vectors, whitening
from quiltgraph.llm.packing import pack
from quiltgraph.llm.registry import ORACLE, QUERIES, query, table

__all__ = ["ORACLE", "QUERIES"]


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op8_best_fit_packing")
def op8(spark: SparkSession, directory: str) -> DataFrame:
    return pack(table(spark, directory, "documents"), tokenizer_file())


@query("op2_language_id")
def op2(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    model = languages.fit(docs.filter(languages.remainder("doc_id", 4) != 2))
    held_out = F.coalesce(languages.remainder("doc_id", 4) == 2, F.lit(False))
    return languages.predict(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})


@query("op10_quality_classifier")
def op10(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    labels = table(spark, directory, "labels").filter(languages.remainder("doc_id", 5) != 0)
    model = quality.fit(docs, labels)
    held_out = F.coalesce(languages.remainder("doc_id", 5) == 0, F.lit(False))
    return quality.predict(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})


URL_RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


@query("op7_url_filters", sql=sql.URLS)
def op7(spark: SparkSession, directory: str) -> DataFrame:
    return urls.decide(table(spark, directory, "pages"), URL_RULES)


@query("op5_secret_scans")
def op5(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents")
    return secrets.digest(secrets.spans(docs, secrets.fit(secrets.samples(docs))))


@query("op1_license_scans", sql=sql.licenses(licenses.PHRASES, licenses.template_sets(licenses.TEMPLATES, licenses.THRESHOLD)))
def op1(spark: SparkSession, directory: str) -> DataFrame:
    return licenses.scan(table(spark, directory, "documents"))


@query("op4_benchmark_decontamination")
def op4(spark: SparkSession, directory: str) -> DataFrame:
    return decontamination.find(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


@query("op6_substring_dedup", sql=sql.SUBSTRINGS)
def op6(spark: SparkSession, directory: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, directory, "documents"))


@query("op9_ngram_jaccard_join", sql=sql.NEAR_DUPLICATES)
def op9(spark: SparkSession, directory: str) -> DataFrame:
    return neardup.classes(table(spark, directory, "documents"))


@query("op3_embedding_near_dedup", sql=sql.VECTORS)
def op3(spark: SparkSession, directory: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, directory, "embeddings"))


@query("op11_lexical_search", sql=sql.SEARCH)
def op11(spark: SparkSession, directory: str) -> DataFrame:
    return search.search(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


@query("op12_embedding_whitening")
def op12(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "embeddings")
    model = whitening.fit(rows)
    listed = whitening.whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    explained = F.array(*map(F.lit, model.explained.tolist())) if model else F.array().cast("array<double>")
    return listed.select(
        "vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, "_at").alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"))


@query("op13_quality_rules", sql=sql.quality_rules(rules.RULES, rules.RISK, rules.ERROR, rules.TOP))
def op13(spark: SparkSession, directory: str) -> DataFrame:
    judged = rules.filter_quality(table(spark, directory, "documents"), table(spark, directory, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
