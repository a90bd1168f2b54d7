"""Preparing document and question sets: filters, coverage, resume and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltgraph.functions.text import word_count


def article_filter(docs: DataFrame, id_col: str, text_col: str, low: int = 100, high: int = 2000) -> DataFrame:
    """Documents of ``low`` to ``high`` words whose id holds no quote."""
    counted = docs.withColumn("n_words", word_count(F.col(text_col)))
    return counted.filter(F.col("n_words").between(low, high) & ~F.col(id_col).cast("string").rlike("['\"]"))


def fully_covered(questions: DataFrame, required: DataFrame, available: DataFrame, key: str, doc: str, empty_ok: bool) -> DataFrame:
    """Questions all of whose required documents are available.

    ``required`` is (key, doc). A question requiring nothing is kept or dropped
    by ``empty_ok``. Missing documents are counted per question before any
    shuffle on the question, so a long list is no bottleneck.
    """
    marked = required.select(key, doc).join(available.select(doc).distinct().withColumn("_ok", F.lit(1)), doc, "left")
    state = marked.groupBy(key).agg(F.sum(F.when(F.col("_ok").isNull(), 1).otherwise(0)).alias("_missing"))
    if empty_ok:
        return questions.join(state.filter("_missing > 0"), key, "left_anti")
    return questions.join(state.filter("_missing = 0"), key, "left_semi")


def without_failed(questions: DataFrame, required: DataFrame, failed: DataFrame, key: str, doc: str) -> DataFrame:
    """Questions none of whose required documents failed."""
    hit = required.select(key, doc).join(failed.select(doc).distinct(), doc, "left_semi").select(key).distinct()
    return questions.join(hit, key, "left_anti")


def required_documents(docs: DataFrame, required: DataFrame, doc: str) -> DataFrame:
    return docs.join(required.select(doc).distinct(), doc, "left_semi")


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows still to be processed."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def done_ids(*logs: DataFrame) -> DataFrame:
    """Union of processed ids over several logs, duplicates harmless."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out.distinct()


def fewest_documents(questions: DataFrame, size: Column, order: str, n: int) -> DataFrame:
    """The ``n`` questions that require the fewest documents, input order on ties."""
    return questions.withColumn("n_documents", size).orderBy("n_documents", order).limit(n)


def documents_per_question(questions: DataFrame, size: Column) -> DataFrame:
    return questions.groupBy(size.alias("n_documents")).agg(F.count("*").alias("n_questions"))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1")


def stale_documents(processed: DataFrame, referenced: DataFrame, doc: str) -> DataFrame:
    """Processed documents that no question refers to."""
    return not_done(processed, referenced, doc)


def united(rows: DataFrame, key: str, items: str) -> DataFrame:
    """Sorted distinct union of the lists of each key."""
    return rows.select(key, F.explode(items).alias("_item")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("_item")).alias(items))


def distinct_titles(questions: DataFrame, contexts: str, title: str = "title") -> DataFrame:
    """Titles named in the contexts of all questions, each once, in order."""
    return questions.select(F.explode(contexts).alias("_c")).select(F.col(f"_c.{title}").alias(title)).distinct().orderBy(title)


def progress(log: DataFrame, total: int) -> DataFrame:
    """Finished rows of a run log (duration), their mean seconds and the seconds left for the rest."""
    state = log.agg(F.count("*").alias("done"), F.avg("duration").alias("mean_seconds"))
    left = F.lit(total) - F.col("done")
    return state.withColumn("seconds_left", F.greatest(left, F.lit(0)) * F.coalesce("mean_seconds", F.lit(0.0)))
