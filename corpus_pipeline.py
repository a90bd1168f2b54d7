"""Corpus pipeline: documents to packed training sequences.

Every stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all rows that the stage before kept; all but the last
return the columns of ``docs``. Rows without an id pass the stages that judge documents by their own text like any other;
the near-duplicate stage, which names documents by id, keeps them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.functions.sizes import cut_lineage, proven_small, salted_join
from quiltgraph.llm import decontamination, neardup, packing, quality, secrets
from quiltgraph.llm.components import SALTS
from quiltgraph.llm.queries import tokenizer_file
from quiltgraph.llm.registry import table

#: Most ids of dropped documents that are broadcast; with more, the documents are shuffled to them.
BROADCAST_IDS = 1_000_000
#: Least words of a benchmark item for which documents are dropped.
LEAST_ITEM_WORDS = 5


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows whose id and text hash are not in ``dropped`` (_id, _hash); null ids count as equal."""
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    keyed = docs.toDF(*plain).withColumn("_h", F.xxhash64(plain[names.index("text")]))
    other = F.broadcast(dropped) if proven_small(dropped, BROADCAST_IDS) else dropped
    same = keyed[plain[names.index("doc_id")]].eqNullSafe(other["_id"]) & (keyed["_h"] == other["_hash"])
    return keyed.join(other, same, "left_anti").select(*plain).toDF(*names)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    A row is judged by its text alone, so equal rows share their fate; null and empty texts are scored by their shape. Of
    labelled documents at equal cosines the smaller id votes. Without labels every score is 0.5, which keeps everything;
    empty tables stay empty.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    plain = {f"_c{i}": F.col(f"`{n}`") for i, n in enumerate(docs.columns)}
    judged = quality.predict(docs, model, plain, kept_text=f"_c{docs.columns.index('text')}")
    return judged.filter("predicted = 1").select(*(F.col(c).alias(n) for c, n in zip(plain, docs.columns, strict=True)))


def _with_row_keys(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``_key``, one whole number for each id and text in the order of ids, and the ids that have several rows.

    Where no id repeats the id itself is the key. Else the distinct ids and text hashes are numbered in sorted order, each
    range of them by one task.
    """
    several = cut_lineage(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if not several.take(1):
        return docs.withColumn("_key", F.col("doc_id").cast("bigint")), several
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    numbers = hashed.filter("doc_id is not null").select("doc_id", "_hash").distinct().repartitionByRange("doc_id", "_hash").sortWithinPartitions(
        "doc_id", "_hash").withColumn("_key", F.monotonically_increasing_id())
    return salted_join(hashed, cut_lineage(numbers), ["doc_id", "_hash"], SALTS, "left", read_from_files=True).drop("_hash"), several


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Rows with one id and different texts are documents of their own: each stays unless its own text links to a smaller id
    or to an earlier text of its id (texts of one id are in the order of their hashes). Of rows with equal id and text one
    stays, the first by the JSON of its columns. Rows without an id, a text or a word are linked to nothing and stay. An
    empty table stays empty.
    """
    names = docs.columns
    plain = [f"c{i}" if n not in ("doc_id", "text") else n for i, n in enumerate(names)]
    keyed, several = _with_row_keys(docs.toDF(*plain))
    keyed = cut_lineage(keyed) if several.take(1) else keyed
    dropped = cut_lineage(neardup.classes(keyed, key="_key").filter("component_id != _key").select(F.col("_key").alias("_gone")).distinct())
    other = F.broadcast(dropped) if proven_small(dropped, BROADCAST_IDS) else dropped
    kept = keyed.join(other, keyed["_key"] == other["_gone"], "left_anti")
    if not several.take(1):
        return kept.select(*plain).toDF(*names)
    again = F.broadcast(several) if proven_small(several, BROADCAST_IDS) else several
    row = F.struct(*plain)
    first = kept.join(again, "doc_id", "left_semi").groupBy("_key").agg(F.min_by(row, F.to_json(row)).alias("_r")).select("_r.*")
    return kept.join(again, "doc_id", "left_anti").select(*plain).unionByName(first).toDF(*names)


def _benchmark_places(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.col("text").alias("_text"))
    return decontamination.find(keyed, table(spark, sf_dir, "benchmark"), text="_text", keys=("_id", "_hash"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str, least_item_words: int = LEAST_ITEM_WORDS) -> DataFrame:
    """Documents that hold no benchmark item of at least ``least_item_words`` words.

    Shorter items are words and phrases that clean documents hold by chance; ``short_item_places`` lists what stays because
    of this. Every row is judged by its own text: null and empty texts hold nothing and stay, rows with one id and text are
    kept or dropped together, rows without an id like any other. Empty tables drop nothing.
    """
    found = _benchmark_places(spark, docs, sf_dir).filter(F.col("n_item_words") >= least_item_words)
    return _without(docs, cut_lineage(found.select("_id", "_hash").distinct()))


def short_item_places(spark: SparkSession, docs: DataFrame, sf_dir: str, least_item_words: int = LEAST_ITEM_WORDS) -> DataFrame:
    """doc_id, item_id, n_item_words of the exact copies of shorter items, for which ``without_benchmarks`` drops nothing."""
    found = _benchmark_places(spark, docs, sf_dir).filter(F.col("n_item_words") < least_item_words)
    return found.select(F.col("_id").alias("doc_id"), "item_id", "n_item_words")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with secrets masked; n_chars, where there is one, follows a changed text.

    No row is dropped. Null and empty texts stay as they are, equal texts are masked alike, overlapping spans as one.
    """
    masked = secrets.redact(docs, secrets.fit(secrets.samples(docs)))
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.when(F.col("text").contains(secrets.MASK), F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of 2048, the columns of ``packing.pack``.

    Null and empty texts are the one end token; repeated rows are packed each for itself; an empty table gives no rows.
    """
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("quality_classifier", keep_good_quality),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmarks),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]

#: The classifier, the walks and the tokenizer are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
