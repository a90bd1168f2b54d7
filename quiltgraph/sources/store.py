"""Knowledge tables in a folder of Parquet batches.

Each table is a folder with one partition per batch. A batch is written once
and overwritten if it is repeated; reading keeps the last row per key and drops
rows of deleted keys and documents. Nothing here depends on a table format.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.functions.sizes import safe_unions
from quiltgraph.operators.ranking import last_by
from quiltgraph.sources.lines import file_names, path_exists, remove_path, write_text

KEYS = {
    "documents": ["doc_id"],
    "chunks": ["chunk_id"],
    "entities": ["entity_id"],
    "sourced_from": ["entity_id", "chunk_id"],
    "relations": ["source_entity_id", "target_entity_id"],
    "failed_chunks": ["chunk_id"],
    "same_as": ["entity_1_id", "entity_2_id"],
    "link_details": ["entity_1_id", "entity_2_id"],
    "blobs": ["doc_id"],
    "waiting": ["doc_id"],
}


@dataclass(frozen=True)
class Store:
    """Tables under ``root``. In a batch deletions come first and writes after them, in whatever order they are called.

    A deletion names what it removes (keys, documents, or a whole table) and never looks at what is stored, and a batch
    that is repeated writes the same again: repeating any call leaves the store as it was.

    Between ``begin`` and ``commit`` readers see nothing of a batch, neither its writes nor its deletions: the commit is one
    small file, written last. A batch that was never begun is seen as it is written.
    """

    spark: SparkSession
    root: str
    #: Numbers of the batches that are not seen; None: as the files say at each reading.
    hidden: tuple[int, ...] | None = None

    def begin(self, batch: int) -> None:
        """Hide a batch until it is committed; one that was committed before is hidden again."""
        write_text(self.spark, self._path(f"_batches/{batch}.open"), "")
        remove_path(self.spark, self._path(f"_batches/{batch}.done"))

    def commit(self, batch: int, note: str = "") -> None:
        write_text(self.spark, self._path(f"_batches/{batch}.done"), note)

    def open_batches(self) -> tuple[int, ...]:
        """Batches that were begun and not committed, the running one and those that stopped half-way."""
        if self.hidden is not None:
            return self.hidden
        names = file_names(self.spark, self._path("_batches"))
        done = {n.removesuffix(".done") for n in names if n.endswith(".done")}
        return tuple(sorted(int(n.removesuffix(".open")) for n in names if n.endswith(".open") and n.removesuffix(".open") not in done))

    def snapshot(self) -> Store:
        """The same store, for whose reader batches that are open now stay hidden even if they are committed meanwhile."""
        return replace(self, hidden=self.open_batches())

    def touched(self, name: str, batch: int) -> DataFrame:
        """doc_id of the documents that a batch wrote to a table or deleted, whether it is committed or not."""
        slots = F.col("batch").isin(2 * batch, 2 * batch + 1)
        ids = [rows.filter(slots).select(F.col("doc_id").cast("string").alias("doc_id"))
               for rows in (self._log(name, all_batches=True), self._log("deleted_documents", all_batches=True)) if rows is not None]
        found = ids[0] if ids else self.spark.createDataFrame([], "doc_id string")
        found = (found.unionByName(ids[1]) if len(ids) > 1 else found).filter("doc_id is not null").distinct()
        held = self._log(name, all_batches=True)
        return found if held is None else found.select(F.col("doc_id").cast(held.schema["doc_id"].dataType).alias("doc_id"))

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _write(self, rows: DataFrame, path: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    def _log(self, name: str, all_batches: bool = False) -> DataFrame | None:
        path = self._path(name)
        if not path_exists(self.spark, path):
            return None
        hidden = () if all_batches else self.open_batches()
        slots = [n for n in file_names(self.spark, path) if n.startswith("batch=") and int(n[6:]) // 2 not in hidden]
        if not slots:
            return None
        # Only folders of batches that count are listed and opened.
        return safe_unions(self.spark.read.option("mergeSchema", True).option("basePath", path).parquet(*(f"{path}/{n}" for n in slots)))

    def exists(self, name: str) -> bool:
        return path_exists(self.spark, self._path(name))

    def put(self, name: str, rows: DataFrame, batch: int) -> None:
        """Upsert rows by key. Odd slots hold writes, even ones deletions."""
        self._write(rows, self._path(name), 2 * batch + 1)

    def delete(self, name: str, keys: DataFrame, batch: int) -> None:
        """Remove rows by key; keys that are not stored do no harm."""
        marked = keys.select(*KEYS[name]).distinct().withColumn("_deleted", F.lit(True))
        self._write(marked, self._path(name), 2 * batch)

    def _gone(self, name: str) -> DataFrame | None:
        """Latest deletion of each document, as (doc_id, _slot), or of each of its entities for links."""
        marks = self._log("deleted_documents")
        if marks is None:
            return None
        gone = marks.groupBy("doc_id").agg(F.max("batch").alias("_slot"))
        if name != "same_as":
            return gone
        known = self._log("entities")
        if known is None or "doc_id" not in known.columns:
            return None
        held = known.filter("doc_id is not null").select("entity_id", "doc_id").distinct()
        return held.join(gone, "doc_id").groupBy("entity_id").agg(F.max("_slot").alias("_slot"))

    def read(
        self, name: str, where: Column | None = None, before: int | None = None, columns: list[str] | None = None,
        made: dict[str, Column] | None = None, only: DataFrame | None = None,
    ) -> DataFrame | None:
        """Current rows, or None when the table was never written.

        ``where`` is a condition on key columns, applied to the files before versions are merged. ``before`` gives the
        rows as they were before a batch. ``columns`` names the columns wanted beside the keys and the document, ``made``
        has columns made from those of a row, and ``only`` holds the keys wanted; they too come before the merge, so that
        nothing else is shuffled.
        """
        log = self._log(name)
        if log is None:
            return None
        until = F.lit(True) if before is None else F.col("batch") < 2 * before
        log = log.filter(until) if where is None else log.filter(until & where)
        cleared = self._log(f"cleared_{name}")
        if cleared is not None:
            last = cleared.filter(until).agg(F.max("batch")).first()[0]
            log = log.filter(F.col("batch") >= (-1 if last is None else last))
        if "_deleted" not in log.columns:
            log = log.withColumn("_deleted", F.lit(None).cast("boolean"))
        if only is not None:
            log = log.join(only.select(*KEYS[name]), KEYS[name], "left_semi")
        if columns is not None:
            kept = [*KEYS[name], "doc_id", *columns, "batch", "_deleted"]
            log = log.select(*[c for c in log.columns if c in kept], *[c.alias(n) for n, c in (made or {}).items()])
        columns = [c for c in log.columns if c not in KEYS[name]]
        current = last_by(log, KEYS[name], F.col("batch"), columns).filter(F.col("_deleted").isNull()).drop("_deleted")
        gone = self._gone(name)
        if gone is not None and before is not None:
            gone = gone.filter(F.col("_slot") < 2 * before)
        for on in (() if gone is None else ("entity_1_id", "entity_2_id") if name == "same_as" else ("doc_id",)):
            if on not in current.columns:
                continue
            named = gone.select(F.col("entity_id" if name == "same_as" else "doc_id").cast(current.schema[on].dataType).alias(on), "_slot")
            current = current.join(named, on, "left").filter(F.col("_slot").isNull() | (F.col("batch") > F.col("_slot"))).drop("_slot")
        return current.select(*[c for c in log.columns if c in current.columns and c != "batch"])

    def count(self, name: str, where: Column | None = None) -> int:
        rows = self.read(name, where)
        return 0 if rows is None else rows.count()

    def ids(self, name: str = "documents") -> DataFrame:
        """Sorted distinct document ids of a table."""
        return self.read(name).select("doc_id").distinct().orderBy("doc_id")

    def create(self, name: str, schema) -> None:
        """An empty table, unless there is one already."""
        if not self.exists(name):
            self._write(self.spark.createDataFrame([], schema), self._path(name), 0)

    def drop(self, *names: str) -> None:
        """Remove tables with all their batches; a table that does not exist does no harm."""
        for name in names or (*KEYS, "deleted_documents"):
            remove_path(self.spark, self._path(name))
            remove_path(self.spark, self._path(f"cleared_{name}"))

    def blob(self, doc_id) -> str | None:
        """Stored JSON of one document, or None."""
        rows = self.read("blobs", F.col("doc_id") == doc_id)
        found = [] if rows is None else rows.select("blob").take(1)
        return found[0]["blob"] if found else None

    def compact(self, name: str, target: Store, batch: int = 0) -> None:
        """Write the current rows as one batch of another store."""
        target.put(name, self.read(name), batch)

    def delete_documents(self, ids: DataFrame, batch: int) -> None:
        """Remove documents with everything derived from them, blobs and log entries too; unknown ids do no harm."""
        self._write(ids.select("doc_id").distinct(), self._path("deleted_documents"), 2 * batch)

    def delete_all(self, name: str, batch: int) -> int:
        """Remove every row that a table held before this batch and say how many there were."""
        rows = self.read(name, before=batch)
        if rows is None:
            return 0
        n = rows.count()
        self._write(self.spark.range(1).select(F.lit(name).alias("name")), self._path(f"cleared_{name}"), 2 * batch)
        return n

    def append_log(self, name: str, rows: DataFrame, batch: int) -> None:
        self._write(rows, self._path(f"log_{name}"), batch)

    def read_log(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        """All rows of a log, or those of batches before a number."""
        path = self._path(f"log_{name}")
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.option("basePath", path).parquet(path)
        return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")

    def log_processed(self, ids: DataFrame, batch: int) -> None:
        self.append_log("processed", ids.select(F.col("doc_id").cast("string").alias("doc_id")), batch)

    def processed(self) -> DataFrame:
        """Ids in the log that were not deleted since."""
        path = self._path("log_processed")
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], "doc_id string")
        rows, gone = self.spark.read.option("basePath", path).parquet(path), self._gone("documents")
        rows = rows.filter(~F.col("batch").isin(*self.open_batches())) if self.open_batches() else rows
        if gone is not None:
            named = gone.select(F.col("doc_id").cast("string").alias("doc_id"), "_slot")
            rows = rows.join(named, "doc_id", "left").filter(F.col("_slot").isNull() | (2 * F.col("batch") + 1 > F.col("_slot")))
        return rows.select("doc_id").distinct()


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; an answer log appends, linking details overwrite."""
    rows.write.mode("append" if append else "overwrite").json(path)


def write_failed_chunks(chunks: DataFrame, path: str) -> None:
    """Failed chunks as JSON under one folder per document, as ``read_failed_chunks`` takes them."""
    columns = ["tokens", "content", "chunk_order_index", "chunk_id", "doc_id"]
    chunks.select(*columns, F.col("doc_id").alias("document")).write.mode("overwrite").partitionBy("document").json(path)


def document_blobs(documents: DataFrame, chunks: DataFrame, entities: DataFrame, sourced: DataFrame, relations: DataFrame) -> DataFrame:
    """One JSON object per document with its chunks, entities and relations, vectors left out."""

    def listed(df, alias, order):
        fields = [c for c in df.columns if c not in ("vector", "doc_id")]
        key = [F.col(c) for c in order]
        packed = F.array_sort(F.collect_list(F.struct(F.struct(*key).alias("o"), F.struct(*fields).alias("v"))))
        return df.groupBy("doc_id").agg(F.transform(packed, lambda x: x["v"]).alias(alias))

    ids = sourced.groupBy("entity_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("source_chunk_ids"))
    full = entities.join(ids, "entity_id", "left")
    out = documents.select("doc_id", "summary")
    for df, alias, order in (
        (chunks, "chunks", ["chunk_order_index"]), (full, "entities", ["entity_id"]),
        (relations, "relations", ["source_entity_id", "target_entity_id"]),
    ):
        out = out.join(listed(df, alias, order), "doc_id", "left")
    return out.select("doc_id", F.to_json(F.struct(*[c for c in out.columns])).alias("blob"))
