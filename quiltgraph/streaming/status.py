"""Document status and continuous ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.functions.sizes import cut_lineage, safe_unions
from quiltgraph.operators.ranking import first_by, last_by

PENDING, PROCESSING, PROCESSED, FAILED = "PENDING", "PROCESSING", "PROCESSED", "FAILED"
MOST_HALVINGS = 40


def queue(documents: DataFrame, status: DataFrame) -> DataFrame:
    """Documents that are new, failed or were interrupted, with their status."""
    known = documents.join(status.select("doc_id", "status"), "doc_id", "left")
    return known.withColumn("status", F.coalesce("status", F.lit(PENDING))).filter(F.col("status") != PROCESSED)


def latest(log: DataFrame) -> DataFrame:
    """Current status per document from an append-only log (doc_id, status, seq, ...)."""
    return last_by(log, "doc_id", F.col("seq"), [c for c in log.columns if c != "doc_id"])


def _ingested(part: DataFrame, ingest: Callable[[DataFrame], dict[str, DataFrame]], depth: int = 0) -> tuple[list[dict], list[DataFrame]]:
    """(written tables, failed documents with their error): halves of a failing part are tried apart, down to single documents."""
    try:
        return [{name: cut_lineage(rows) for name, rows in ingest(part).items()}], []
    except Exception as problem:  # noqa: BLE001
        if depth >= MOST_HALVINGS or len(part.select("doc_id").take(2)) < 2:
            return [], [part.select("doc_id").withColumn("error", F.lit(str(problem)))]
    bit = F.shiftright(F.xxhash64("doc_id"), depth).bitwiseAND(F.lit(1))
    made, failed = [], []
    for side in (0, 1):
        half = part.filter(bit == side)
        if half.take(1):
            good, bad = _ingested(half, ingest, depth + 1)
            made, failed = made + good, failed + bad
    return made, failed


def again(waiting: DataFrame | None, log: DataFrame, most_attempts: int) -> DataFrame | None:
    """Stored rows of documents that failed or were interrupted, fewer than ``most_attempts`` times."""
    if waiting is None:
        return None
    tries = log.filter(F.col("status") == PROCESSING).groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_tries"))
    due = latest(log).filter(F.col("status").isin(FAILED, PROCESSING)).select(F.col("doc_id").alias("_id")).join(tries, "_id").filter(
        F.col("_tries") < most_attempts)
    return waiting.join(due, F.col("doc_id").cast("string") == F.col("_id"), "left_semi")


def start(
    stream: DataFrame, ingest: Callable[[DataFrame], dict[str, DataFrame]], store, checkpoint: str, available_now: bool = True,
    most_attempts: int = 3,
):
    """Ingest a stream of documents batch by batch.

    Each batch takes the first copy of each document, drops those already processed,
    logs the rest as being processed, ingests them and writes the tables under its
    batch number, so a repeated batch overwrites itself. Documents that fail are
    logged with their error and do not hold up the others. Their rows are kept in
    the store, and later batches take them up again, without their arriving again,
    until they were tried ``most_attempts`` times; what arrives again is always tried.
    """

    def run(batch: DataFrame, number: int) -> None:
        safe_unions(batch)
        log = store.read_log("status", "doc_id string, status string, seq long, error string", before=2 * number)
        status = latest(log)
        fields = [c for c in batch.columns if c != "doc_id"]
        arrived = first_by(batch.withColumn("_at", F.monotonically_increasing_id()), "doc_id", F.col("_at"), fields)
        todo = cut_lineage(queue(arrived, status).drop("status"))
        due = again(store.read("waiting", before=number), log, most_attempts)
        if due is not None:
            todo = cut_lineage(todo.unionByName(due.select(*todo.columns).join(todo.select("doc_id"), "doc_id", "left_anti")))

        def note(rows: DataFrame, state: str, slot: int) -> DataFrame:
            error = F.col("error") if "error" in rows.columns and state == FAILED else F.lit(None).cast("string")
            return rows.select(
                F.col("doc_id").cast("string").alias("doc_id"), F.lit(state).alias("status"), F.lit(slot).cast("long").alias("seq"), error.alias("error"))

        store.append_log("status", note(todo, PROCESSING, 2 * number), 2 * number)
        made, failed = _ingested(todo, ingest)
        for name in made[0] if made else ():
            rows = made[0][name]
            for more in made[1:]:
                rows = rows.unionByName(more[name])
            store.put(name, rows, number)
        ended = todo
        lost = None
        for rows in failed:
            lost = rows if lost is None else lost.unionByName(rows)
        if lost is not None:
            lost = cut_lineage(lost)
            store.put("waiting", todo.join(lost.select("doc_id"), "doc_id", "left_semi"), number)
            ended = todo.join(lost.select("doc_id"), "doc_id", "left_anti")
        log = note(ended, PROCESSED, 2 * number + 1)
        store.append_log("status", log if lost is None else log.unionByName(note(lost, FAILED, 2 * number + 1)), 2 * number + 1)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
