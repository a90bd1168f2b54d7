"""Size checks, skew-proof joins and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiltgraph.config import Settings

DEFAULT = Settings()


def safe_unions(df: DataFrame) -> DataFrame:
    """Have this session shuffle after a union instead of trusting the placement of its inputs.

    Spark 4.1 lets an aggregate over a union of equally hashed inputs skip its
    shuffle; with aggregates and joins below the union this splits groups and
    gives wrong rows. Every entry point of the library passes through here.
    """
    df.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return df


def in_small_batches(spark: SparkSession) -> None:
    """Have this session send rows to Python in batches of at most 8 MB, so that long texts do not add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def proven_small(df: DataFrame, max_rows: int) -> bool:
    """True when a bounded count shows at most ``max_rows`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], salts: int, how: str = "inner", read_from_files: bool = False
) -> DataFrame:
    """Equi-join whose hot keys on the ``big`` side are split into ``salts`` parts.

    ``how`` is inner, left or left_semi. The small side is repeated once per salt, so every pair still meets exactly once.
    A row's salt is a hash of the row, which a repeated task gives again. Equal rows of a hot key then stay together;
    where ``big`` comes straight from files, whose rows are numbered alike at every reading, ``read_from_files`` splits
    these too. Both sides are shuffled: the planner would judge the small side by the size of its compressed files, without
    its repetition, and could send far more than its limit through the driver.
    """
    place = F.monotonically_increasing_id() if read_from_files else F.xxhash64(*big.columns)
    big = big.withColumn("_salt", F.pmod(place, F.lit(salts)).cast("int"))
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.join(small.hint("merge"), [*on, "_salt"], how).drop("_salt")


def join_lookup(
    big: DataFrame, small: DataFrame, on: list[str], settings: Settings = DEFAULT, how: str = "inner"
) -> DataFrame:
    """Join a large table with a lookup side: broadcast when proven small, salted otherwise."""
    if proven_small(small, settings.broadcast_rows):
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, settings.salts, how)


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session in which tables between steps are written.

    A cluster has to name one in ``spark.checkpoint.dir``; only a session in one
    local process makes its own.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def cut_lineage(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write the rows as a table in the cluster's checkpoint folder and continue from it.

    The table survives lost executors, is read column by column, and gives the
    planner true sizes. The folder belongs to whoever set it up and is cleared by
    them; ``remove_tables`` takes away tables that no later step reads. ``compression`` is a codec of Parquet: zstd writes
    less for more work.
    """
    spark = safe_unions(df).sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._written_to = path
    return made


def remove_tables(*tables: DataFrame) -> None:
    """Delete tables that ``cut_lineage`` gave, once everything made from them is written."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
