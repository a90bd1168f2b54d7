"""The supplied Parquet tables under the names the engine uses."""

from pyspark.sql import DataFrame, SparkSession

from quiltgraph.functions.sizes import safe_unions


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return safe_unions(spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core on an input with fewer splits than cores.

    Such an input is at most (cores x split size), so this shuffle is small by
    construction; an input with enough splits is left as scanned. Hashing on the
    key lets the per-key aggregates that follow reuse the placement.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def documents(spark: SparkSession, directory: str) -> DataFrame:
    return spread(table(spark, directory, "documents").select("doc_id", "text"), "doc_id")
