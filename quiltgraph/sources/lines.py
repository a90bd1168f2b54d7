"""JSON-line and file sources.

The parsers work on rows ``position, value``: one raw line and its place in the
input. ``read_lines`` supplies both from files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quiltgraph import schemas
from quiltgraph.functions.replies import is_json
from quiltgraph.functions.rows import unnest
from quiltgraph.functions.sizes import safe_unions
from quiltgraph.functions.text import file_stem, strip, unescape_html
from quiltgraph.operators.ranking import first_by


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: file, start of the split, then order inside the split."""
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )
    return safe_unions(spark.read.text(path).select(place.alias("position"), "value"))


def parsed(lines: DataFrame, schema: StructType, strict: bool = False) -> DataFrame:
    """Columns of the lines that are JSON objects; ``strict`` fails on a line that is not."""
    rows = lines.filter(strip(F.col("value")) != "")
    valid = is_json(F.col("value")) & strip(F.col("value")).startswith("{")
    if strict:
        checked = F.when(valid, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), "value")))
        rows = rows.withColumn("value", checked)
    else:
        rows = rows.filter(valid)
    return rows.select("position", F.from_json("value", schema).alias("_j")).select("position", "_j.*")


def _present(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def documents_from_lines(lines: DataFrame, unescape: bool = False, distinct: bool = True) -> DataFrame:
    """``id, text``, both trimmed and not empty; the first line of an id wins."""
    rows = parsed(lines, schemas.DOCUMENT)
    if unescape:
        rows = unescape_html(rows, "id", "text")
    rows = rows.select("position", strip(F.col("id")).alias("id"), strip(F.col("text")).alias("text"))
    rows = rows.filter(_present("id") & _present("text"))
    return first_by(rows, "id", F.col("position"), ["text"]) if distinct else rows.select("id", "text")


def paragraphs_from_lines(lines: DataFrame, limit: int | None = None, unescape: bool = False) -> DataFrame:
    """Paragraphs of questions as documents, first of an id wins; a broken line fails the read.

    ``limit`` counts questions, not paragraphs.
    """
    rows = parsed(lines, schemas.NESTED_QUESTION, strict=True)
    if limit is not None:
        rows = rows.orderBy("position").limit(limit)
    flat = unnest(rows.select("position", "paragraphs"), ["position"], F.col("paragraphs"), "place")
    flat = flat.filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    if unescape:
        flat = unescape_html(flat, "id", "text")
    return first_by(flat, "id", F.struct("position", "place"), ["text"])


def questions_from_lines(lines: DataFrame, limit: int | None = None, id_prefix: str | None = None) -> DataFrame:
    """Questions with every field present. ``limit`` counts raw lines.

    ``id_prefix`` gives a question without id the prefix and its zero-based line number.
    """
    if limit is not None:
        lines = lines.orderBy("position").limit(limit)
    rows = lines
    if id_prefix is not None:
        rows = _numbered(rows)
    keep = ["position", "line_number"] if id_prefix is not None else ["position"]
    valid = rows.filter(is_json(F.col("value")) & strip(F.col("value")).startswith("{"))
    out = valid.select(*keep, F.from_json("value", schemas.QUESTION).alias("_j")).select(*keep, "_j.*")
    if id_prefix is not None:
        out = out.withColumn("id", F.coalesce("id", F.concat(F.lit(id_prefix), F.col("line_number").cast("string"))))
    return out.filter("id is not null and question is not null and answer is not null and ids is not null").select(
        "id", "question", "answer", "ids"
    )


def _numbered(lines: DataFrame) -> DataFrame:
    """Zero-based line numbers over all partitions without gathering the lines.

    Rows are range-partitioned by position; each partition numbers its own rows
    and adds the sizes of the partitions before it, of which there are few.
    """
    from pyspark.sql import Window

    from quiltgraph.functions.sizes import cut_lineage

    placed = lines.repartitionByRange("position").sortWithinPartitions("position")
    placed = cut_lineage(placed.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    number = F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1)
    return joined.withColumn("line_number", number).drop("_part", "_m", "_before")


def read_documents(spark: SparkSession, path: str, unescape: bool = False, distinct: bool = True) -> DataFrame:
    return documents_from_lines(read_lines(spark, path), unescape, distinct)


def read_paragraphs(spark: SparkSession, path: str, limit: int | None = None, unescape: bool = False) -> DataFrame:
    return paragraphs_from_lines(read_lines(spark, path), limit, unescape)


def read_questions(spark: SparkSession, path: str, limit: int | None = None, id_prefix: str | None = None) -> DataFrame:
    return questions_from_lines(read_lines(spark, path), limit, id_prefix)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Every ``*.md`` file of a folder as one document named by its stem."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md")
    return files.select(file_stem(F.col("_metadata.file_name")).alias("id"), F.col("value").alias("text"))


def read_multihop(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Multi-hop questions from Parquet, with their context as (title, sentences) pairs; ``limit`` takes the first in file order."""
    rows = spark.read.schema(schemas.MULTIHOP).parquet(path)
    if limit is None:
        return rows
    order = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.select("*", *(c.alias(f"_o{i}") for i, c in enumerate(order))).orderBy("_o0", "_o1", "_o2").limit(limit).drop("_o0", "_o1", "_o2")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages projected to documents: the title is the id, the content the text."""
    return parsed(read_lines(spark, path), schemas.RAW_PAGE).select(F.col("title").alias("id"), F.col("content").alias("text"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a line log; a log that does not exist holds none."""
    empty = spark.createDataFrame([], "doc_id string")
    if not path_exists(spark, path):
        return empty
    rows = spark.read.text(path).select(strip(F.col("value")).alias("doc_id"))
    return rows.filter("doc_id <> ''").distinct()


def read_answered(spark: SparkSession, path: str) -> DataFrame:
    """Ids already in an answer log; broken lines are skipped."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "id string")
    return parsed(read_lines(spark, path), schemas.ANSWER_LOG).filter("id is not null").select("id").distinct()


def read_failed_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Failed chunks with the document that names their file.

    Two layouts are read: one JSON array per document in ``failed_chunks_*.json``, and the
    folders per document that ``write_failed_chunks`` makes.
    """
    rows = spark.read.schema(schemas.FAILED_CHUNK).option("multiLine", True).option("pathGlobFilter", "failed_chunks_*.json").json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"failed_chunks_(.*)\.json", 1)
    rows = rows.select(*schemas.FAILED_CHUNK.fieldNames(), F.translate(F.url_decode(name), "_", " ").alias("file_doc_id"))
    files, hadoop = _file_system(spark, f"{path.rstrip('/')}/document=*")
    if not files.globStatus(hadoop):
        return rows
    written = spark.read.schema(schemas.FAILED_CHUNK).option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").json(path)
    return rows.unionByName(written.withColumn("file_doc_id", F.col("doc_id")))


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    files, hadoop = _file_system(spark, path)
    return files.exists(hadoop)


def remove_path(spark: SparkSession, path: str) -> bool:
    files, hadoop = _file_system(spark, path)
    return files.delete(hadoop, True)


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders right below a folder; none if there is no such folder."""
    files, hadoop = _file_system(spark, path)
    return [entry.getPath().getName() for entry in files.listStatus(hadoop)] if files.exists(hadoop) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, which appears under its name only when it is whole."""
    files, hadoop = _file_system(spark, path)
    part = hadoop.suffix(".part")
    stream = files.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    files.delete(hadoop, False)
    files.rename(part, hadoop)
