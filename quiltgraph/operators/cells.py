"""Exact vector search over stored cells.

Items are stored with the nearest of a bounded number of centres: a cell has a centre, a radius (the farthest item) and a
count. A question first meets its nearest cells, as many as hold ``k`` items; the ``k``-th best distance found there is a
bound. By the triangle inequality no item of a cell is nearer than the distance to the centre less the radius, so cells
beyond the bound are left out and the others are met. The result is that of ``nearest``: nothing is approximate, the
cells only decide how much is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltgraph.config import Settings
from quiltgraph.functions.shared import Shared
from quiltgraph.functions.sizes import cut_lineage, join_lookup
from quiltgraph.operators.nearest import _one, matrix, meet
from quiltgraph.operators.ranking import top_k

DEFAULT = Settings()
#: Most centres, which are broadcast: this many vectors.
CENTRES = 1024
#: Items that a cell should hold; fewer cells are made for few items.
CELL_ITEMS = 256
#: Rounds that move the centres to the means of the sample's cells.
ROUNDS = 4
#: Distances are rounded to six digits, so a bound may be short by half of the last one.
SLACK = 1e-6


@dataclass(frozen=True)
class Cells:
    """``rows`` (cell, item, vector), ``cells`` (cell, centre, radius, n). Cell -1 holds the zero vectors of ``unit_l2``."""

    rows: DataFrame
    cells: DataFrame
    metric: str


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


def _centres(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` centres of a bounded sample: every so many of its rows, moved to the means of what is nearest to them."""
    made = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(ROUNDS):
        near = _apart(x, made).argmin(1)
        count = np.bincount(near, minlength=n)
        sums = np.zeros_like(made)
        np.add.at(sums, near, x)
        made[count > 0] = sums[count > 0] / count[count > 0, None]
    return made


def build_cells(vectors: DataFrame, item: str, metric: str = "l2", most: int = CENTRES, cell_items: int = CELL_ITEMS) -> Cells:
    """Cells of (``item``, vector) rows; rows without a vector are left out.

    Centres are fitted to at most ``8 * most`` rows, chosen by a hash; every row is assigned. ``l2`` or ``unit_l2``.
    """
    if metric not in ("l2", "unit_l2"):
        raise ValueError(f"unknown metric: {metric}")
    own = cut_lineage(vectors.filter(F.col("vector").isNotNull()).select(F.col(item).alias("item"), F.col("vector").cast("array<double>").alias("vector")))
    spark, total = own.sparkSession, own.count()
    n = max(1, min(most, total // cell_items))
    sample = own.select("vector").orderBy(F.xxhash64("vector"), F.xxhash64("item")).limit(8 * n).toArrow()
    plain = (lambda x: x) if metric == "l2" else _unit
    centres = _centres(plain(matrix(_one(sample.column("vector")))), n) if total else np.zeros((0, 0))
    shared = Shared(spark, centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = matrix(part.column(1))
                scaled = plain(x)
                apart = _apart(scaled, shared.value)
                cell, far = apart.argmin(1), apart.min(1)
                if metric == "unit_l2":
                    cell = np.where(np.any(x, axis=1), cell, -1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(far), part.column(0), part.column(1)], names=["cell", "far", "item", "vector"])

    kind = own.schema["item"].dataType.simpleString()
    rows = cut_lineage(own.mapInArrow(assign, f"cell int, far double, item {kind}, vector array<double>"))
    sizes = rows.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
    named = spark.createDataFrame(pa.table({"cell": pa.array(range(-1, len(centres)), pa.int32()), "centre": pa.array([[0.0] * centres.shape[1], *centres.tolist()], pa.list_(pa.float64()))}))
    return Cells(rows.drop("far"), cut_lineage(sizes.join(named, "cell")), metric)


def _to_centres(questions: DataFrame, cells: Cells, kind: str) -> DataFrame:
    """_q, cell, low, n: the least distance that an item of each cell can have to each question; at most ``CENTRES`` rows a question."""
    held = cells.cells.toArrow()  # bounded by the number of centres
    unit = cells.metric == "unit_l2"
    zero = held.column("cell").to_numpy() < 0
    centres = np.array(held.column("centre").to_pylist(), float)
    shared = Shared(questions.sparkSession, (centres, held.column("radius").to_numpy(), held.column("n").to_numpy(), held.column("cell").to_numpy(), zero))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, n, cell, zero = shared.value
        for batch in batches if len(cell) else ():
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = matrix(part.column(1))
                apart = _apart(_unit(x) if unit else x, centres)
                low = np.maximum(apart - radius, 0) ** 2
                if unit:
                    # A zero vector is at distance 2 of everything, and so is everything of it.
                    low[:, zero] = 2.0
                    low[~np.any(x, axis=1)] = 2.0
                    apart[:, zero] = np.inf
                m = len(cell)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(np.arange(len(x)), m))), *(pa.array(np.tile(c, len(x))) for c in (cell.astype(np.int32), n)),
                     pa.array(low.ravel()), pa.array(apart.ravel())], names=["_q", "cell", "n", "low", "apart"])

    return questions.mapInArrow(scan, f"_q {kind}, cell int, n bigint, low double, apart double")


def search_cells(questions: DataFrame, cells: Cells, question: str, item: str, k: int, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(best, read). ``best`` is ``question, item, distance, rank`` as ``nearest`` gives it; ``read`` is ``question, n_read,
    n_items``: how many items the question met, of how many."""
    q = cut_lineage(questions.filter(F.col("vector").isNotNull()).select(F.col(question).alias("_q"), F.col("vector").cast("array<double>").alias("vector")))
    kind = q.schema["_q"].dataType.simpleString()
    near = cut_lineage(_to_centres(q, cells, kind))
    # Nearest cells until they hold k items: those before a cell do not hold enough.
    order = Window.partitionBy("_q").orderBy("apart", "cell")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = near.withColumn("_before", before).filter(F.col("_before") < k).select("_q", "cell", "n")
    one = cut_lineage(_met(q, cells, first, k, settings))
    bound = top_k(one, "_q", [F.asc("distance"), F.asc("_v")], k).filter(F.col("rank") == k).select("_q", F.col("distance").alias("bound"))
    # Questions that met fewer than k items have met all of them.
    open_cells = join_lookup(near.join(first.select("_q", "cell"), ["_q", "cell"], "left_anti"), bound, ["_q"], settings)
    second = cut_lineage(open_cells.filter(F.col("low") <= F.col("bound") + SLACK).select("_q", "cell", "n"))
    two = cut_lineage(_met(q, cells, second, k, settings))
    found = top_k(one.unionByName(two), "_q", [F.asc("distance"), F.asc("_v")], k)
    total = cells.cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"))
    read = q.select("_q").distinct().join(first.unionByName(second).groupBy("_q").agg(F.sum("n").alias("n_read")), "_q", "left").na.fill(0)
    return (found.select(F.col("_q").alias(question), F.col("_v").alias(item), "distance", "rank"),
            read.crossJoin(F.broadcast(total)).withColumnRenamed("_q", question))  # one row of totals


def _met(q: DataFrame, cells: Cells, chosen: DataFrame, k: int, settings: Settings) -> DataFrame:
    """Best ``k`` of the chosen (question, cell) pairs, cell by cell."""
    mine = cut_lineage(chosen.select("_q", F.col("cell").cast("bigint").alias("_g")).join(q, "_q"))
    wanted = chosen.select("cell").distinct()
    rows = join_lookup(cells.rows, wanted, ["cell"], settings, "left_semi").select(F.col("cell").cast("bigint").alias("_g"), F.col("item").alias("_v"), "vector")
    return meet(mine, rows, k, cells.metric, settings)
