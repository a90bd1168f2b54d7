"""Near-duplicate vectors by cosine: a forest of random-projection trees whose leaves are compared exactly.

Each tree splits on random directions at the median of a bounded sample; a vector close to a split goes both ways. All
vectors are routed through the broadcast splits (their size is set by parameters). A node that still holds more rows than
one task may is split again by a tree fitted to a bounded sample of its own rows; a task splits what it gets down to
leaves of ``LEAF`` rows. Pairs of a leaf are compared in double precision, and a leaf sends on at most one link for each
of its vectors. Equal vectors are one class before the forest. Inside the components the links are then counted exactly,
in blocks, so that the counts do not depend on which trees found what.

How many trees are needed depends on the depth and on how tightly the vectors lie. It is measured: made-up partners at
exactly the least cosine to a bounded sample of the rows go through the same trees, and forests are added until at least
``RECALL`` of the partners of every part of the sample met their row in a leaf. If ``FORESTS`` of them do not reach it, all
vectors are compared in pairs of blocks, and so are nodes that no direction splits.

Trees are grown a few at a time, one where the vectors are many: what they route goes through one shuffle and is not
written, only their links are. So the disk in use is that of one step, whatever the number of trees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.functions.shared import Shared
from quiltgraph.functions.sizes import cut_lineage, proven_small, remove_tables, salted_join
from quiltgraph.llm.components import SALTS, connected
from quiltgraph.llm.texts import in_small_batches

COSINE = 0.9
#: Trees of one forest.
TREES = 8
#: Least share of the made-up partners that has to be found, in each of the parts that the first tree's top splits make.
RECALL = 0.95
PROBES = 8192
PARTS = 32
#: Most forests before all vectors are compared.
FORESTS = 6
#: Share of the projections' standard deviation, on each side of a split, that goes both ways.
SPILL = 0.12
SAMPLE = 16_384
SAMPLE_LEAF = 128
LEAF = 1024
TASK_ROWS = 50_000
BLOCK = 8192
#: Most bytes of a task's vectors, and of a sample that is fitted on the driver, in double precision: for wide vectors fewer rows.
TASK_BYTES = 1 << 26
#: Most bytes that the trees of one step route, unless one tree alone routes more.
STEP_BYTES = 1 << 26
BROADCAST_NODES = 1024
MOST_ROUNDS = 12


class Splits:
    """A binary tree of random splits: node k has children 2k + 1 and 2k + 2."""

    def __init__(self, x: np.ndarray, least: int, spill: float, seed: int):
        rng = np.random.default_rng(seed)
        self.depth = max(0, int(np.ceil(np.log2(max(len(x), 1) / least))))
        inner = (1 << self.depth) - 1
        self.directions = rng.standard_normal((inner, x.shape[1]))
        self.directions /= np.maximum(np.linalg.norm(self.directions, axis=1, keepdims=True), 1e-12)
        self.at, self.margin = np.zeros(inner), np.zeros(inner)
        members = {0: np.arange(len(x))}
        for k in range(inner):
            rows = members.pop(k)
            p = x[rows] @ self.directions[k]
            if len(p):
                self.at[k], self.margin[k] = np.median(p), spill * p.std()
            members[2 * k + 1], members[2 * k + 2] = rows[p < self.at[k]], rows[p >= self.at[k]]

    def part(self, x: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row after so many splits, without spill."""
        nodes = np.zeros(len(x), np.int64)
        for _ in range(min(levels, self.depth)):
            nodes = 2 * nodes + 1 + (np.einsum("ij,ij->i", x, self.directions[nodes]) >= self.at[nodes])
        return nodes

    def to_bytes(self) -> bytes:
        return np.concatenate([[self.depth, self.directions.shape[1]], self.directions.ravel(), self.at, self.margin]).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Splits:
        values, made = np.frombuffer(raw), cls.__new__(cls)
        made.depth, width = int(values[0]), int(values[1])
        inner = (1 << made.depth) - 1
        made.directions = values[2 : 2 + inner * width].reshape(inner, width)
        made.at, made.margin = values[2 + inner * width :].reshape(2, inner)
        return made

    def route(self, x: np.ndarray):
        """Row numbers and leaves, a row once for every leaf it belongs to."""
        rows, nodes = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            p = np.einsum("ij,ij->i", x[rows], self.directions[nodes]) - self.at[nodes]
            margin = self.margin[nodes]
            left, right = p < margin, p >= -margin
            rows = np.concatenate([rows[left], rows[right]])
            nodes = np.concatenate([2 * nodes[left] + 1, 2 * nodes[right] + 2])
        return rows, nodes - ((1 << self.depth) - 1)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in double precision; shorter ones are padded with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == width).all():
        x = flat.reshape(-1, width).copy()
    else:
        x = np.zeros((len(lengths), width))
        x[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths] or [[]]).astype(int)] = flat
    x /= np.abs(x).max(1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def leaf_links(x: np.ndarray, cosine: float) -> np.ndarray:
    """For each row the first row of its component among the rows, by links of at least ``cosine``."""
    near = x @ x.T >= cosine
    np.fill_diagonal(near, True)
    label = np.arange(len(x))
    busy = np.flatnonzero(near.sum(1) > 1)
    near = near[np.ix_(busy, busy)]
    while len(busy):
        new = np.where(near, label[busy][None, :], len(x)).min(1)
        if (new == label[busy]).all():
            break
        label[busy] = new
    return label


def _links(x: np.ndarray, ids: np.ndarray, probe: np.ndarray, cosine: float, spill: float, leaf: int, seed: int, depth: int = 0):
    """Links of a node's rows, and the probes that meet their row: split it further until leaves are small, then compare."""
    own = ~probe
    if own.sum() > leaf and depth < 40:
        splits = Splits(x[own], max(leaf // 2, int(own.sum()) // 16), spill, seed)
        rows, nodes = splits.route(x)
        order = np.argsort(nodes, kind="stable")
        rows, nodes = rows[order], nodes[order]
        cuts = np.flatnonzero(np.diff(nodes)) + 1
        for part in np.split(rows, cuts):
            # Rows that no direction tells apart would not get fewer: they are compared in blocks against all.
            if own[part].sum() > 0.9 * own.sum():
                kept = part[own[part]]
                for a, b in _blocks(x[kept], ids[kept], cosine, leaf):
                    yield a, b, False
                yield _met(ids[part], probe[part])
            else:
                yield from _links(x[part], ids[part], probe[part], cosine, spill, leaf, seed + 1, depth + 1)
        return
    label = leaf_links(x[own], cosine)
    linked = np.flatnonzero(label != np.arange(len(label)))
    yield ids[own][linked], ids[own][label[linked]], False
    yield _met(ids, probe)


def _met(ids: np.ndarray, probe: np.ndarray):
    """Ids of the probes that are together with the row they were made from."""
    met = np.intersect1d(ids[probe], ids[~probe])
    return met, met, True


def _spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, other) that join the rows and columns of a block exactly as all its true entries do.

    Columns are numbered after the rows. Every row or column of a component but its first is linked to the first.
    """
    rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    near = near[np.ix_(rows, columns)]
    places = np.concatenate([rows, columns + (1 << 40)])
    mine, theirs = np.arange(len(rows)), np.arange(len(rows), len(places))
    while len(rows):
        new = np.minimum(mine, np.where(near, theirs[None, :], len(places)).min(1))
        other = np.minimum(theirs, np.where(near, new[:, None], len(places)).min(0))
        if (new == mine).all() and (other == theirs).all():
            break
        mine, theirs = new, other
    label = np.concatenate([mine, theirs])
    linked = np.flatnonzero(label != np.arange(len(places)))
    return places[linked], places[label[linked]]


def _block_links(x: np.ndarray, ids: np.ndarray, y: np.ndarray, others: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    a, b = _spanning(x @ y.T >= cosine)
    name = lambda at: np.where(at < 1 << 40, ids[np.minimum(at, len(ids) - 1)], others[np.clip(at - (1 << 40), 0, len(others) - 1)])
    return name(a), name(b)


def _blocks(x: np.ndarray, ids: np.ndarray, cosine: float, leaf: int):
    """Links among all rows, block against block."""
    for a in range(0, len(x), leaf):
        for b in range(a, len(x), leaf):
            yield _block_links(x[a : a + leaf], ids[a : a + leaf], x[b : b + leaf], ids[b : b + leaf], cosine)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _grouped(batches: Iterator[pa.RecordBatch], keys: int):
    """Rows of each run of equal first ``keys`` columns, over batch borders."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new), batch.num_rows]
        for a, z in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if key != now and held:
                yield now, _one(held)
                held = []
            now = key
            held.append(batch.slice(a, z - a))
    if held:
        yield now, _one(held)


def _pairs(found: list) -> pa.RecordBatch:
    kinds = np.concatenate([np.full(len(a), probe) for a, _, probe in found])
    return pa.RecordBatch.from_arrays(
        [*(pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in (0, 1)), pa.array(kinds, pa.bool_())], names=["a", "b", "probe"])


def _forest(shared, width: int):
    """Every row once for each tree and leaf that it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width)
            for tree, splits in shared.value:
                rows, nodes = splits.route(x)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), tree, np.int32)), pa.array(nodes.astype(str)), *(batch.column(i).take(take) for i in (0, 1, 2))],
                    names=["tree", "node", "id", "v", "probe"])

    return run


def _again(width: int):
    """Rows of too large nodes with their node's own splits: one level further down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _), group in _grouped(batches, 2):
            x = matrix(group.column(3), width)
            rows, nodes = Splits.from_bytes(group.column(5)[0].as_py()).route(x)
            take = pa.array(rows)
            above = np.array(group.column(1).take(take).to_pylist(), str)
            path = pa.array(np.char.add(np.char.add(above, "."), nodes.astype(str)))
            yield pa.RecordBatch.from_arrays(
                [group.column(0).take(take), path, *(group.column(i).take(take) for i in (2, 3, 4))],
                names=["tree", "node", "id", "v", "probe"])

    return run


def _split_large(rows: DataFrame, width: int, task_rows: int, sample: int, sample_leaf: int, spill: float) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """Split nodes of more than ``task_rows`` rows, again and again, by trees fitted to a bounded sample of each.

    Also the names of the nodes that are still larger after ``MOST_ROUNDS`` rounds (None: there are none), and the tables
    that were written. ``rows`` itself is never written: it is routed anew for every reader.
    """
    written = []
    for level in range(1, MOST_ROUNDS + 1):
        large = cut_lineage(rows.groupBy("tree", "node").count().filter(F.col("count") > task_rows))
        written.append(large)
        if not large.take(1):
            return rows, None, written
        if level == MOST_ROUNDS:
            return rows, large, written
        # A hash picks about ``sample`` rows of each node, whatever its size.
        share = (F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 20)) * F.col("count") < F.lit(sample) * F.lit(1 << 20))
        few = proven_small(large, BROADCAST_NODES)
        mine = rows.join(F.broadcast(large) if few else large, ["tree", "node"])

        def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            made = Splits(matrix(pa.array(group["v"]), width), sample_leaf, spill, 1000 * level + int(key[0]))  # noqa: B023
            return pd.DataFrame({"tree": [key[0]], "node": [key[1]], "splits": [made.to_bytes()]})

        splits = cut_lineage(mine.filter(share & ~F.col("probe")).select("tree", "node", "v").groupBy("tree", "node").applyInPandas(
            fit, "tree int, node string, splits binary"))
        # Chunks of a node keep the splits beside few rows of it and spread a large node over tasks.
        chunked = mine.withColumn("chunks", F.ceil(F.col("count") / task_rows)).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
        fitted = splits.join(large.select("tree", "node", F.ceil(F.col("count") / task_rows).alias("chunks")), ["tree", "node"])
        fitted = fitted.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        joined = chunked.select("tree", "node", "chunk", "id", "v", "probe").join(fitted.select("tree", "node", "chunk", "splits"), ["tree", "node", "chunk"])
        deeper = cut_lineage(joined.select("tree", "node", "id", "v", "probe", "splits").sortWithinPartitions("tree", "node").mapInArrow(
            _again(width), rows.select("tree", "node", "id", "v", "probe").schema))
        written += [splits, deeper]
        names = large.select("tree", "node")
        rows = rows.join(F.broadcast(names) if few else names, ["tree", "node"], "left_anti").unionByName(deeper)
    return rows, None, written


def _all_pairs(rows: DataFrame, group: list[str], width: int, cosine: float, block: int) -> DataFrame:
    """Links (a, b) that span the links among all rows (``group``, id, v) of each group, found in pairs of blocks."""
    parts = rows.groupBy(*group).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = salted_join(rows, parts, group, SALTS).withColumn("part", F.pmod(F.xxhash64("id", F.lit(6)), F.col("parts")).cast("int"))
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(
        F.least(x, F.col("part")).alias("i"), F.greatest(x, F.col("part")).alias("j")))).alias("cell")
    names = [F.col(g).cast("string") for g in group]
    keyed = dealt.select(F.concat_ws("/", *names).alias("g"), cells, "part", "id", "v").select("g", "cell.i", "cell.j", "part", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), held in _grouped(batches, 3):
            part, ids, x = held.column(3).to_numpy(), held.column(4).to_numpy(), matrix(held.column(5), width)
            mine, others = np.flatnonzero(part == i), np.flatnonzero(part == j)
            for a in range(0, len(mine), LEAF):
                for b in range(0, len(others), LEAF):
                    one, two = mine[a : a + LEAF], others[b : b + LEAF]
                    linked = _block_links(x[one], ids[one], x[two], ids[two], cosine)
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) for k in linked], names=["a", "b"])

    return keyed.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(run, "a bigint, b bigint").distinct()


def _compare(width: int, cosine: float, spill: float, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _), group in _grouped(batches, 2):
            if group.num_rows > 1:
                x = matrix(group.column(3), width)
                # Seeds far apart: no tree draws the directions that another one has a level deeper.
                yield _pairs(list(_links(x, group.column(2).to_numpy(), group.column(4).to_numpy(zero_copy_only=False), cosine, spill, leaf, 1000 * (7 + int(tree)))))

    return run


def _count(width: int, cosine: float, step: int = 512):
    """From (component, i, j, part, id, weight, v) in order: for each id the weights of the other block's linked rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), group in _grouped(batches, 3):
            part, ids, weight = (group.column(k).to_numpy() for k in (3, 4, 5))
            x = matrix(group.column(6), width)
            sides = [(np.flatnonzero(part == i), np.flatnonzero(part == j))]
            if i != j:
                sides.append(sides[0][::-1])
            for mine, others in sides:
                total = np.zeros(len(mine), np.int64)
                for a in range(0, len(mine), step):
                    at = mine[a : a + step]
                    near = (x[at] @ x[others].T >= cosine) & (ids[at][:, None] != ids[others][None, :])
                    total[a : a + step] = near @ weight[others]
                yield pa.RecordBatch.from_arrays([pa.array(ids[mine]), pa.array(total)], names=["id", "n"])

    return run


def _probes(picked: pa.Table, width: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and, for each, a vector at exactly ``cosine`` to it in a random direction."""
    column = picked.column("v").combine_chunks()
    x = matrix(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, width)
    u = np.random.default_rng(23).standard_normal(x.shape)
    u -= np.einsum("ij,ij->i", u, x)[:, None] * x
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
    return picked.column("id").to_numpy(), x, cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * u


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, spill: float = SPILL, key: str = "vec_id", vector: str = "embedding",
    sample: int = SAMPLE, sample_leaf: int = SAMPLE_LEAF, leaf: int = LEAF, task_rows: int = TASK_ROWS, block: int = BLOCK,
    recall: float = RECALL, forests: int = FORESTS,
) -> DataFrame:
    """``key``, n_links, component_id, kept: one row per input row.

    Vectors that are null, empty, zero or hold a null or a non-finite number link with nothing, nor do rows with a null
    key; shorter vectors count as padded with zeros. n_links counts other rows linked directly, equal ones included;
    component_id is the smallest ``key`` that links reach; kept marks that one (and rows with a null key). Rows with equal
    keys are forms of one vector: they share its links and component. ``key`` has to be an integer. Other columns are
    not read. Forests of ``trees`` trees are added until they find ``recall`` of made-up pairs at the least cosine; where
    ``forests`` of them do not, every pair of blocks is compared, at a cost that grows with the square of the rows.
    """
    spark = vectors.sparkSession
    good = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0)
    # Adding 0 makes one zero of both.
    plain = F.transform(F.col(vector), lambda c: c + F.lit(0.0).cast(vectors.schema[vector].dataType.elementType))
    own = in_small_batches(vectors).select(F.col(key).cast("bigint").alias("id"), plain.alias("v"))
    valid = own.filter(good & F.col("id").isNotNull())
    classes = cut_lineage(valid.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight")))
    width = classes.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return own.select(F.col("id").cast(vectors.schema[key].dataType).alias(key), F.lit(0).cast("bigint").alias("n_links"),
                          F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    fits = max(leaf, TASK_BYTES // (8 * width))
    sample, probes, task_rows, block = (min(n, fits) for n in (sample, PROBES, task_rows, block))
    fitted = matrix(_arrow_lists(classes.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample).select("v")), width)
    kind = vectors.schema[vector].dataType.simpleString()
    ids, x, partners = _probes(classes.orderBy(F.xxhash64("id", F.lit(4)), "id").limit(probes).select("id", "v").toArrow(), width, cosine)
    table = pa.table({"id": pa.array(ids), "v": pa.array(list(partners), pa.list_(pa.float64())), "probe": pa.array(np.full(len(ids), True))})
    given = classes.select("id", "v", F.lit(False).alias("probe")).unionByName(
        spark.createDataFrame(table).select("id", F.col("v").cast(kind).alias("v"), "probe"))
    # A vector goes to about two leaves of a tree.
    step = int(min(trees, max(1, STEP_BYTES // (2 * 8 * width * classes.count()))))
    met, part, links = np.zeros(len(ids), bool), None, None
    for first in range(0, forests * trees, step):
        forest = [(t, Splits(fitted, sample_leaf, spill, t)) for t in range(first, min(first + step, forests * trees))]
        if part is None:
            part = np.unique(forest[0][1].part(x, PARTS.bit_length() - 1), return_inverse=True)[1]
        shared = Shared(spark, forest)
        routed = given.mapInArrow(_forest(shared, width), f"tree int, node string, id bigint, v {kind}, probe boolean")
        rows, stuck, written = _split_large(routed, width, task_rows, sample, sample_leaf, spill)
        made = []
        if stuck is not None:
            whole = rows.join(stuck.select("tree", "node"), ["tree", "node"], "left_semi")
            made.append(cut_lineage(_all_pairs(whole.filter(~F.col("probe")).select("tree", "node", "id", "v"), ["tree", "node"], width, cosine, block)
                                    .withColumn("probe", F.lit(False))))
            made.append(cut_lineage(whole.filter("probe").select(F.col("id").alias("a"), F.col("id").alias("b"), "probe").distinct()))
            rows = rows.join(stuck.select("tree", "node"), ["tree", "node"], "left_anti")
        made.append(cut_lineage(rows.repartition("tree", "node").sortWithinPartitions("tree", "node").mapInArrow(
            _compare(width, cosine, spill, leaf), "a bigint, b bigint, probe boolean").distinct()))
        remove_tables(*written)
        shared.destroy()
        for found in made:
            links = found if links is None else links.unionByName(found)
            met |= np.isin(ids, found.filter("probe").select("a").toArrow().column("a").to_numpy())  # at most PROBES
        # Whole forests, so that a lucky tree does not end the search.
        if (first + step) % trees < step and (np.bincount(part, met) >= recall * np.bincount(part)).all():
            break
    else:
        exact = _all_pairs(classes.withColumn("g", F.lit(0)), ["g"], width, cosine, block)
        links = cut_lineage(exact.withColumn("probe", F.lit(False)))
    links = links.filter(~F.col("probe")).select("a", "b").distinct()
    reached = cut_lineage(connected(links))

    members = classes.join(reached.withColumnRenamed("node", "id"), "id")
    parts = members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    members = salted_join(members, parts, ["component"], SALTS).withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int"))
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(
        F.least(x, F.col("part")).alias("i"), F.greatest(x, F.col("part")).alias("j")))).alias("cell")
    counted = members.select("component", cells, "part", "id", "weight", "v").select("component", "cell.i", "cell.j", "part", "id", "weight", "v")
    counted = counted.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(
        _count(width, cosine), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("_links"))
    found = cut_lineage(counted.join(reached.withColumnRenamed("node", "id"), "id", "full"))

    several = classes.filter("weight > 1").withColumnsRenamed({"id": "_class", "v": "_v"})
    by_vector = own.withColumn("_v", F.when(good, F.col("v"))).select("id", "_v")
    placed = salted_join(by_vector, several, ["_v"], SALTS, "left").select(
        "id", F.coalesce("_class", F.when(F.col("_v").isNotNull(), F.col("id"))).alias("_class"), F.coalesce("weight", F.lit(1)).alias("weight"))
    out = salted_join(placed, found.withColumnRenamed("id", "_class"), ["_class"], SALTS, "left")
    component = F.coalesce("component", "_class", "id")
    return out.select(
        F.col("id").cast(vectors.schema[key].dataType).alias(key),
        F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("_links", F.lit(0)) + F.col("weight") - 1).cast("bigint").alias("n_links"),
        F.when(F.col("id").isNotNull(), component).cast(vectors.schema[key].dataType).alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _arrow_lists(df: DataFrame) -> pa.Array:
    column = df.toArrow().column(0).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
