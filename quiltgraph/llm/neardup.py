"""Documents whose word-shingle sets are alike: an exact Jaccard join by signature trees.

1. One pass counts, in each batch of rows, the words and shingles that the batch repeats; the most frequent of the whole
   corpus, a fixed number of them, only set an order: likely shingles, by their words, late, and common shingles last.
2. One pass makes every document's shingle set in that order. Equal sets are one class from here on.
3. Two sets that are similar enough share ``SHARED`` percent of n shingles among the first n - ceil(threshold n) + that
   many of each (any order gives this). Pairs that share so many form families; no link leaves a family. Shingles that
   more than ``SMALL`` classes hold are not paired: a pair may miss as many as both hold of these, and classes that hold
   so many that they could share no others are joined to their neighbours by size among such classes.
4. Families are dealt to tasks with their sets. In a task a family becomes a tree: nodes hold the OR of their members'
   token bitmaps and their range of sizes. A dual traversal leaves out node pairs whose greatest possible overlap is too
   small, whose sizes differ too much or whose members are already linked; what reaches two documents is counted exactly.
   A family with more members than ``BLOCK`` (or more shingles than ``BLOCK_SHINGLES``) is dealt out as pairs of blocks, so no task holds more than two blocks.

Links, not pairs, leave a task: at most one for each member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.functions.shared import Shared
from quiltgraph.functions.sizes import cut_lineage, proven_small, salted_join
from quiltgraph.llm.components import SALTS, connected
from quiltgraph.llm.texts import LOWER, U, grams, in_small_batches, lists, mix, sequence_hashes, slices, word_hashes, words

SHINGLE = 5
PERCENT = 80
COMMON_WORDS, COMMON_SHINGLES = 1 << 16, 1 << 20
BLOCK, BLOCK_SHINGLES = 4096, 1 << 22
SHARED, SMALL = 15, 6
LEAF = 32
BITS = 2048
BROADCAST_IDS = 1_000_000


def shingles(data: np.ndarray, offsets: np.ndarray, k: int):
    """Row and hash of each shingle and how many words each row has; a row of fewer than ``k`` words is one shingle.

    Also the hashes of the words and the index of each shingle's first word.
    """
    starts, ends, first = words(data, offsets)
    hashes = word_hashes(data, starts, ends, LOWER)
    count = np.diff(first)
    rows = np.repeat(np.arange(len(count)), count)
    at = np.flatnonzero(np.arange(len(hashes)) + k <= first[1:][rows]) if len(hashes) else np.zeros(0, np.int64)
    made = grams(hashes, k, 21)[at] if len(at) else np.zeros(0, U)
    short = np.flatnonzero((count > 0) & (count < k))
    whole = sequence_hashes(hashes, first, 22)[short]
    return np.concatenate([rows[at], short]), np.concatenate([made, whole]), count, hashes, np.concatenate([at, first[short]])


def _repeated(k: int, least_words: int, least_shingles: int):
    """Words and shingles that a batch repeats, with their counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = {0: [], 1: []}
            for _, data, offsets in slices(batch.column(0)):
                rows, made, _, hashes, _ = shingles(data, offsets, k)
                sums[0].append(hashes)
                order = np.lexsort((made, rows))
                new = np.ones(len(order), bool)
                new[1:] = (made[order][1:] != made[order][:-1]) | (rows[order][1:] != rows[order][:-1])
                sums[1].append(made[order][new])
            for kind, least in ((0, least_words), (1, least_shingles)):
                if sums[kind]:
                    value, n = np.unique(np.concatenate(sums[kind]), return_counts=True)
                    value, n = value[n >= least], n[n >= least]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), kind, np.int32)), pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))],
                        names=["kind", "value", "n"])

    return run


class Order:
    """Places of shingles: common ones last, and before them those whose words make them likely."""

    def __init__(self, frequent: np.ndarray, word_counts: np.ndarray, common: np.ndarray, counts: np.ndarray):
        order = np.argsort(frequent)
        # Whole numbers, so that a shingle's sum is the same wherever it stands.
        self.words, self.logs = frequent[order], np.rint(8 * np.log2(word_counts[order] + 1.0)).astype(np.int64)
        order = np.argsort(common)
        self.shingles, self.counts = common[order], counts[order]

    def keys(self, made: np.ndarray, at: np.ndarray, hashes: np.ndarray, k: int) -> np.ndarray:
        """Sort key of each shingle: the logarithms of its words' counts added up, and above all its own count if common."""
        sums = np.zeros(len(hashes) + 1, np.int64)
        np.cumsum(_look_up(self.words, self.logs, hashes), out=sums[1:])
        key = sums[np.minimum(at + k, len(hashes))] - sums[at]
        return key + _look_up(self.shingles, self.counts, made) * (1 << 16)


def _look_up(names: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Value of each wanted name, 0 for those not in the sorted names."""
    if not len(names):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
    return np.where(names[at] == wanted, values[at], 0)


def _distinct(rows: np.ndarray, made: np.ndarray):
    """Order that sorts by row and shingle and keeps the first of equal ones."""
    order = np.lexsort((made, rows))
    new = np.ones(len(order), bool)
    new[1:] = (made[order][1:] != made[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    return order[new]


def _sets(shared, k: int, percent: int):
    """Size, two hashes of the set, and its prefix, for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in slices(batch.column(2)):
                n = len(offsets) - 1
                rows, made, _, hashes, place = shingles(data, offsets, k)
                key = shared.value.keys(made, place, hashes, k)
                kept = _distinct(rows, made)
                rows, made, key = rows[kept], made[kept], key[kept]
                size = np.bincount(rows, minlength=n)
                bounds = np.searchsorted(rows, np.arange(n + 1))
                total = [np.concatenate([np.zeros(1, U), np.cumsum(mix(made, s))]) for s in (31, 32)]
                order = np.lexsort((made, key, rows))
                length = np.minimum(size, size - -(-percent * size // 100) + shared_at_least(size))
                inside = np.arange(len(rows)) - bounds[:-1][rows] < length[rows]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(size.astype(np.int64)),
                    *(pa.array((t[bounds[1:]] - t[bounds[:-1]]).view(np.int64)) for t in total),
                    lists(made[order][inside].view(np.int64), length),
                ], names=["_id", "_text_hash", "n_shingles", "_s1", "_s2", "_prefix"])

    return run


def shared_at_least(size):
    """How many shingles two similar sets share among the prefixes; the smaller of both sets' numbers counts."""
    return np.maximum(1, size * SHARED // 100)


def _emit(token, size, ident, crowded, percent: int):
    """Pairs of ids that hold one shingle with few others, and the ids that hold one with many."""
    out = []
    for lag in range(1, SMALL):
        if len(token) <= lag:
            break
        pair = (token[lag:] == token[:-lag]) & ~crowded[lag:] & (100 * size[:-lag] >= percent * size[lag:]) & (ident[lag:] != ident[:-lag])
        a, b = ident[lag:][pair], ident[:-lag][pair]
        out.append((np.maximum(a, b), np.minimum(a, b), shared_at_least(size[:-lag][pair]), np.zeros(len(a), np.int64)))
    out.append((ident[crowded], token[crowded], size[crowded], np.ones(int(crowded.sum()), np.int64)))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "n", "crowded"])


def _groups(percent: int):
    """From (shingle, size, id) sorted by all three: what ``_emit`` gives; groups may run over many batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, open_token = None, None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not len(cols[0]):
                continue
            if carry is not None:
                cols = [np.concatenate(c) for c in zip(carry, cols, strict=True)]
            token = cols[0]
            new = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            held = np.diff(np.append(new, len(token)))
            many = held > SMALL
            many[0] |= open_token is not None and token[0] == open_token
            # A last group that is still small may go on in the next batch.
            open_token = token[-1] if many[-1] else None
            end = len(token) if many[-1] else new[-1]
            carry = None if many[-1] else [c[end:] for c in cols]
            yield _emit(*(c[:end] for c in cols), np.repeat(many, held)[:end], percent)
        if carry is not None:
            yield _emit(*carry, np.zeros(len(carry[0]), bool), percent)

    return run


def _chains(percent: int):
    """From (shingle, size, id) sorted by all three: ids next to each other in size. Between two of fitting size all fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not len(cols[0]):
                continue
            if last is not None:
                cols = [np.concatenate([[x], c]) for x, c in zip(last, cols, strict=True)]
            last = [c[-1] for c in cols]
            token, size, ident = cols
            pair = (token[1:] == token[:-1]) & (100 * size[:-1] >= percent * size[1:]) & (ident[1:] != ident[:-1])
            a, b = ident[1:][pair], ident[:-1][pair]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return run


def _whole(k: int):
    """The sorted shingle set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in slices(batch.column(1)):
                n = len(offsets) - 1
                rows, made, _, _, _ = shingles(data, offsets, k)
                kept = _distinct(rows, made)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), lists(made[kept].view(np.int64), np.bincount(rows[kept], minlength=n))],
                    names=["_id", "_set"])

    return run


class Tree:
    """Signature tree over sets: per level and node the OR of bitmaps, the sizes' range, the most tokens beyond bits."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        n = len(sets)
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        bit = (flat.view(U) if flat.dtype == np.int64 else flat) & U(BITS - 1)
        marks = np.zeros((n, BITS // 8), np.uint8)
        owner = np.repeat(np.arange(n), size)
        np.bitwise_or.at(marks, (owner, (bit >> U(3)).astype(np.int64)), (1 << (bit & U(7)).astype(np.int64)).astype(np.uint8))
        self.marks = marks.view(U)
        beyond = size - np.bitwise_count(self.marks).sum(1, dtype=np.int64)
        pad = -n % LEAF
        level = [np.concatenate([self.marks, np.zeros((pad, BITS // 64), U)]).reshape(-1, LEAF, BITS // 64),
                 *(np.concatenate([x, np.full(pad, fill)]).reshape(-1, LEAF) for x, fill in ((size, 1 << 40), (size, 0), (beyond, 0)))]
        self.size, self.beyond = size, beyond
        self.levels = []
        while True:
            level = [np.bitwise_or.reduce(level[0], axis=1), level[1].min(1), level[2].max(1), level[3].max(1)]
            self.levels.append(level)
            m = len(level[0])
            if m == 1:
                break
            pad = -m % 2
            fills = (0, 1 << 40, 0, 0)
            level = [np.concatenate([x, np.full((pad, *x.shape[1:]), f, x.dtype)]).reshape(-1, 2, *x.shape[1:]) for x, f in zip(level, fills, strict=True)]


def _may(bits_a, low_a, high_a, beyond_a, bits_b, low_b, high_b, beyond_b, percent: int):
    """Whether two nodes (or documents) can hold a similar pair, by sizes and the greatest possible overlap."""
    overlap = np.bitwise_count(bits_a & bits_b).sum(-1, dtype=np.int64) + np.minimum(beyond_a, beyond_b)
    sized = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    return sized & ((100 + percent) * overlap >= percent * (low_a + low_b))


class Links:
    """Union of members by verified links."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def roots(self, a: int, z: int) -> np.ndarray:
        return np.array([self.root(i) for i in range(a, z)])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * both >= percent * (len(a) + len(b) - both)


def link(sets: list[np.ndarray], percent: int, block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links of all similar pairs; with ``block``, of pairs whose blocks differ."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][0]))
    tree, links, made = Tree([sets[i] for i in order]), Links(len(sets)), []
    side = None if block is None else block[order]
    todo = [(len(tree.levels) - 1, 0, 0)]
    while todo:
        depth, x, y = todo.pop()
        level = tree.levels[depth]
        if y >= len(level[0]) or not _may(*(v[x] for v in level), *(v[y] for v in level), percent):
            continue
        if depth:
            down = [(2 * x, 2 * y), (2 * x + 1, 2 * y + 1), (2 * x, 2 * y + 1)] + ([(2 * x + 1, 2 * y)] if x != y else [])
            todo += [(depth - 1, *p) for p in down]
            continue
        a, az, b, bz = x * LEAF, min((x + 1) * LEAF, len(sets)), y * LEAF, min((y + 1) * LEAF, len(sets))
        ra, rb = links.roots(a, az), links.roots(b, bz)
        open_pairs = ra[:, None] != rb[None, :]
        if not open_pairs.any():
            continue
        one = lambda p, z: (tree.marks[p:z], tree.size[p:z], tree.size[p:z], tree.beyond[p:z])
        may = _may(*(v[:, None] for v in one(a, az)), *(v[None, :] for v in one(b, bz)), percent) & open_pairs
        if side is not None:
            may &= side[a:az, None] != side[None, b:bz]
        for i, j in np.argwhere(may):
            i, j = a + int(i), b + int(j)
            if i != j and links.root(i) != links.root(j) and similar(tree.sets[i], tree.sets[j], percent):
                links.up[links.root(i)] = links.root(j)
                made.append((order[i], order[j]))
    return made


def _families(percent: int):
    """From (family, one block, other block, id, own block, set) sorted by the first four: links (a, b)."""

    def settle(ids, blocks, sets, cross):
        made = link(sets, percent, np.array(blocks) if cross else None)
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in made], pa.int64()), pa.array([ids[j] for _, j in made], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, blocks, sets = None, [], [], []
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            own_ids, own_blocks = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            held = batch.column(5)
            values = held.flatten().to_numpy(zero_copy_only=False).view(U)
            ends = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False))])
            for r, key in enumerate(keys):
                if key != now:
                    if len(ids) > 1:
                        yield settle(ids, blocks, sets, now[1] != now[2])
                    now, ids, blocks, sets = key, [], [], []
                mine = values[ends[r] : ends[r + 1]]
                if ids and ids[-1] == own_ids[r] and np.array_equal(sets[-1], mine):
                    continue  # a repeated row
                ids.append(own_ids[r])
                blocks.append(own_blocks[r])
                sets.append(mine.copy())
        if len(ids) > 1:
            yield settle(ids, blocks, sets, now[1] != now[2])

    return run


def classes(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_shingles, component_id: one row per input row.

    Words are compared with A-Z in lower case. Two documents link when ``100 * intersection >= percent * union`` of their
    sets of ``k``-word shingles; component_id is the smallest ``key`` that links reach, its own included. A text of fewer
    words is one shingle; a null text, or one without words, has none and links with nothing. A row with a null key has a
    null component and links with nothing; rows with equal keys are one document with several texts, in one component.
    ``key`` has to be an integer. Other columns are not read.
    """
    spark = docs.sparkSession
    own = in_small_batches(docs).select(F.col(key).cast("bigint").alias("_id"), F.xxhash64(text).alias("_text_hash"), F.col(text).alias("_text"))
    often = cut_lineage(own.select("_text").mapInArrow(_repeated(k, 16, 3), "kind int, value bigint, n bigint").groupBy("kind", "value").agg(F.sum("n").alias("n")))

    def top(kind: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """At most ``most`` values and their counts, 16 bytes each on the driver."""
        rows = often.filter(F.col("kind") == kind).orderBy(F.desc("n"), "value").limit(most).select("value", "n").toArrow()
        return rows.column("value").to_numpy().view(U), rows.column("n").to_numpy()

    shared = Shared(spark, Order(*top(0, COMMON_WORDS), *top(1, COMMON_SHINGLES)))

    scanned = cut_lineage(own.mapInArrow(
        _sets(shared, k, percent), "_id bigint, _text_hash bigint, n_shingles bigint, _s1 bigint, _s2 bigint, _prefix array<bigint>"))
    full = scanned.filter("n_shingles > 0 and _id is not null")
    # The class of a set: its smallest id. A document with several texts may stand for several classes.
    classes_of = cut_lineage(full.groupBy("_s1", "_s2", "n_shingles").agg(F.min("_id").alias("_class"), F.count("*").alias("_n")))
    chosen = full.join(classes_of.select("_s1", "_s2", "n_shingles", F.col("_class").alias("_id")), ["_s1", "_s2", "n_shingles", "_id"], "left_semi")
    tokens = chosen.select(F.explode("_prefix").alias("t"), "n_shingles", "_id").repartition("t").sortWithinPartitions("t", "n_shingles", "_id")
    near = cut_lineage(_candidates(tokens, percent))
    family = cut_lineage(connected(near))
    links = cut_lineage(_link_families(own, chosen, family, percent, k))

    # Rows of one document, or of one class, belong together whatever their own links.
    same = full.select("_id", "_s1", "_s2", "n_shingles").join(
        classes_of.filter("_n > 1").select("_s1", "_s2", "n_shingles", "_class"), ["_s1", "_s2", "n_shingles"]).select(
        F.col("_id").alias("a"), F.col("_class").alias("b")).filter("a != b")
    reached = cut_lineage(connected(links.unionByName(same)))
    out = scanned.select("_id", "n_shingles")
    return salted_join(out, reached.select(F.col("node").alias("_id"), "component"), ["_id"], SALTS, "left").select(
        F.col("_id").cast(docs.schema[key].dataType).alias(key), "n_shingles", F.coalesce("component", "_id").alias("component_id"))


def _candidates(tokens: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose components hold every similar pair."""
    found = cut_lineage(tokens.mapInArrow(_groups(percent), "a bigint, b bigint, n bigint, crowded bigint"))
    crowds = found.filter("crowded = 1")
    held = cut_lineage(crowds.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("c"), F.min("n").alias("size")))
    pairs = found.filter("crowded = 0").groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("n").alias("need"))
    of = lambda side: held.select(F.col("id").alias(side), F.col("c").alias(f"c_{side}"))
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    both = F.least(F.coalesce("c_a", F.lit(0)), F.coalesce("c_b", F.lit(0)))
    few = pairs.filter((F.col("shared") >= F.greatest(F.lit(1), F.col("need") - both))).select("a", "b")
    # Only two documents that both hold that many crowded shingles can share no others; the partner may be a fifth smaller.
    full = held.filter(F.col("c") >= F.greatest(F.lit(1), F.floor(F.col("size") * (SHARED * percent) / 10_000))).select(F.col("id").alias("a"))
    chains = crowds.join(full, "a", "left_semi").select(F.col("b").alias("t"), "n", "a").repartition("t").sortWithinPartitions(
        "t", "n", "a").mapInArrow(_chains(percent), "a bigint, b bigint")
    return few.unionByName(chains).distinct()


def _link_families(own: DataFrame, chosen: DataFrame, family: DataFrame, percent: int, k: int) -> DataFrame:
    """Verified links inside each family."""
    wanted = cut_lineage(chosen.select("_id", "_text_hash", "n_shingles").join(
        family.select(F.col("node").alias("_id"), "component"), "_id"))
    parts = wanted.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    members = salted_join(wanted.drop("n_shingles"), parts, ["component"], SALTS).withColumn(
        "part", F.pmod(F.xxhash64("_id"), F.col("parts")).cast("int"))
    if proven_small(wanted, BROADCAST_IDS):  # else the texts are shuffled to their families
        members = F.broadcast(members)
    made = own.join(members, ["_id", "_text_hash"]).select("component", "part", "parts", "_id", "_text").mapInArrow(
        _with_sets(k), "component bigint, part int, parts int, _id bigint, _set array<bigint>")
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(
        F.least(x, F.col("part")).alias("i"), F.greatest(x, F.col("part")).alias("j")))).alias("cell")
    dealt = made.select("component", cells, "_id", "part", "_set").select("component", "cell.i", "cell.j", "_id", "part", "_set")
    return dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "_id").mapInArrow(
        _families(percent), "a bigint, b bigint")


def _with_sets(k: int):
    whole = _whole(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in whole([pa.RecordBatch.from_arrays([batch.column(3), batch.column(4)], names=["_id", "_text"])]):
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, n) for i in range(3)), part.column(0), part.column(1)],
                    names=["component", "part", "parts", "_id", "_set"])
                at += n

    return run
