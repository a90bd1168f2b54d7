"""Whitening of vectors on a whole-number grid, by a bidiagonal qd solver.

1. Every entry c becomes floor(64 c) + 1 000 000. The fit list, each distinct vector once, is written as a table; its size
   and sums are exact.
2. Blockwise QR: a task reduces its centred rows block after block to one triangular factor, and factors are combined by
   groups until one is left. No covariance matrix is ever formed.
3. One task brings the factor to bidiagonal form by Householder reflections, finds all squared singular values by dqds
   (shifted quotient differences, which are accurate relative to each value), and each wanted direction by twisted
   factorisations of the bidiagonal's shifted square. Directions of values that lie close together are made orthogonal.
4. The directions, at most ``components`` of them, go to every task and whiten all rows. One more pass over the fit list
   measures how far the whitened covariance is from the identity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.functions.sizes import cut_lineage
from quiltgraph.llm.texts import in_small_batches

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Numbers of a block of rows in a task (8 MB).
BLOCK = 1 << 20
#: Factors that one task combines.
FAN = 32
EPS = np.finfo(float).eps
TINY = 1e-300
#: Squared singular values closer than this, relative to the greater one, have their directions made orthogonal.
CLOSE = 1e-3


def grid(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones are filled with what 0 becomes."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.full((len(lengths), width), SHIFT, np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n: the whole part of the mean is taken off exactly."""
    whole = np.array([int(s) // n for s in sums], np.int64)
    rest = np.array([(int(s) % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def _rows(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    step = max(1, BLOCK // max(width, 1))
    for at in range(0, len(column), step):
        yield grid(column.slice(at, step), width)


def _sums(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            for x in _rows(batch.column(0), width):
                n += len(x)
                # Halves, so that no sum of a block passes 64 bits; Python's numbers have no end.
                high, low = (x >> 31).sum(0), (x & 0x7FFFFFFF).sum(0)
                total = [t + (int(h) << 31) + int(l) for t, h, l in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, width), pa.int32()), pa.array([str(v) for v in (n, *total)])], names=["i", "s"])

    return run


def _triangle(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if r is None else np.concatenate([r, rows]), mode="r")


def _packed(r: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if r is not None:
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], names=["r"])


def _reduce(width: int, n: int, sums: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for x in _rows(batch.column(0), width):
                r = _triangle(r, centred(x, n, sums))
        yield from _packed(r)

    return run


def _combine(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for raw in batch.column(0):
                r = _triangle(r, np.frombuffer(raw.as_py()).reshape(-1, width))
        yield from _packed(r)

    return run


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal and upper diagonal of Q' r P, and the reflections (first column, vector) whose product is P."""
    a = np.array(r, float)
    width = a.shape[1]
    if len(a) < width:
        a = np.concatenate([a, np.zeros((width - len(a), width))])
    reflections = []

    def mirror(v: np.ndarray) -> np.ndarray | None:
        """Unit vector w with (1 - 2 w w') v along the first axis."""
        size = np.linalg.norm(v)
        if size == 0 or not np.any(v[1:]):
            return None
        w = v / size
        w[0] += math.copysign(1.0, w[0])
        return w / np.linalg.norm(w)

    for k in range(width):
        w = mirror(a[k:, k])
        if w is not None:
            a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        w = mirror(a[k, k + 1 :]) if k + 2 < width else None
        if w is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
            reflections.append((k + 1, w))
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix without zeros in it, greatest first."""
    q, e, found, shift, done = [float(v) ** 2 for v in diagonal], [float(v) ** 2 for v in upper], [], 0.0, 0
    if len(q) > 1 and q[0] < q[-1]:
        q, e = q[::-1], e[::-1]  # small values are found at the end
    least = None
    while q:
        n = len(q)
        if n == 1 or e[-1] <= EPS * EPS * (shift + q[-1]) or e[-1] <= TINY:
            found.append(shift + q.pop())
            if e:
                e.pop()
            least = None
            continue
        done += 1
        if done > 200 * len(diagonal) + 1000:
            raise ArithmeticError("dqds did not settle")
        # The lower value of the last two by two block; if it is too large the step is repeated with a smaller shift.
        p, s = q[-2] + e[-1], q[-1]
        half = (p + s) / 2
        root = math.sqrt(max(half * half - q[-2] * q[-1], 0.0))
        s = q[-2] * q[-1] / (half + root) if half + root > 0 else 0.0
        step = max(0.0, min(s, least if least is not None else s) * (1 - 4 * EPS))
        while True:
            new_q, new_e, d, least, good = [0.0] * n, [0.0] * (n - 1), q[0] - step, math.inf, True
            for i in range(n - 1):
                least = min(least, d)
                new_q[i] = d + e[i]
                if d < 0 or new_q[i] <= 0:
                    good = False
                    break
                t = q[i + 1] / new_q[i]
                new_e[i] = e[i] * t
                d = d * t - step
            least = min(least, d)
            if good and (d >= 0 or step == 0):
                new_q[-1] = max(d, 0.0)
                break
            step = 0.0 if step < EPS * EPS * (shift + q[-1]) else step / 4
        q, e, shift, least = new_q, new_e, shift + step, max(least, 0.0)
    return np.sort(np.array(found))[::-1]


def twisted(diagonal: np.ndarray, upper: np.ndarray, value: float, rounds: int = 3) -> tuple[float, np.ndarray]:
    """Eigenvalue near ``value`` and unit eigenvector of B'B for the bidiagonal B, by twisted factorisations of B'B - value."""
    n = len(diagonal)
    d, l = [float(v) ** 2 for v in diagonal], [float(u) / float(a) for u, a in zip(upper, diagonal, strict=False)]
    best = (math.inf, value, np.eye(n)[0])
    for _ in range(rounds):
        s, plus = [-value], []
        for i in range(n - 1):
            top = s[i] + d[i]
            top = top if abs(top) > TINY else TINY
            plus.append(d[i] * l[i] / top)
            s.append(plus[i] * l[i] * s[i] - value)
        p, minus = [0.0] * n, [0.0] * (n - 1)
        p[-1] = d[-1] - value
        for i in range(n - 2, -1, -1):
            top = d[i] * l[i] * l[i] + p[i + 1]
            top = top if abs(top) > TINY else TINY
            t = d[i] / top
            minus[i] = l[i] * t
            p[i] = p[i + 1] * t - value
        gamma = [s[k] + p[k] + value for k in range(n)]
        r = min(range(n), key=lambda k: abs(gamma[k]))
        z = [0.0] * n
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -plus[i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] = -minus[i] * z[i]
        z = np.array(z)
        size = float(np.linalg.norm(z))
        if not math.isfinite(size):
            break
        if abs(gamma[r]) / size < best[0]:
            best = (abs(gamma[r]) / size, value, z / size)
        value += gamma[r] / size**2
        if abs(gamma[r]) / size <= 4 * EPS * abs(value):
            break
    return best[1], best[2]


def _blocks(diagonal: np.ndarray, upper: np.ndarray) -> list[tuple[int, int]]:
    """Runs of the bidiagonal between upper entries that are nothing against its size."""
    size = max(np.abs(diagonal).max(initial=0), np.abs(upper).max(initial=0))
    cuts = np.flatnonzero(np.abs(upper) <= EPS * size) + 1
    edges = [0, *cuts.tolist(), len(diagonal)]
    return list(zip(edges, edges[1:], strict=False))


def solve(r: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The greatest squared singular values, their right directions as rows, and the sum of all squared values.

    Values that are rounding noise against the greatest one are left out.
    """
    a, b, reflections = bidiagonal(r)
    width = len(a)
    size = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    # A zero on the diagonal is moved by less than the rounding of the factor.
    a = np.where(np.abs(a) < EPS * EPS * size, EPS * EPS * size, a)
    values = []
    for start, end in _blocks(a, b) if size else []:
        values += [(v, start, end) for v in dqds(a[start:end], b[start : end - 1])]
    values.sort(key=lambda v: (-v[0], v[1]))
    total = math.fsum(v for v, _, _ in values)
    noise = (width * EPS * math.sqrt(values[0][0])) ** 2 if values else 0.0
    out, rows = [], []
    rng = np.random.default_rng(0)
    for value, start, end in values[:components]:
        if value <= noise:
            break
        better, z = twisted(a[start:end], b[start : end - 1], value)
        z = np.concatenate([np.zeros(start), z, np.zeros(width - end)])
        near = [rows[i] for i in range(len(rows)) if out[i] - value <= CLOSE * out[i]]
        for attempt in range(20):
            for _ in range(2):
                for other in near:
                    z = z - (z @ other) * other
            left = np.linalg.norm(z)
            if left > 0.5:
                break
            # Close values gave one direction twice: start again across those found, by inverse iteration.
            z = rng.standard_normal(end - start)
            z = np.concatenate([np.zeros(start), z, np.zeros(width - end)])
            for _ in range(3):
                for other in near:
                    z = z - (z @ other) * other
                z[start:end] = _inverse(a[start:end], b[start : end - 1], value * (1 + (attempt + 1) * EPS), z[start:end] / np.linalg.norm(z))
                z /= np.linalg.norm(z)
        rows.append(z / np.linalg.norm(z))
        out.append(better)
    directions = np.array(rows).reshape(-1, width)
    for first, w in reversed(reflections):
        directions[:, first:] -= 2 * np.outer(directions[:, first:] @ w, w)
    return np.array(out), directions, total


def _inverse(a: np.ndarray, b: np.ndarray, value: float, rhs: np.ndarray) -> np.ndarray:
    """(B'B - value) \\ rhs by the stationary factorisation."""
    n = len(a)
    d, l, s = a * a, b / a[:-1] if n > 1 else np.zeros(0), -value
    top, lower = np.zeros(n), np.zeros(max(n - 1, 0))
    for i in range(n):
        top[i] = s + d[i]
        top[i] = top[i] if abs(top[i]) > TINY else TINY
        if i + 1 < n:
            lower[i] = d[i] * l[i] / top[i]
            s = lower[i] * l[i] * s - value
    y = np.array(rhs, float)
    for i in range(n - 1):
        y[i + 1] -= lower[i] * y[i]
    y /= top
    for i in range(n - 2, -1, -1):
        y[i] -= lower[i] * y[i + 1]
    return y / np.abs(y).max()


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: numbers and at most ``components`` directions, whatever the number of vectors."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the covariance, greatest first
    directions: np.ndarray  # rows
    explained: np.ndarray
    identity_error: float

    @property
    def width(self) -> int:
        return len(self.sums)


def _on_grid(vectors: DataFrame, vector: str):
    c = F.col(vector)
    good = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE) + F.lit(SHIFT).cast("bigint"))
    return good, x


def fit(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> Whitening | None:
    """Learn from each distinct vector once; None without vectors or entries. The solver runs in one task, on one factor."""
    good, x = _on_grid(vectors, vector)
    distinct = cut_lineage(in_small_batches(vectors).filter(good).select(x.alias("x")).distinct())
    width = distinct.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return None
    # Lists of other lengths may stand for one vector: as long as they end in what 0 becomes.
    if distinct.filter(F.size("x") < width).take(1):
        filled = F.concat("x", F.array_repeat(F.lit(SHIFT).cast("bigint"), F.lit(width) - F.size("x")))
        distinct = cut_lineage(distinct.select(filled.alias("x")).distinct())
    held = distinct.mapInArrow(_sums(width), "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by_place = {row["i"]: int(row["s"]) for row in held}  # width + 1 rows
    n, sums = by_place[-1], [by_place[i] for i in range(width)]
    factors = cut_lineage(distinct.mapInArrow(_reduce(width, n, sums), "r binary"))
    parts = factors.count()
    while parts > 1:
        parts = -(-parts // FAN)
        factors = cut_lineage(factors.repartition(parts).mapInArrow(_combine(width), "r binary"))
        parts = factors.count()

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                squares, directions, total = solve(np.frombuffer(raw.as_py()).reshape(-1, width), components)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([squares.tobytes()], pa.binary()), pa.array([directions.tobytes()], pa.binary()), pa.array([total])],
                    names=["squares", "directions", "total"])

    row = cut_lineage(factors.mapInArrow(solved, "squares binary, directions binary, total double")).first()
    squares = np.frombuffer(row["squares"])
    model = Whitening(n, sums, squares / n, np.frombuffer(row["directions"]).reshape(-1, width), squares / row["total"] if len(squares) else squares, 0.0)
    return Whitening(**{**vars(model), "identity_error": _identity_error(distinct, model)})


def project(x: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(x, model.n, model.sums) @ (model.directions / np.sqrt(model.values)[:, None]).T


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance less the identity; blocks are centred on their own means."""
    k = len(model.values)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for x in _rows(batch.column(0), model.width):
                w = project(x, model)
                n, mean, spread = _together((n, mean, spread), (len(w), w.mean(0), (w - w.mean(0)).T @ (w - w.mean(0))))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.concatenate([mean, spread.ravel()]).tobytes()], pa.binary())], names=["n", "m"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (0, np.zeros(k), np.zeros((k, k)))
        for batch in batches:
            for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = np.frombuffer(raw)
                held = _together(held, (n, m[:k], m[k:].reshape(k, k)))
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([np.concatenate([held[1], held[2].ravel()]).tobytes()], pa.binary())], names=["n", "m"])

    made = cut_lineage(distinct.mapInArrow(run, "n bigint, m binary"))
    parts = made.count()
    while parts > 1:
        made = cut_lineage(made.repartition(-(-parts // FAN)).mapInArrow(merged, "n bigint, m binary"))
        parts = made.count()
    row = made.first()
    spread = np.frombuffer(row["m"])[k:].reshape(k, k)
    return float(np.abs(spread / row["n"] - np.eye(k)).max())


def _together(a: tuple, b: tuple) -> tuple:
    """Count, mean and spread of two sets of rows."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * (b[0] / n))


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null where it passes 64 bits."""
    n, sums = model.n, model.sums
    far = max((abs(n * int(v) - s) for low, high, s in zip(x.min(0), x.max(0), sums, strict=True) for v in (low, high)), default=0)
    top = (1 << 63) - 1
    if n * int(np.abs(x).max(initial=0)) <= top and max(map(abs, sums)) <= top and far * far * len(sums) <= top:
        gap = n * x - np.array(sums, np.int64)
        return (gap * gap).sum(1).tolist()
    exact = (sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x)
    return [v if v <= top else None for v in exact]


def whiten(vectors: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key``, deviation, whitened (array of double, greatest component first): one row per vector without nulls or non-finite entries.

    Shorter vectors count as padded with zeros; repeated rows and null keys are whitened like any other. Components are
    left out where the vectors have no spread (one vector only, a constant dimension, fewer dimensions than components):
    their eigenvalue is 0 up to rounding. Components of equal eigenvalues are any orthogonal ones, the same for all rows.
    deviation is null where it does not fit 64 bits. Without vectors there are no rows. Other columns are not read.
    """
    good, x = _on_grid(vectors, vector)
    kind = vectors.schema[key].dataType.simpleString()
    if model is None:
        return vectors.filter(good).limit(0).select(F.col(key), F.lit(0).cast("bigint").alias("deviation"), F.array().cast("array<double>").alias("whitened"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for rows in _rows(batch.column(1), model.width):
                w = project(rows, model)
                offsets = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(w)), pa.array(deviations(rows, model), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))],
                    names=["k", "deviation", "whitened"])
                at += len(w)

    return in_small_batches(vectors).filter(good).select(F.col(key).alias("k"), x.alias("x")).mapInArrow(
        run, f"k {kind}, deviation bigint, whitened array<double>").withColumnRenamed("k", key)
