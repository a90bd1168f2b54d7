"""Benchmark items in documents, found within an edit distance over words.

The CGK embedding reads a word sequence with a random walk: at step j it writes the current word and moves on when a random
bit of (j, word) says so. Sequences a few edits apart fall into step again after each edit, so edit distance becomes
Hamming distance between what they write. Items and the windows of documents are embedded by several independent walks, and
windows that agree with an item in all of a few sampled steps, for any of several samples, are candidates. Candidates are
verified exactly by bit-parallel approximate matching of the whole item.

Items are broadcast in blocks of a fixed number; documents are read once for each block and never shuffled. Windows of
every position are considered: those left out before embedding hold fewer word triples of items than any run within the
distance holds, since an edit destroys at most three of them.

A character of a script without spaces is a word. Items of fewer than five words have no edits to spare and are found as
exact runs of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.functions.shared import Shared
from quiltgraph.llm.texts import LOWER, U, byte_class, grams, in_small_batches, mix, slices, word_hashes, words

SIMILARITY = 0.8
LEAST_WORDS = 5
WALKS, SAMPLES, STEPS = 6, 6, 3
#: Items in one broadcast block, and words in one embedded piece of an item.
ITEM_BLOCK = 20_000
PIECE = 64
STRETCH = 1.3
#: Letters and digits of any script; case, ASCII and CJK punctuation and line breaks do not matter.
INSIDE = byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
_GRAM_BITS = 22
_CHUNK = 1 << 15


#: Code points that are words of their own, and punctuation of the same scripts: inclusive spans.
ALONE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035),
         (0x3038, 0x303C), (0x3040, 0x30FA), (0x30FC, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F),
         (0x20000, 0x3FFFF))
BETWEEN = ((0x3000, 0x3004), (0x3008, 0x3020), (0x302A, 0x3030), (0x3036, 0x3037), (0x303D, 0x303F), (0x30FB, 0x30FB), (0xFE30, 0xFE4F),
           (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


def split_words(data: np.ndarray, offsets: np.ndarray):
    """Like ``words`` over ``INSIDE``, but characters of ``ALONE`` are words of their own and those of ``BETWEEN`` in none."""
    lead = np.flatnonzero(data >= 0xE0)
    if not len(lead):
        return words(data, offsets, INSIDE)
    long = data[lead] >= 0xF0
    byte = lambda k: data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 0x3F
    point = (data[lead].astype(np.int64) & 0x0F) << 12 | byte(1) << 6 | byte(2)
    point = np.where(long, (data[lead].astype(np.int64) & 0x07) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3), point)
    within = lambda spans: np.logical_or.reduce([(point >= a) & (point <= b) for a, b in spans])
    alone, between = within(ALONE), within(BETWEEN)
    if not (alone | between).any():
        return words(data, offsets, INSIDE)
    size = np.where(long, 4, 3)
    flag, cut = INSIDE[data], np.zeros(len(data) + 1, bool)
    for k in range(4):
        flag[np.minimum(lead + k, len(data) - 1)[between & (k < size)]] = False
    cut[offsets] = cut[lead[alone]] = cut[(lead + size)[alone]] = True
    before, after = np.zeros_like(flag), np.zeros_like(flag)
    before[1:], after[:-1] = flag[:-1], flag[1:]
    starts = np.flatnonzero(flag & (~before | cut[:-1]))
    ends = np.flatnonzero(flag & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def embed(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, walk: int, steps: int, wanted: set[int]) -> dict[int, np.ndarray]:
    """Words written at the ``wanted`` steps by one walk from each start; 0 after the end."""
    out, at = {}, starts.copy()
    bits = [mix(hashes, 100 + 2 * walk), mix(hashes, 101 + 2 * walk)]
    last = len(hashes) - 1
    for j in range(steps):
        inside = at < ends
        here = np.minimum(at, last)
        if j in wanted:
            out[j] = np.where(inside, hashes[here], U(0))
        if j % 128 == 0 and j:
            bits = [mix(b, 55) for b in bits]
        move = (bits[j % 128 // 64][here] >> U(j % 64)) & U(1)
        at += np.where(inside, move, U(0)).astype(at.dtype)
    return out


class Index:
    """Items by the keys of their sampled steps, for each length class, walk and sample."""

    def __init__(self, ids: list, texts: list[str], similarity: float, walks: int, samples: int, sampled: int):
        self.walks, kept, short = walks, [], {}
        for ident, text in zip(ids, texts, strict=True):
            data = np.frombuffer(text.encode(), np.uint8)
            starts, ends, _ = split_words(data, np.array([0, len(data)]))
            found = word_hashes(data, starts, ends, LOWER)
            if len(found) >= LEAST_WORDS:
                kept.append((ident, found, int((1 - similarity) * len(found) + 1e-9)))
            elif len(found):
                short.setdefault(len(found), {}).setdefault(int(grams(found, len(found))[0]), []).append(ident)
        self.items = kept
        #: Items of too few words for edits: by number of words, the sorted hashes and the ids of each.
        self.short = {n: (np.array(sorted(held), U), [held[h] for h in sorted(held)]) for n, held in short.items()}
        self.patterns: dict[int, dict[int, int]] = {}
        pieces = []  # item, offset, length
        for number, (_, found, _) in enumerate(kept):
            parts = max(1, -(-len(found) // PIECE))
            cuts = [len(found) * p // parts for p in range(parts + 1)]
            pieces += [(number, a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.grams = {q: _bitmap([grams(f, q) for _, f, _ in kept]) for q in (2, 3)}
        rng = np.random.default_rng(17)
        self.classes = []  # longest piece, gram size, grams needed, pieces, steps, tables
        bound = LEAST_WORDS
        while bound <= PIECE:
            upper = bound * 3 // 2
            members = [p for p in pieces if bound <= p[2] <= upper]
            if members:
                self._add_class(members, similarity, rng, samples, sampled)
            bound = upper + 1

    def _add_class(self, members, similarity, rng, samples, sampled) -> None:
        steps = max(sampled, int(STRETCH * min(m[2] for m in members)))
        base = np.concatenate([self.items[i][1][a : a + n] for i, a, n in members])
        ends = np.cumsum([m[2] for m in members])
        starts = ends - [m[2] for m in members]
        tables = []
        for walk in range(self.walks):
            sets = [np.sort(rng.choice(steps, sampled, replace=False)) for _ in range(samples)]
            written = embed(base, starts.copy(), ends, walk, steps, {int(j) for s in sets for j in s})
            for chosen in sets:
                key = combine([written[int(j)] for j in chosen])
                order = np.argsort(key, kind="stable")
                tables.append((walk, [int(j) for j in chosen], key[order], np.array(order)))
        edits = lambda n: int((1 - similarity) * n + 1e-9)
        needed = {q: min(n - q + 1 - q * edits(n) for _, _, n in members) for q in self.grams}
        q = 3 if needed[3] > 0 else 2
        longest = max(n + edits(n) for _, _, n in members)
        self.classes.append((longest, q, max(needed[q], 0), members, steps, tables))

    def pattern(self, number: int) -> dict[int, int]:
        """Bit mask of the places of each word of an item."""
        if number not in self.patterns:
            made: dict[int, int] = {}
            for place, word in enumerate(self.items[number][1].tolist()):
                made[word] = made.get(word, 0) | 1 << place
            self.patterns[number] = made
        return self.patterns[number]


def _bitmap(found: list[np.ndarray]) -> np.ndarray:
    table = np.zeros(1 << _GRAM_BITS, bool)
    for f in found:
        table[f >> U(64 - _GRAM_BITS)] = True
    return table


def combine(parts: list[np.ndarray]) -> np.ndarray:
    key = parts[0] * U(0x9E3779B97F4A7C15)
    for p in parts[1:]:
        key = (key ^ (key >> U(29))) * U(0xBF58476D1CE4E5B9) + p
    return key * U(0x94D049BB133111EB)


def nearest_end(pattern: dict[int, int], length: int, text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to any run of ``text``, and the first place where such a run ends."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score, best, at = full, 0, length, length, 0
    for place, word in enumerate(text):
        eq = pattern.get(word, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (full & ~(xh | plus)), plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus, minus = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, at = score, place + 1
    return best, at


def candidates(index: Index, hashes: np.ndarray, first: np.ndarray):
    """Candidate (row, item, start in the row's words) triples, with repetitions."""
    n = len(hashes)
    end_of = np.repeat(first[1:], np.diff(first)).astype(np.int32)
    at = np.arange(n, dtype=np.int32)
    held = {}
    for q in {c[1] for c in index.classes}:
        hits = np.zeros(n, bool)
        hits[: max(n - q + 1, 0)] = index.grams[q][grams(hashes, q) >> U(64 - _GRAM_BITS)]
        hits &= at + q <= end_of
        held[q] = np.zeros(n + 1, np.int32)
        np.cumsum(hits, out=held[q][1:])
    for longest, q, need, members, steps, tables in index.classes:
        # The last gram of a window begins q - 1 words before its end.
        enough = held[q][np.minimum(at + np.int32(longest - q + 1), end_of)] - held[q][:-1] >= need
        chosen = np.flatnonzero(enough)
        for low in range(0, len(chosen), _CHUNK):
            starts = chosen[low : low + _CHUNK].astype(np.int64)
            ends, walk_now, written = end_of[starts], -1, {}
            lo, hi = starts[0], ends[-1]
            for walk, sampled, keys, order in tables:
                if walk != walk_now:
                    wanted = {j for w, s, _, _ in tables if w == walk for j in s}
                    written = embed(hashes[lo:hi], starts - lo, ends - lo, walk, steps, wanted)
                    walk_now = walk
                key = combine([written[j] for j in sampled])
                left = np.searchsorted(keys, key, "left")
                hit = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == key)
                for h in hit:
                    k = left[h]
                    while k < len(keys) and keys[k] == key[h]:
                        number, offset, _ = members[order[k]]
                        yield int(starts[h]), number, offset
                        k += 1


def exact(index: Index, hashes: np.ndarray, first: np.ndarray):
    """(row, item id, words, last word) of the first copy of each short item in each row."""
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for n, (wanted, ids) in index.short.items():
        found = grams(hashes, n)
        place = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
        hit = np.flatnonzero((wanted[place] == found) & (np.arange(len(found)) + n <= first[1:][row_of[: len(found)]]))
        for h in hit[np.unique(row_of[hit] * len(wanted) + place[hit], return_index=True)[1]]:
            row = int(row_of[h])
            for ident in ids[place[h]]:
                yield row, ident, n, int(h) + n - 1 - int(first[row])


def find(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, text: str = "text", keys: tuple[str, ...] = ("doc_id",),
         item: str = "item_id", item_text: str = "text", walks: int = WALKS, samples: int = SAMPLES, steps: int = STEPS) -> DataFrame:
    """``keys``, item_id, n_item_words, distance, last_word: one row per document and item found in it, the closest place.

    An item of n words is found where some run of the document is at most (1 - similarity) n word edits away. Null texts
    are empty and hold nothing; items of fewer than five words are found as exact copies, and those without a word or an
    id are not looked for. Ties go to the first place. Repeated documents and repeated items are reported each. Other columns are not read.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item).alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null")
    blocks = max(1, -(-wanted.count() // ITEM_BLOCK))
    picked = in_small_batches(docs).select(*keys, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    item_type = items.schema[item].dataType.simpleString()
    made = None
    for block in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).orderBy("i", "t").collect()
        shared = Shared(spark, Index([r["i"] for r in rows], [r["t"] for r in rows], similarity, walks, samples, steps))
        part = picked.mapInArrow(_search(shared), f"{kinds}, item_id {item_type}, n_item_words int, distance int, last_word bigint")
        made = part if made is None else made.unionByName(part)
    return made


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            width = batch.num_columns - 1
            rows, found = [], []
            for at, data, offsets in slices(batch.column(width)):
                starts, ends, first = split_words(data, offsets)
                if not len(starts) or not (index.items or index.short):
                    continue
                hashes = word_hashes(data, starts, ends, LOWER)
                for row, ident, n, last in exact(index, hashes, first):
                    rows.append(at + row)
                    found.append((ident, n, 0, last))
                regions: dict[tuple[int, int], list[int]] = {}
                for start, number, offset in candidates(index, hashes, first):
                    row = int(np.searchsorted(first, start, "right")) - 1
                    regions.setdefault((row, number), []).append(start - offset)
                for (row, number), begins in sorted(regions.items()):
                    match = verify(index, number, hashes, begins, int(first[row]), int(first[row + 1]))
                    if match:
                        rows.append(at + row)
                        found.append((index.items[number][0], len(index.items[number][1]), *match))
            if rows:
                taken = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(width)]
                made = [pa.array([f[0] for f in found]), *(pa.array([f[k] for f in found], t) for k, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.int64())))]
                yield pa.RecordBatch.from_arrays(taken + made, names=[*batch.schema.names[:-1], "item_id", "n_item_words", "distance", "last_word"])

    return run


def verify(index: Index, number: int, hashes: np.ndarray, begins: list[int], low: int, high: int) -> tuple[int, int] | None:
    """Distance and last word of the closest run around the candidate places, None when none is close enough."""
    _, item, most = index.items[number]
    n, slack, best = len(item), len(item) // 2 + most, None
    spans: list[list[int]] = []
    for b in sorted(set(begins)):
        a, z = max(low, b - slack), min(high, b + n + slack)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(z, spans[-1][1])
        else:
            spans.append([a, z])
    for a, z in spans:
        distance, end = nearest_end(index.pattern(number), n, hashes[a:z].tolist())
        if distance <= most and (best is None or distance < best[0]):
            best = (distance, a + end - 1 - low)
    return best
