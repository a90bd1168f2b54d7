"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Bounded-space online best-fit: each task keeps at most ``open_bins`` open sequences. They are found through a bitset keyed
by free space, so the tightest fit is two integer operations; when no open one fits and the space is used up, the fullest
is closed. Documents never leave their task: nothing is shuffled, memory is one batch of texts, the open bins and a
bounded word cache, and a lost task is packed again to the same result.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quiltgraph.llm.texts import in_small_batches, process_cache

CAPACITY = 2048
OPEN_BINS = 1024
#: Chunks of text and tokenizer pieces whose ids a Python worker remembers; the memory is given back when there are more.
CACHED_CHUNKS = 300_000
CACHED_PIECES = 500_000
TASK_BITS = 33


class Bins:
    """Open sequences in a bitset keyed by free space: bit f is set when some open sequence has f places left."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.by_free, self.n_open, self.made = 0, {}, 0, 0

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        name = held.pop()
        if not held:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return name

    def put(self, need: int) -> tuple[int, int]:
        """Number of the sequence that gets ``need`` tokens, and their offset in it."""
        fitting = self.bits >> need
        if fitting:
            free = need + (fitting & -fitting).bit_length() - 1
            name = self._take(free)
        else:
            free, name = self.capacity, self.made
            self.made += 1
        if free > need:
            if self.n_open >= self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self._take(fullest)
            left = free - need
            self.by_free.setdefault(left, []).append(name)
            self.bits |= 1 << left
            self.n_open += 1
        return name, self.capacity - free


class Signs(dict):
    """Letters in the byte alphabet of a tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, letter: str) -> str:
        made = self[letter] = self.tokenizer.pre_tokenizer.pre_tokenize_str(letter)[0][0]
        return made


class WordIds(dict):
    """Little-endian ids of a chunk of text without white space, as bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its chunks in order. Ids of
    chunks and of the tokenizer's own pieces of them are remembered, within the two bounds.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces: dict[str, bytes] = {}
        self.signs = Signs(self.tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Chunks that may hold an added token go to the tokenizer as they are; the sign saves looking for each of them.
        self.mark = "<" if all(t.startswith("<") for t in self.added) else ""

    def __missing__(self, chunk: str) -> bytes:
        # Latin letters followed by signs are by far the most; the tokenizer makes one piece of each of the two.
        letters = chunk.rstrip(_SIGNS).lower()
        if letters.isalpha() and (letters.isascii() or max(letters) < _LATIN_END):
            made = self._piece(letters if letters.isascii() else "".join(map(self.signs.__getitem__, letters)))
            if len(letters) < len(chunk):
                rest = chunk[len(letters) :]
                made = self._encoded(chunk) if self.mark in rest and any(t in chunk for t in self.added) else made + self._piece(rest)
        else:
            made = self._encoded(chunk)
        self[chunk] = made
        return made

    def _encoded(self, chunk: str) -> bytes:
        """Ids of any chunk by the tokenizer's own steps, as a whole where it may hold an added token."""
        tokenizer = self.tokenizer
        if self.mark in chunk and any(t in chunk for t in self.added):
            return self._bytes(tokenizer.encode(chunk, add_special_tokens=False).ids)
        split = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(chunk))
        return b"".join([self._piece(p) for p, _ in split])

    def _piece(self, piece: str) -> bytes:
        made = self.pieces.get(piece)
        if made is None:
            made = self.pieces[piece] = self._bytes([t.id for t in self.tokenizer.model.tokenize(piece)])
        return made

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        made = array("I", ids)
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()

    def of(self, text: str) -> bytes:
        # Only these are white space to every tokenizer; other kinds stay inside a chunk and are left to the tokenizer.
        for space in "\t\n\r":
            text = text.replace(space, " ")
        made = b"".join(map(self.__getitem__, text.split(" ")))
        if len(self) > CACHED_CHUNKS:
            self.clear()
        if len(self.pieces) > CACHED_PIECES:
            self.pieces.clear()
        return made


#: Signs that may follow letters in a chunk without changing how the letters are split off; no apostrophe.
_SIGNS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~"
_LATIN_END = "\u0250"
_FIELDS = "piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = 0,
    text: str = "text", keys: tuple[str, ...] = ("doc_id",), with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document: ``keys``, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its token ids and ``end_id``; only documents longer than ``capacity`` are cut, into pieces of
    ``capacity`` and a last one. A null or empty text is the end id alone. Repeated rows are packed once each; an empty
    table gives no rows. Other columns are not read, so their names do not matter. Sequence numbers hold the task's
    number in their upper bits and count from 0 in each task. The last open sequences of each task stay partly empty:
    tasks should hold many sequences each, as those of a scan do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = process_cache("word_ids", large=True)
        if tokenizer_path not in cache:
            cache.clear()
            cache[tokenizer_path] = WordIds(tokenizer_path)
        words, bins = cache[tokenizer_path], Bins(capacity, open_bins)
        base = TaskContext.get().partitionId() << TASK_BITS
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, cols = [], {n: [] for n in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")}
            ids = []
            for i, value in enumerate(batch.column(len(keys))):
                value = value.as_py()
                whole = (words.of(value) if value else b"") + end
                n = len(whole) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = whole[4 * start : 4 * (start + capacity)]
                    name, offset = bins.put(len(part) // 4)
                    rows.append(i)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                    made = (piece, start, len(part) // 4, zlib.crc32(part), base + name, offset)
                    for column, x in zip(cols.values(), made, strict=True):
                        column.append(x)
            taken = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(len(keys))]
            made = [pa.array(v, pa.int32() if n == "piece" else pa.int64()) for n, v in cols.items()]
            if with_ids:
                made.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(taken + made, names=[*keys, *cols, *(["ids"] if with_ids else [])])

    picked = in_small_batches(docs).select(*keys, text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keys)])
    return picked.mapInArrow(run, f"{kinds}, {_FIELDS}" + (", ids array<int>" if with_ids else ""))
