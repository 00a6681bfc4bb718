"""Sum-of-squares online packing of tokenised documents into fixed windows.

Every task packs the documents of its own input split, so nothing is shuffled. A document of more than one window
gives whole windows first; its remainder goes to the fill level that minimises the sum over levels of the squared
number of windows partially filled to that level. The level array has one entry for each fill level. Open windows are
bounded: beyond ``max_open`` they are cut and joined to whole ones. At the end of a split the same is done with what is
still open, and the last partial window leaves as sequences whose lengths are powers of two, which need no padding.

Edge cases: a null text counts as empty and gives the end id alone; repeated ids are packed row by row; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Emitter, arrow_schema, bound_batches, text_rows
from .tokens import vocabulary_encoder

PIECES = "doc_id long, start long, length long, token_bytes binary, doc_tokens long, sequence_id long, offset long"
#: Sequence ids are the task's partition number in the high bits and a running number in the low ones.
ID_BITS = 40

Piece = tuple[object, int, bytes, int]  # doc_id, start, ids as little-endian uint32, tokens of the document
Window = list[Piece]


class LevelPacker:
    """Places remainders by sums of squares; ``closed`` collects (pieces) of finished windows."""

    def __init__(self, capacity: int = 2048, max_open: int = 2048):
        self.capacity, self.max_open = capacity, max_open
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: list[list[Window]] = [[] for _ in range(capacity)]
        self.n_open = 0
        self.arrive = np.ones(capacity + 1)  # what one more window at a level adds to the sum of squares
        self.arrive[capacity] = 0
        self.leave = np.full(capacity + 1, np.inf)  # minus what one window less at a level takes away
        self.leave[0] = 0

    def _count(self, level: int, by: int) -> None:
        self.levels[level] += by
        n = int(self.levels[level])
        self.arrive[level] = 2 * n + 1
        self.leave[level] = 1 - 2 * n if n else np.inf
        self.n_open += by

    def choose(self, size: int) -> int:
        """The level to fill; 0 opens a window. Ties go to the fullest level."""
        top = self.capacity - size
        change = self.arrive[size:] + self.leave[: top + 1]
        return top - int(change[::-1].argmin())

    def place(self, piece: Piece) -> list[Window]:
        """Adds one piece shorter than the capacity; returns the windows that this fills."""
        size = len(piece[2]) // 4
        level = self.choose(size)
        window = self.open[level].pop() if level else []
        if level:
            self._count(level, -1)
        window.append(piece)
        return self._store(window, level + size)

    def _store(self, window: Window, level: int) -> list[Window]:
        if level == self.capacity:
            return [window]
        self.open[level].append(window)
        self._count(level, 1)
        if self.n_open <= self.max_open:
            return []
        whole, partial, left = self.join_open()
        return whole + (self._store(partial, left) if left else [])

    def join_open(self) -> tuple[list[Window], Window, int]:
        """Cuts and joins all open windows to whole ones; what is left over is one partial window."""
        whole: list[Window] = []
        current: Window = []
        filled = 0
        for level in range(1, self.capacity):
            for window in self.open[level]:
                for doc, start, data, tokens in window:
                    at = 0
                    while at < len(data):
                        part = data[at : at + 4 * (self.capacity - filled)]
                        current.append((doc, start + at // 4, part, tokens))
                        at += len(part)
                        filled += len(part) // 4
                        if filled == self.capacity:
                            whole.append(current)
                            current, filled = [], 0
            if self.levels[level]:
                self.open[level] = []
                self._count(level, -int(self.levels[level]))
        return whole, current, filled


def power_of_two_parts(window: Window, length: int) -> Iterator[Window]:
    """Cuts a partial window into sequences whose lengths are the binary digits of its length, longest first."""
    pieces = list(reversed(window))
    for bit in reversed(range(length.bit_length())):
        room = (length >> bit & 1) << bit
        part: Window = []
        while room:
            doc, start, data, tokens = pieces.pop()
            take = min(room, len(data) // 4)
            part.append((doc, start, data[: 4 * take], tokens))
            if 4 * take < len(data):
                pieces.append((doc, start + take, data[4 * take :], tokens))
            room -= take
        if part:
            yield part


def pack_stream(documents: Iterator[tuple[object, np.ndarray]], capacity: int, max_open: int) -> Iterator[Window]:
    """Finished windows for a stream of (doc_id, ids)."""
    packer = LevelPacker(capacity, max_open)
    for doc, ids in documents:
        data, n = ids.astype("<u4").tobytes(), len(ids)
        whole = n - n % capacity
        for at in range(0, whole, capacity):
            yield [(doc, at, data[4 * at : 4 * (at + capacity)], n)]
        if n > whole:
            yield from packer.place((doc, whole, data[4 * whole :], n))
    whole_windows, rest, length = packer.join_open()
    yield from whole_windows
    yield from power_of_two_parts(rest, length)


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 1, capacity: int = 2048, max_open: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, token_bytes (ids as little-endian uint32), doc_tokens, sequence_id, offset."""
    schema = arrow_schema(PIECES)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary_encoder(tokenizer_path, pattern)
        first_id = TaskContext.get().partitionId() << ID_BITS

        def tokenised() -> Iterator[tuple[object, np.ndarray]]:
            for batch in batches:
                for doc, text in text_rows(batch):
                    ids = encode(text or "")
                    ids.append(end_id)
                    yield doc, np.array(ids, np.uint32)

        out = Emitter(schema)
        for number, window in enumerate(pack_stream(tokenised(), capacity, max_open)):
            offset = 0
            for doc, start, data, tokens in window:
                out.add(doc, start, len(data) // 4, data, tokens, first_id + number, offset, weight=len(data))
                offset += len(data) // 4
            if out.full:
                yield out.take()
        yield from out.rest()

    return bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(kernel, PIECES)


def with_checksums(pieces: DataFrame) -> DataFrame:
    """Replaces the ids of each piece by their crc32."""
    return pieces.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
