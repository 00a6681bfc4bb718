"""Best-two-fit packing of tokenised documents into windows.

A window is filled greedily, each time with the longest unpacked document that fits. Then its smallest document is taken
out, and if two unpacked documents fit the gap so widened more tightly than it did, they replace it.

Documents of one length are interchangeable, so what is packed is the histogram of lengths: at most ``capacity`` counts,
whatever the size of the table. A filling is used for as many windows as leave every choice that led to it open, so the
work of the driver is bounded by the number of lengths too, and the windows are those of packing one document at a time.
The documents stay where they are: each has a rank among those of its length (a number within its input split plus the
number in earlier splits), and ranks are dealt out to fillings in runs.

Edge cases: a null text counts as empty and gives the end id alone; repeated and null ids are packed row by row; texts
of more than one window give whole windows and a shorter first piece; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Emitter, arrow_schema, bound_batches, materialise, text_rows
from .tokens import vocabulary_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long, token_bytes binary"
PLACED = "sequence_id long, offset long"
#: Bits of a rank beside the length, in the keys by which runs are found.
RANK_BITS = 44

#: Lengths of a window's documents with how often each occurs, longest first, and the number of such windows.
Filling = tuple[list[tuple[int, int]], int]


def fill(left: np.ndarray, capacity: int) -> tuple[dict[int, int], int]:
    """The greedy filling: lengths and how often, and the gap that stays."""
    taken: dict[int, int] = {}
    gap = capacity
    while gap:
        fits = np.flatnonzero(left[: gap + 1])
        fits = fits[len(fits) - 1 :]
        if not len(fits):
            break
        length = int(fits[0])
        times = min(int(left[length]), gap // length)
        taken[length] = times
        left[length] -= times
        gap -= length * times
    return taken, gap


def best_two(left: np.ndarray, room: int) -> tuple[int, int]:
    """The two unpacked documents that fill ``room`` most, longer one first; of equal sums the one with the longest document. (0, 0) if no two fit."""
    lengths = np.flatnonzero(left[: room + 1])
    if not len(lengths):
        return 0, 0
    at = np.searchsorted(lengths, np.minimum(lengths, room - lengths), side="right") - 1
    own = (at >= 0) & (lengths[at] == lengths) & (left[lengths] < 2)
    at = at - own
    sums = np.where(at >= 0, lengths + lengths[at], 0)
    best = len(sums) - 1 - int(sums[::-1].argmax())
    return (int(lengths[best]), int(lengths[at[best]])) if sums[best] else (0, 0)


def best_two_fit(counts: dict[int, int], capacity: int = 2048) -> Iterator[Filling]:
    """Fillings for so many documents by length, each with the number of windows it is used for."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    while left.any():
        before = left.copy()
        greedy, gap = fill(left, capacity)
        final = dict(greedy)
        if gap and sum(greedy.values()) > 1:
            smallest = min(greedy)
            first, second = best_two(left, gap + smallest)
            if first + second > smallest:
                final[smallest] -= 1
                for length in (first, second):
                    final[length] = final.get(length, 0) + 1
        final = {length: n for length, n in final.items() if n}
        # The choices hold as long as each length has as many documents left as the greedy filling and the final one take.
        windows = min(int(before[length] - max(n, greedy.get(length, 0))) // n + 1 for length, n in final.items())
        left = before
        for length, n in final.items():
            left[length] -= n * windows
        yield sorted(final.items(), reverse=True), windows


class Runs:
    """Where the documents of each length go, by rank: arrays with an entry for each run of ranks."""

    def __init__(self, fillings: Iterator[Filling]):
        used: dict[int, int] = {}
        rows: list[tuple[int, int, int, int, int]] = []
        sequence = 0
        for lengths, windows in fillings:
            offset = 0
            for length, times in lengths:
                rank = used.get(length, 0)
                rows.append((length << RANK_BITS | rank, rank, sequence, times, offset))
                used[length] = rank + times * windows
                offset += times * length
            sequence += windows
        self.sequences = sequence
        self.key, self.rank, self.sequence, self.times, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T.copy()

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset of documents of these lengths and ranks."""
        run = np.searchsorted(self.key, length << RANK_BITS | rank, side="right") - 1
        number = rank - self.rank[run]
        return self.sequence[run] + number // self.times[run], self.offset[run] + number % self.times[run] * length


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids: whole windows, after a first piece that may be shorter."""
    start, length = 0, n % capacity or min(n, capacity)
    while length:
        yield start, length
        start += length
        length = min(capacity, n - start)


def token_pieces(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int, capacity: int, tokens: bool, id_col: str, text_col: str) -> DataFrame:
    """One row per piece, with the task that made it (part) and its number among the pieces of its length there (place)."""
    schema = arrow_schema(PIECES)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = vocabulary_encoder(tokenizer_path, pattern), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        out = Emitter(schema)
        for batch in batches:
            for doc, text in text_rows(batch):
                ids = encode(text or "")
                ids.append(end_id)
                data = np.array(ids, "<u4").tobytes()
                for number, (start, length) in enumerate(cut(len(ids), capacity)):
                    piece = data[4 * start : 4 * (start + length)]
                    out.add(doc, number, start, length, zlib.crc32(piece), part, int(seen[length]), piece if tokens else None, weight=len(piece) if tokens else 0)
                    seen[length] += 1
                if out.full:
                    yield out.take()
        yield from out.rest()

    return bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(kernel, PIECES)


def best_fit_packing(
    docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 0, capacity: int = 2048, tokens: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if ``tokens``, token_bytes (ids as little-endian uint32)."""
    pieces = materialise(token_pieces(docs, tokenizer_path, pattern, end_id, capacity, tokens, id_col, text_col), "pieces")
    counts = materialise(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    runs = Runs(best_two_fit({row["length"]: row["n"] for row in histogram}, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["token_bytes"] if tokens else [])]
    ranked = pieces.join(bases, ["length", "part"]).select(*kept, (F.col("base") + F.col("place")).alias("rank"))
    ddl = ", ".join(f"{name} {kind}" for name, kind in ranked.drop("rank").dtypes) + f", {PLACED}"
    schema = arrow_schema(ddl)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = runs.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, at)], schema=schema)

    return ranked.mapInArrow(place, ddl)
