"""Compression of vectors to codes of eight parts, by RDD treeAggregate over columnar NumPy blocks.

Components become integers floor(4096 * x). A block holds the components of up to ``BLOCK`` vectors, one row of memory
for each dimension, and is stored in the shared folder. In each round a task takes its blocks one at a time: distances
to the 16 entries of a part's codebook accumulate dimension by dimension, and ``np.add.at`` adds every part to the sum
and count of its nearest entry. The tensors of sums and counts (16 entries of each part, whatever the number of
vectors) merge through a reduction tree; the driver divides them.

All arithmetic is exact. Blocks with components of 2^25 and more (values of 8192 and more) are handled as Python
integers, so that no square overflows; an error beyond 2^63 - 1 is given as that.

Edge cases: vectors that are null or hold null or non-finite components are dropped; vectors of fewer components than
the longest, or of a number that eight does not divide, count as filled up with zeros; of repeated ids the first entries
are those with the smaller vector, null ids come last; fewer than 16 vectors give as many entries; null labels count as
equal; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block at most.
BLOCK = 4096
#: Components of at least this size are handled as Python integers.
WIDE = 1 << 25
MOST = (1 << 63) - 1

Sums = tuple[np.ndarray, np.ndarray]


def exact(values: np.ndarray) -> np.ndarray:
    """Whole numbers, given as floats or integers, as int64, or as Python integers if squares may overflow."""
    if values.size and max(abs(values.max()), abs(values.min())) >= WIDE:
        return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)
    return values.astype(np.int64)


def scaled(values: np.ndarray) -> np.ndarray:
    return np.floor(values.astype(np.float64) * SCALE)


def distances(block: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """Squared distances (entry, vector) of one part; ``block`` has a row for each dimension."""
    total = np.zeros((len(codebook), block.shape[1]), np.result_type(block, codebook))
    for dimension, values in enumerate(block):
        step = values[None, :] - codebook[:, dimension, None]
        total += step * step
    return total


def assign(block: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every part and vector the nearest entry (of equal ones the first) and its squared distance."""
    each = [distances(part, codebook) for part, codebook in zip(block, codebooks)]
    codes = np.stack([d.argmin(0) for d in each])
    return codes, np.stack([np.take_along_axis(d, c[None, :], 0)[0] for d, c in zip(each, codes)])


def unpack(wide: bool, data: bytes, width: int) -> np.ndarray:
    """A stored block as (part, dimension, vector)."""
    values = np.frombuffer(data, "<f8" if wide else "<i4")
    return exact(values.reshape(PARTS, width, -1))


def zero(entries: int, width: int) -> Sums:
    return np.zeros((PARTS, entries, width), np.int64), np.zeros((PARTS, entries), np.int64)


def add_block(total: Sums, row: tuple[bool, bytes], codebooks: np.ndarray) -> Sums:
    """``total`` and what the vectors of a block add to the entries nearest to their parts."""
    block = unpack(row[0], row[1], codebooks.shape[2])
    codes, _ = assign(block, codebooks)
    sums, counts = zero(*codebooks.shape[1:])
    sums = sums.astype(block.dtype)
    parts = np.arange(PARTS)[:, None]
    np.add.at(sums, (parts, codes), block.transpose(0, 2, 1))
    np.add.at(counts, (parts, codes), 1)
    return merge(total, (sums, counts))


def merge(a: Sums, b: Sums) -> Sums:
    if object in (a[0].dtype, b[0].dtype):
        return a[0].astype(object) + b[0].astype(object), a[1] + b[1]
    return a[0] + b[0], a[1] + b[1]


def updated(codebooks: np.ndarray, total: Sums) -> np.ndarray:
    """Entries replaced by the floors of their means; unused ones stay."""
    sums, counts = total
    means = sums // np.maximum(counts, 1)[..., None]
    return exact(np.where(counts[..., None] > 0, means, codebooks))


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, vector of the rows that are kept."""
    found = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return found.filter(F.col("vector").isNotNull() & finite)


def to_blocks(kept: DataFrame, width: int) -> DataFrame:
    """vec_ids, labels, wide, data: blocks of whole numbers, dimension by dimension (four bytes each, or eight if ``wide``)."""
    kinds = dict(kept.dtypes)
    ddl = f"vec_ids array<{kinds['vec_id']}>, labels array<{kinds['label']}>, wide boolean, data binary"
    schema = arrow_schema(ddl)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                lists = batch.column("vector")
                lengths = np.diff(lists.offsets.to_numpy())
                dense = np.zeros((batch.num_rows, PARTS * width))
                dense[np.arange(PARTS * width) < lengths[:, None]] = scaled(lists.flatten().to_numpy(zero_copy_only=False))
                wide = bool(np.abs(dense).max(initial=0) >= WIDE)
                data = np.ascontiguousarray(dense.T, "<f8" if wide else "<i4").tobytes()
                columns = [[batch.column("vec_id").to_pylist()], [batch.column("label").to_pylist()], [wide], [data]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return kept.mapInArrow(kernel, ddl)


def train(blocks: DataFrame, codebooks: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after so many rounds of assigning and averaging; the stored blocks are read again in each."""
    rows = blocks.select("wide", "data").rdd.map(lambda row: (row[0], bytes(row[1])))
    for _ in range(rounds):
        total = rows.treeAggregate(zero(*codebooks.shape[1:]), partial(add_block, codebooks=codebooks), merge)
        codebooks = updated(codebooks, total)
    return codebooks


def encode(blocks: DataFrame, codebooks: np.ndarray, kinds: dict[str, str]) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every stored vector."""
    ddl = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    schema, width = arrow_schema(ddl), codebooks.shape[2]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes, errors = assign(unpack(row["wide"], row["data"], width), codebooks)
                code = [bytes(c).hex() for c in codes.T.astype(np.uint8)]
                error = [min(int(e), MOST) for e in errors.sum(0)]
                columns = [row["vec_ids"], row["labels"], code, error]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return blocks.mapInArrow(kernel, ddl)


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in codebooks.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error (summed over equal labels), codebooks_sha256."""
    kept = usable(vectors, id_col, vector_col, label_col)
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // PARTS))
    blocks = materialise(to_blocks(kept, width), "vector-blocks")
    seeds = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(ENTRIES).collect()
    first = np.zeros((len(seeds), PARTS * width))
    for row, seed in zip(first, seeds):
        row[: len(seed[0])] = scaled(np.array(seed[0]))
    codebooks = exact(first.reshape(len(seeds), PARTS, width).transpose(1, 0, 2))
    if seeds:
        codebooks = train(blocks, codebooks)
    coded = materialise(encode(blocks, codebooks, dict(kept.dtypes)), "codes")
    wide_sum = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.least(wide_sum, F.lit(MOST)).cast("long").alias("label_error"))
    sums = materialise(sums, "label-errors")  # read plainly, so that a hot label's side of the join can be split
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))
