"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints have 64 bits, from 4-word shingles. To find all pairs within a few bits: bits that agree or disagree
together are grouped into partitions; each partition gets its own threshold, such that two fingerprints within the
radius must be within the threshold of at least one partition; the thresholds are allocated by dynamic programming so
that probes and estimated candidates cost least; each fingerprint is indexed under its partition values and probes all
values within the threshold; what meets in a bucket is verified on all bits.

Equal fingerprints are merged first. A bucket gives only a spanning forest of its verified links, found by a search
that drops each fingerprint once reached, so no pairs pile up where copies do. Buckets beyond a bound are compared in
blocks, block against block.

Edge cases: null and empty texts have fingerprint zero and link like any other; rows that repeat an id count as one
document; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Emitter, arrow_schema, bound_batches, materialise, text_rows, without_rows
from .components import connected_components

BITS = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
_LANES = np.uint64(0x0001000100010001)
_SEGMENT = 1 << 15


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of a text, A-Z lower-cased, words split at ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = lengths.cumsum() - 1
    starts = (ends - lengths + 1)[: len(words) - size + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each bit; four 16-bit counters travel in each word."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _SEGMENT):
        part = hashes[at : at + _SEGMENT]
        for shift in range(16):
            lanes = int(((part >> np.uint64(shift)) & _LANES).sum())
            for lane in range(4):
                total[16 * lane + shift] += lanes >> (16 * lane) & 0xFFFF
    return total


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned number."""
    hashes = shingle_hashes(text)
    if not len(hashes):
        return 0
    set_bits = bit_counts(hashes) * 2 > len(hashes)
    return int(sum(1 << int(i) for i in np.flatnonzero(set_bits)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as signed long)."""
    ddl = "doc_id long, fp long"
    schema = arrow_schema(ddl)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(schema)
        for batch in batches:
            for doc, text in text_rows(batch):
                value = fingerprint(text)
                out.add(doc, value - (1 << 64) if value >> 63 else value)
            if out.full:
                yield out.take()
        yield from out.rest()

    return bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(kernel, ddl)


def pair_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each pair of bits how many set both; summed over all rows in the cluster."""
    ddl = "cell int, n long"
    schema = arrow_schema(ddl)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 1 << 16):
                part = np.ascontiguousarray(values[at : at + (1 << 16)])
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
                rows += len(part)
        if rows:
            cells = np.r_[total.astype(np.int64).ravel(), rows]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], schema=schema)

    sums = np.zeros(BITS * BITS + 1, np.int64)
    for row in distinct.select("fp").mapInArrow(kernel, ddl).groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sums[row["cell"]] = row["n"]
    return int(sums[-1]), sums[:-1].reshape(BITS, BITS)


def group_bits(rows: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size; each group grows by the bit most correlated with it."""
    p = np.diag(both) / max(rows, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    related = np.abs((both / max(rows, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    free = set(range(BITS))
    groups = []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(sorted(free), key=lambda b: related[b, sorted(free)].sum())]
        free.remove(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: related[b, group].sum())
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def within(p: np.ndarray, group: list[int], most: int) -> np.ndarray:
    """Estimated chance that two fingerprints differ in at most 0, 1, ... ``most`` bits of a group."""
    chance = np.zeros(most + 1)
    chance[0] = 1
    for b in group:
        q = 2 * p[b] * (1 - p[b])
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    return chance.cumsum()


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of -1 and more that sum to ``total`` at least cost; costs[i][e + 1] is that of threshold e."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for e, more in enumerate(options, -1):
                key = used + e
                if key not in following or cost + more < following[key][0]:
                    following[key] = (cost + more, [*chosen, e])
        best = following
    return best[total]


#: Relative costs of one probe row (moved and sorted) and of one candidate (compared in memory).
PROBE_COST, CANDIDATE_COST = 1.0, 0.02


def plan(rows: int, both: np.ndarray, radius: int, collisions=None) -> list[tuple[list[int], int]]:
    """Groups of bits with thresholds. ``collisions(groups)`` may give the measured share of equal pairs in each group."""
    p = np.diag(both) / max(rows, 1)
    best: tuple[float, list] = (np.inf, [])
    for parts in range(2, radius + 2):
        groups = group_bits(rows, both, parts)

        def costs(measured: list[float] | None) -> list[list[float]]:
            found = []
            for i, group in enumerate(groups):
                chance = within(p, group, radius)
                if measured:
                    chance = np.minimum(1, chance * max(1.0, measured[i] / max(chance[0], 1e-30)))
                probes = np.cumsum([comb(len(group), e) for e in range(radius + 1)])
                found.append([0.0, *(PROBE_COST * rows * probes + CANDIDATE_COST * rows * rows * chance)])
            return found

        cost, chosen = allocate(costs(None), radius - parts + 1)
        if cost < best[0]:
            best = (cost, [groups, chosen, costs])
    groups, chosen, costs = best[1]
    if collisions is not None:
        _, chosen = allocate(costs(collisions(groups)), radius - len(groups) + 1)
    return [(g, e) for g, e in zip(groups, chosen) if e >= 0]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def bit_mask(bits) -> int:
    return signed(sum(1 << b for b in bits))


def measured_collisions(distinct: DataFrame, groups: list[list[int]]) -> list[float]:
    """Share of pairs equal in each group, counted over all fingerprints."""
    values = distinct.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(bit_mask(g))) for g in groups])).alias("part", "value"))
    sizes = values.groupBy("part", "value").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = sizes.groupBy("part").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("pairs")).collect()
    found = {r["part"]: r["pairs"] / (r["n"] * r["n"]) for r in rows}
    return [found.get(i, 0.0) for i in range(len(groups))]


def probe_rows(distinct: DataFrame, partitions: list[tuple[list[int], int]]) -> DataFrame:
    """Index rows (indexed true) and probes, keyed by partition and value."""
    sides = []
    for number, (group, most) in enumerate(partitions):
        flips = [bit_mask(c) for e in range(most + 1) for c in combinations(group, e)]
        value = F.col("fp").bitwiseAND(F.lit(bit_mask(group)))
        sides.append(
            distinct.select("fp", F.explode(F.array(*map(F.lit, flips))).alias("flip")).select(
                F.lit(number).alias("part"), value.bitwiseXOR(F.col("flip")).alias("value"), "fp", (F.col("flip") == 0).alias("indexed")
            )
        )
    found = sides[0]
    for side in sides[1:]:
        found = found.unionByName(side)
    return found


def forest(members: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the links among fingerprints; each is compared only until it is reached."""
    left = np.unique(members)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                for other in left[near]:
                    yield int(at), int(other)
                queue.extend(left[near])
                left = left[~near]


#: Buckets up to this size are compared all at once with others of a batch; they can hold few links.
SMALL = 16
LINKS = "a long, b long, part int, value long, chunk int"


def bucket_links(rows: DataFrame, radius: int, block: int) -> DataFrame:
    """Links of each bucket of ``rows`` (part, value, fp, indexed).

    A bucket of more than ``block`` rows is searched block by block; its rows are given too, with their block's number
    in ``chunk`` and no ``b``, to be compared across blocks.
    """
    schema = arrow_schema(LINKS)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(schema)
        held: list[np.ndarray] = []  # structured rows of the bucket not yet ended
        kind = np.dtype([("part", np.int32), ("value", np.int64), ("fp", np.uint64), ("indexed", bool)])
        chunks = 0

        def large(part: int, value: int, members: np.ndarray) -> None:
            for a, b in forest(members, radius):
                out.add(signed(a), signed(b), part, value, None)

        def spill(rows: np.ndarray) -> None:
            nonlocal chunks
            part, value = int(rows["part"][0]), int(rows["value"][0])
            large(part, value, rows["fp"])
            for fp in np.unique(rows["fp"]).tolist():
                out.add(signed(fp), None, part, value, chunks)
            chunks += 1

        def ended(rows: np.ndarray) -> None:
            """Rows of whole buckets, in order."""
            change = np.flatnonzero((rows["part"][1:] != rows["part"][:-1]) | (rows["value"][1:] != rows["value"][:-1])) + 1
            starts = np.r_[0, change]
            sizes = np.diff(np.r_[starts, len(rows)])
            useful = (sizes > 1) & np.logical_or.reduceat(rows["indexed"], starts)
            fps = rows["fp"]
            owner = np.repeat(np.where(useful & (sizes <= SMALL), np.arange(len(starts)), -1), sizes)
            for gap in range(1, min(SMALL, int(sizes.max()))):
                same = np.flatnonzero((owner[gap:] == owner[:-gap]) & (owner[gap:] >= 0))
                if not len(same):
                    continue
                a, b = fps[same], fps[same + gap]
                hit = (a != b) & (np.bitwise_count(a ^ b) <= radius)
                for x, y in zip(a[hit].tolist(), b[hit].tolist()):
                    out.add(signed(x), signed(y), 0, 0, None)
            for k in np.flatnonzero(useful & (sizes > SMALL)):
                large(int(rows["part"][starts[k]]), int(rows["value"][starts[k]]), fps[starts[k] : starts[k] + sizes[k]])

        def bucket_over(rows: np.ndarray) -> None:
            if chunks:
                spill(rows)
            else:
                ended(rows)

        for batch in batches:
            fresh = np.empty(batch.num_rows, kind)
            for i, name in enumerate(("part", "value", "fp", "indexed")):
                column = batch.column(i).to_numpy(zero_copy_only=False)
                fresh[name] = column.view(np.uint64) if name == "fp" else column
            if not len(fresh):
                continue
            if held:
                first = held[0][0]
                same = int(((fresh["part"] == first["part"]) & (fresh["value"] == first["value"])).sum())
                held.append(fresh[:same])
                fresh = fresh[same:]
                if sum(map(len, held)) > block:
                    spill(np.concatenate(held))
                    held = [held[0][:1]]
                if len(fresh):
                    bucket_over(np.concatenate(held))
                    held, chunks = [], 0
            if len(fresh):
                last = fresh[-1]
                tail = len(fresh) - int(((fresh["part"] == last["part"]) & (fresh["value"] == last["value"])).sum())
                if tail:
                    ended(fresh[:tail])
                held = [fresh[tail:]]
            while out.full:
                yield out.take()
        if held:
            bucket_over(np.concatenate(held))
        yield from out.rest()

    spread = rows.select("part", "value", "fp", "indexed").repartition("part", "value").sortWithinPartitions("part", "value")
    return spread.mapInArrow(kernel, LINKS)


def near_links(distinct: DataFrame, radius: int = RADIUS, block: int = 2_000_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs within ``radius`` bits."""
    rows, both = pair_statistics(distinct)
    partitions = plan(rows, both, radius, lambda groups: measured_collisions(distinct, groups))
    found = materialise(bucket_links(probe_rows(distinct, partitions), radius, block), "links")
    links = found.filter("b is not null").select("a", "b")
    blocks = found.filter("b is null").select("part", "value", F.col("a").alias("fp"), "chunk")
    if not blocks.isEmpty():
        counts = blocks.groupBy("part", "value").agg((F.max("chunk") + 1).alias("n"))
        cells = blocks.join(counts, ["part", "value"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).filter("other != chunk")
        cell = F.xxhash64("part", "value", F.least("chunk", "other"), F.greatest("chunk", "other"))
        crossed = cells.select(F.lit(0).alias("part"), cell.alias("value"), "fp", F.lit(True).alias("indexed"))
        links = links.unionByName(bucket_links(crossed, radius, 1 << 62).filter("b is not null").select("a", "b"))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, block: int = 2_000_000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest id reachable over links) of every row."""
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    links = near_links(distinct, radius, block)
    first_a = distinct.select(F.col("fp").alias("a"), F.col("first").alias("ia"))
    first_b = distinct.select(F.col("fp").alias("b"), F.col("first").alias("ib"))
    edges = links.join(first_a, "a").join(first_b, "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"))
    roots = connected_components(edges).select(F.col("node").alias("first"), "root")
    component = distinct.join(roots, "first", "left").select("fp", F.coalesce("root", "first").alias("component_id"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(component, "fp").select("doc_id", shown, "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, **sizes: int) -> DataFrame:
    """The first document of each component, all columns as they came.

    Decided by row (id and hash of the text), and components are of fingerprints: an id may have several texts. Null
    ids come last, and of rows that share id and text one stays.
    """
    key = F.xxhash64(F.col(text_col))
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), key.alias("key")).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")), "rows")
    prints = materialise(fingerprints(docs.select(key.alias("key"), text_col), "key", text_col).groupBy("doc_id").agg(F.first("fp").alias("fp")).withColumnRenamed("doc_id", "key"), "fingerprints")
    links = near_links(materialise(prints.select("fp").distinct(), "distinct"), radius)
    roots = materialise(connected_components(links).select(F.col("node").alias("fp"), "root"), "roots")
    placed = rows.join(prints, "key").join(roots, "fp", "left")
    placed = materialise(placed.select("doc_id", "key", "n", F.coalesce("root", "fp").alias("root")), "placed")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    keep = materialise(placed.groupBy("root").agg(F.min(place).alias("keep"), F.sum("n").alias("members")).filter("members > 1"), "keep")
    kept = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("key") == F.col("keep.key"))
    going = placed.join(keep, "root").withColumn("kept", kept).filter("not kept or n > 1")
    going = materialise(going.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "kept"), "dropped")
    return without_rows(docs, id_col, key, going, **sizes)
