"""Removal of byte strings that a document with a smaller id already has, by suffix arrays over shards.

A stretch of 50 bytes is removed if it also starts in a document with a smaller id. Every such stretch holds an anchor
chosen by its content (see ``anchors``), so equal stretches are found through equal anchors:

0. Strings of GRAM bytes that stand in very many documents are counted; they are anchors only of stretches that hold
   nothing else, so that the documents around a common line do not all meet at that line.
1. Every document names its anchors and their contexts by hashes. A scan task keeps, of each context, the smallest
   document, and settles the others at once: all of the context is in a smaller document. Hashes travel packed.
2. By shard of the anchor's hash: all but the smallest document of a context are settled likewise. Where documents
   share an anchor but not its context, the smallest document of each context is asked for the bytes.
3. Those documents send the contexts' bytes to the anchor's shard.
4. Each shard sorts the suffixes of its contexts by induced sorting and computes permuted common prefixes; stretches
   whose common prefixes reach 50 bytes are equal, and all but those in the smallest document are to go.
5. Documents remove what was settled in 2 and 4, wherever their contexts occur.

Steps 3 and 5 read documents by bucket of their id and share one shuffle of them. The number of shards and buckets
grows with the text, and is no less than ``spark.sql.shuffle.partitions``.

Edge cases: a null text counts as empty; rows repeating an id are never evidence against each other; null ids count as
larger than all others; documents shorter than 50 bytes stay whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

from .anchors import NONE, WINDOW, CommonGrams, anchors, mix
from .common import Emitter, arrow_schema, bound_batches, materialise, release_memory, text_rows
from .suffix_array import permuted_lcp, suffix_array

#: Text that a scan task gathers before it sends hashes on, and symbols that one suffix array spans unless one anchor has more.
FLUSH_BYTES = 8 << 20
ARRAY_SYMBOLS = 2_000_000
LAST_ID = (1 << 63) - 1
#: Text that a bucket of documents has on the average, at most.
PART_BYTES = 64 << 20
NAMES, SETTLED, ASKED = 0, 1, 2
#: A string in this many documents is common. A gathering of text counts those that stand in at least LOCAL_DOCS of its
#: documents; at most MOST_COMMON, the most frequent, are told to the tasks. No result depends on which are common.
COMMON_DOCS, LOCAL_DOCS, MOST_COMMON = 50_000, 8, 1 << 18
WHOLE = 255

ENTRIES = "shard int, kind int, docs binary, grams binary, contexts binary"
ORDERS = "bucket int, kind int, docs binary, contexts binary, starts binary, ends binary"
BYTES = "shard int, docs binary, grams binary, contexts binary, lengths binary, data binary"


def planes(values: np.ndarray, width: int = 8) -> bytes:
    """Numbers as planes of their bytes, lowest first, so that what is constant compresses."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes, width: int = 8) -> np.ndarray:
    got = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((got.shape[1], 8), np.uint8)
    out[:, :width] = got.T
    return out.view("<u8").ravel().astype(np.uint64)


def pack_ids(ids: np.ndarray) -> bytes:
    """Ids in any order, as differences."""
    return planes(np.diff(ids.astype(np.int64).view(np.uint64), prepend=np.uint64(0)))


def unpack_ids(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64).view(np.int64)


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each id, as ``bucket_column`` computes it."""
    return np.mod(ids, buckets)


def bucket_column(ids: str, buckets: int) -> Column:
    return F.pmod(F.col(ids), F.lit(buckets)).cast("int")


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each anchor. Anchors have small hashes, being least ones, so they are mixed once more."""
    return ((mix(grams) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _groups(keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def _emit_orders(out: Emitter, buckets: int, kind: int, docs: np.ndarray, contexts: np.ndarray, starts=None, ends=None) -> None:
    if not len(docs):
        return
    bucket = bucket_of(docs, buckets)
    order = np.lexsort((docs, bucket))
    bucket, docs, contexts = bucket[order], docs[order], contexts[order]
    edges = np.r_[_groups(bucket), len(bucket)]
    for a, b in zip(edges[:-1], edges[1:]):
        spans = (planes(starts[order][a:b], 1), planes(ends[order][a:b], 1)) if starts is not None else (None, None)
        out.add(int(bucket[a]), kind, pack_ids(docs[a:b]), planes(contexts[a:b]), *spans, weight=16 * (b - a))


def common_grams(docs: DataFrame, least: int = COMMON_DOCS, local: int = LOCAL_DOCS, most: int = MOST_COMMON) -> CommonGrams:
    """Step 0: anchors' strings by the documents they stand in, counted over all documents. At most ``most`` hashes come to the driver."""
    ddl = "gram long, n long"
    schema = arrow_schema(ddl)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(schema)
        grams: list[np.ndarray] = []
        size = 0

        def count() -> None:
            found, n = np.unique(np.concatenate(grams), return_counts=True)
            for gram, times in zip(found[n >= local].view(np.int64).tolist(), n[n >= local].tolist()):
                out.add(gram, times)

        for batch in batches:
            for _, text in text_rows(batch):
                data = np.frombuffer(text.encode() if text else b"", np.uint8)
                grams.append(np.unique(anchors(data)[1]))
                size += len(data)
                if size >= FLUSH_BYTES:
                    count()
                    grams, size = [], 0
            if out.full:
                yield out.take()
        if grams:
            count()
        yield from out.rest()

    counted = docs.select("_id", "_text").mapInArrow(kernel, ddl).groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rows = counted.orderBy(F.desc("n"), "gram").limit(most).select("gram").collect()
    return CommonGrams(np.array([r["gram"] for r in rows], np.int64).view(np.uint64))


def name_anchors(docs: DataFrame, shards: int, common: CommonGrams = NONE) -> DataFrame:
    """Step 1: packed (document, anchor, context) hashes by shard, and contexts settled within the task."""
    schema = arrow_schema(ENTRIES)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(schema)
        ids: list[int] = []
        grams: list[np.ndarray] = []
        contexts: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if not ids:
                return
            doc = np.repeat(np.array(ids, np.int64), [len(g) for g in grams])
            gram, context = np.concatenate(grams), np.concatenate(contexts)
            ids.clear(), grams.clear(), contexts.clear()
            size = 0
            order = np.lexsort((doc, context))
            doc, gram, context = doc[order], gram[order], context[order]
            first = _groups(context)
            least = np.repeat(doc[first], np.diff(np.r_[first, len(context)]))
            again = doc > least
            if again.any():
                fresh = again & np.r_[True, (context[1:] != context[:-1]) | (doc[1:] != doc[:-1])]
                out.add(int(doc[0]) % shards, SETTLED, pack_ids(doc[fresh]), b"", planes(context[fresh]))
            doc, gram, context = doc[first], gram[first], context[first]
            shard = shard_of(gram, shards)
            order = np.lexsort((doc, shard))
            doc, gram, context, shard = doc[order], gram[order], context[order], shard[order]
            edges = np.r_[_groups(shard), len(shard)]
            for a, b in zip(edges[:-1], edges[1:]):
                out.add(int(shard[a]), NAMES, pack_ids(doc[a:b]), planes(gram[a:b], 5), planes(context[a:b]), weight=14 * int(b - a))
                if out.full:
                    yield out.take()

        for batch in batches:
            docs_, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                data = np.frombuffer(text.encode() if text else b"", np.uint8)
                _, gram, context, _, _ = anchors(data, common)
                if len(gram):
                    ids.append(docs_[i].as_py())
                    grams.append(gram)
                    contexts.append(context)
                    size += len(data)
                if size >= FLUSH_BYTES:
                    yield from flush()
        yield from flush()
        yield from out.rest()

    return docs.select("_id", "_text").mapInArrow(kernel, ENTRIES)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """A partition's rows by their first column; a partition holds one shard or a few."""
    shards: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            shards.setdefault(row[0], []).append(row[1:])
    for shard in sorted(shards):
        yield shard, shards.pop(shard)


def settle(entries: DataFrame, shards: int, buckets: int) -> DataFrame:
    """Step 2: orders to documents, each to remove a context (SETTLED) or to send its bytes (ASKED)."""
    schema = arrow_schema(ORDERS)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(schema)
        for _, rows in _by_shard(batches):
            for kind, docs, _, contexts in rows:
                if kind == SETTLED:
                    _emit_orders(out, buckets, SETTLED, unpack_ids(docs), from_planes(contexts))
                    if out.full:
                        yield out.take()
            named = [r for r in rows if r[0] == NAMES]
            if not named:
                continue
            doc = np.concatenate([unpack_ids(r[1]) for r in named])
            gram = np.concatenate([from_planes(r[2], 5) for r in named])
            context = np.concatenate([from_planes(r[3]) for r in named])
            del named, rows
            order = np.lexsort((doc, context, gram))
            doc, gram, context = doc[order], gram[order], context[order]
            by_gram = _groups(gram)
            gram_of = np.repeat(np.arange(len(by_gram)), np.diff(np.r_[by_gram, len(gram)]))
            new_context = np.r_[True, (context[1:] != context[:-1]) | (gram_of[1:] != gram_of[:-1])]
            first = np.flatnonzero(new_context)
            least = np.repeat(doc[first], np.diff(np.r_[first, len(doc)]))
            again = doc > least
            _emit_orders(out, buckets, SETTLED, doc[again], context[again])
            shared = np.maximum.reduceat(doc, by_gram) > np.minimum.reduceat(doc, by_gram)
            several = np.add.reduceat(new_context.astype(np.int64), by_gram) > 1
            asked = new_context & (shared & several)[gram_of]
            _emit_orders(out, buckets, ASKED, doc[asked], context[asked])
            if out.full:
                yield out.take()
        yield from out.rest()

    return entries.repartition(shards, "shard").mapInArrow(kernel, ORDERS)


def _orders_by_doc(orders: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, context, start, end) of all orders, sorted by document."""
    docs, contexts, starts, ends = [], [], [], []
    for d, c, s, e in zip(*(orders.column(n).to_pylist() for n in ("docs", "contexts", "starts", "ends"))):
        docs.append(unpack_ids(d))
        contexts.append(from_planes(c))
        starts.append(from_planes(s, 1) if s is not None else np.zeros(len(docs[-1]), np.uint64))
        ends.append(from_planes(e, 1) if e is not None else np.full(len(docs[-1]), WHOLE, np.uint64))
    if not docs:
        none = np.zeros(0, np.uint64)
        return none.view(np.int64), none, none, none
    doc = np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return doc[order], *(np.concatenate(x)[order] for x in (contexts, starts, ends))


def send_bytes(docs: DataFrame, asked: DataFrame, shards: int, common: CommonGrams = NONE) -> DataFrame:
    """Step 3: the bytes of the contexts asked for, by shard of their anchor."""
    schema = arrow_schema(BYTES)

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted_docs, wanted, _, _ = _orders_by_doc(right)
        found: list[tuple] = []
        sent: dict[int, np.ndarray] = {}  # contexts sent already, of ids that several rows have
        ids, texts = left.column("_id").to_pylist(), left.column("_text")
        for i, doc in enumerate(ids):
            low, high = np.searchsorted(wanted_docs, doc, "left"), np.searchsorted(wanted_docs, doc, "right")
            if low == high:
                continue
            data = np.frombuffer((texts[i].as_py() or "").encode(), np.uint8)
            _, gram, context, start, end = anchors(data, common)
            at = np.flatnonzero(np.isin(context, wanted[low:high]))
            if doc in sent:
                at = at[~np.isin(context[at], sent[doc])]
            at = at[np.unique(context[at], return_index=True)[1]]
            sent[doc] = np.r_[sent[doc], context[at]] if doc in sent else context[at]
            for k, s, e in zip(at.tolist(), start[at].tolist(), end[at].tolist()):
                found.append((int(gram[k]), int(context[k]), doc, data[s:e].tobytes()))
        out = Emitter(schema, max_rows=1 << 60, max_bytes=1 << 60)
        if found:
            gram = np.array([f[0] for f in found], np.uint64)
            shard = shard_of(gram, shards)
            order = np.lexsort((gram, shard))
            edges = np.r_[_groups(shard[order]), len(order)]
            for a, b in zip(edges[:-1], edges[1:]):
                part = [found[k] for k in order[a:b]]
                out.add(
                    int(shard[order[a]]),
                    pack_ids(np.array([p[2] for p in part], np.int64)),
                    planes(np.array([p[0] for p in part], np.uint64)),
                    planes(np.array([p[1] for p in part], np.uint64)),
                    bytes(len(p[3]) for p in part),
                    b"".join(p[3] for p in part),
                )
        table = pa.Table.from_batches([out.take()], schema)
        del found, out
        release_memory()
        return table

    return docs.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(kernel, BYTES)


def repeated_stretches(docs: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Step 4 for some contexts laid end to end: (context number, start, end) of what is to go.

    Two stretches of one context that are both to go overlap, so each context has one run at most.
    """
    n = len(docs)
    text = np.ones(len(data) + n + 1, np.uint16)
    bases = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    inside = np.repeat(np.arange(n), lengths)
    text[np.arange(len(data)) + inside] = data.astype(np.uint16) + 2
    text[-1] = 0
    counts = np.maximum(lengths - WINDOW + 1, 0)
    array = suffix_array(text)
    lcp = permuted_lcp(text, array, bases, counts, WINDOW)
    owner = np.full(len(text), -1, np.int32)
    where = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(bases, counts)
    owner[where] = np.repeat(np.arange(n), counts)
    ranked = array[owner[array] >= 0]
    if not len(ranked):
        none = np.zeros(0, np.int64)
        return none, none, none
    first = np.flatnonzero(np.r_[True, lcp[ranked[1:]] < WINDOW])
    doc = docs[owner[ranked]]
    least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.r_[first, len(ranked)]))
    going = np.sort(ranked[doc > least])
    context = owner[going]
    starts = _groups(context)
    ends = np.r_[starts[1:], len(context)] - 1 if len(starts) else starts
    context_of = context[starts]
    return context_of, going[starts] - bases[context_of], going[ends] - bases[context_of] + WINDOW


def sort_shards(sent: DataFrame, shards: int, buckets: int) -> DataFrame:
    """Step 4: orders to remove stretches of contexts."""
    schema = arrow_schema(ORDERS)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(schema)
        for _, rows in _by_shard(batches):
            docs = np.concatenate([unpack_ids(r[0]) for r in rows])
            gram = np.concatenate([from_planes(r[1]) for r in rows])
            context = np.concatenate([from_planes(r[2]) for r in rows])
            lengths = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).astype(np.int64)
            data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
            del rows
            offsets = np.cumsum(lengths) - lengths
            order = np.lexsort((context, docs, gram))
            edges = np.r_[_groups(gram[order]), len(order)]
            total = np.r_[0, np.cumsum(lengths[order] + 1)]
            at = 0
            while at < len(edges) - 1:
                to = int(np.searchsorted(total[edges], total[edges[at]] + ARRAY_SYMBOLS, "right")) - 1
                to = min(max(to, at + 1), len(edges) - 1)
                part = order[edges[at] : edges[to]]
                at = to
                size = lengths[part]
                index = np.repeat(offsets[part] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                which, starts, ends = repeated_stretches(docs[part], size, data[index])
                _emit_orders(out, buckets, SETTLED, docs[part][which], context[part][which], starts, ends)
                if out.full:
                    yield out.take()
        yield from out.rest()

    return sent.repartition(shards, "shard").mapInArrow(kernel, ORDERS)


def removed_spans(data: np.ndarray, contexts: np.ndarray, starts: np.ndarray, ends: np.ndarray, common: CommonGrams = NONE) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a document's bytes that the orders cover."""
    _, _, context, begin, reach = anchors(data, common)
    order = np.argsort(contexts, kind="stable")
    contexts, starts, ends = contexts[order], starts[order].astype(np.int64), ends[order].astype(np.int64)
    low, high = np.searchsorted(contexts, context, "left"), np.searchsorted(contexts, context, "right")
    depth = np.zeros(len(data) + 1, np.int32)
    while True:
        hit = np.flatnonzero(low < high)
        if not len(hit):
            break
        k = low[hit]
        np.add.at(depth, begin[hit] + starts[k], 1)
        np.add.at(depth, np.minimum(begin[hit] + np.where(ends[k] == WHOLE, 1 << 40, ends[k]), reach[hit]), -1)
        low[hit] += 1
    covered = np.r_[False, depth[:-1].cumsum() > 0, False]
    return np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(covered[:-1] & ~covered[1:])


def apply_orders(docs: DataFrame, orders: DataFrame, as_text: bool, common: CommonGrams = NONE) -> DataFrame:
    """Step 5: the rows of ``docs`` (column _row) with n_bytes, n_removed, n_spans and kept (remaining bytes, or their text)."""
    out_type = StructType([docs.schema["_row"]])
    for name in ("n_bytes", "n_removed", "n_spans"):
        out_type = out_type.add(name, LongType())
    out_type = out_type.add("kept", StringType() if as_text else BinaryType())

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        order_docs, contexts, starts, ends = _orders_by_doc(right)
        ids, texts = left.column("_id").to_pylist(), left.column("_text")
        sizes, removed, spans, kept = [], [], [], []
        for i, doc in enumerate(ids):
            raw = (texts[i].as_py() or "").encode()
            low, high = np.searchsorted(order_docs, doc, "left"), np.searchsorted(order_docs, doc, "right")
            first = last = np.zeros(0, np.int64)
            if low < high:
                first, last = removed_spans(np.frombuffer(raw, np.uint8), contexts[low:high], starts[low:high], ends[low:high], common)
            bounds = [0, *np.column_stack([first, last]).ravel().tolist(), len(raw)]
            sizes.append(len(raw))
            removed.append(int((last - first).sum()))
            spans.append(len(first))
            kept.append(b"".join(raw[a:b] for a, b in zip(bounds[::2], bounds[1::2])))
        last_column = pa.array([k.decode(errors="ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        added = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), last_column]
        del kept, ids, texts
        columns = [left.column("_row").combine_chunks(), *added]
        release_memory()
        return pa.table(columns, names=["_row", "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.groupBy("bucket").cogroup(orders.groupBy("bucket")).applyInArrow(kernel, out_type)


def rows_with_removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, as_text: bool = False, common_docs: int = COMMON_DOCS, local_docs: int = LOCAL_DOCS) -> DataFrame:
    """_row (a struct of ``columns``, whatever their names), n_bytes, n_removed, n_spans and kept.

    ``kept`` has the remaining bytes, or with ``as_text`` the text they spell; where a removed run cuts a character of
    several bytes, the rest of that character goes too. Shards and buckets are as many as PART_BYTES of text asks for.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    parts = max(1, int(bound_batches(docs).sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    shards, buckets = 2 * parts, parts | 1
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)])
    keyed = docs.select(row.alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("_id"), F.col(text_col).alias("_text"))
    keyed = keyed.withColumn("bucket", bucket_column("_id", buckets))
    common = common_grams(keyed, common_docs, local_docs)
    orders = materialise(settle(name_anchors(keyed, shards, common), shards, buckets), "orders")
    asked = orders.filter(F.col("kind") == ASKED)
    found = sort_shards(send_bytes(keyed, asked, shards, common), shards, buckets)
    return apply_orders(keyed, orders.filter(F.col("kind") == SETTLED).unionByName(found), as_text, common)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common_docs: int = COMMON_DOCS, local_docs: int = LOCAL_DOCS) -> DataFrame:
    """The id of every row, with n_bytes, n_removed, n_spans and kept (the remaining bytes)."""
    found = rows_with_removals(docs, id_col, text_col, [id_col], common_docs=common_docs, local_docs=local_docs)
    return found.select(F.col("_row").getField(id_col).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents with repeated stretches taken out of their texts, and ``length_col``, if there is one, counted anew.

    Documents left empty by that go. All other columns stay as they are, whatever their names.
    """
    found = rows_with_removals(docs, id_col, text_col, [c for c in docs.columns if c not in (text_col, length_col)], as_text=True)
    left = found.filter((F.col("n_removed") == 0) | (F.length("kept") > 0))
    made = {text_col: F.col("kept"), length_col: F.length("kept").cast(docs.schema[length_col].dataType if length_col in docs.columns else "long")}
    return left.select(*[(made[c] if c in made else F.col("_row").getField(c)).alias(c) for c in docs.columns])
