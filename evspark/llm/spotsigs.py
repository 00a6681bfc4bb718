"""Document fingerprints by SpotSigs.

Words of a text are split into common words, the anchors, and content words. Behind every anchor, the chain of the
next content words forms a signature; the fingerprint is the set of signatures. A text with too few words behind its
anchors has one signature made of all its words. Two fingerprints are compared by the Jaccard similarity of their sets;
as it can't exceed the ratio of the set sizes, pairs whose sizes differ too much are pruned, and a similarity join
only looks at neighbouring partitions of set size.

Edge cases: null and empty texts have the signature of no words; rows that repeat an id are ordered by text; with one
document, the next document is itself; null ids sort first; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Emitter, arrow_schema, bound_batches, materialise

CHAIN = 2
#: Common words of English, French, German and Spanish that serve as anchors.
ANCHORS = frozenset(
    """
    a an and are as at be by for in is it of on or that the this to was with
    au aux ce dans de des du elle en est et il la le les ne pas pour que qui se sur un une
    auf das dem den der die ein eine es für im ist mit nicht sich sie und von zu
    al como con el esta los no para por su una y
    """.split()
)
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of each word seen, with the lowest bit set for anchors only; emptied when it outgrows its bound."""

    def __init__(self, bound: int = 300_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: str) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode()) & ~1 | (word in ANCHORS)
        return value


_HASHES = WordHashes()


def signatures(text: str | None, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct 32-bit signatures of a whole text."""
    words = _WORD.findall((text or "").lower())
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    is_anchor = (hashes & np.uint64(1)).astype(bool)
    content = hashes[~is_anchor]
    follows = (~is_anchor).cumsum()[is_anchor]  # index of the first content word behind each anchor
    usable = follows + chain <= len(content)
    follows = follows[usable]
    if not len(follows):
        whole = xxhash.xxh32_intdigest(" ".join(words).encode())
        return np.array([whole], np.uint32)
    mixed = hashes[is_anchor][usable].copy()
    for k in range(chain):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX + content[follows + k]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def as_string(found: np.ndarray) -> str:
    """The fingerprint as text: eight hex digits per signature, in ascending order."""
    return found.astype(">u4").tobytes().hex()


def from_string(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u4").astype(np.uint32)


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 without comparing when sizes rule out ``least``."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(large) or len(small) < least * len(large):
        return 0.0
    common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    value = common / (len(small) + len(large) - common)
    return value if value >= least else 0.0


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many (or all) of the following text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_following(docs: DataFrame, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Rows in id order within buckets of id ranges; each bucket ends with a copy of the next bucket's first row (marked
    ``ghost``), the last one with a copy of the first row of all. Only ``buckets`` ids come to the driver."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select("doc_id").filter("doc_id is not null")
    shares = [i / buckets for i in range(1, buckets)]
    bounds = sorted({int(b) for b in ids.approxQuantile("doc_id", shares, 0.2 / buckets)}) if shares else []
    bucket = F.lit(0)
    if bounds:
        # Halving, so that a row takes as many comparisons as the number of bounds has binary digits.
        steps = len(bounds).bit_length()
        between = f"""aggregate(sequence(1, {steps}), named_struct('low', 0, 'high', {len(bounds)}), (s, k) -> if(s.low >= s.high, s,
            if(get(bounds, (s.low + s.high) div 2) <= doc_id, named_struct('low', cast((s.low + s.high) div 2 + 1 as int), 'high', s.high), named_struct('low', s.low, 'high', cast((s.low + s.high) div 2 as int)))), s -> s.low)"""
        bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(F.expr(between.replace("bounds", f"array({','.join(f'{b}L' for b in bounds)})").replace("(s.low + s.high) div 2", "cast((s.low + s.high) div 2 as int)")))
    placed = rows.withColumn("bucket", bucket.cast("int"))
    firsts = [r for r in placed.groupBy("bucket").agg(F.min(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))).alias("first")).collect()]
    firsts.sort(key=lambda r: r["bucket"])
    heads = [(firsts[i]["first"], firsts[i - 1]["bucket"]) for i in range(len(firsts))]
    if not heads:
        return placed.withColumn("ghost", F.lit(False))
    listed = spark.createDataFrame(heads, "head long, bucket int")
    ghosts = rows.join(F.broadcast(listed), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))) == F.col("head")).select("doc_id", "text", "bucket", F.lit(True).alias("ghost"))
    return placed.withColumn("ghost", F.lit(False)).unionByName(ghosts)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses (see RESULT)."""
    parts = max(1, int(bound_batches(docs).sparkSession.conf.get("spark.sql.shuffle.partitions")))
    buckets = 4 * parts
    schema = arrow_schema(RESULT)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(schema)
        held = None  # (bucket, id, text, signatures) still waiting for the text that follows it

        def close(following: str, following_signatures: np.ndarray) -> None:
            _, doc, text, found = held
            changed = edited(text, following)
            other = signatures(changed, chain)
            shown, shown_other = as_string(found), as_string(other)
            digest = hashlib.sha256(changed.encode()).hexdigest()
            out.add(doc, len(text), digest, shown, shown_other, jaccard(found, other), jaccard(found, following_signatures), weight=len(shown) + len(shown_other))

        for batch in batches:
            for i in range(batch.num_rows):
                bucket, ghost, doc, text = (batch.column(k)[i].as_py() for k in range(4))
                found = None
                if held is not None and held[0] == bucket:
                    found = signatures(text, chain)
                    close(text, found)
                held = None
                if not ghost:
                    held = (bucket, doc, text, signatures(text, chain) if found is None else found)
                if out.full:
                    yield out.take()
        yield from out.rest()

    ordered = with_following(docs, buckets, id_col, text_col).repartition(parts, "bucket").sortWithinPartitions("bucket", "ghost", "doc_id", "text")
    return ordered.select("bucket", "ghost", "doc_id", "text").mapInArrow(kernel, RESULT)


def similar_pairs(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """All pairs of different fingerprints (columns doc_id, fingerprint) with Jaccard similarity of ``least`` and more.

    Sets are partitioned by the logarithm of their size, so partners stand in the same or the next partition; within
    one, only sets that share a signature of their prefixes (in hash order) meet, which loses none.
    """
    base = 1 / least
    ddl = "rep long, fingerprint string, size int, part int, signature long"
    schema = arrow_schema(ddl)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(schema)
        for batch in batches:
            for rep, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = from_string(text)
                part = int(np.log(max(len(found), 1)) / np.log(base))
                ordered = np.sort(found * np.uint32(0x9E3779B1))
                for signature in ordered[: len(found) - int(np.ceil(least * len(found))) + 1].tolist():
                    out.add(rep, None, len(found), part, signature)
                if out.full:
                    yield out.take()
        yield from out.rest()

    distinct = materialise(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "spots")
    keys = distinct.select("rep", "fingerprint").mapInArrow(prefixes, ddl).drop("fingerprint")
    left = keys.select(F.col("rep").alias("a"), F.col("size").alias("na"), F.explode(F.array("part", F.col("part") + 1)).alias("part"), "signature")
    right = keys.select(F.col("rep").alias("b"), F.col("size").alias("nb"), "part", "signature")
    sized = (F.least("na", "nb") >= least * F.greatest("na", "nb")) & (F.col("a") != F.col("b"))
    pairs = left.join(right, ["part", "signature"]).filter(sized).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    texts_a = distinct.select(F.col("rep").alias("a"), F.col("fingerprint").alias("fa"))
    texts_b = distinct.select(F.col("rep").alias("b"), F.col("fingerprint").alias("fb"))
    likeness = F.pandas_udf(lambda x, y: x.combine(y, lambda p, q: jaccard(from_string(p), from_string(q), least)).astype("float64"), "double")
    return pairs.join(texts_a, "a").join(texts_b, "b").select("a", "b", likeness("fa", "fb").alias("likeness")).filter("likeness > 0")
