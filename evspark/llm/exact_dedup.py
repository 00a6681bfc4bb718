"""Exact deduplication by two passes over a Bloom filter, with DataFrame functions only.

The filter is blocked: a digest's signature names one 64-bit word and two bits in it. Pass one counts signatures, one
long per row and combined before the shuffle, and sets the bits of those that occur more than once. Pass two tests each
row: one whose bits are not all set has a text of its own and passes straight through, whatever the size of the table;
only the others are shuffled and grouped by digest. False positives cost a little shuffle and never change a result.

A task holds one segment of the filter. Where the filter has several, digests are written by segment, without a
shuffle, and each segment's rows meet only its own words.

Edge cases: a null text counts as empty; rows repeating an id and a text share one decision; null ids lose to any
other id, and a group of null ids alone has a null ``keep_id``; an empty table gives an empty result; other columns are
never read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append, ascii_lower, materialise, new_path, reader, sha256_hex, without_rows

#: Bits of the filter that a task holds at most (8 MB).
SEGMENT_BITS = 1 << 26
BITS_PER_ROW = 16
#: Segments that one job takes.
SEGMENTS_AT_ONCE = 64
_PATTERNS = 64 * 64


def normalised(text: str = "text") -> Column:
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


def filter_words(rows: int, segment_bits: int = SEGMENT_BITS) -> tuple[int, int]:
    """Words of a filter for so many rows, and into how many segments they fall."""
    words = 1 << max(4, (rows * BITS_PER_ROW // 64).bit_length())
    return words, max(1, words * 64 // max(64, segment_bits))


def signature(value: Column, words: int) -> Column:
    """Word and two bits (six binary digits each) in one long."""
    return F.pmod(F.xxhash64(value), F.lit(words * _PATTERNS))


def mask_of(signature_: str) -> Column:
    return F.expr(f"shiftleft(1L, cast({signature_} & 63 as int)) | shiftleft(1L, cast(shiftright({signature_}, 6) & 63 as int))")


def set_words(signatures: DataFrame) -> DataFrame:
    """word and mask of a filter that holds all ``signatures`` (column sig)."""
    return signatures.groupBy(F.expr(f"sig div {_PATTERNS}").alias("word")).agg(F.bit_or(mask_of("sig")).alias("mask"))


def repeated_words(signatures: DataFrame) -> DataFrame:
    """Pass one: a filter of the signatures that more than one row has."""
    return set_words(signatures.groupBy("sig").agg(F.count(F.lit(1)).alias("hits")).filter("hits > 1"))


def segment_of(sig: str, words: int, segments: int) -> Column:
    return F.expr(f"cast({sig} div {_PATTERNS * (words // segments)} as int)")


def segment_arrays(words_set: DataFrame, words: int, segments: int) -> DataFrame:
    """segment and bits: the words of each segment as a dense array, all segments in one job; written."""
    each = words // segments
    dense = words_set.sparkSession.range(words).withColumnRenamed("id", "word")
    pairs = dense.join(words_set, "word", "left").select(F.expr(f"cast(word div {each} as int)").alias("segment"), "word", F.coalesce("mask", F.lit(0)).alias("mask"))
    sorted_ = pairs.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias("pairs"))
    return materialise(sorted_.select("segment", F.col("pairs.mask").alias("bits")), "bloom")


def with_maybe(rows: DataFrame, words_set: DataFrame, words: int, segments: int, sig: str = "sig", segment: str = "segment") -> DataFrame:
    """Adds boolean ``maybe``: whether the filter may hold column ``sig``.

    With several segments, ``rows`` is a table stored by ``segment``: each segment's rows are read and tested in place, many
    segments in one job. Nothing is shuffled.
    """
    arrays, each = segment_arrays(words_set, words, segments), words // segments

    def tested(part: DataFrame, k: int) -> DataFrame:
        bits = arrays.filter(F.col("segment") == k).select("bits").scalar()
        mask = mask_of(sig)
        return part.withColumn("maybe", F.get(bits, F.expr(f"cast({sig} div {_PATTERNS} - {k * each} as int)")).bitwiseAND(mask) == mask)

    if segments == 1:
        return tested(rows, 0)
    groups = [range(at, min(at + SEGMENTS_AT_ONCE, segments)) for at in range(0, segments, SEGMENTS_AT_ONCE)]
    found = [reduce(DataFrame.unionByName, [tested(rows.filter(F.col(segment) == k).drop(segment), k) for k in group]) for group in groups]
    if len(found) == 1:
        return found[0]
    path = new_path(rows.sparkSession, "flagged")
    for part in found:
        append(part, path)
    return reader(found[0], path)


def flag_possible_repeats(digests: DataFrame, words: int, segments: int) -> DataFrame:
    """Pass two: adds boolean ``maybe``, false only for rows whose digest certainly occurs once.

    ``digests`` has a column sig, and with several segments a column segment by which it is stored.
    """
    return with_maybe(digests, materialise(repeated_words(digests.select("sig")), "bloom-words"), words, segments)


def split_by_members(rows: DataFrame, value: Column, members: DataFrame, column: str, count: int, segment_bits: int = SEGMENT_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``value`` may be in ``members[column]`` (``count`` rows), and those whose value certainly is not.

    Rows are not shuffled at any size: where the filter has several segments, they are written by segment, each task its
    own, and tested there. There are at most SEGMENTS_AT_ONCE, so beyond these segments grow.
    """
    words, segments = filter_words(count, segment_bits)
    segments = min(segments, SEGMENTS_AT_ONCE)
    found = materialise(set_words(members.select(signature(F.col(column), words).alias("sig"))), "bloom-words")
    # The value may be dear (a digest of a text) and is used several times, so a generator that gives one row makes it.
    probed = rows.select("*", F.explode_outer(F.array(signature(value, words))).alias("_sig"))
    if segments > 1:
        probed = materialise(probed.withColumn("_segment", segment_of("_sig", words, segments)), "by-segment", by=("_segment",))
    tested = with_maybe(probed, found, words, segments, "_sig", "_segment").drop("_sig")
    return tested.filter("maybe").drop("maybe"), tested.filter("not maybe").drop("maybe")


def _decisions(docs: DataFrame, id_col: str, text_col: str, segment_bits: int) -> DataFrame:
    words, segments = filter_words(docs.count(), segment_bits)
    digests = docs.select(F.col(id_col).alias("doc_id"), sha256_hex(normalised(text_col)).alias("text_sha256"))
    digests = digests.withColumn("sig", signature(F.col("text_sha256"), words))
    if segments > 1:
        digests = digests.withColumn("segment", segment_of("sig", words, segments))
    digests = materialise(digests, "digests", by=("segment",) if segments > 1 else ())
    flagged = flag_possible_repeats(digests, words, segments).drop("sig")
    alone = flagged.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    several = flagged.filter("maybe").drop("maybe")
    groups = several.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialise(groups, "groups")  # so that the join reads two plain shuffles, of which a hot group's can be split
    return alone.unionByName(several.join(groups, "text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id (the largest id of its group), group_size, kept, text_sha256."""
    found = _decisions(docs, id_col, text_col, segment_bits)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """The documents that stay, one of each group of equal texts, all columns as they came.

    Decided by id and digest: an id may have several texts. Rows that share both, or have null ids only, keep one.
    """
    found = exact_dedup(docs, id_col, text_col, segment_bits).filter("group_size > 1")
    rows = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_key")).agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    going = materialise(rows.filter("not kept or n > 1").drop("n"), "dropped")
    return without_rows(docs, id_col, sha256_hex(normalised(text_col)), going, segment_bits=segment_bits)
