"""Exact cosine top-k within a scope."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from evspark.functions.vectors import norm

#: Vectors and asking vectors of a part, and scores that a task holds at a time.
ROWS, ASKED, SCORES = 16_384, 4_096, 4_000_000
#: How near the last of the best a score must be to be looked at again: beyond what rounding to 6 places and sums in another order can change.
NEAR = 2e-6


def vector_index(vectors: DataFrame, key: str, embedding: str, scope: str) -> DataFrame:
    """Rows that can be ranked, with their ``norm``: a vector is there and its norm is positive."""
    return vectors.filter(F.col(embedding).isNotNull()).select(key, scope, embedding, norm(F.col(embedding)).alias("norm")).filter("norm > 0")


def dense_topk(index: DataFrame, queries: DataFrame, key: str, qkey: str, embedding: str, scope: str, k: int) -> DataFrame:
    """qkey, key, score and rank; queries carry ``query_vector`` and the scope they ask in, never the whole corpus.

    A scope's vectors and those that ask in it are dealt into parts of bounded size, and each part meets each in a task
    of its own. A task multiplies matrices; what is within NEAR of the best k is scored again term by term, so that the
    result does not depend on the order in which a product adds up.
    """
    rows = index.select(F.col(key).alias("key"), F.col(scope).alias("scope"), F.col(embedding).alias("vector"), "norm", F.size(embedding).alias("size"))
    asked = queries.select(F.col(qkey).alias("qkey"), F.col(scope).alias("scope"), F.col("query_vector").alias("vector"), norm(F.col("query_vector")).alias("norm"), F.size("query_vector").alias("size")).filter("norm > 0")
    of = ["scope", "size"]
    parts = [d.groupBy(of).agg(F.ceil(F.count(F.lit(1)) / most).alias(n)) for d, n, most in ((rows, "n_rows", ROWS), (asked, "n_asked", ASKED))]
    grid = parts[0].join(parts[1], of)
    left = rows.join(grid, of).withColumn("row_part", F.expr("pmod(xxhash64(key), n_rows)")).withColumn("asked_part", F.explode(F.expr("sequence(0L, n_asked - 1)")))
    right = asked.join(grid, of).withColumn("asked_part", F.expr("pmod(xxhash64(qkey), n_asked)")).withColumn("row_part", F.explode(F.expr("sequence(0L, n_rows - 1)")))
    block = [*of, "row_part", "asked_part"]
    sides = (d.select(c, "vector", "norm", *block).groupBy(block) for d, c in ((left, "key"), (right, "qkey")))
    found = StructType([*asked.select("qkey").schema, *rows.select("key", "scope").schema, StructField("score", DoubleType())])
    scored = next(sides).cogroup(next(sides)).applyInArrow(_best_of_block(k), found)
    scored = scored.select(F.col("qkey").alias(qkey), F.col("key").alias(key), F.col("scope").alias(scope), F.round("score", 6).alias("score"))
    order = Window.partitionBy(qkey).orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(qkey, key, scope, "score", "rank")


def _best_of_block(k: int):
    """A function of a block's vectors and asking vectors: qkey, key, scope and score of all pairs that may be among the best k."""

    def matrix(table: pa.Table) -> np.ndarray:
        vectors = table["vector"].combine_chunks()
        return vectors.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(vectors), -1)

    def best(rows: pa.Table, asked: pa.Table) -> pa.Table:
        n, found = rows.num_rows, []
        if n and asked.num_rows:
            a, b, a_norm, b_norm = matrix(rows), matrix(asked), rows["norm"].to_numpy(), asked["norm"].to_numpy()
            place = np.empty(n, "i8")
            place[pc.sort_indices(rows["key"], null_placement="at_start").to_numpy()] = np.arange(n)
            step = max(1, SCORES // n)
            with np.errstate(all="ignore"):
                for at in range(0, asked.num_rows, step):
                    scores = b[at : at + step] @ a.T / (b_norm[at : at + step, None] * a_norm)
                    odd = ~np.isfinite(scores)
                    scores[odd] = -np.inf
                    least = np.partition(scores, n - k, axis=1)[:, n - k, None] - NEAR if n > k else -np.inf
                    q, r = np.nonzero((scores >= least) | odd)
                    q += at
                    score = np.zeros(len(q))
                    for i in range(a.shape[1]):
                        score += a[r, i] * b[q, i]
                    lengths = a_norm[r] * b_norm[q]
                    score /= lengths
                    # Of pairs with the very same score, as copies give, the first k by key are enough.
                    order = np.lexsort((place[r], score, q))
                    q, r, score, lengths = q[order], r[order], score[order], lengths[order]
                    same = (q[1:] == q[:-1]) & ((score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1])))
                    begins = np.maximum.accumulate(np.where(np.r_[True, ~same][: len(q)], np.arange(len(q)), 0))
                    kept = (np.arange(len(q)) - begins < k) & (lengths != 0)
                    found.append((q[kept], r[kept], score[kept]))
        q, r, score = (np.concatenate(c) for c in zip(*found)) if found else (np.array([], "i8"), np.array([], "i8"), np.array([]))
        return pa.table({"qkey": asked["qkey"].take(pa.array(q)), "key": rows["key"].take(pa.array(r)), "scope": rows["scope"].take(pa.array(r)), "score": pa.array(score, pa.float64())})

    return best


def coverage(vectors: DataFrame, embedding: str, scope: str) -> DataFrame:
    return vectors.groupBy(scope).agg(F.count(F.lit(1)).alias("n"), F.count(embedding).alias("with_vector"))
