"""Second-phase ranking: a service scores the head of each question's ranking anew; the tail stays as it was.

Only the first HEAD x top_n items of a question are sent, as one call with all of them, so what a task holds at a time is
bounded by that. A call that fails, or gives other than one finite score for each item, leaves its question's order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How many times top_n items are scored, and characters of an item that are sent.
HEAD, SENT_CHARS = 3, 4000


class Reranker(Protocol):
    """Built once per partition by a factory."""

    def rerank(self, question: str, documents: list[str]) -> list[float]: ...


class OverlapReranker:
    """Offline stub: the share of the question's words that a document has."""

    def rerank(self, question: str, documents: list[str]) -> list[float]:
        words = set(question.lower().split())
        return [len(words & set(d.lower().split())) / max(1, len(words)) for d in documents]


def score_heads(heads: DataFrame, factory: Callable[[], Reranker], qid: str) -> DataFrame:
    """qid, scores and error for rows of qid, question and texts: one call a question."""
    kind = dict(heads.dtypes)[qid]

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = factory()
        for frame in frames:
            out = []
            for key, question, texts in frame[[qid, "question", "texts"]].itertuples(index=False):
                try:
                    scores = [float(s) for s in service.rerank(question or "", list(texts))]
                    if len(scores) != len(texts) or not all(map(math.isfinite, scores)):
                        raise ValueError("not one finite score for each document")
                    out.append((key, scores, None))
                except Exception as error:  # an outage leaves the first ranking
                    out.append((key, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=[qid, "scores", "error"])

    return heads.select(qid, "question", "texts").mapInPandas(kernel, f"{qid} {kind}, scores array<double>, error string")


def rerank_head(ranked: DataFrame, factory: Callable[[], Reranker], top_n: int, qid: str = "qid", item: str = "page_id", question: str = "question", text: str = "text", header: str | None = None, keep_floor: float | None = None) -> DataFrame:
    """qid, item, rank, score and error: ``ranked`` (qid, item, rank, question, text) with its head in the order of new scores.

    Equal scores keep their order. Items scored below ``keep_floor`` go, if one is set; ranks close up then. The tail
    keeps its order behind the head, without scores.
    """
    most = max(HEAD * top_n, top_n)
    shown = F.col(text) if header is None else F.concat_ws("\n", header, text)
    rows = ranked.select(F.col(qid).alias(qid), F.col(item).alias("item"), F.col("rank").cast("int").alias("rank"), F.col(question).alias("question"), F.substring(F.coalesce(shown, F.lit("")), 1, SENT_CHARS).alias("text"))
    head = rows.filter(F.col("rank") <= most).groupBy(qid).agg(F.first("question").alias("question"), F.sort_array(F.collect_list(F.struct("rank", "item", "text"))).alias("items"))
    head = head.withColumn("texts", F.col("items.text"))
    scored = score_heads(head, factory, qid)
    joined = head.select(qid, F.transform("items", lambda i: F.struct(i["rank"].alias("rank"), i["item"].alias("item"))).alias("items")).join(scored, qid)
    paired = F.transform("items", lambda i, at: F.struct((-F.get("scores", at)).alias("minus"), i["rank"].alias("rank"), i["item"].alias("item")))
    kept = paired if keep_floor is None else F.filter(paired, lambda p: p["minus"].isNull() | (-p["minus"] >= keep_floor))
    ordered = joined.select(qid, "error", F.sort_array(kept).alias("items"), F.size("items").alias("sent"))
    top = ordered.select(qid, "error", F.posexplode_outer("items").alias("at", "i")).filter("i is not null")
    top = top.select(qid, F.col("i.item").alias(item), (F.col("at") + 1).alias("rank"), (-F.col("i.minus")).alias("score"), "error")
    gone = ordered.select(qid, (F.col("sent") - F.size("items")).alias("gone"))
    tail = ranked.filter(F.col("rank") > most).join(gone, qid, "left")
    tail = tail.select(qid, F.col(item), (F.col("rank").cast("int") - F.coalesce("gone", F.lit(0))).alias("rank"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("error"))
    return top.unionByName(tail)
