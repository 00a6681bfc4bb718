"""The seam to model services: a provider is called once per distinct input, in batches, with retries; an offline stub has the same shape."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESPONSE = "input string, output string, error string, input_tokens bigint, output_tokens bigint, attempts int"


class Throttled(RuntimeError):
    """The service asks to come back later; the only error worth a retry."""


class Provider(Protocol):
    """Built once per partition by a factory, so clients never travel."""

    def complete(self, text: str) -> str: ...


class EchoProvider:
    """Offline stub: extracts nothing and answers with the first sentence."""

    def complete(self, text: str) -> str:
        return text.split(".")[0].strip()


def with_retry(call: Callable[[], str], attempts: int = 5, base: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> tuple[str, int]:
    """The result and the attempts it took; waits grow exponentially, with jitter."""
    for n in range(1, attempts + 1):
        try:
            return call(), n
        except Throttled:
            if n == attempts:
                raise
            sleep(base * 2 ** (n - 1) * (1 + random.random()))
    raise AssertionError


def call_provider(rows: DataFrame, text: str, factory: Callable[[], Provider], attempts: int = 5) -> DataFrame:
    """Rows with output and error. Equal inputs are asked once; a failing input has an error, it does not end the job."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for frame in frames:
            out = []
            for value in frame["input"]:
                try:
                    answer, n = with_retry(lambda v=value: provider.complete(v), attempts)
                    out.append((value, answer, None, len(value) // 4, len(answer) // 4, n))
                except Exception as error:  # any failure of a service is a result here
                    out.append((value, None, f"{type(error).__name__}: {error}", len(value) // 4, 0, attempts if isinstance(error, Throttled) else 1))
            yield pd.DataFrame(out, columns=["input", "output", "error", "input_tokens", "output_tokens", "attempts"])

    # Inputs are long, so replies come back by their digests.
    asked = rows.select(F.col(text).alias("input")).filter("input is not null").groupBy(F.sha2("input", 256).alias("_digest")).agg(F.first("input").alias("input"))
    replies = asked.select("input").mapInPandas(kernel, RESPONSE).withColumn("_digest", F.sha2("input", 256)).drop("input")
    return rows.withColumn("_digest", F.sha2(text, 256)).join(replies, "_digest", "left").drop("_digest")


def both_accept(a: str, b: str):
    """Two verdicts must both be ``accept``; anything else, an error included, fails closed."""
    return F.coalesce((F.col(a) == "accept") & (F.col(b) == "accept"), F.lit(False))
