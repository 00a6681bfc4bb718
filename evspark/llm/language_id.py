"""Language identification by a byte convolutional network, trained in numpy.

A text is lower-cased and cut into fixed windows of UTF-8 bytes that overlap by the widest filter less one. Each byte
is embedded; filters of several widths slide over a window, the maximum of each over the window is kept, and a softmax
layer gives the language. A document's prediction averages the log probabilities of all its windows, each weighted by
its share of the bytes, so every byte of every text counts.

Training takes a bounded sample of labelled rows (``sample_docs`` in expectation, at most ``windows_per_doc`` windows of each).

Edge cases: ``und`` with score 0 for a null text and for one without a letter; with no labelled row at all everything
is ``und``; null languages are not learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import regex
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import Emitter, arrow_schema, bound_batches, crc_mod, release_memory, text_rows

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
UNKNOWN = "und"
SAMPLE_DOCS = 3000
#: Score under which a document counts as in none of the languages learned.
LEAST_SCORE = 0.4
WINDOWS_PER_DOC = 4
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 5, 0

_LETTER = regex.compile(r"\p{L}")
SPAN = max(WIDTHS)


def windows_of(text: str) -> np.ndarray:
    """All windows of a text as rows of bytes; the last is padded with zeros."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    step = WINDOW - SPAN + 1
    count = max(1, -(-max(len(data) - SPAN + 1, 1) // step))
    padded = np.zeros(count * step + SPAN - 1, np.uint8)
    padded[: len(data)] = data[: len(padded)]
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step].copy()


@dataclass
class ByteNetwork:
    """Parameters and passes of the network."""

    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # SPAN * EMBEDDING x all filters; narrow filters are zero beyond their width
    filter_bias: np.ndarray
    output: np.ndarray
    output_bias: np.ndarray

    @staticmethod
    def mask() -> np.ndarray:
        columns = []
        for width in WIDTHS:
            column = np.zeros((SPAN * EMBEDDING, FILTERS), np.float32)
            column[: width * EMBEDDING] = 1
            columns.append(column)
        return np.hstack(columns)

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        total = FILTERS * len(WIDTHS)
        return cls(
            languages,
            rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
            (rng.normal(0, 0.3, (SPAN * EMBEDDING, total)) * cls.mask()).astype(np.float32),
            np.zeros(total, np.float32),
            rng.normal(0, 0.1, (total, len(languages))).astype(np.float32),
            np.zeros(len(languages), np.float32),
        )

    def pooled(self, windows: np.ndarray, where: bool = False):
        """Maximum of each filter over each window, and its position if ``where``."""
        embedded = self.embedding[windows]
        patches = np.lib.stride_tricks.sliding_window_view(embedded, SPAN, axis=1).transpose(0, 1, 3, 2)
        n, positions = patches.shape[:2]
        responses = (np.ascontiguousarray(patches).reshape(n * positions, -1) @ self.filters).reshape(n, positions, -1)
        if where:
            at = responses.argmax(1)
            best = np.take_along_axis(responses, at[:, None], 1)[:, 0]
        else:
            at, best = None, responses.max(1)
        return np.maximum(best + self.filter_bias, 0), at

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        logits = self.pooled(windows)[0] @ self.output + self.output_bias
        logits -= logits.max(1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 700, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteNetwork:
    """Adam on the cross-entropy; only the pooled maxima carry gradients back."""
    net = ByteNetwork.fresh(languages, seed)
    mask = net.mask()
    rng = np.random.default_rng(seed)
    names = ("embedding", "filters", "filter_bias", "output", "output_bias")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    weight = np.bincount(labels, minlength=len(languages)).astype(np.float64)
    chance = (1 / weight[labels]) / (1 / weight[labels]).sum()  # languages are drawn equally often
    draws = rng.choice(len(labels), size=(steps, batch), p=chance)
    for step, rows in enumerate(draws, 1):
        x, y = windows[rows], labels[rows]
        hidden, at = net.pooled(x, where=True)
        logits = hidden @ net.output + net.output_bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ net.output.T) * (hidden > 0)
        at_bytes = x[np.arange(len(y))[:, None, None], at[:, :, None] + np.arange(SPAN)]  # rows x filters x SPAN
        patches = net.embedding[at_bytes].reshape(len(y), at.shape[1], -1)
        d_patches = (back[:, :, None] * net.filters.T[None]).reshape(-1, EMBEDDING)
        gradients = {
            "output": hidden.T @ p,
            "output_bias": p.sum(0),
            "filter_bias": back.sum(0),
            "filters": np.einsum("bf,bfk->kf", back, patches) * mask,
            "embedding": np.stack([np.bincount(at_bytes.ravel(), d_patches[:, k], 256) for k in range(EMBEDDING)], 1),
        }
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for n in names:
            g = gradients[n].astype(np.float32)
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.999 * second[n] + 0.001 * g * g
            setattr(net, n, getattr(net, n) - np.float32(pace) * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8))
    return net


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int, windows_per_doc: int, learn: Column) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A hash sample of the labelled rows and some windows of each, chosen evenly over the text."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    total = max(1, docs.count())
    share = min(1.0, sample_docs / total)
    picked = rows.filter(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    ddl = "lang string, bytes binary"
    schema = arrow_schema(ddl)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = Emitter(schema)
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                if not _LETTER.search(text):
                    continue
                found = windows_of(text)
                for k in np.unique(np.linspace(0, len(found) - 1, windows_per_doc).astype(int)):
                    out.add(batch.column(2)[i].as_py(), found[k].tobytes())
            yield from out.rest()

    sample = bound_batches(picked).mapInArrow(cut, ddl).limit(2 * sample_docs * windows_per_doc).collect()
    sample.sort(key=lambda r: (r["lang"], r["bytes"]))
    languages = sorted({r["lang"] for r in sample})
    index = {name: i for i, name in enumerate(languages)}
    windows = np.frombuffer(b"".join(bytes(r["bytes"]) for r in sample), np.uint8).reshape(-1, WINDOW)
    return windows, np.array([index[r["lang"]] for r in sample], np.int64), languages


def predictions(net: ByteNetwork | None, texts: list[str | None], batch_windows: int = 256) -> Iterator[tuple[str, float]]:
    """(language, score) of each text; windows of many texts share a pass."""
    owners: list[np.ndarray] = []
    parts: list[np.ndarray] = []
    weights: list[np.ndarray] = []
    totals = np.zeros((len(texts), len(net.languages) if net else 0))

    def flush() -> None:
        if not parts:
            return
        windows, owner, weight = np.concatenate(parts), np.concatenate(owners), np.concatenate(weights)
        for at in range(0, len(windows), batch_windows):
            rows = slice(at, at + batch_windows)
            np.add.at(totals, owner[rows], net.log_probabilities(windows[rows]) * weight[rows, None])
        owners.clear(), parts.clear(), weights.clear()

    known, held = [], 0
    for i, text in enumerate(texts):
        known.append(net is not None and text is not None and _LETTER.search(text) is not None)
        if known[-1]:
            found = windows_of(text)
            used = (found != 0).sum(1) + 1e-3
            owners.append(np.full(len(found), i))
            parts.append(found)
            weights.append(used / used.sum())
            held += len(found)
            if held >= 4 * batch_windows:
                flush()
                held = 0
    flush()
    for i, ok in enumerate(known):
        if not ok:
            yield UNKNOWN, 0.0
            continue
        p = np.exp(totals[i] - totals[i].max())
        p /= p.sum()
        best = int(p.argmax())
        yield net.languages[best], float(p[best])


def fit_language_model(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, windows_per_doc: int = WINDOWS_PER_DOC) -> ByteNetwork | None:
    windows, labels, languages = training_windows(docs, id_col, text_col, lang_col, sample_docs, windows_per_doc, learn)
    return train(windows, labels, languages) if len(labels) else None


def predicted_rows(docs: DataFrame, net: ByteNetwork | None, text_col: str = "text") -> DataFrame:
    """_row (a struct of all columns, whatever their names), lang_pred and score."""
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))
    out_type = StructType([source.schema["_row"]]).add("lang_pred", StringType()).add("score", DoubleType())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                found = list(predictions(net, [t for _, t in text_rows(batch, 1, 1)]))
                added = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *added], names=["_row", "lang_pred", "score"])
        release_memory()

    return bound_batches(source).mapInArrow(kernel, out_type)


def identify(docs: DataFrame, net: ByteNetwork | None, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score to every row, in place of columns of these names; all others stay as they are."""
    found = predicted_rows(docs, net, text_col)
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ("lang_pred", "score")]
    return found.select(*kept, "lang_pred", "score")


def keep_known(docs: DataFrame, net: ByteNetwork | None, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose best language scores ``least`` or more, all columns as they came; without a model none is rejected.

    Texts without any letter (null and empty ones among them) are in no language. What the network divides between
    languages, as it does text in one that it has not learned, is in none either; clean text of a few words scores higher.
    """
    if net is None:
        return docs
    return predicted_rows(docs, net, text_col).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("_row.*")


def learnable(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, HELD_OUT_MODULUS) != HELD_OUT_REMAINDER
