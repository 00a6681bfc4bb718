"""Byte-level BPE as a lazily determinised transducer, and its inverse with an incremental UTF-8 machine.

The encoding of a prefix ends in exactly one token, and two tokens may stand side by side exactly when encoding their
joined bytes gives those two. So it is enough to know, for the positions where a longer token may still begin, the
last token there. A state of the transducer is the last token already emitted and the bytes read since; reading a byte
adds a position, drops the positions no token can start from any more, and emits the tokens that all remaining ones
share. Lookahead is therefore bounded by the longest token. States and transitions are built on first use and dropped
together when there are too many.

Edge cases: a null text counts as empty and encodes to no ids; an empty table gives an empty result; ids outside the
vocabulary are an error when decoding.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bound_batches, text_rows
from .tokens import PieceEncoder, load_ranks


_BYTES = [bytes((b,)) for b in range(256)]


class _State:
    """``anchor`` is the last token emitted; each tail is (bytes read since a position where a token may still begin,
    tokens from the anchor to that position). The last tail ends where reading stands."""

    __slots__ = ("anchor", "tails", "next")

    def __init__(self, anchor: int | None, tails: tuple[tuple[bytes, tuple[int, ...]], ...]):
        self.anchor, self.tails = anchor, tails
        self.next: dict[int, tuple[_State, tuple[int, ...]]] = {}


class BpeTransducer:
    """Encodes bytes left to right with the ranks' merges."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 300_000):
        self.ranks, self.max_states = ranks, max_states
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.openings = {token[:n] for token in ranks for n in range(1, len(token))}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.start = self._state(None, ((b"", ()),))

    def _state(self, anchor: int | None, tails: tuple) -> _State:
        if tails[0][1]:
            anchor = None  # the earliest tail has left it, so no token can follow it directly any more
        state = self.states.get((anchor, tails))
        if state is None:
            state = self.states[anchor, tails] = _State(anchor, tails)
        return state

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        known = self.split.get(token, False)
        if known is False:
            data = self.tokens[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            known = self.split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return known

    def fits(self, left: int | None, right: int) -> bool:
        """Whether the two tokens stand side by side in an encoding.

        Their merges are undone from the boundary outwards, the latest first. The pair fails if at some moment
        what touched at the boundary would have been merged before the merge just undone.
        """
        if left is None:
            return True
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 500_000:
                self.compatible.clear()
            known = self.compatible[key] = self._touch(left, right)
        return known

    def _touch(self, left: int, right: int) -> bool:
        tokens, ranks = self.tokens, self.ranks
        undone, from_right = 1 << 60, False
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and (joined < undone or joined == undone and from_right):
                return False
            inner_left, inner_right = self.halves(left), self.halves(right)
            if inner_left is None and inner_right is None:
                return True
            if inner_right is None or inner_left is not None and left > right:
                undone, from_right, left = left, False, inner_left[1]
            else:
                undone, from_right, right = right, True, inner_right[0]

    def _advance(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        read = _BYTES[byte]
        rank, openings = self.ranks.get, self.openings
        tails: list[tuple[bytes, tuple[int, ...]]] = []
        ending: tuple[int, ...] | None = None
        for suffix, chain in state.tails:
            suffix += read
            if ending is None:
                token = rank(suffix)
                if token is not None and self.fits(chain[-1] if chain else state.anchor, token):
                    ending = (*chain, token)
            if suffix in openings:
                tails.append((suffix, chain))
        tails.append((b"", ending))
        anchor, emitted = state.anchor, ()
        first = tails[0][1]
        if first:
            shared = len(first)
            for _, chain in tails[1:]:
                while first[:shared] != chain[:shared]:
                    shared -= 1
            if shared:
                emitted, anchor = first[:shared], first[shared - 1]
                tails = [(suffix, chain[shared:]) for suffix, chain in tails]
        result = state.next[byte] = (self._state(anchor, tuple(tails)), emitted)
        return result

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self._reset()
        out: list[int] = []
        state = self.start
        for byte in data:
            step = state.next.get(byte)
            if step is None:
                if len(self.states) > 2 * self.max_states:  # within one very long piece: keep only where we are
                    self._reset()
                step = self._advance(state, byte)
            state, emitted = step
            if emitted:
                out += emitted
        out += state.tails[-1][1]
        return out


#: Fixed values of UTF-8: for a state, the (first byte, last byte, following state) ranges that continue a character.
UTF8_STEPS = {
    "start": [(0x00, 0x7F, "start"), (0xC2, 0xDF, "one"), (0xE0, 0xE0, "e0"), (0xE1, 0xEC, "two"), (0xED, 0xED, "ed"), (0xEE, 0xEF, "two"), (0xF0, 0xF0, "f0"), (0xF1, 0xF3, "three"), (0xF4, 0xF4, "f4")],
    "one": [(0x80, 0xBF, "start")],
    "two": [(0x80, 0xBF, "one")],
    "three": [(0x80, 0xBF, "two")],
    "e0": [(0xA0, 0xBF, "one")],
    "ed": [(0x80, 0x9F, "one")],
    "f0": [(0x90, 0xBF, "two")],
    "f4": [(0x80, 0x8F, "two")],
}


class Utf8Machine:
    """Incremental UTF-8: ``push`` returns the text complete so far; broken sequences become U+FFFD, one per maximal part."""

    def __init__(self):
        self.state, self.held = "start", b""

    @staticmethod
    def _step(state: str, byte: int) -> str | None:
        return next((to for first, last, to in UTF8_STEPS[state] if first <= byte <= last), None)

    def push(self, data: bytes) -> str:
        out: list[str] = []
        for byte in data:
            following = self._step(self.state, byte)
            if following is None and self.state != "start":
                out.append("�")
                self.state, self.held = "start", b""
                following = self._step("start", byte)
            if following is None:
                out.append("�")
                continue
            self.held += bytes((byte,))
            self.state = following
            if following == "start":
                out.append(self.held.decode())
                self.held = b""
        return "".join(out)

    def finish(self) -> str:
        left, self.state, self.held = self.held, "start", b""
        return "�" if left else ""


class TokenDecoder:
    """The byte machine's moves by whole tokens, worked out by it when first met.

    ``whole`` has the text of tokens that leave the machine where it starts; ``moves`` has, for what is held and a token,
    the text that completes and what is held then. Both are bounded by the vocabulary and emptied beyond that.
    """

    MOVES = 200_000

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        decoder = self

        class Whole(dict):
            def __missing__(self, token: int) -> str | None:
                text, held = decoder.move(b"", token)
                self[token] = None if held else text
                return self[token]

        self.whole = Whole()

    def move(self, held: bytes, token: int) -> tuple[str, bytes]:
        """Text that completes, and what is held, after a token."""
        found = self.moves.get((held, token))
        if found is None:
            machine = Utf8Machine()
            machine.push(held)
            found = machine.push(self.tokens[token]), machine.held
            if len(self.moves) >= self.MOVES:
                self.moves.clear()
            self.moves[held, token] = found
        return found

    def pieces(self, ids: list[int], step: int = 4096) -> Iterator[str]:
        """Text as it completes. Tokens met while nothing is held go through ``whole``, many in one go."""
        held, at, ahead = b"", 0, step
        while at < len(ids):
            if not held:
                found = list(map(self.whole.__getitem__, ids[at : at + ahead]))
                stop = found.index(None) if None in found else len(found)
                yield "".join(found[:stop])
                at += stop
                ahead = min(step, 2 * ahead) if stop == len(found) else 16
                if stop == len(found):
                    continue
            text, held = self.move(held, ids[at])
            yield text
            at += 1
        if held:
            yield "�"


def stream_decode(ids: Iterable[int], tokens: dict[int, bytes]) -> Iterator[str]:
    """Text as it completes, token by token."""
    decoder, held = TokenDecoder(tokens), b""
    for i in ids:
        text, held = decoder.move(held, i)
        if text:
            yield text
    if held:
        yield "�"


@lru_cache(maxsize=2)
def rank_encoder(path: str, pattern: str) -> tuple[PieceEncoder, BpeTransducer]:
    transducer = BpeTransducer(load_ranks(path))
    return PieceEncoder(pattern, lambda pieces: [transducer.encode(p.encode()) for p in pieces]), transducer


@lru_cache(maxsize=2)
def token_decoder(path: str, pattern: str) -> TokenDecoder:
    return TokenDecoder(rank_encoder(path, pattern)[1].tokens)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) for every row."""
    ddl = "doc_id long, ids array<int>"
    schema = arrow_schema(ddl)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = rank_encoder(ranks_path, pattern)
        out = IdBatches(schema)
        for batch in batches:
            for doc, text in text_rows(batch):
                out.add(doc, encoder.encode(text or ""))
                if out.full:
                    yield out.take()
        if out.docs:
            yield out.take()

    return bound_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(kernel, ddl)


class IdBatches:
    """Rows of (doc_id, ids[, text]); ids are kept end to end."""

    def __init__(self, schema: pa.Schema, max_ids: int = 2_000_000, max_rows: int = 20_000):
        self.schema, self.max_ids, self.max_rows = schema, max_ids, max_rows
        self._clear()

    def _clear(self) -> None:
        self.docs: list = []
        self.texts: list[str] = []
        self.flat, self.offsets = array("i"), [0]

    def add(self, doc: int | None, ids: list[int], text: str | None = None) -> None:
        self.docs.append(doc)
        self.texts.append(text)
        self.flat.extend(ids)
        self.offsets.append(len(self.flat))

    @property
    def full(self) -> bool:
        return len(self.flat) >= self.max_ids or len(self.docs) >= self.max_rows

    def take(self) -> pa.RecordBatch:
        values = pa.Array.from_buffers(pa.int32(), len(self.flat), [None, pa.py_buffer(self.flat.tobytes())])
        ids = pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), values)
        columns = [pa.array(self.docs, pa.int64()), ids, pa.array(self.texts, pa.string())][: len(self.schema)]
        self._clear()
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def decode_ids(ids: list[int], decoder: TokenDecoder) -> str:
    """The text of an id sequence."""
    return "".join(decoder.pieces(ids))


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds ``text``, decoded from ``ids`` in order through the UTF-8 machine."""
    return _kernel_frame(encoded.select("doc_id", "ids"), ranks_path, pattern, decode_only=True)


def round_trip_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and the text decoded from them, in one pass over the documents."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _kernel_frame(rows, ranks_path, pattern, decode_only=False)


def _kernel_frame(rows: DataFrame, ranks_path: str, pattern: str, decode_only: bool) -> DataFrame:
    ddl = "doc_id long, ids array<int>, text string"
    schema = arrow_schema(ddl)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = rank_encoder(ranks_path, pattern)[0], token_decoder(ranks_path, pattern)
        out = IdBatches(schema)
        for batch in batches:
            docs, values = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                value = values[i].as_py()
                ids = (value or []) if decode_only else encoder.encode(value or "")
                out.add(docs[i].as_py(), ids, decode_ids(ids, decoder))
                if out.full:
                    yield out.take()
        if out.docs:
            yield out.take()

    return bound_batches(rows).mapInArrow(kernel, ddl)
