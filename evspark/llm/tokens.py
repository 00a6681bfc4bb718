"""Byte-level tokenising shared by packing and encoding: pattern pieces looked up in a bounded memo."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import regex

#: Characters handed to one pass of the pattern; a text is never cut inside a piece.
CHUNK_CHARS = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PieceEncoder:
    """Encodes texts piece by piece. ``encode_pieces`` is asked once for each piece not in the memo.

    The memo is emptied when it would outgrow ``memo_pieces``; results never depend on it.
    """

    def __init__(self, pattern: str, encode_pieces: Callable[[list[str]], list[list[int]]], memo_pieces: int = 600_000):
        self.find = regex.compile(pattern).findall
        self.encode_pieces, self.memo_pieces = encode_pieces, memo_pieces
        self.memo: dict[str, tuple[int, ...]] = {}

    def _learn(self, pieces: set[str]) -> None:
        if len(self.memo) + len(pieces) > self.memo_pieces:
            self.memo.clear()
        fresh = list(pieces)
        self.memo.update(zip(fresh, map(tuple, self.encode_pieces(fresh))))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in safe_chunks(text):
            pieces = self.find(part)
            missing = set(pieces).difference(self.memo)
            if missing:
                self._learn(set(pieces) if len(self.memo) + len(missing) > self.memo_pieces else missing)
            out.extend(chain.from_iterable(map(self.memo.__getitem__, pieces)))
        return out


_BREAK = regex.compile(r"[^\s](?=\s)")  # what the pattern takes for space


def safe_chunks(text: str) -> Iterator[str]:
    """Cuts a long text only between a non-space and a following space, where no piece of the pattern spans."""
    start = 0
    while len(text) - start > CHUNK_CHARS:
        found = _BREAK.search(text, start + CHUNK_CHARS)
        if found is None:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:] if start else text


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest for 256 onwards."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def vocabulary_encoder(path: str, pattern: str) -> Callable[[str], list[int]]:
    """Ids of a byte-level tokenizer file whose merges stand in id order.

    Texts are cut at the file's added tokens first, as the ``tokenizers`` library does by default; it gives the same ids
    from the same file (tests compare them) at four times the CPU time.
    """
    import tiktoken

    alphabet = _byte_alphabet()
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    added = {t["content"]: t["id"] for t in content.get("added_tokens", ())}
    if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in content.get("added_tokens", ())):
        raise ValueError(f"{path}: added tokens that take in or depend on what is around them are not supported")
    ranks = {bytes(alphabet[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in added}
    ordinary = tiktoken.Encoding(name="vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if not added:
        return ordinary
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split

    def encode(text: str) -> list[int]:
        parts = cut(text)
        if len(parts) == 1:
            return ordinary(text)
        return list(chain.from_iterable([added[part]] if i % 2 else ordinary(part) for i, part in enumerate(parts)))

    return encode
