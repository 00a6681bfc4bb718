"""Grouping of spelling variants: words at one edit from each other, by automata of words and of reversed words.

Of two words at one edit, either the first half of the longer one (or of either, if equally long) or the rest of it is
unchanged in the other. So words are dealt by direction, half and length: every word looks up the words of its own length
and of one letter less that begin with its first half, and those that end with its second half. A task takes the keys it
was dealt one after the other and builds a minimal acyclic automaton of a few thousand words at a time (of reversed
words for the other direction). A word's half is matched exactly, its rest is completed with one error, and the number
of the path tells which word was found. What both directions find counts for the first.

A key that more words share than a task should hold is split: its words are dealt out to several automata, and what
looks them up goes to each of these.

Edge cases: null texts have no words; a null id counts as an empty one; repeated rows count each; no word occurs twice
in the result; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Emitter, arrow_schema, bound_batches, materialise, release_memory, text_rows
from .word_graph import WordGraph

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: Of the runs of a document, those with a hash that this divides lose a letter.
SLIP = 31
#: How many times as often as a word its form occurs at least.
TIMES = 10
#: Different words that a task counts before it hands them on.
COUNTED = 200_000
#: Words of an automaton before the next key starts another, and most words of one key in it.
GRAPH_WORDS, KEY_WORDS = 20_000, 50_000
FORWARD, BACKWARD = 0, 1
#: What a row does at its key: it is found there, looks for others, or both.
FOUND, LOOKS, BOTH = 1, 2, 3
NEAR = "word string, near string, near_n long"


def slipped(doc: object, run: str) -> str:
    """The run, without one of its letters if its hash in this document says so."""
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n of all words of enough letters and occurrences. A task counts what it reads before anything is shuffled."""
    ddl = "word string, n long"
    schema = arrow_schema(ddl)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def take() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)
            counts.clear()
            return batch

        for batch in batches:
            for doc, text in text_rows(batch):
                if not text:
                    continue
                lowered = text.encode().lower().decode()  # of bytes, only A-Z have lower case
                runs = Counter(run for run in RUN.findall(lowered) if len(run) >= LEAST_LENGTH)
                for run, n in runs.items():
                    word = slipped(doc, run)
                    if len(word) >= LEAST_LENGTH:
                        counts[word] += n
                if len(counts) >= COUNTED:
                    yield take()
        if counts:
            yield take()
        release_memory()

    found = bound_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(kernel, ddl)
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def half(length: int | Column) -> int | Column:
    """Letters of the first half of a word of so many."""
    return F.floor(length / 2).cast("int") if isinstance(length, Column) else length // 2


def dealt(words: DataFrame) -> DataFrame:
    """One row for every key of a word: key, dir, role, want (the length of words at the key), word, n."""
    length = F.length("word")

    def at(direction: int, of: Column, want: Column, role: int) -> Column:
        """A key of the half that words of length ``of`` match exactly."""
        part = F.substring(F.col("word"), F.lit(1), half(of)) if direction == FORWARD else F.substring(F.col("word"), length - (of - half(of)) + 1, of - half(of))
        return F.struct(F.lit(direction).alias("dir"), part.alias("part"), want.alias("want"), F.lit(role).alias("role"))

    # Longer words look for a word by their own half, which may be a letter longer than the word's.
    either = [F.filter(F.array(at(d, length, length, BOTH), at(d, length, length - 1, LOOKS), at(d, length + 1, length, FOUND)), lambda x: (x.role != FOUND) | (F.length(x.part) != own)) for d, own in ((FORWARD, half(length)), (BACKWARD, length - half(length)))]
    rows = words.select("word", "n", F.explode(F.concat(*either)).alias("at")).filter(F.col("at.want") >= LEAST_LENGTH)
    return rows.select(F.xxhash64("at.dir", "at.part", "at.want").alias("key"), "at.dir", "at.role", "at.want", "word", "n")


def split_hot(rows: DataFrame, most: int) -> DataFrame:
    """Adds salt: -1, but where more than ``most`` words are found at a key, the number of an automaton.

    There a word is found in one automaton, by its hash, and looks into all.
    """
    sizes = rows.filter(F.col("role") != LOOKS).groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > most)
    sizes = materialise(sizes.select("key", F.ceil(F.col("size") / most).cast("int").alias("salts")), "hot-keys")
    if sizes.isEmpty():
        return rows.withColumn("salt", F.lit(-1))
    joined = rows.join(sizes, "key", "left")
    plain = joined.filter("salts is null").drop("salts").withColumn("salt", F.lit(-1))
    hot = joined.filter("salts is not null")
    found = hot.filter(F.col("role") != LOOKS).withColumn("salt", F.pmod(F.xxhash64("word"), F.col("salts")).cast("int")).withColumn("role", F.lit(FOUND))
    looking = hot.filter(F.col("role") != FOUND).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("role", F.lit(LOOKS))
    return plain.unionByName(found.drop("salts")).unionByName(looking.drop("salts"))


class Finder:
    """Words to find and words that look for them, in one direction, for a few keys at a time."""

    def __init__(self, direction: int):
        self.direction = direction
        self.words: dict[str, int] = {}
        self.looking: list[tuple[str, int, int]] = []
        self.graph: WordGraph | None = None

    def add(self, role: int, want: int, word: str, n: int) -> None:
        if role != LOOKS and word not in self.words:
            self.words[word] = n
            self.graph = None
        if role != FOUND:
            self.looking.append((word, n, want))

    def _turned(self, word: str) -> str:
        return word[::-1] if self.direction == BACKWARD else word

    def answer(self) -> Iterator[tuple[str, str, int]]:
        """(word, near word, its n) of all that look, and forgets these."""
        looking, self.looking = self.looking, []
        if not self.words or not looking:
            return
        if self.graph is None:
            self.ordered = sorted(map(self._turned, self.words))
            self.graph = WordGraph(self.ordered)
        graph = self.graph
        for word, n, want in looking:
            first = half(len(word))
            text, exact = self._turned(word), len(word) - first if self.direction == BACKWARD else first
            at = graph.follow(graph.start, 0, text[:exact])
            if at is None:
                continue
            same = want == len(word)
            for number in (graph.replaced if same else graph.shortened)(*at, text[exact:]):
                near = self._turned(self.ordered[number])
                if self.direction == BACKWARD and near.startswith(word[:first]):
                    continue  # the other direction finds it
                yield word, near, self.words[near]
                if not same:  # words of one length look for each other
                    yield near, word, n

    def clear(self) -> None:
        self.words, self.graph = {}, None


def near_words(words: DataFrame, graph_words: int = GRAPH_WORDS, key_words: int = KEY_WORDS) -> DataFrame:
    """word, near, near_n: all pairs of ``words`` (word, n) at exactly one edit, in both orders, each once."""
    schema = arrow_schema(NEAR)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, finder, at = Emitter(schema), Finder(FORWARD), (FORWARD, -1, None)

        def answers(clear: bool) -> Iterator[pa.RecordBatch]:
            for found in finder.answer():
                out.add(*found)
                if out.full:
                    yield out.take()
            if clear:
                finder.clear()

        for batch in batches:
            for direction, salt, key, role, want, word, n in zip(*(column.to_pylist() for column in batch.columns)):
                if (direction, salt, key) != at:
                    # Several automata of a key must not meet in one, and a large one ends with its key.
                    if (direction, salt) != at[:2] or salt >= 0 or len(finder.words) >= graph_words or len(finder.looking) >= graph_words:
                        yield from answers(True)
                        finder.direction = direction
                    at = (direction, salt, key)
                elif role == LOOKS and len(finder.looking) >= graph_words:
                    yield from answers(False)  # all words of the key are there
                finder.add(role, want, word, n)
        yield from answers(True)
        yield from out.rest()

    rows = split_hot(dealt(words), key_words).withColumn("last", F.col("role") == LOOKS)
    rows = rows.repartition("key", "salt").sortWithinPartitions("dir", "salt", "key", "last")
    return rows.select("dir", "salt", "key", "role", "want", "word", "n").mapInArrow(kernel, NEAR)


def follow_forms(forms: DataFrame) -> DataFrame:
    """word and root for ``forms`` (word, form): forms followed to the last, twice as far each round.

    A form occurs ten times as often as its word, so chains have at most 18 steps and 6 rounds are enough.
    """
    ahead, further = forms.select("word", F.col("form").alias("root")), True
    while further:
        onward = ahead.select(F.col("word").alias("root"), F.col("root").alias("far"))
        ahead = materialise(ahead.join(onward, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        further = not ahead.filter("moved").isEmpty()
        ahead = ahead.drop("moved")
    return ahead


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", graph_words: int = GRAPH_WORDS, key_words: int = KEY_WORDS) -> DataFrame:
    """One row per word: word, n, form, form_n (null without a form), root, n_near."""
    words = materialise(count_words(docs, id_col, text_col), "words")
    found = near_words(words, graph_words, key_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    known = words.join(found, "word", "left").withColumn("is_form", F.coalesce(-F.col("best.rank") >= TIMES * F.col("n"), F.lit(False)))
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.expr("if(is_form, best.near, null)").alias("form"), F.expr("if(is_form, -best.rank, null)").alias("form_n"))
    known = materialise(known, "near-words")
    roots = follow_forms(known.filter("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")
