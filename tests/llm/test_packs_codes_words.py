"""Best-fit packing, vector codes and spelling variants against brute force, with edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from math import floor, inf, nan

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evspark.llm import best_fit, spelling, vector_codes
from evspark.llm.queries import QUERIES, TOKENIZER_FILE, token_pattern, tokenizer_path
from evspark.llm.word_graph import WordGraph
from tests.oracle import SF

from .test_llm import DOCS, EDGES

LETTERS = "abcdé"


# Packing


def one_by_one(lengths, capacity):
    """Best-two-fit over a plain list of lengths."""
    left, windows = sorted(lengths, reverse=True), []
    while left:
        window, gap, i = [], capacity, 0
        while i < len(left):
            if left[i] <= gap:
                gap -= left[i]
                window.append(left.pop(i))
            else:
                i += 1
        if gap and len(window) > 1:
            smallest, best = window[-1], (0, 0, 0)
            for i in range(len(left)):
                for j in range(i + 1, len(left)):
                    if left[i] + left[j] <= gap + smallest:
                        best = max(best, (left[i] + left[j], left[i], left[j]))
            if best[0] > smallest:
                window.remove(smallest)
                for length in best[1:]:
                    left.remove(length)
                    window.append(length)
                left = sorted([*left, smallest], reverse=True)
        windows.append(sorted(window, reverse=True))
    return windows


@pytest.mark.parametrize("seed", range(30))
def test_fillings_are_those_of_single_documents(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 40) if rng.random() < 0.7 else rng.choice([7, 13, 20]) for _ in range(rng.randint(1, 90))]
    found = [[length for length, times in filling for _ in range(times)] for filling, n in best_fit.best_two_fit(Counter(lengths), 40) for _ in range(n)]
    assert found == one_by_one(lengths, 40)


def test_fillings_are_bounded_by_lengths():
    rng = random.Random(5)
    counts = {length: rng.randint(1, 10**9) for length in range(1, 2049)}
    fillings = list(best_fit.best_two_fit(counts, 2048))
    assert len(fillings) < 5 * 2048
    total = sum(length * n for length, n in counts.items())
    assert sum(n for _, n in fillings) <= 1.01 * total / 2048 + 1
    packed = Counter()
    for filling, n in fillings:
        assert sum(length * times for length, times in filling) <= 2048
        for length, times in filling:
            packed[length] += times * n
    assert packed == counts


def assert_packed(pieces, docs, capacity=2048):
    """Every id in one piece, pieces at their places without gaps, windows not overfull."""
    tokenizer = Tokenizer.from_file(tokenizer_path(TOKENIZER_FILE))
    expected = Counter()
    for doc, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity)] if len(ids) > capacity else [0]
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            expected[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == expected
    windows = defaultdict(list)
    for r in pieces:
        windows[r.sequence_id].append((r.offset, r.length))
    for places in windows.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return windows


def test_best_fit_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op13_best_fit"](spark, SF).collect()
    windows = assert_packed(found, docs)
    assert len(windows) <= 1.01 * sum(r.length for r in found) / 2048 + 1


@pytest.mark.parametrize("splits", [1, 7])
def test_best_fit_edges(spark, splits):
    rows = [*EDGES, (11, "word " * 5000, None, None, 1), (12, "word " * 2047, None, None, 1), (13, "word " * 4095, None, None, 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(splits)
    pieces = best_fit.best_fit_packing(docs, tokenizer_path(TOKENIZER_FILE), token_pattern()).collect()
    assert_packed(pieces, [r[:2] for r in rows])
    assert all(zlib.crc32(r.token_bytes) == r.ids_crc32 for r in pieces)


def test_best_fit_does_not_depend_on_splits(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = {best_fit.best_fit_packing(docs.repartition(n), tokenizer_path(TOKENIZER_FILE), token_pattern(), tokens=False).select("sequence_id").distinct().count() for n in (1, 9)}
    assert len(sizes) == 1


def test_best_fit_empty(spark):
    assert best_fit.best_fit_packing(spark.createDataFrame([], DOCS), tokenizer_path(TOKENIZER_FILE), token_pattern()).count() == 0


# Vector codes


def plain_codes(rows):
    """The rule on plain lists of (vec_id, vector, label)."""
    kept = [(i, [floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and abs(x) < inf for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // 8))
    kept = [(i, v + [0] * (8 * width - len(v)), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[v[p * width : (p + 1) * width] for _, v, _ in kept[:16]] for p in range(8)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(6):
        for p in range(8):
            groups = defaultdict(list)
            for _, v, _ in kept:
                part = v[p * width : (p + 1) * width]
                groups[nearest(part, books[p])[1]].append(part)
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else entry for e, entry in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    coded = [(i, [nearest(v[p * width : (p + 1) * width], books[p]) for p in range(8)], label) for i, v, label in kept]
    sums = Counter()
    for _, parts, label in coded:
        sums[label] += sum(d for d, _ in parts)
    most = (1 << 63) - 1
    return [(i, "".join(f"{e:02x}" for _, e in parts), min(most, sum(d for d, _ in parts)), min(most, sums[label]), digest) for i, parts, label in coded]


VECTORS = "vec_id long, embedding array<float>, label int, code string"
HARD = [
    *[(i, [float((i * j) % 7) / 3 - 1 for j in range(16)], i % 3 if i % 4 else None, "x") for i in range(40)],
    (3, [float(j) for j in range(16)], 1, None), (3, [float(-j) for j in range(16)], 1, None), (None, [0.5] * 16, 2, None), (100, None, 1, None),
    (101, [1.0, None], 1, None), (102, [nan] * 16, 1, None), (103, [inf] + [0.0] * 15, 1, None), (104, [], 2, None), (105, [1.0] * 19, None, None),
]


@pytest.mark.parametrize("rows", [HARD, HARD[:5], HARD[40:], [*HARD, (-7, [3e30, -2e9, 9000.0] + [1.0] * 13, 5, None)], HARD[43:47]], ids=["all", "few", "odd", "huge", "dropped"])
def test_vector_codes(spark, rows):
    found = vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    plain = [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v], label) for i, v, label, _ in rows]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(plain_codes(plain), key=key)


def test_vector_blocks_are_cut(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    whole = vector_codes.compress(rows).toPandas().sort_values("vec_id").values.tolist()
    monkeypatch.setattr(vector_codes, "BLOCK", 7)
    assert vector_codes.compress(rows.repartition(3)).toPandas().sort_values("vec_id").values.tolist() == whole


def test_vector_codes_empty(spark):
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0


# Spelling variants


def plain_variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    by_size = defaultdict(list)
    for w in n:
        by_size[len(w)].append(w)
    links = {w: [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_size[size] if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(links[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, n[w], form[w], form[w] and n[form[w]], root(w), len(links[w])) for w in n)


def variants(docs, **sizes):
    return sorted(map(tuple, spelling.group_variants(docs, **sizes).collect()))


def invented(seed, n):
    """Documents of words near each other, with doubled letters and chains of forms."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(7, 10))) for _ in range(12)]
    words = list(stems)
    for stem in stems:
        for _ in range(8):
            i = rng.randrange(len(stem))
            words.append(rng.choice([stem[:i] + stem[i + 1 :], stem[:i] + rng.choice(LETTERS) + stem[i:], stem[:i] + rng.choice(LETTERS) + stem[i + 1 :], stem[:i] + stem[i] + stem[i:]]))
    weights = [1000 ** rng.random() for _ in words]
    return [(i, " ".join(rng.choices([w.upper() if rng.random() < 0.1 else w for w in words], weights, k=40)), None, None, 0) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"graph_words": 3, "key_words": 2}, {"graph_words": 1, "key_words": 1}], ids=["plain", "split", "single"])
def test_variants(spark, sizes):
    rows = [*invented(1, 150), *EDGES, (None, "Zzzzzzzz zzzzzzz zzzzzzz zzzzzzzzz zzzzzzzzz", None, None, 0), (77, "naïveté× NAÏVETÉ× naiveté× naiveté×", None, None, 0)]
    expected = plain_variants([r[:2] for r in rows])
    assert sum(r[5] for r in expected) > 100
    assert sum(r[4] != r[0] for r in expected) > 5
    assert variants(spark.createDataFrame(rows, DOCS).repartition(5), **sizes) == expected


def test_variants_of_real_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op11_spelling_variants"](spark, SF)
    assert sorted(map(tuple, found.select("word", "n", "form", "form_n", "root", "n_near").collect())) == plain_variants(rows)


def test_variants_empty(spark):
    assert variants(spark.createDataFrame([], DOCS)) == []
    assert variants(spark.createDataFrame([(1, None, None, None, 0), (2, "short words only", None, None, 0)], DOCS)) == []


def test_forms_are_followed_to_the_last(spark):
    chain = [f"w{i}" for i in range(18)]
    found = spelling.follow_forms(spark.createDataFrame(list(zip(chain, chain[1:])), "word string, form string"))
    assert {tuple(r) for r in found.select("word", "root").collect()} == {(w, "w17") for w in chain[:-1]}


@pytest.mark.parametrize("seed", range(5))
def test_word_graph(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(80)})
    graph = WordGraph(words)
    assert [graph.number(w) for w in words] == list(range(len(words))) and len(graph) == len(words)
    assert graph.number("abc") is None
    for text in ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(50)]:
        replaced = [w for w in words if len(w) == len(text) and sum(a != b for a, b in zip(w, text)) == 1]
        assert sorted(words[i] for i in graph.replaced(graph.start, 0, text)) == replaced
        shortened = sorted({text[:i] + text[i + 1 :] for i in range(len(text))} & set(words))
        assert sorted(words[i] for i in graph.shortened(graph.start, 0, text)) == shortened
    ends = Counter()
    for state, steps in enumerate(graph.steps):
        ends[graph.ends[state], tuple(sorted((c, to) for c, (to, _) in steps.items()))] += 1
    assert max(ends.values()) == 1  # no two equal states
