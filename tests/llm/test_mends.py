"""Cases that earlier tests left out: filters of several segments, columns of any type, repeated turns, long texts, uncertain languages."""

import hashlib
import random
from itertools import combinations

import pytest
import regex
from pyspark.sql import functions as F

from evspark.llm import bpe, chat, exact_dedup, language_id, line_dedup, quality, simhash, spotsigs, tokens
from evspark.llm.queries import token_pattern

from .test_llm import DOCS, EDGES, plain_fold, plain_similar, union_find

ANY = "doc_id long, text string, m map<string,int>, s struct<a:int,`b.c`:array<int>>, `odd name` binary"
WORDS = "some words that stand here and make up a document of its own with the number"


def any_rows():
    texts = [f"{WORDS} {i}" for i in range(6)]
    rows = [(i % 9 if i % 5 else None, texts[i % 6], {"k": i}, (i, [i]), bytes([i])) for i in range(40)]
    return rows + [(50, "", {}, None, None), (51, None, None, None, None), (51, None, {"x": 1}, None, None)]


@pytest.mark.parametrize("bits", [exact_dedup.SEGMENT_BITS, 256])
def test_copies_go_whatever_the_columns(spark, bits):
    docs = spark.createDataFrame(any_rows(), ANY).repartition(5)
    kept = exact_dedup.drop_exact_copies(docs, segment_bits=bits)
    rows = kept.collect()
    assert kept.columns == docs.columns and sorted((r["text"] or "") for r in rows) == sorted({r[1] or "" for r in any_rows()})
    for r in rows:
        ids = [x[0] for x in any_rows() if (x[1] or "") == (r["text"] or "") and x[0] is not None]
        assert r["doc_id"] == max(ids)


@pytest.mark.parametrize("bits", [exact_dedup.SEGMENT_BITS, 256])
def test_near_copies_go_whatever_the_columns(spark, bits):
    other = "quite another text about things that nobody else here has written down before today"
    rows = [(i, WORDS if i % 4 else other, {"k": i}, (i, None), None) for i in range(12)] + [(None, "twelve", {}, None, None)] * 2
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, ANY).repartition(3), segment_bits=bits).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 0), (False, 1), (True, 0)]


@pytest.mark.parametrize("bits", [exact_dedup.SEGMENT_BITS, 64 * 64])
def test_texts_do_not_move_to_be_filtered(spark, bits):
    texts = spark.range(2000).select("id", F.concat(F.lit("text "), "id").alias("text"))
    members = texts.filter("id % 20 = 0").select(F.xxhash64("text").alias("h"))
    maybe, rest = exact_dedup.split_by_members(texts, F.xxhash64("text"), members, "h", 100, bits)
    for part in (maybe, rest):
        plan = part._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
        assert "Exchange" not in plan and "Join" not in plan
    found = {r["id"] for r in maybe.collect()}
    assert {i for i in range(2000) if i % 20 == 0} <= found and len(found) < 130
    assert found.isdisjoint(r["id"] for r in rest.collect()) and maybe.count() + rest.count() == 2000


def told(turns):
    """Role and text of turns, digested as the query does."""
    return hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()


def test_repeated_turns_stay_apart(spark):
    long = [(1, 0, "user", "A" * 500), (1, 0, "user", "B" * 500), (1, 0, "user", "B" * 500), (1, 1, "assistant", "C" * 1300), (1, 1, "user", None), (1, 2, None, "x</s>")]
    turns = spark.createDataFrame(long, "conv_id long, turn long, role string, text string").repartition(4)
    segments = chat.render(chat.turns_as_log(turns))
    got = [chat.parse_segment(r["segment"]) for r in segments.orderBy("part").collect()]
    assert len(got) == 6 and sorted(got[:3]) == [("user", "A" * 500), ("user", "B" * 500), ("user", "B" * 500)]
    assert got[3:] == [("assistant", "C" * 1300), ("user", ""), ("", "x</s>")]
    back = chat.read_back(chat.render(chat.turns_as_log(turns)), in_order=True).collect()
    assert [(r["n_turns"], r["turns_sha256"], r["loss_chars"]) for r in back] == [(6, told(got), 1300)]


def test_drafts_leave_no_trace(spark):
    rng = random.Random(4)
    rows = [(c, t, "assistant" if t % 2 else "user", rng.choice(["", "short", "word " * 300, "é" * 401, "[INST]\\" * 90])) for c in range(30) for t in range(5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.turns_as_log(turns)
    kinds = {r["event"]: r["count"] for r in log.groupBy("event").count().collect()}
    assert kinds["edit"] > 20 and kinds["regenerate"] > 20
    expected = {c: told([(r[2], r[3]) for r in rows if r[0] == c]) for c in range(30)}
    for found in (chat.read_back(chat.render(log), in_order=True), chat.read_back(chat.render(log).repartition(5)), chat.read_back(chat.render(chat.turns_as_log(turns, drafts=False)))):
        assert {r["conv_id"]: r["turns_sha256"] for r in found.collect()} == expected
    plan = chat.read_back(chat.render(log), in_order=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_plain_log_still_folds(spark):
    events = [(0, "delta", 0, "user", "a"), (1, "delta", 1, "assistant", "b"), (2, "edit", 0, None, "c"), (3, "delta", 1, "assistant", "d"), (4, "regenerate", 1, None, None), (5, "delta", 1, None, "e")]
    log = spark.createDataFrame([(7, *e) for e in events], "conv_id long, seq long, event string, turn long, role string, text string")
    got = [chat.parse_segment(r["segment"]) for r in chat.render(log).orderBy("part").collect()]
    assert got == [(role, text) for _, role, text in plain_fold(events)]


def test_uncertain_languages_are_rejected(spark):
    words = {"aa": "bala kala mala tala", "bb": "woxo voxo zoxo xoxo"}
    rows = [(i, " ".join([words[lang]] * (1 + i % 5)), lang, "s", 0) for i in range(200) for lang in words]
    docs = spark.createDataFrame(rows, DOCS)
    net = language_id.fit_language_model(docs, F.lit(True))
    more = spark.createDataFrame([(1, words["aa"], None, None, 0), (2, "12 !!", None, None, 0), (3, None, None, None, 0), (4, words["bb"] * 40_000, None, None, 0)], DOCS)
    assert sorted(r["doc_id"] for r in language_id.keep_known(more, net).collect()) == [1, 4]
    scores = {r["doc_id"]: r["score"] for r in language_id.identify(more, net).collect()}
    assert sorted(r["doc_id"] for r in language_id.keep_known(more, net, least=scores[1] + 1e-9).collect()) == ([4] if scores[4] > scores[1] else [])


def test_rare_labels_are_all_used(spark):
    """Labels are sampled apart from documents, so a few among very many still teach."""
    good, bad = "A clear sentence about the weather in the north of the country. " * 5, "$$$ !!! buy @@ now ### 999 $$$ !!! " * 5
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, good).otherwise(bad).alias("text"))
    labels = spark.range(0, 6000, 100).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    model = quality.fit_quality_model(docs, labels, sample_docs=200)
    assert model is not None
    scored = {r["doc_id"]: r["score"] for r in quality.score_quality(docs.filter("doc_id < 4"), model).collect()}
    assert min(scored[0], scored[2]) > max(scored[1], scored[3])


def test_long_texts_are_cut_where_the_pattern_breaks(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 10)
    pattern = regex.compile(token_pattern())
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab!\x1c\x1f\x85 \n\t'é漢") for _ in range(rng.randint(0, 80)))
        assert [p for part in tokens.safe_chunks(text) for p in pattern.findall(part)] == pattern.findall(text)


@pytest.mark.parametrize("step", [1, 3, 4096])
def test_ids_are_decoded_by_the_machine(step, monkeypatch):
    """Tokens that end inside characters, and byte sequences that are no text."""
    monkeypatch.setattr(bpe.TokenDecoder, "MOVES", 50)
    tokens = {i: bytes([i]) for i in range(256)} | {256: "é".encode(), 257: "漢".encode()[:2], 258: "漢".encode()[2:] + b"x", 259: "🙂".encode()[1:], 260: b"plain ", 261: b"\xff\xc3"}
    decoder, rng = bpe.TokenDecoder(tokens), random.Random(step)
    for _ in range(300):
        ids = [rng.choice([*range(256, 262), 65, 0xF0, 0xC3, 0xA9, 0xE2]) for _ in range(rng.randint(0, 30))]
        expected = b"".join(tokens[i] for i in ids).decode(errors="replace")
        assert "".join(decoder.pieces(ids, step)) == expected == "".join(bpe.stream_decode(ids, tokens)) == bpe.decode_ids(ids, decoder)
        assert len(decoder.moves) <= 50


def test_buckets_of_ids_follow_their_bounds(spark):
    ids = [*range(0, 400, 3), *range(10_000, 10_050), None, -5]
    rows = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    placed = spotsigs.with_following(rows, 16, "doc_id", "text").collect()
    own = sorted((r["bucket"], r["doc_id"]) for r in placed if not r["ghost"] and r["doc_id"] is not None)
    assert [d for _, d in own] == sorted(i for i in ids if i is not None) and len({b for b, _ in own}) > 8


def test_edges_include_long_lines():
    assert max(len(r[1] or "") for r in EDGES) > 3000


def test_short_lines_lose_no_link(spark):
    """Of lines of a few words exactly those stay that all pairs leave."""
    rng, lines = random.Random(5), {"the.", "sthe.", "thhe.", "are.", "anre."}
    for _ in range(60):
        base = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(3, 27)))
        for _ in range(3):
            edited = list(base)
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(edited) + 1)
                edited[at : at + rng.randint(0, 1)] = rng.choice(("", "x", "é", "q"))
            lines.add(" ".join("".join(edited).split()))
    lines = sorted(x for x in lines if 0 < len(x) <= line_dedup.SHORT)
    find = union_find(len(lines), [(a, b) for a, b in combinations(range(len(lines)), 2) if plain_similar(lines[a], lines[b])])
    got = line_dedup.line_dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    expected = {i for i in range(len(lines)) if find(i) != i}
    assert len(expected) > 40 and {r["doc_id"] for r in got if r["n_removed"]} == expected


def test_variants_of_a_line_do_not_give_all_pairs(spark):
    lines = ["page %d of %d" % (100 + k % 20, 300 + k // 20) for k in range(400)]
    nodes = spark.createDataFrame([(k, line_dedup.WORDS, x, len(x)) for k, x in enumerate(lines)], "line_id long, kind int, short string, chars int")
    links = [(r["a"], r["b"]) for r in line_dedup.short_links(nodes).collect()]
    find = union_find(400, links)
    assert {find(i) for i in range(400)} == {0} and len(links) < 20 * 400


def test_variants_of_a_long_line_are_not_verified_in_all_pairs(spark):
    """Of 40 variants that all met, links connect what all pairs connect, and are about one for each; a line of other words stays apart."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(40)]
    lines = [" ".join("variant%d" % k if i == k else w for i, w in enumerate(words)) for k in range(40)] + [" ".join(w[::-1] for w in words)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    nodes = line_dedup.materialise(line_dedup.distinct_lines(line_dedup.simhash_lines(docs)), "lines")
    ids = [r[0] for r in docs.orderBy("doc_id").selectExpr("xxhash64(text)").collect()]
    pairs = spark.createDataFrame([(min(p), max(p), k % 20) for k, p in enumerate(combinations(ids, 2))], "a long, b long, bits int")
    links = [(ids.index(r["a"]), ids.index(r["b"])) for r in line_dedup.verified(docs, nodes, pairs, "doc_id", "text").collect()]
    find = union_find(41, links)
    assert {find(i) for i in range(40)} == {find(0)} != {find(40)} and len(links) < 2 * 40


def test_lines_are_not_bundled_by_likeness_in_half_their_print(spark):
    """Two lines of nearly one print that share a block with a line of quite another one."""
    block = line_dedup.key_plan(3, line_dedup.WORDS)[0][0]
    f0 = sum(1 << b for b in range(48) if not block[0] >> b & 1 and b % 5 == 0)
    f1 = sum(1 << b for b in range(63) if not block[1] >> b & 1)
    rows = [(0, line_dedup.WORDS, 200, 0, 0), (1, line_dedup.WORDS, 200, f0, f1), (2, line_dedup.WORDS, 200, f0, f1 ^ (f1 & -f1))]
    nodes = spark.createDataFrame(rows, "line_id long, kind int, chars int, f0 long, f1 long")
    assert (1, 2) in {(r["a"], r["b"]) for r in line_dedup.candidates(nodes).collect()}


def test_lines_that_share_a_handle_meet(spark):
    rows = [(5, line_dedup.WORDS, 200, 77, 9), (5 + (1 << 14), line_dedup.WORDS, 200, 77, 9)]
    nodes = spark.createDataFrame(rows, "line_id long, kind int, chars int, f0 long, f1 long")
    assert [(r["a"], r["b"]) for r in line_dedup.candidates(nodes).collect()] == [(5, 5 + (1 << 14))]
