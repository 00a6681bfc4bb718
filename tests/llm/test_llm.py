"""Operators of the llm subpackage against brute force, round trips and other libraries, with edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evspark.llm import anchors, bpe, chat, components, exact_dedup, language_id, line_dedup, packing, quality, simhash, spotsigs, substring_dedup, tokens
from evspark.llm import suffix_array as sa
from evspark.llm.queries import ORACLE_SQL, QUERIES, RANK_FILE, TOKENIZER_FILE, token_pattern, tokenizer_path
from tests.oracle import SF, assert_same, database

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "many words that stand in a row and repeat again and again without an end in sight " * 40
EDGES = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, "One two three four five six seven eight nine ten eleven twelve.", "en", "s", 1),
    (4, "ONE two three four five six seven eight nine ten eleven twelve.", None, "s", 1),
    (5, "one two three four five six seven eight nine ten eleven thirteen.", "en", None, 1),
    (6, LONG, "en", "s", 1),
    (7, LONG + "and more", "en", "s", 1),
    (8, "  \n\t\n ", "en", "s", 1),
    (9, "12 34 !!", "en", "s", 1),
    (10, "É à ü ñ 漢字 🙂 <|endoftext|>", "fr", "s", 1),
    (5, "one two three four five six seven eight nine ten eleven thirteen.", "en", None, 1),
    (None, "one two three four five six seven eight nine ten eleven thirteen.", "en", "x", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def union_find(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return find


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, name):
    found = QUERIES[name](spark, SF).toPandas()
    assert len(found)
    if name in ORACLE_SQL:
        assert_same(found, database().sql(ORACLE_SQL[name]).df())
    again = QUERIES[name](spark, SF).toPandas()
    order = [c for c in ("conv_id", "doc_id", "start", "word", "vec_id") if c in found]
    assert found.sort_values(order).astype(str).values.tolist() == again.sort_values(order).astype(str).values.tolist()


# 1 line deduplication


def plain_lines(rows, least=0.8):
    """All pairs of lines by edit similarity alone."""
    occurrences, first = [], {}
    for doc, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            words = " ".join(w for w in line.lower().split(" ") if w)
            if words:
                occurrences.append(((doc is None, doc, k), words))
                first.setdefault(words, len(first))
    keys = list(first)
    links = [(i, j) for i, j in combinations(range(len(keys)), 2) if plain_similar(keys[i], keys[j], least)]
    find = union_find(len(keys), links)
    keep = {}
    for place, words in occurrences:
        root = find(first[words])
        keep[root] = min(keep.get(root, place), place)
    going = {}
    for place, words in occurrences:
        if keep[find(first[words])] != place:
            going.setdefault(place[1], []).append(place[2])
    return going


def plain_similar(a, b, least=0.8):
    """Whether the edit distance of two lines is at most a fifth of the longer one; bit-parallel, one column a step."""
    a, b = sorted((a, b), key=len)
    most = int((1 - least) * len(b) + 1e-9)
    if len(b) - len(a) > most:
        return False
    left, right = Counter(a), Counter(b)
    if max((left - right).total(), (right - left).total()) > most:
        return False
    at, full, top = {}, (1 << len(a)) - 1, 1 << len(a) - 1
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    plus, minus, distance = full, 0, len(a)
    for c in b:
        equal = at.get(c, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(across | plus) & full, plus & across
        distance += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
    return distance <= most


def near_lines(seed=3):
    rng = random.Random(seed)
    vocabulary = ["word%d" % i for i in range(300)] + ["a", "of", "|"]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 40))] for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(base))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            lines.append(" ".join(line) if rng.random() < 0.8 else " ".join(line).upper() + "  ")
        rows.append((i, "\n".join(lines)))
    return rows


def share_found(got, going):
    """Of the lines that all pairs remove, the share that was; none but those may be."""
    wanted = {(d, n) for d, lines in going.items() for n in lines}
    found = {(r["doc_id"], n) for r in got for n in r["removed_lines"]}
    assert found <= wanted and len(wanted) > 50
    return len(found) / len(wanted)


def test_line_dedup_against_all_pairs(spark, real):
    for rows in (near_lines(), near_lines(11), [(r["doc_id"], r["text"]) for r in real.select("doc_id", "text").collect()]):
        got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r["doc_id"]: r["n_lines"] for r in got} == {i: len((t or "").split("\n")) for i, t in rows}
        assert share_found(got, plain_lines(rows)) >= 0.9


def test_pairs_of_lines_are_found(spark, real):
    """Recall of pairs, which groups can't help."""
    lines = sorted({" ".join(w for w in x.lower().split(" ") if w) for r in real.collect() for x in (r["text"] or "").split("\n")})
    near = [(a, b) for a, b in combinations([x for x in lines if x], 2) if plain_similar(a, b)]
    rows = [(2 * k + side, line) for k, pair in enumerate(near) for side, line in enumerate(pair)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = line_dedup.materialise(line_dedup.distinct_lines(line_dedup.simhash_lines(frame)), "lines")
    names = {t: r[0] for t, r in zip([t for _, t in rows], spark.createDataFrame(rows, "doc_id long, text string").selectExpr("xxhash64(text)").collect())}
    found = {(r["a"], r["b"]) for r in line_dedup.candidates(nodes).collect()}
    pairs = [tuple(sorted((names[a], names[b]))) for a, b in near]
    assert len(pairs) > 20 and sum(p in found for p in pairs) >= 0.85 * len(pairs)


def plain_print(features):
    counts = [0] * 126
    for f in features:
        low = xxhash.xxh64_intdigest(f.encode(), 42)
        h = low & (1 << 63) - 1 | (xxhash.xxh64_intdigest(low.to_bytes(8, "little"), 42) & (1 << 63) - 1) << 63
        for b in range(126):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(126) if counts[b] * 2 > len(features))


def test_line_prints(spark):
    rng = random.Random(4)
    lines = [" ".join("w%d" % rng.randrange(900) for _ in range(n)) for n in (1, 2, 3, 9, 126, 127, 128, 254, 255, 600, 1500)] + ["a b", "漢字" * 30, "x" * 16, "x" * 17 + " of it"]
    got = {(r["doc_id"], r["kind"]): r["f0"] | r["f1"] << 63 for r in line_dedup.simhash_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    expected = {}
    for i, line in enumerate(lines):
        words = line.split(" ")
        cut = len(line) > 12 * len(words)
        pieces = [[w[k : k + 4] for k in range(len(w) - 3)] if cut and len(w) > 16 else [w] for w in words]
        expected[i, 0] = plain_print({f for p in pieces for f in p})
        if 5 <= len(line) < 80:
            expected[i, 1] = plain_print({line[k : k + 2] for k in range(len(line) - 1)})
    assert got == expected


def test_line_dedup_edges(spark, docs, empty):
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert got[1]["n_lines"] == 1 and got[1]["n_removed"] == 0 and got[8]["n_removed"] == 0
    assert list(got[4]["removed_lines"]) == [0] and got[3]["n_removed"] == 0
    assert list(got[None]["removed_lines"]) == [0]
    assert line_dedup.line_dedup(empty).count() == 0
    kept = line_dedup.without_lines(docs.dropDuplicates(["doc_id"]), line_dedup.line_dedup(docs)).collect()
    assert {r["doc_id"]: r["text"] for r in kept}[4] == ""


def test_line_fingerprints_have_no_python(spark, docs):
    plan = line_dedup.simhash_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 2 packing


def check_pieces(rows, texts, encode, capacity=2048):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    for doc, text in texts.items():
        ids = [*encode(text or ""), 1]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    return padding


def test_packing_covers_every_id(spark, real, docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(TOKENIZER_FILE))
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    for df in (real, docs.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        pieces = packing.with_checksums(packing.pack_documents(df, tokenizer_path(TOKENIZER_FILE), token_pattern())).collect()
        assert check_pieces(pieces, {r["doc_id"]: r["text"] for r in df.collect()}, encode) == 0
    assert packing.pack_documents(empty, tokenizer_path(TOKENIZER_FILE), token_pattern()).count() == 0


def test_packer_minimises_squares():
    rng = random.Random(0)
    packer = packing.LevelPacker(capacity=20, max_open=10_000)
    for i in range(300):
        size = rng.randint(1, 19)
        before = packer.levels[1:20].copy()
        choices = {}
        for level in range(0, 21 - size):
            if level == 0 or before[level - 1]:
                after = before.copy()
                if level:
                    after[level - 1] -= 1
                if level + size < 20:
                    after[level + size - 1] += 1
                choices[level] = int((after**2).sum())
        packer.place((i, 0, b"\0" * 4 * size, size))
        assert int((packer.levels[1:20] ** 2).sum()) == min(choices.values())


def test_packer_bounds_open_windows():
    windows = list(packing.pack_stream(((i, np.full(15, i, np.uint32)) for i in range(500)), 20, 8))
    sizes = [sum(len(p[2]) // 4 for p in w) for w in windows]
    assert sum(sizes) == 7500 and all(s == 20 or s & (s - 1) == 0 for s in sizes)


# 3 quality


def test_quality(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op3_quality"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert (found.held_out == found.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = found[found.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.93
    assert quality.score_quality(docs, None).count() == len(EDGES) and quality.score_quality(empty, None).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit_quality_model(docs, labels) is None
    model = quality.fit_quality_model(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(1, 11)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int"))
    scores = [r["score"] for r in quality.score_quality(docs, model).collect()]
    assert all(0 <= s <= 1 for s in scores)


def test_non_negative_risk_learns_from_positives():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, (400, 5)).astype(np.float32)
    mixed = np.vstack([rng.normal(2, 1, (600, 5)), rng.normal(-2, 1, (400, 5))]).astype(np.float32)
    model = quality.fit(positive, mixed, steps=600)
    assert 0.4 < model.prior < 0.95
    assert ((model.raw(mixed) > 0) == (np.arange(1000) < 600)).mean() > 0.95


# 4 exact deduplication


def plain_groups(rows):
    groups = {}
    for doc, text in rows:
        norm = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        groups.setdefault(norm, []).append(doc)
    return {norm: (max((d for d in ids if d is not None), default=None), len(ids)) for norm, ids in groups.items()}


@pytest.mark.parametrize("bits", [exact_dedup.SEGMENT_BITS, 256])
def test_exact_dedup(spark, docs, empty, bits):
    assert exact_dedup.filter_words(len(EDGES), 256)[1] > 1
    got = exact_dedup.exact_dedup(docs, segment_bits=bits).collect()
    expected = plain_groups([(r[0], r[1]) for r in EDGES])
    assert len(got) == len(EDGES)
    by_sha = {hashlib.sha256(n.encode()).hexdigest(): v for n, v in expected.items()}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == by_sha[r["text_sha256"]] and r["kept"] == (r["doc_id"] == r["keep_id"])
    assert exact_dedup.exact_dedup(empty, segment_bits=bits).count() == 0
    kept = exact_dedup.drop_exact_copies(docs, segment_bits=bits)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == {2, 4, 5, 6, 7, 8, 9, 10}


@pytest.mark.parametrize("bits", [exact_dedup.SEGMENT_BITS, 64 * 64])
def test_few_unique_rows_are_flagged(spark, bits):
    """All rows that repeat and few others go on, with one segment and with several."""
    texts = spark.range(3000).select(F.concat(F.lit("text "), F.when(F.col("id") < 300, F.col("id") % 100).otherwise(F.col("id"))).alias("text_sha256"))
    words, segments = exact_dedup.filter_words(3000, bits)
    digests = texts.withColumn("sig", exact_dedup.signature(F.col("text_sha256"), words))
    if segments > 1:
        digests = digests.withColumn("segment", F.expr(f"cast(sig div {4096 * (words // segments)} as int)"))
    flagged = exact_dedup.flag_possible_repeats(digests, words, segments)
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Subquery")[0] and "Join" not in plan.split("Subquery")[0]
    rows = [(r["text_sha256"], r["maybe"]) for r in flagged.collect()]
    assert len(rows) == 3000
    assert sum(m for t, m in rows if int(t.split()[1]) < 100) == 300 and sum(m for _, m in rows) < 330


def test_exact_dedup_has_no_python(spark, docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 5 byte-level BPE


@pytest.fixture(scope="module")
def reference_encoding():
    import tiktoken

    ranks = tokens.load_ranks(tokenizer_path(RANK_FILE))
    return tiktoken.Encoding("own", pat_str=token_pattern(), mergeable_ranks=ranks, special_tokens={})


def test_transducer_against_library(reference_encoding, real):
    encoder, transducer = bpe.rank_encoder(tokenizer_path(RANK_FILE), token_pattern())
    rng = random.Random(5)
    vocabulary = list(transducer.ranks)
    texts = [r["text"] for r in real.limit(100).collect()] + [t for _, t, *_rest in EDGES if t]
    for _ in range(1500):
        texts.append(b"".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6))).decode(errors="ignore"))
        texts.append("".join(rng.choice("abcdet 1\n'sé漢🙂  ") for _ in range(rng.randint(0, 30))))
    for text in texts:
        ids = encoder.encode(text)
        assert ids == reference_encoding.encode_ordinary(text)
        assert "".join(bpe.stream_decode(ids, transducer.tokens)) == text


def test_transducer_survives_resets(reference_encoding):
    small = bpe.BpeTransducer(tokens.load_ranks(tokenizer_path(RANK_FILE)), max_states=5)
    text = "unbelievablyantidisestablishmentarianismpneumonoultramicroscopic"
    assert small.encode(text.encode()) == reference_encoding.encode_ordinary(text)


def test_utf8_machine_replaces_broken_parts():
    rng = random.Random(2)
    for _ in range(500):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE6, 0xBC, 0xA2, 0xF0, 0x9F, 0x99, 0x82, 0xFF, 0x80, 0xED, 0xA0]) for _ in range(rng.randint(0, 12)))
        machine = bpe.Utf8Machine()
        cut = rng.randint(0, len(data))
        assert machine.push(data[:cut]) + machine.push(data[cut:]) + machine.finish() == data.decode(errors="replace")


def test_bpe_documents(spark, docs, empty, reference_encoding):
    path, pattern = tokenizer_path(RANK_FILE), token_pattern()
    for frame in (bpe.round_trip_documents(docs, path, pattern), bpe.decode_documents(bpe.encode_documents(docs, path, pattern), path, pattern)):
        got = sorted((r["doc_id"] or 0, list(r["ids"]), r["text"]) for r in frame.collect())
        assert got == sorted((d or 0, reference_encoding.encode_ordinary(t or ""), t or "") for d, t, *_rest in EDGES)
    assert bpe.round_trip_documents(empty, path, pattern).count() == 0


# 6 chat


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice(["\\", "<|", "|>", "<", "|", ">", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|end|>", "<|text|>", "a", "\n", "<<SYS>>", "é"]) for _ in range(rng.randint(0, 8)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not any(mark in escaped for mark in (chat.TURN, chat.TEXT, chat.END, "[INST]", "</s>"))
        rendered, start, end = chat.segment("user", text)
        assert chat.parse_segment(rendered) == ("user", text) and chat.unescape(rendered[start:end]) == text


def plain_fold(events):
    """Final (turn, role, text) of one conversation's events in order."""
    state = {}
    for _, event, turn, role, text in sorted(events, key=lambda e: e[0]):
        if event != "delta":
            state = {t: v for t, v in state.items() if t < turn}
        known = state.get(turn, ("", ""))
        fresh = "" if event == "regenerate" else text or ""
        state[turn] = (role or known[0], fresh if event != "delta" else known[1] + fresh)
    return [(t, *state[t]) for t in sorted(state)]


def test_events_fold(spark):
    rng = random.Random(9)
    rows = []
    for conv in range(40):
        for seq in range(rng.randint(1, 25)):
            event = rng.choice(["delta", "delta", "delta", "edit", "regenerate"])
            turn = rng.randint(0, 4)
            rows.append((conv, seq, event, turn, "assistant" if turn % 2 else "user", rng.choice(["a", "b<|end|>", None, "\\", ""])))
    log = spark.createDataFrame(rows, "conv_id long, seq long, event string, turn long, role string, text string")
    got = {}
    for r in chat.render(log.repartition(3)).orderBy("conv_id", "part").collect():
        got.setdefault(r["conv_id"], []).append(chat.parse_segment(r["segment"]))
    expected = {c: [(role, text) for _, role, text in plain_fold([r[1:] for r in rows if r[0] == c])] for c in range(40)}
    assert got == expected


def test_chat_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect() + chat.samples(spark).collect()
    got = {r["conv_id"]: r for r in QUERIES["op6_chat_format"](spark, SF).collect()}
    by = {}
    for r in rows:
        by.setdefault(r["conv_id"], []).append(r)
    assert set(got) == set(by) and -1 in got
    for conv, turns in by.items():
        turns.sort(key=lambda r: r["turn"])
        loss = "".join(r["text"] or "" for r in turns if r["role"] == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r['role']}\n{r['text'] or ''}\n" for r in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"], got[conv]["n_turns"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(turns))


def test_chat_edges(spark):
    turns = spark.createDataFrame([(1, 0, None, None), (1, 1, "assistant", ""), (None, 0, "user", "x" * 1000)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.turns_as_log(turns))).collect()}
    assert got[1]["n_turns"] == 2 and got[1]["loss_chars"] == 0 and got[None]["n_turns"] == 1
    assert chat.read_back(chat.render(chat.turns_as_log(turns.limit(0)))).count() == 0


# 7 suffix arrays


def test_suffix_array_and_prefixes(monkeypatch):
    rng = np.random.default_rng(0)
    for trial in range(300):
        monkeypatch.setattr(sa, "INDUCE_NAMES", [1, 3, 1000][trial % 3])
        text = np.r_[rng.integers(1, rng.integers(2, 6), rng.integers(0, 60)), 0].astype(np.uint16)
        expected = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        array = sa.suffix_array(text)
        assert array.tolist() == expected
        prefixes = np.zeros(len(text), int)
        for x, y in zip(array, array[1:]):
            while prefixes[y] < 5 and max(x, y) + prefixes[y] < len(text) and text[x + prefixes[y]] == text[y + prefixes[y]]:
                prefixes[y] += 1
        assert sa.permuted_lcp(text, array, np.array([0]), np.array([len(text)]), 5).tolist() == prefixes.tolist()


def test_every_stretch_has_an_anchor(monkeypatch):
    data = np.frombuffer(random.Random(3).randbytes(3000) + b"a" * 300, np.uint8)
    whole = anchors.anchors(data)
    for at in range(len(data) - anchors.WINDOW + 1):
        assert ((whole[0] >= at) & (whole[0] + anchors.GRAM <= at + anchors.WINDOW)).any()
    monkeypatch.setattr(anchors, "_CHUNK", 500)
    for a, b in zip(whole, anchors.anchors(data)):
        assert (a == b).all()


def test_anchors_and_their_stretches():
    rng = random.Random(1)
    for trial in range(150):
        data = np.array([rng.randrange(rng.choice([1, 2, 3, 200])) for _ in range(rng.randint(0, 300))], np.uint8)
        if trial % 3 == 0:
            data = np.tile(data[:37], 8)
        grams = anchors.gram_hashes(data) if len(data) >= anchors.WINDOW else np.zeros(0, np.uint64)
        common = anchors.CommonGrams(np.array(rng.sample(list(grams), len(grams) // 3), np.uint64)) if trial % 2 else anchors.NONE
        known, span, expected = set(common.hashes.tolist()), anchors.WINDOW - anchors.GRAM + 1, {}
        order = [(int(g) in known, int(g) >> 1 if known else int(g)) for g in grams]
        for j in range(len(data) - anchors.WINDOW + 1):
            least = min(order[j : j + span])
            for q in range(j, j + span):
                if order[q] == least:
                    expected.setdefault(q, []).append(j)
        place, _, _, start, end = anchors.anchors(data, common)
        assert {p: (s, e) for p, s, e in zip(place.tolist(), start.tolist(), end.tolist())} == {q: (min(js), max(js) + anchors.WINDOW) for q, js in expected.items()}


def plain_removal(rows):
    out, seen = [], {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        data = (rows[i][1] or "").encode()
        key = (rows[i][0] is None, rows[i][0] or 0)
        mask = bytearray(len(data))
        for j in range(len(data) - 49):
            if seen.setdefault(data[j : j + 50], key) < key:
                mask[j : j + 50] = b"\1" * 50
        out.append((rows[i][0], len(data), sum(mask), len([p for p in bytes(mask).split(b"\0") if p]), bytes(c for c, m in zip(data, mask) if not m)))
    return sorted(out, key=str)


def passages(seed=4):
    rng = random.Random(seed)
    words = ["stone", "river", "été", "漢字", "light", "a", "of", "night"]
    shared = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 30))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join("%x" % rng.getrandbits(40) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(0, 6))]
        rows.append((i * 3, " ".join(parts) * (2 if rng.random() < 0.1 else 1)))
    return rows


def test_substring_removal_against_all_windows(spark, docs, empty, real):
    for rows in (passages(), [(r[0], r[1]) for r in EDGES], [(r["doc_id"], r["text"]) for r in real.collect()]):
        got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=str) == plain_removal(rows)
        few = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), common_docs=5, local_docs=2).collect()
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in few), key=str) == plain_removal(rows)
    assert substring_dedup.substring_dedup(empty).count() == 0
    passage = "a passage of well over fifty bytes that two documents have in common, word by word."
    again = [(9, passage), (5, "short"), (5, "before " + passage + " after"), (3, passage[:60] + "x")]
    got = substring_dedup.substring_dedup(spark.createDataFrame([*again, (12, passage)], "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=str) == plain_removal([*again, (12, passage)])


def test_stages_keep_columns_of_any_name(spark, docs, empty):
    """Every stage's rows on edge cases, with columns named as those that operators make."""
    import corpus_pipeline

    clash = ["kept", "bucket", "_id", "_text", "_row", "n_removed", "score", "lang_pred", "row", "id", "key", "sig", "maybe", "_dropped"]
    wide = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in clash])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, SF)
        assert got.columns == wide.columns and [f.dataType for f in got.schema] == [f.dataType for f in wide.schema], name
        rows = got.collect()
        assert rows and all(r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in clash), name
        assert stage(spark, wide.limit(0), SF).count() == 0, name
    ids = lambda name: sorted(str(r["doc_id"]) for r in dict(corpus_pipeline.STAGES)[name](spark, docs, SF).collect())
    assert ids("language_id") == sorted(["3", "4", "5", "5", "6", "7", "10", "None"])
    assert ids("exact_dedup") == sorted(["2", "4", "5", "6", "7", "8", "9", "10"])
    packed = corpus_pipeline.STAGES[-1][1](spark, wide, SF).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in EDGES}
    assert corpus_pipeline.STAGES[-1][1](spark, wide.limit(0), SF).count() == 0


# 8 language


def test_language(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op8_language_id"](spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").toPandas(), on="doc_id")
    assert (found.held_out == found.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = found[found.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    net = language_id.fit_language_model(docs, F.lit(True))
    rows = {r["doc_id"]: r for r in language_id.identify(docs.withColumn("score", F.lit("clash")), net).collect()}
    assert {i for i, r in rows.items() if r["lang_pred"] == "und"} == {1, 2, 8, 9} and rows[1]["score"] == 0.0
    assert language_id.fit_language_model(empty, F.lit(True)) is None
    assert [r["lang_pred"] for r in language_id.identify(docs, None).collect()] == ["und"] * len(EDGES)
    assert language_id.identify(empty, net).count() == 0


def test_digits_of_any_kind_are_no_letters():
    net = language_id.ByteNetwork.fresh(["a", "b"])
    found = [p for p, _ in language_id.predictions(net, ["½ ² Ⅷ 12 _", "ª", "漢", "é", None, ""])]
    assert [p == "und" for p in found] == [True, False, False, False, True, True]


def test_windows_cover_text():
    for n in (0, 1, 252, 253, 256, 257, 1000):
        windows = language_id.windows_of("x" * n)
        step = language_id.WINDOW - language_id.SPAN + 1
        covered = sum(int((w[:step] != 0).sum()) for w in windows[:-1]) + int((windows[-1] != 0).sum())
        assert covered == n


# 9 SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


@pytest.mark.parametrize("block", [2_000_000, 10])
def test_simhash_components(spark, real, docs, empty, block):
    for frame in (real, docs):
        rows = frame.select("doc_id", "text").collect()
        got = simhash.near_duplicates(frame, block=block).collect()
        assert len(got) == len(rows)
        ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        prints = {i: plain_fingerprint(t) for i, t in ((r["doc_id"], r["text"]) for r in rows) if i is not None}
        names = sorted(set(ids))
        find = union_find(len(names), [(a, b) for a, b in combinations(range(len(names)), 2) if (prints[names[a]] ^ prints[names[b]]).bit_count() <= 4])
        for r in got:
            if r["doc_id"] is not None:
                assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == names[find(names.index(r["doc_id"]))]
    assert simhash.near_duplicates(empty, block=block).count() == 0


def test_links_of_random_prints(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (1 << 64) - 1 for b in base for _ in range(40)})
    frame = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    for block in (2_000_000, 15):
        links = [(r["a"], r["b"]) for r in simhash.near_links(frame, block=block).collect()]
        index = {simhash.signed(v): i for i, v in enumerate(values)}
        found = union_find(len(values), [(index[a], index[b]) for a, b in links])
        exact = union_find(len(values), [(i, j) for i, j in combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 4])
        assert [found(i) for i in range(len(values))] == [exact(i) for i in range(len(values))]


def test_allocation_is_least():
    costs = [[0.0, 5.0, 9.0, 20.0], [0.0, 1.0, 2.0, 30.0], [0.0, 4.0, 4.5, 4.6]]
    best = min((costs[0][a + 1] + costs[1][b + 1] + costs[2][c + 1]) for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 2)
    cost, chosen = simhash.allocate(costs, 2)
    assert cost == best and sum(chosen) == 2


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(80)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    find = union_find(301, edges)
    assert got == {n: find(n) for n in {x for e in edges if e[0] != e[1] for x in e}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 10 SpotSigs


def test_spotsigs(spark, docs, real, empty):
    for frame in (real, docs.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in frame.collect()), key=lambda r: r[0])
        got = {r["doc_id"]: r for r in spotsigs.fingerprint_edits(frame.repartition(5)).collect()}
        assert len(got) == len(rows)
        for i, (doc, text) in enumerate(rows):
            following = rows[(i + 1) % len(rows)][1]
            half = len(text) // 2
            changed = text[: len(text) - half] + following[:half]
            a, b, c = (set(spotsigs.signatures(t).tolist()) for t in (text, changed, following))
            r = got[doc]
            assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
            assert r["near_edited"] == len(a & b) / len(a | b) and r["near_next"] == len(a & c) / len(a | c)
            assert set(spotsigs.from_string(r["fingerprint"]).tolist()) == a and set(spotsigs.from_string(r["edited_fingerprint"]).tolist()) == b
    assert spotsigs.fingerprint_edits(empty).count() == 0
    one = spotsigs.fingerprint_edits(docs.filter("doc_id = 3")).first()
    assert one["near_next"] == 1.0
    assert spotsigs.fingerprint_edits(docs).count() == len(EDGES)


def test_similar_pairs_loses_none(spark):
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 1 << 32, rng.integers(1, 40), dtype=np.uint32) for _ in range(20)]
    rows = []
    for i in range(120):
        found = base[i % 20].copy()
        found[: rng.integers(0, 4)] = rng.integers(0, 1 << 32, 1, dtype=np.uint32)
        rows.append((i, spotsigs.as_string(np.unique(found))))
    reps = {}
    for i, text in rows:
        reps.setdefault(text, i)
    expected = {}
    for (x, a), (y, b) in combinations(reps.items(), 2):
        p, q = set(spotsigs.from_string(x).tolist()), set(spotsigs.from_string(y).tolist())
        if len(p & q) / len(p | q) >= 0.8:
            expected[min(a, b), max(a, b)] = round(len(p & q) / len(p | q), 9)
    got = {(r["a"], r["b"]): round(r["likeness"], 9) for r in spotsigs.similar_pairs(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()}
    assert got == expected and expected


# the pipeline


def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "passage_dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == columns
        frame = spark.createDataFrame(frame.collect(), frame.schema)
        if name == "language_id":
            rows = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
        elif name == "exact_dedup":
            last = {}
            for i in sorted(rows):
                last[re.sub("[A-Z]", lambda m: m[0].lower(), rows[i])] = i
            rows = {i: rows[i] for i in last.values()}
        elif name == "near_dedup":
            ids = sorted(rows)
            prints = [plain_fingerprint(rows[i]) for i in ids]
            find = union_find(len(ids), [(a, b) for a, b in combinations(range(len(ids)), 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
            rows = {i: rows[i] for k, i in enumerate(ids) if find(k) == k}
        else:
            left = {r[0]: r[4].decode(errors="ignore") for r in plain_removal(list(rows.items())) if not r[2] or r[4].decode(errors="ignore")}
            rows = left
        got = {r["doc_id"]: r["text"] for r in frame.collect()}
        assert got == rows, name
    total = sum(r["length"] for r in corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect())
    assert total == sum(r["length"] for r in corpus_pipeline.run(spark, SF).collect()) > 0


def test_line_dedup_by_edit_similarity_alone(spark):
    """Every pair has a vocabulary of its own, so that links over third lines can't stand in for its own."""
    rng = random.Random(7)
    rows, planned = [], 0
    for k in range(240):
        size = (2, 6, 15, 27, 60)[k % 5]
        alphabet = "".join(chr(0x4E00 + rng.randrange(8000)) for _ in range(60)) if k % 4 == 3 else "abcdefghijklmnopqrstuvwxyz"
        words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(2, 9))) for _ in range(size)]
        line = ("" if k % 4 == 3 else " ").join(words)
        at = rng.randrange(len(line))
        if k % 3 == 0 and k % 4 != 3:
            i = rng.randrange(size)
            words[i] = "".join(rng.choice(alphabet) for _ in words[i])
            other = " ".join(words)
        else:
            other = line[:at] + "é" + line[at + 1 :] if line[at] != " " else line + "\r"
        rows += [(2 * k, line), (2 * k + 1, other)]
        planned += plain_similar(line, other)
    going = {r["doc_id"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["n_removed"]}
    expected = {2 * k + 1 for k in range(240) if rows[2 * k][1] == rows[2 * k + 1][1] or plain_similar(rows[2 * k][1], rows[2 * k + 1][1])}
    assert planned > 150 and going <= expected
    assert len(going) >= 0.98 * len(expected), (len(going), len(expected))


def test_packing_ids_at_the_library_default(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(TOKENIZER_FILE))
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    ours = tokens.vocabulary_encoder(tokenizer_path(TOKENIZER_FILE), token_pattern())
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "a  <|endoftext|>\n", "<|endoftext", ""):
        assert ours(text) == encode(text)
    df = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    pieces = packing.with_checksums(packing.pack_documents(df, tokenizer_path(TOKENIZER_FILE), token_pattern())).collect()
    assert check_pieces(pieces, {r["doc_id"]: r["text"] for r in df.collect()}, encode) == 0


def test_copies_are_dropped_by_row(spark, docs):
    kept = exact_dedup.drop_exact_copies(docs).collect()
    same = [r for r in kept if r["text"] and r["text"].endswith("thirteen.")]
    assert [r["doc_id"] for r in same] == [5]
    a, b = "first words of one text that goes on for a while", "quite another story told by somebody else at sea"
    frame = spark.createDataFrame([(5, a, 1), (7, a, 2), (5, b, 3), (None, "alone", 4), (None, "alone", 5), (None, b.upper(), 6)], "doc_id long, text string, n int")
    for drop, first in ((exact_dedup.drop_exact_copies, 2), (simhash.drop_near_duplicates, 1)):
        left = drop(frame).collect()
        expected = [(None, "alone", 4), (5, b, 3), (7, a, 2) if first == 2 else (5, a, 1)]
        got = [tuple(r) for r in left if r["n"] != 6]
        assert sorted(got, key=str) == sorted(expected, key=str)
    assert sum(r["n"] == 6 for r in exact_dedup.drop_exact_copies(frame).collect()) == 0
