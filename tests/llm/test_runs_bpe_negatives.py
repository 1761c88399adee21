"""Periodic runs, byte-level BPE and hard negatives against plain versions."""

import functools
import random
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from corpusloom.llm import blocks, byte_bpe, hard_negatives, periodic_runs

# periodic runs


def plain_runs(words, min_length=24, repeats=3):
    found, n = {}, len(words)
    for period in range(1, n // repeats + 1):
        at = period
        while at < n:
            begin = at
            while at < n and words[at] == words[at - period]:
                at += 1
            if at - begin + period >= max(min_length, repeats * period) and at > begin:
                found.setdefault((begin - period, at - begin + period), period)
            at += 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repeating(seed):
    draw, words = random.Random(seed), []
    letters = draw.choice([1, 2, 2, 3, 50])
    for _ in range(draw.randrange(12)):
        if draw.random() < 0.7:
            base = [str(draw.randrange(letters)) for _ in range(draw.choice([1, 2, 3, 4, 5, 7, 8, 9, 12, 20, 30]))]
            if draw.random() < 0.3:
                base = base * draw.choice([3, 6]) + [str(draw.randrange(letters))]
            if words and draw.random() < 0.2:
                base = words[(at := draw.randrange(len(words))) : at + 40]
            words += (base * 6)[: draw.randrange(1, 6 * len(base) + 1)]
        else:
            words += [str(draw.randrange(60)) for _ in range(draw.randrange(30))]
    return words


@pytest.mark.parametrize("min_length, repeats", [(24, 3), (10, 3), (24, 4)])
def test_runs_equal_brute_force(documents, min_length, repeats):
    texts = [repeating(seed) for seed in range(300)]
    df = documents([(i, " ".join(w), "a") for i, w in enumerate(texts)]).repartition(5)
    got = {r.id: r for r in periodic_runs.found(df, min_length=min_length, repeats=repeats).collect()}
    some = 0
    for i, words in enumerate(texts):
        want = plain_runs(words, min_length, repeats)
        some += len(want)
        assert [tuple(x) for x in got[i].runs] == want
        assert got[i].n_words == len(words) and got[i].collapsed == plain_collapsed(words, want)
    assert some > 100


def test_runs_of_odd_rows(documents):
    long = "x y " * 60_000
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a b " * 30), (5, "a b c " * 8), (5, "a b c " * 8), (6, long + "end " + long), (None, "z " * 24)]
    df = documents([(i, t, "s") for i, t in rows], extra=True)
    got = [(r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.found(df).collect()]
    assert got[:3] == [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], "")]
    assert got[3] == (4, 30, [(0, 30, 1)], "a b")
    assert got[4] == got[5] == (5, 24, [(0, 24, 3)], "a b c")
    assert got[6] == (6, 240_001, [(0, 120_000, 2), (120_001, 120_000, 2)], "x y end x y")
    assert got[7] == (None, 24, [(0, 24, 1)], "z")
    assert periodic_runs.found(documents([])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.found(df, repeats=2)


def test_many_lines_with_a_counter_are_no_runs(documents):
    text = "\n".join(f"error at line {i} in module foo bar baz qux quux" for i in range(20_000))
    row = periodic_runs.found(documents([(1, text, "a")])).first()
    assert row.runs == [] and row.n_words == 220_000


# byte-level BPE


@pytest.fixture(scope="module")
def known():
    return byte_bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(known):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known.ranks, special_tokens={})


SIGNS = "abcdeABC xyz  \n\t0123456789éüñ中文字符日本語кириллица==--__..  Ᲊ\U000323b0​😀\x00\x1c'sll"


def test_bpe_equals_the_library(documents, known, library):
    draw = random.Random(3)
    texts = ["".join(draw.choices(SIGNS, k=draw.randrange(300))) for _ in range(600)]
    texts += ["x" * 20_000, "=-" * 3000, "中" * 4000, "aaab" * 2000, "".join(draw.choices("abcde", k=3000)), "<|endoftext|> it's", " ", ""]
    df = documents([(i, t, "a") for i, t in enumerate(texts)]).repartition(6)
    got = {r.id: r for r in byte_bpe.decoded(byte_bpe.encoded(df, known), known).collect()}
    for i, text in enumerate(texts):
        assert got[i].ids == library.encode_ordinary(text)
        assert bytes(got[i].bytes) == text.encode()


@pytest.mark.parametrize("short", [0, 255])
def test_both_recursive_queries_give_the_same(known, library, short, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SHORT", short)
    codec, draw = byte_bpe.Codec(known), random.Random(short)
    texts = ["".join(draw.choices("abcdeéü中文 ", k=draw.randrange(60))) for _ in range(400)]
    ids, bounds = codec.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode_ordinary(t) for t in texts]


def test_bpe_of_odd_rows(documents, known, spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "same words", "a"), (3, "same words", "a"), (None, "same words", "b")]
    got = byte_bpe.encoded(documents(rows, extra=True), known).collect()
    assert [r.ids for r in got[:2]] == [[], []] and got[2].ids == got[3].ids == got[4].ids != []
    ids = spark.createDataFrame([(1, None), (2, []), (3, [999_999]), (4, [known.ranks[b"\xe4"]])], "id long, ids array<int>")
    assert [bytes(r.bytes) for r in byte_bpe.decoded(ids, known).collect()] == [b"", b"", b"", b"\xe4"]
    assert byte_bpe.encoded(documents([]), known).count() == 0


def test_blocks_wait_for_new_pieces_and_one_engine_serves_both_ways(documents, known, library, monkeypatch):
    monkeypatch.setattr(blocks, "blocks", functools.partial(blocks.blocks, limit=200))
    for name, value in (("NEW_BYTES", 150), ("WAITING_BYTES", 900), ("WORD_BYTES", 40), ("DECODED_IDS", 60)):
        monkeypatch.setattr(byte_bpe, name, value)
    draw = random.Random(5)
    texts = ["".join(draw.choices(SIGNS, k=draw.randrange(90))) for _ in range(150)] + ["", None, "same words", "same words", "x" * 999]
    codec, asked, waited = byte_bpe.Codec(known), [], []
    monkeypatch.setattr(codec, "merged", lambda words, long, whole=codec.merged: asked.append(sum(map(len, words)) * (len(words) > 1)) or whole(words, long))
    monkeypatch.setattr(codec, "learn", lambda whole=codec.learn: waited.append(sum(map(len, codec.kept.fresh))) or whole())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    got = {}
    for names, ids, bounds in byte_bpe._tokens(codec, batch):
        raw = [x for _, _, part in byte_bpe._bytes(codec, ids, bounds) for x in part.to_pylist()]
        got.update(zip(names.to_pylist(), zip((ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])), raw)))
    assert got == {i: (library.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts)}
    assert max(asked) <= 40 and len(waited) < sum(1 for _ in blocks.blocks(batch.column(1)))
    df = documents([(i, t, "a") for i, t in enumerate(texts)]).repartition(3)
    made = byte_bpe.round_trip(df, known)
    assert {r.id: (r.ids, bytes(r.bytes)) for r in made.collect()} == got
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_pieces_are_remembered_within_a_bound(known, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_PIECES", len(known.ranks))
    codec = byte_bpe.Codec(known)
    for part in range(5):
        texts = [f"word{part}x{i} gleichbleibend" for i in range(200)]
        ids, bounds = codec.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library.encode_ordinary(t) for t in texts]
    assert len(codec.kept) < len(known.ranks) + 2000


# hard negatives

ITEMS = "id long, label int, embedding array<float>, score long, kind string, number int"


def plain_negatives(rows, chosen, rule=hard_negatives.Rule()):
    from math import floor, isfinite

    ok = {(i, l, tuple(floor(256 * x) for x in v)) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and isfinite(x) for x in v)}
    out = []
    for a, la, va in sorted(r for r in ok if chosen(r[0])):
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, l) for i, l, v in ok if len(v) == len(va))
        seen, near = set(), []
        for s, i, l in scored:
            if l == la and i != a and (s, i) not in seen:
                seen.add((s, i))
                near.append((-s, i))
        for ps, p in near[: rule.positives]:
            fit = sorted({(s, i) for s, i, l in scored if l != la and rule.low * ps <= -100 * s <= rule.high * ps})
            out += [(a, p, k, i, ps, -s) for k, (s, i) in enumerate(fit[: rule.negatives], 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], ITEMS).repartition(7)
    df = df.withColumn("vector", hard_negatives.scaled(F.col("embedding")))
    return sorted(tuple(r) for r in hard_negatives.mined(df, F.col("id") % 5 == 0, **kw).collect())


def vectors(seed, n, parts=(0.0, 0.25, 0.5, 1.0, -0.5), size=4, labels=3):
    draw = random.Random(seed)
    return [(i, draw.randrange(labels), [draw.choice(parts) for _ in range(size)]) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_negatives_equal_brute_force(spark, seed):
    rows = vectors(seed, 200)  # few different values: many ties
    want = plain_negatives(rows, lambda i: i % 5 == 0)
    assert len(want) > 100
    assert mined(spark, rows) == want
    assert mined(spark, rows, max_broadcast_bytes=0, cell_bytes=4000) == want  # blocks of anchors against blocks of rows
    rule = hard_negatives.Rule(positives=2, negatives=4, low=10, high=99)
    assert mined(spark, rows, rule=rule) == plain_negatives(rows, lambda i: i % 5 == 0, rule)


def test_negatives_with_hot_vectors_and_copies(spark):
    rows = [(i, i % 2, [0.5, 0.25]) for i in range(300)] + [(300 + i, 2, [0.4, 0.2]) for i in range(300)] + vectors(9, 50, size=2)[:0]
    rows += [(5, 1, [0.5, 0.25])] * 40 + [(301, 2, [0.4, 0.2])] * 40  # repeated rows count once
    assert mined(spark, rows) == plain_negatives(rows, lambda i: i % 5 == 0)


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 0.0]), (2, 0, [0.6, 0.1]), (3, 0, [0.0, 0.0]), (4, None, [0.6, 0.1]), (6, 0, None), (7, 0, [nan, 1.0]), (8, 0, [inf, 1.0]), (9, 0, [None, 1.0]),
            (None, 0, [0.7, 0.0]), (10, 1, [0.0, 0.0]), (11, 1, [0.0, -1.0]), (12, 0, [0.7]), (15, 4, []), (16, 4, []), (17, 5, [])]
    want = plain_negatives(rows, lambda i: i % 5 == 0)
    assert (10, 0, 1, 2, 0, 0) in want  # scores of 0: the window is 0 alone
    assert mined(spark, rows) == want
    assert mined(spark, []) == []


def test_products_beyond_doubles_stay_exact(spark):
    rows = [(0, 1, [1.1e7, 3.0]), (1, 1, [1.3e6, 1.0]), (2, 0, [0.9e6, 7.0]), (3, 0, [0.8e6, 5.0])]
    import numpy as np

    exact = [(i, l, [float(np.float32(x)) for x in v]) for i, l, v in rows]
    assert mined(spark, rows) == plain_negatives(exact, lambda i: i % 5 == 0) != []
    assert (hard_negatives._products(np.array([[1e18, 1.0]]), np.array([[1e18, 1.0]])) == 2**63 - 1).all()
