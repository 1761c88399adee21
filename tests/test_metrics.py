import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import metrics as mt

PAIRS = [
    ("hello there", ["hello there"]),
    ("the cat sat on the mat", ["the cat is on the mat", "there is a cat on the mat"]),
    ("completely different", ["nothing alike whatsoever"]),
    ("", ["reference"]),
    ("the the the", ["the cat the"]),
    ("first line here\nsecond one", ["second one\nfirst line", "other"]),
]


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i, p, r) for i, (p, r) in enumerate(PAIRS)]
    return spark.createDataFrame(rows, "id int, prediction string, references array<string>")


def tok(text):
    return re.findall(r"[a-z0-9]+", text.lower())


def f1(hit, p, r):
    return 2 * (hit / p) * (hit / r) / (hit / p + hit / r) if hit else 0.0


def plain_rouge(pred, refs, n):
    grams = lambda ws: Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    a = grams(tok(pred))
    return max(f1(sum((a & grams(tok(r))).values()), sum(a.values()), sum(grams(tok(r)).values())) for r in refs)


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_rouge_n_and_l_match_brute_force(pairs):
    rows = {r.id: r for r in mt.rouge_lsum(mt.rouge_l(mt.rouge_n(pairs))).collect()}
    for i, (pred, refs) in enumerate(PAIRS):
        assert rows[i].rouge1 == pytest.approx(plain_rouge(pred, refs, 1))
        assert rows[i].rouge2 == pytest.approx(plain_rouge(pred, refs, 2))
        want = max(f1(plain_lcs(tok(pred), tok(r)), len(tok(pred)), len(tok(r))) for r in refs)
        assert rows[i].rougeL == pytest.approx(want)
    assert rows[0].rougeLsum == 1.0 and rows[3].rougeLsum == 0.0
    assert rows[5].rougeLsum == pytest.approx(f1(4, 5, 4)) and rows[5].rougeL < rows[5].rougeLsum


def test_lcs_bit_vector():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (list(map(str, rng.integers(0, 5, rng.integers(0, 90)))) for _ in range(2))
        assert mt.lcs_length(a, b) == len(mt.lcs_positions(a, b)) == plain_lcs(a, b)


def test_bleu_goldens(spark):
    df = spark.createDataFrame(
        [("hello there general kenobi", ["hello there general kenobi", "hello there!"]), ("foo bar foobar", ["foo bar foobar"])],
        "prediction string, references array<string>",
    )
    row = mt.bleu(df).first()
    assert row.bleu == 1.0 and row.brevity_penalty == 1.0 and row.translation_length == 7
    short = spark.createDataFrame([("the cat sat on", ["the cat sat on the mat"])], "prediction string, references array<string>")
    row = mt.bleu(short).first()
    assert row.bleu == pytest.approx(math.exp(1 - 6 / 4)) and row.length_ratio == pytest.approx(4 / 6)
    none = spark.createDataFrame([("x y", ["a b"])], "prediction string, references array<string>")
    assert mt.bleu(none).first().bleu == 0.0
    assert mt.bleu(none, smooth=True).first().precision1 == pytest.approx(1 / 3)
    assert mt.bleu(none.limit(0)).first().bleu == 0.0


def test_pluggable_tokenizer(spark):
    df = spark.createDataFrame([("电路设计", ["电路图"])], "prediction string, references array<string>")
    row = mt.rouge_l(mt.rouge_n(df, (1,), mt.BatchTokenizer(list)), mt.BatchTokenizer(list)).first()
    assert row.rouge1 == pytest.approx(f1(2, 4, 3)) and row.rougeL == pytest.approx(f1(2, 4, 3))
    assert mt.rouge_n(df, (1,)).first().rouge1 == 0.0


def test_bert_score(spark):
    df = spark.createDataFrame(
        [([[1.0, 0.0], [0.0, 2.0]], [[3.0, 0.0]]), ([], [[1.0, 0.0]])],
        "prediction_vectors array<array<double>>, reference_vectors array<array<double>>",
    )
    got = [(r.precision, r.recall, round(r.f1, 6)) for r in mt.bert_score(df).collect()]
    assert got == [(0.5, 1.0, 0.666667), (0.0, 0.0, 0.0)]


def test_overlap_verdict(spark):
    cases = [
        ("", "x", False), ("Retrieved Chunks:\n[1]", "x", False), ("anything", "", True), ("a", "a b c d e", True),
        ("a", "a b c d e f", False), ("  ", None, False), ("答案", "答 案 x", True),
    ]
    df = spark.createDataFrame([(i, a, r) for i, (a, r, _) in enumerate(cases)], "i int, a string, r string")
    got = [r[0] for r in df.orderBy("i").select(mt.overlap_verdict(F.col("a"), F.col("r"))).collect()]
    assert got == [w for *_, w in cases]


def test_corpus_means_of_nothing(pairs):
    row = mt.corpus_means(mt.rouge_n(pairs).limit(0), {"rouge1": 1.0, "rouge2": 100.0}).first()
    assert (row.rouge1, row.rouge2) == (0.0, 0.0)


def test_report_groups_by_mode(spark):
    same, other = [[1.0, 0.0]], [[0.0, 1.0]]
    rows = [("True", "a b c d e", ["a b c d e"], same, same), ("False", "x y", ["a b c d e"], same, other), ("False", "a b c d e", ["a b c d e"], same, same)]
    df = spark.createDataFrame(
        rows, "mode string, prediction string, references array<string>, prediction_vectors array<array<double>>, reference_vectors array<array<double>>"
    )
    got = {r.mode: r for r in mt.report(df, ["mode"]).collect()}
    assert (got["True"].rouge1, got["True"].rougeL, got["True"].bleu, got["True"].bertscore_f1) == (1.0, 1.0, 100.0, 100.0)
    assert (got["False"].rouge2, got["False"].bertscore_precision) == (0.5, 50.0) and 0 < got["False"].bleu < 100


def table_positions(ref, pred):
    table = [[0] * (len(pred) + 1) for _ in range(len(ref) + 1)]
    for i, a in enumerate(ref, 1):
        for j, b in enumerate(pred, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if a == b else max(table[i - 1][j], table[i][j - 1])
    found, i, j = set(), len(ref), len(pred)
    while i and j:
        if ref[i - 1] == pred[j - 1]:
            found.add(i - 1)
            i, j = i - 1, j - 1
        elif table[i][j - 1] > table[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return found


def test_subsequence_positions_equal_the_whole_table():
    draw = random.Random(3)
    for letters in ("ab", "abc", "abcdefghij"):
        for _ in range(400):
            ref, pred = ([draw.choice(letters) for _ in range(draw.randrange(40))] for _ in range(2))
            assert mt.lcs_positions(ref, pred) == table_positions(ref, pred)


def test_subsequence_of_long_texts_needs_little_memory():
    draw = random.Random(4)
    few = [[str(draw.randrange(2000)) for _ in range(100_000)] for _ in range(2)]
    many = [[str(draw.randrange(10**9)) for _ in range(15_000)] + list(map(str, range(15_000))) for _ in range(2)]
    for ref, pred in (few, many):
        tracemalloc.start()
        found = mt.lcs_positions(ref, pred)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(found) == mt.lcs_length(ref, pred) and peak < 200e6


def test_bootstrap_matches_a_plain_version(spark):
    rows = [(i, i % 2, None if i % 10 == 3 else i / 30, 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, g int, x double, one double").repartition(4)
    out = {(r.g, r.metric): r for r in mt.bootstrap(df, ["x", "one"], "id", ["g"], resamples=50).collect()}
    assert len(out) == 4 and all(out[g, "one"][1 + k] == 1.0 for g in (0, 1) for k in (1, 2, 3))
    for g in (0, 1):
        means = []
        for sample in range(50):
            total = n = 0
            for i, group, x, _ in rows:
                u = int(hashlib.md5(f"bootstrap-1:{i}:{sample // 4}".encode()).hexdigest()[sample % 4 * 8 :][:8], 16)
                times = sum(u >= b for b in mt.POISSON_BOUNDS)
                if group == g and x is not None:
                    total, n = total + x * times, n + times
            means.append(total / n)
        want = np.percentile(means, [2.5, 50, 97.5])
        assert np.allclose([out[g, "x"].low, out[g, "x"].mid, out[g, "x"].high], want)
    assert mt.bootstrap(df.limit(0), ["x"], "id").count() == 0
    draws = spark.range(2000).select(F.col("id"), F.lit(1.0).alias("x"))
    wide = mt.bootstrap(draws.withColumn("x", (F.col("id") % 2).cast("double")), ["x"], "id", resamples=400).first()
    assert abs((wide.high - wide.low) - 2 * 1.96 * 0.5 / 2000**0.5) < 0.006 and abs(wide.mid - 0.5) < 0.005


def test_weighted_match_and_baseline(spark):
    rows = [(1, ["a", "b"], ["a", "c"]), (2, ["z"], ["a"]), (3, [], ["a"]), (4, None, ["b", "b"])]
    df = spark.createDataFrame(rows, "id int, p array<string>, r array<string>")
    idf = mt.reference_idf(df, "r")
    assert {r.token: round(r.idf, 9) for r in idf.collect()} == {"a": round(math.log(5 / 4), 9), "b": round(math.log(5 / 2), 9), "c": round(math.log(5 / 2), 9)}
    weighed = mt.idf_weights(df, "id", {"p": "pw", "r": "rw"}, idf, math.log(5.0))
    got = {r.id: r for r in weighed.collect()}
    assert len(got) == 4 and np.allclose(got[1].pw, [math.log(5 / 4), math.log(5 / 2)]) and np.allclose(got[2].pw, [math.log(5)]) and got[4].pw is None
    one_hot = lambda c: F.transform(c, lambda t: F.transform(F.array(*map(F.lit, "abcz")), lambda x: (x == t).cast("double")))
    vectors = weighed.withColumns({"pv": one_hot("p"), "rv": one_hot("r")})
    out = {r.id: r for r in mt.bert_score(vectors, "pv", "rv", "pw", "rw", (0.5, 0.5, 0.0)).collect()}
    p = math.log(5 / 4) / (math.log(5 / 4) + math.log(5 / 2))
    assert np.allclose([out[1].precision, out[1].recall, out[1].f1], [(p - 0.5) / 0.5, (p - 0.5) / 0.5, p])
    assert (out[3].precision, out[4].recall, out[2].f1) == (-1.0, -1.0, 0.0)
    with pytest.raises(ValueError):
        mt.bert_score(vectors, "pv", "rv", "pw")
