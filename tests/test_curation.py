import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import sizing
from corpusloom.functions.models import BatchChat, ColumnChat
from corpusloom.operators import curation as cu, encode as en, pairs as pr
from corpusloom.session import scratch_path


def make_qa():
    """Nested, so that it travels to the workers by value."""

    def answer(prompts):
        return ["```json\n" + json.dumps({"question": "Q " + p[-5:], "cot": "c", "answer": "A"}) + "\n```" for p in prompts]

    return answer


def test_textbook_rows_resume_and_defaults(spark):
    rows = [(1, "x" * 60, "s", "d"), (2, "short", "s", "d"), (3, "y" * 60, "s", "d"), (4, "y" * 60, "s", "d"), (5, None, "s", "d")]
    df = spark.createDataFrame(rows, "id int, text string, source string, domain string")
    out = cu.textbook_rows(df, BatchChat(make_qa())).collect()
    assert sorted(r.id for r in out) == [1, 3, 4]
    assert {r.category for r in out} == {"其他"} and {r.language for r in out} == {"English"}
    done = spark.createDataFrame([("x" * 60,), (None,), ("",)], "original_text_preview string")
    assert sorted(r.id for r in cu.textbook_rows(df, BatchChat(make_qa()), done).collect()) == [3, 4]


def test_model_is_asked_once_per_needed_row(spark):
    counter = spark.sparkContext.accumulator(0)
    qa = make_qa()

    def call(prompts):
        counter.add(len(prompts))
        return qa(prompts)

    rows = [(i, str(i) * 60 if i % 2 else "no", "s", "d") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string, source string, domain string")
    assert cu.textbook_rows(df, BatchChat(call)).count() == 20
    assert counter.value == 20


def test_unreadable_or_partial_replies_drop_rows(spark):
    df = spark.createDataFrame([(i, "z" * (60 + i), "s", "d") for i in range(4)], "id int, text string, source string, domain string")
    replies = ["not json", '{"question": "", "answer": "a"}', '{"question": "q"}', '{"question": "q", "answer": "a", "category": "k"}']
    chat = ColumnChat(lambda p: F.element_at(F.array(*[F.lit(r) for r in replies]), (F.length(p) % 4 + 1).cast("int")))
    assert [(r.question, r.answer, r.category, r.cot) for r in cu.textbook_rows(df, chat).collect()] == [("q", "a", "k", "")]


def test_judge_needs_a_boolean(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, text string")
    judge = ColumnChat(
        lambda p: F.when(p.endswith("a"), '{"should_keep": true, "reason": "r"}').when(p.endswith("b"), '{"should_keep": "false"}').otherwise("?")
    )
    assert {r.id: r.keep for r in cu.keep_verdict(df, judge).collect()} == {1: True, 2: False, 3: False}


def test_prompts_fall_back_on_english(spark):
    df = spark.createDataFrame([("French", "t"), ("Korean", "t")], "l string, t string")
    plain = [r[0] for r in df.select(cu.qa_prompt(F.col("l"), F.col("t"))).collect()]
    assert plain[0].startswith("Write one") and plain[1].startswith("다음")
    hinted = [r[0] for r in df.select(cu.qa_prompt(F.col("l"), F.col("t"), F.lit("Why?"))).collect()]
    assert all(p.startswith("Write one") and p.endswith("Suggested question: Why?") for p in hinted)


def test_answered_rows(spark):
    ddl = "conversation_id string, category string, conversation array<struct<question:string,answer:string,reference_content:string>>"
    rows = [
        ("1", None, [(" q1 ", " a1 ", "r" * 600)]), ("2", "c", []), ("3", "c", [("", "a", "")]), ("4", "c", [("q4", "a4", None)]),
        ("5", "c", None), ("6", "c", [("q6", "a6", "")]),
    ]
    done = spark.createDataFrame([("6", "q6")], "conversation_id string, question string")
    chat = ColumnChat(lambda p: F.when(F.contains(p, F.lit("q1")), " thought "))
    out = {r.conversation_id: r for r in cu.answered_rows(spark.createDataFrame(rows, ddl), chat, "S", "D", done=done).collect()}
    assert set(out) == {"1", "4"}
    assert (out["1"].question, out["1"].cot, out["1"].category, len(out["1"].original_text_preview)) == ("q1", "thought", "Others", 500)
    assert out["4"].cot.startswith("To answer this question") and "q4..." in out["4"].cot


def test_split_has_no_overlap_and_survives_a_hot_group(spark):
    df = spark.range(20000).select(F.col("id"), F.when(F.col("id") % 10 < 9, "en").otherwise("zh").alias("lang"))
    test, train = cu.split_rows(df, "lang", "id")
    assert {r.lang: r["count"] for r in test.groupBy("lang").count().collect()} == {"en": 30, "zh": 30}
    assert test.join(train, "id").count() == 0 and test.count() + train.count() == 20000
    again, _ = cu.split_rows(df.repartition(17), "lang", "id")
    assert sorted(r.id for r in test.collect()) == sorted(r.id for r in again.collect())


def test_dedup_is_idempotent_and_leaks_are_found(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(90)], "id int, text string")
    once = cu.drop_repeats(df, F.col("text"), "id")
    assert once.count() == 31 and cu.drop_repeats(once, F.col("text"), "id").count() == 31
    test, train = df.filter("id < 3"), df.filter("id >= 3")
    assert cu.leaked(test, train, F.col("text")).count() == train.filter("text = 'same'").count()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    right = spark.createDataFrame([(7, "hot"), (11, "b"), (99, "c")], "k long, v string")
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)
    assert rows(sizing.salted_join(left, right, ["k"], how, ["id"], 5)) == rows(left.join(right, ["k"], how))
    assert rows(sizing.lookup_join(left, right, ["k"], how, ["id"], max_rows=1)) == rows(left.join(right, ["k"], how))


def test_counted_key_join_with_a_hot_key(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 1900)).alias("k"))
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    joined = sizing.counted_key_join(rows, counts, "k", "n", ["id"])
    assert joined.count() == 6000 and joined.filter("n is null").count() == 0
    assert joined.filter("k = 'hot'").select("n").distinct().collect()[0].n == 2000
    assert joined.groupBy("k").agg(F.count("*").alias("c"), F.max("n").alias("n")).filter("c <> n").count() == 0


def test_size_check(spark):
    assert sizing.measure(spark.range(10)) == (10, 160)
    assert not sizing.is_small(spark.range(101), max_rows=100)
    assert not sizing.is_small(spark.createDataFrame([("x" * 1000,)], "s string"), max_bytes=500)


def test_hard_negatives_match_brute_force(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(90, 6))
    p = rng.normal(size=(90, 6))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    a, p = unit(a), unit(p)
    rows = [(i, a[i].tolist(), p[i].tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "pair_id long, anchor_vector array<double>, positive_vector array<double>")
    got = pr.hard_negatives(df, max_score=0.5, absolute_margin=0.05).collect()
    bounded = pr.hard_negatives(df, max_score=0.5, absolute_margin=0.05, path=scratch_path(spark, "cells")).collect()
    known = lambda rows: sorted((r.pair_id, r["rank"], r.negative_id) for r in rows)
    assert known(bounded) == known(got)
    scores = np.round(a @ p.T, 9)
    for i in range(90):
        near = sorted((j for j in range(90) if j != i), key=lambda j: (-scores[i, j], j))[20:50]
        want = [j for j in near if scores[i, j] <= 0.5 and round(scores[i, j] + 0.05, 9) <= scores[i, i]][:5]
        assert [r.negative_id for r in sorted((r for r in got if r.pair_id == i), key=lambda r: r["rank"])] == want


def test_row_shapes(spark):
    labeled = spark.createDataFrame([(1, "q", ["p", "n1", "n2"], [1, 0, 0])], "pair_id int, question string, answer array<string>, labels array<int>")
    row = pr.contrastive_rows(labeled).first()
    assert row.messages[0].asDict() == {"role": "user", "content": "q"}
    assert [m[0].content for m in row.negative_messages] == ["n1", "n2"] and row.positive_messages[0][0].content == "p"
    reranked = pr.rerank_rows(labeled)
    assert reranked.first().rejected_response == ["n1", "n2"]
    points = pr.pointwise_rows(reranked).orderBy("at").collect()
    assert [r.messages[2].content[-3:].strip() for r in points] == ["no", "no", "yes"]
    assert points[0].messages[1].content == "<Instruct>: Given a search query, retrieve relevant passages that answer the query'\n<Query>: q\n<Document>: n1"


def test_encode_masks_and_truncates(spark):
    df = spark.createDataFrame([("a b", "c", "d e"), (None, "c", "d")], "question string, cot string, answer string")
    rows = en.encode_rows(df, en.batch_encoder(lambda t: [len(w) for w in t.split()] if t else []), 99, 12).collect()
    first = rows[0]
    assert len(first.input_ids) == len(first.labels) == len(first.attention_mask) == 12
    full = en.encode_rows(df.limit(1), en.word_encoder, 2).first()
    masked = sum(1 for x in full.labels if x == en.IGNORED)
    assert full.labels[masked:] == full.input_ids[masked:] and full.labels[-1] == 2 and masked > 0
    assert [r.input_ids for r in en.encode_rows(df, en.word_encoder, 2).filter("question is null").collect()] == [[]]


def test_counts_by_dimension(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 1)], "x string, y int")
    got = {(r.dimension, r.value): r.n for r in cu.value_counts(df, ["x", "y"]).collect()}
    assert got == {("x", "a"): 2, ("x", None): 1, ("y", "1"): 2, ("y", "2"): 1}


def test_counters_of_a_flow(spark):
    """Rows are counted at their place of the flow while it is written; places that nothing reaches count none."""
    judge = ColumnChat(lambda p: F.when(p.contains("keep me"), '{"should_keep": true, "reason": "r"}').otherwise('{"should_keep": false}'))
    writer = ColumnChat(lambda p: F.when(p.contains("good"), '{"question": "q", "chain_of_thought": "c", "answer": "a"}'))
    texts = ["keep me good ", "keep me ", "drop ", "good ", None, "short"]
    rows = spark.createDataFrame([(i, None if t is None else t * (1 if t == "short" else 20), "s", "x") for i, t in enumerate(texts)], "id int, text string, source string, section string")
    for given, want in ((rows, (4, 2)), (rows.limit(0), (0, 0))):
        counters = cu.Counters()
        found = cu.judged_rows(given, judge, writer, counters=counters)
        path = scratch_path(spark, "flow")
        found.write.parquet(path)
        got = counters.run()
        written = spark.read.parquet(path).count()
        assert (got["total"], got["total"] - got["filtered"]) == want
        assert got["success"] == written and got["failed"] == want[1] - written
        if want[0]:
            assert written == 1
