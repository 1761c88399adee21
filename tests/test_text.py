import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import arrays, models, text as tx


def values(spark, rows, expression, ddl="v string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {ddl}")
    return [r.out for r in df.withColumn("out", expression).orderBy("i").collect()]


def test_tokens_mix_scripts(spark):
    got = values(spark, ["EDA工具 v2.0 Café ルータ x"], tx.tokens(F.col("v")))
    assert got == [["eda", "工", "具", "v", "caf", "x"]]


def test_an_initial_is_one_character(spark):
    rows = ["ßtark", "étage", "ﬁn", "ᾳ", "ŉ", "1a", "abc", "", None]
    assert values(spark, rows, tx.initial(F.col("v"))) == ["ẞ", "É", "ﬁ", "ᾼ", "ŉ", "1", "A", "", None]


def test_strip_takes_all_python_whitespace(spark):
    rows = ["　 a b \n", "\x1c\x85x", "   ", "plain"]
    assert values(spark, rows, tx.strip(F.col("v"))) == [r.strip() for r in rows]


@pytest.mark.parametrize(
    "text, language",
    [
        ("电路abcde设计", "English"),
        ("电路设计abc", "Chinese"),
        ("ひらカタab", "Japanese"),
        ("한국어ab", "Korean"),
        ("中a", "Chinese"),
        ("あ한", "Japanese"),
        ("1234 ...", "English"),
        ("", "English"),
    ],
)
def test_script_language(spark, text, language):
    assert values(spark, [text], tx.script_language(F.col("v"))) == [language]


def test_any_script_language(spark):
    rows = ["long english text 中", "かな한", "한 a", "a"]
    assert values(spark, rows, tx.any_script_language(F.col("v"))) == ["Chinese", "Japanese", "Korean", "English"]


def test_named_language_falls_back(spark):
    df = spark.createDataFrame([("The text is french.", "中"), ("dunno", "中文"), (None, "abc")], "reply string, t string")
    got = [r[0] for r in df.select(tx.named_language(F.col("reply"), F.col("t"))).collect()]
    assert got == ["French", "Chinese", "English"]


def test_unfence_and_parse(spark):
    rows = ['```json\n{"question": "q"}\n```', '```\n{"question": "q"}```', '{"question": "q"}', "```json\n{bad\n```", "[1]", '"s"']
    assert values(spark, rows, tx.parse_reply(F.col("v"), "question string")["question"]) == ["q", "q", "q", None, None, None]


def test_long_enough_counts_stripped_characters(spark):
    rows = ["x" * 50, " " * 30 + "x" * 49 + " " * 30, "数" * 50, None]
    assert values(spark, rows, tx.long_enough(F.col("v"))) == [True, False, True, False]


def test_mteval_tokens(spark):
    rows = ["Hello, world! It's 3.14-ish &amp; more.", "a-\nb\nc<skipped>d", "1,000 and 2-3."]
    want = [
        ["Hello", ",", "world", "!", "It's", "3.14", "-", "ish", "&", "more", "."],
        ["ab", "cd"],
        ["1,000", "and", "2", "-", "3", "."],
    ]
    assert values(spark, rows, tx.mteval_tokens(F.col("v"))) == want


def test_after_think_uses_last_marker(spark):
    df = spark.createDataFrame([("<think>\na</think>b</think>\nfinal\n",), ("no marker",)], "v string")
    thinking, answer = tx.after_think(F.col("v"))
    assert [tuple(r) for r in df.select(thinking, answer).collect()] == [("a</think>b", "final"), ("", "no marker")]


def test_small_scalars(spark):
    assert values(spark, ["Error code: 429 - x", "boom"], tx.error_code(F.col("v"))) == [429, 500]
    hosts = ["http://h/ ", "http://h/v1/rerank/", "", None]
    assert values(spark, hosts, tx.rerank_endpoint(F.col("v"))) == ["http://h/v1/rerank", "http://h/v1/rerank", "", ""]
    names = ["A.PDF", "b.docx", "c.doc", "d.xls", "e.txt", "f.pdf.zip"]
    assert values(spark, names, tx.document_type(F.col("v"))) == ["PDF", "Word", "Word", "Excel", None, None]
    event = values(spark, ["é"], tx.server_event(F.struct(F.col("v").alias("content"))))[0]
    assert event.endswith("\n\n") and json.loads(event[len("data: ") :]) == {"content": "é"}


def test_first_filled(spark):
    df = spark.createDataFrame([("", None, "c"), (None, "b", "c"), (None, "", None)], "a string, b string, c string")
    assert [r[0] for r in df.select(tx.first_filled(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["c", "b", ""]


def test_counts_and_numbered(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],)], "w array<string>")
    got = [r[0] for r in df.select(arrays.counts(F.col("w"))).collect()]
    assert [[tuple(e) for e in row] for row in got] == [[("a", 1), ("b", 2)], []]
    shared = df.select(arrays.shared(arrays.numbered(F.col("w")), arrays.numbered(F.array(F.lit("b"), F.lit("b"), F.lit("b"))))).collect()
    assert [r[0] for r in shared] == [2, 0]


def test_batch_chat_skips_nulls_and_survives_failures(spark):
    def call(prompts):
        if any("boom" in p for p in prompts):
            raise RuntimeError("down")
        return [p.upper() for p in prompts]

    chat = models.BatchChat(call, batch=1)
    assert values(spark, ["a", "boom", None, "b"], chat.reply(F.col("v"))) == ["A", None, None, "B"]


def test_batch_embedder_and_reranker(spark):
    embed = models.BatchEmbedder(lambda texts: [[float(len(t)), 1.0] for t in texts], batch=2)
    assert values(spark, ["a", "bbb", "cc"], embed.embed(F.col("v"))) == [[1.0, 1.0], [3.0, 1.0], [2.0, 1.0]]
    rerank = models.BatchReranker(lambda qs, ts: [float(len(t)) for t in ts])
    assert values(spark, ["a", "bbb"], rerank.score(F.lit("q"), F.col("v"))) == [1.0, 3.0]
