"""Curation, split, mining and encoding queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom import sizing
from corpusloom.functions import arrays, text as tx
from corpusloom.functions.models import ColumnChat, LetterRowEmbedder
from corpusloom.operators import curation as cu, encode as en, pairs as pr
from corpusloom.plans import statements as st
from corpusloom.plans.registry import ORACLES, query, table
from corpusloom.plans.text_queries import docs, qa_pairs
from corpusloom.session import scratch_path

WS = st.WS

# Offline stand-in for question generation: question and answer are cut from the prompt's passage.
# A passage with an even number of characters gets its reply fenced, and one whose length is a
# multiple of 11 an unreadable reply.


def _reply(passage: Column) -> Column:
    return arrays.let(_record(passage), lambda record: _dressed(passage, record))


def _record(passage: Column) -> Column:
    return F.to_json(
        F.struct(
            F.concat(F.lit("About: "), F.substring(passage, 1, 60)).alias("question"),
            F.lit("because").alias("cot"),
            F.substring(passage, 61, 120).alias("answer"),
        )
    )


def _dressed(passage: Column, record: Column) -> Column:
    n = F.length(passage)
    return F.when(n % 11 == 0, F.substring(record, 1, 20)).when(n % 2 == 0, F.concat(F.lit("```json\n"), record, F.lit("\n```"))).otherwise(record)


WRITER = ColumnChat(lambda prompt: arrays.let(F.substring_index(prompt, "\nText:\n", -1), _reply))


def _reply_sql(passage: str) -> str:
    return f"""'About: ' || substr({passage}, 1, 60) AS question, 'because' AS cot, substr({passage}, 61, 120) AS answer"""


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text", "source", F.col("lang").alias("domain"))


def done_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier output for the resume checks: the documents that carry a label."""
    labelled = docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return labelled.filter("text <> ''").select(tx.prefix_key(F.col("text")).alias("text_key"))


_DONE = "done AS (SELECT DISTINCT md5(text) AS k FROM documents JOIN labels USING (doc_id) WHERE text <> '')"


@query(st.with_(_DONE) + " SELECT doc_id, lang FROM documents WHERE md5(text) NOT IN (SELECT k FROM done)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text no earlier output row was made from."""
    done = done_rows(spark, sf_dir)
    rest = cu.without_done(docs(spark, sf_dir), done, tx.prefix_key(F.col("text")), cu.done_key(done), ["doc_id"])
    return rest.select("doc_id", "lang")


@query(st.with_(_DONE) + " SELECT doc_id, lang FROM documents WHERE md5(text) NOT IN (SELECT k FROM done)")
def resume_anti_join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``resume_anti_join`` on the salted shuffle used when the earlier output is too large to broadcast."""
    seen = done_rows(spark, sf_dir).select(F.col("text_key").alias("k")).distinct()
    rows = docs(spark, sf_dir).withColumn("k", tx.prefix_key(F.col("text")))
    return sizing.salted_join(rows, seen, ["k"], "left_anti", ["doc_id"]).select("doc_id", "lang")


@query(st.with_(_DONE) + " SELECT doc_id, lang FROM documents WHERE md5(text) NOT IN (SELECT k FROM done)")
def resume_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``resume_anti_join`` by the sketch used when the earlier output is too large to broadcast: most new rows stay where they are."""
    done = done_rows(spark, sf_dir)
    rest = cu.without_done(docs(spark, sf_dir), done, tx.prefix_key(F.col("text")), cu.done_key(done), ["doc_id"], max_rows=0)
    return rest.select("doc_id", "lang")


@query(
    """SELECT doc_id, prefix_md5 FROM (SELECT doc_id, md5(substr(text, 1, 200)) AS prefix_md5,
  row_number() OVER (PARTITION BY md5(substr(text, 1, 200)) ORDER BY doc_id) AS n FROM documents) WHERE n = 1"""
)
def prefix_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document per 200-character prefix."""
    keyed = docs(spark, sf_dir).select("doc_id", tx.prefix_key(F.col("text"), 200).alias("prefix_md5"))
    return cu.drop_repeats(keyed, F.col("prefix_md5"), "doc_id")


_JUDGE = ColumnChat(
    lambda prompt: arrays.let(
        F.length(prompt) % 4,
        lambda kind: F.when(kind == 0, '{"should_keep": "false", "reason": "a string is no verdict"}')
        .when(kind == 1, '```json\n{"should_keep": true, "reason": "kept", "suggested_question": "Why?"}\n```')
        .when(kind == 2, '{"should_keep": true, "reason": "kept"}')
        .otherwise("no JSON at all"),
    )
)
_KEEP = f"(length(text) + {len(cu._ASK_KEEP)}) % 4"


@query(
    f"""SELECT id, keep, CASE v WHEN 0 THEN '' WHEN 1 THEN 'kept' WHEN 2 THEN 'kept' ELSE '' END AS reason,
  CASE WHEN v = 1 THEN 'Why?' END AS suggested_question
  FROM (SELECT doc_id AS id, {_KEEP} AS v, {_KEEP} IN (1, 2) AS keep FROM documents)"""
)
def keep_verdict_standin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep/drop verdicts of an offline judge; unreadable replies and non-boolean verdicts drop the row."""
    judged = cu.keep_verdict(raw_rows(spark, sf_dir), _JUDGE)
    return judged.select("id", "keep", F.when(F.col("keep"), F.col("reason")).otherwise("").alias("reason"), "suggested_question")


@query(
    """SELECT doc_id, quality = 1 AND toxic = 0 AS keep, CASE WHEN quality = 1 AND toxic = 0 THEN 'yes' ELSE 'no' END AS verdict
  FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0"""
)
def keep_filter_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep/drop with the labels table standing in for the judge's verdict."""
    labels = table(spark, sf_dir, "labels")
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "yes").otherwise("no")
    joined = sizing.lookup_join(docs(spark, sf_dir).select("doc_id"), labels, ["doc_id"], "inner", ["doc_id"])
    return joined.withColumn("verdict", verdict).filter("verdict = 'yes'").select("doc_id", F.lit(True).alias("keep"), "verdict")


_LONG = f"length(trim(text, {WS})) >= 50"
_RECORDS = f"""
made AS (SELECT doc_id AS id, {_reply_sql("p")}, 'English' AS language, '其他' AS category, source, {{domain}} AS domain,
  substr(text, 1, 500) AS original_text_preview, md5(text) AS text_key{{extra}}
  FROM (SELECT *, text{{suffix}} AS p FROM documents WHERE {_LONG} {{where}}) WHERE length(p) % 11 <> 0),
kept AS (SELECT * FROM made WHERE question <> '' AND answer <> '')"""


@query(
    st.with_(_DONE, _RECORDS.format(domain="lang", extra="", suffix="", where="AND md5(text) NOT IN (SELECT k FROM done)"))
    + " SELECT * FROM kept"
)
def textbook_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length filter, resume, language, prompt, reply, parsing and required fields in one chain."""
    return cu.textbook_rows(raw_rows(spark, sf_dir), WRITER, done_rows(spark, sf_dir))


_SUFFIX = f" || chr(10) || CASE WHEN {_KEEP} = 1 THEN chr(10) || 'Suggested question: Why?' ELSE '' END"


@query(
    st.with_(_RECORDS.format(domain="lang", extra=", 'kept' AS filter_reason", suffix=_SUFFIX, where=f"AND {_KEEP} IN (1, 2)"))
    + " SELECT * FROM kept"
)
def judged_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow with a keep/drop verdict and a suggested question in the prompt."""
    rows = raw_rows(spark, sf_dir).withColumnRenamed("domain", "section")
    return cu.judged_rows(rows, _JUDGE, WRITER)


@query(
    st.with_(_RECORDS.format(domain="lang", extra=", 'kept' AS filter_reason", suffix=_SUFFIX, where=f"AND {_KEEP} IN (1, 2)"))
    + f""", n AS (SELECT count(*) AS total, count(*) FILTER ({_KEEP} IN (1, 2)) AS judged FROM documents WHERE {_LONG}), s AS (SELECT count(*) AS success FROM kept)
SELECT total, success, total - judged AS filtered, judged - success AS failed FROM n, s"""
)
def judged_flow_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run summary of ``judged_flow``, counted while its rows are written."""
    counters = cu.Counters("judged")
    rows = raw_rows(spark, sf_dir).withColumnRenamed("domain", "section")
    cu.judged_rows(rows, _JUDGE, WRITER, counters=counters).write.parquet(scratch_path(spark, "judged"))
    return spark.createDataFrame([counters.run()], "total long, success long, filtered long, failed long")


CODER = ColumnChat(
    lambda p: arrays.let(F.substring_index(F.element_at(F.split(p, "```verilog\n"), 2), "\n```\n\n- ", 1), _reply)
)


@query(
    st.with_(
        f"""made AS (SELECT page_id AS id, {_reply_sql("html")}, CASE WHEN page_id % 3 = 0 THEN 'Chinese' WHEN page_id % 3 = 1 THEN 'Korean' ELSE 'English' END AS language,
  '其他' AS category, 'verilog' AS source, 'RTL' AS domain, substr(html, 1, 500) AS original_text_preview, md5(html) AS text_key
  FROM pages WHERE length(trim(html, {WS})) >= 50 AND length(html) % 11 <> 0)"""
    )
    + " SELECT * FROM made WHERE question <> '' AND answer <> ''"
)
def code_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code flow; page sources stand in for code, and descriptions rotate through languages."""
    which = F.col("page_id") % 3
    described = F.struct(
        F.when(which == 1, "모듈").otherwise("module").alias("block_summary"),
        F.when(which == 0, "这是一个模块").otherwise("").alias("detailed_global_summary"),
        F.when(which == 0, "english text").otherwise("").alias("high_level_global_summary"),
    )
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("code"), described.alias("description"))
    return cu.code_rows(rows, CODER, "verilog", "RTL")


_THINKER = ColumnChat(
    lambda p: arrays.let(F.length(p), lambda n: F.when(n % 3 != 0, F.concat(F.lit(" n="), n.cast("string"))))
)
_COT_LEN = f"(length(question) + length(answer) + {len(cu._ASK_COT) + len('Question:') + 1 + len('Answer:') + 3} + CASE WHEN ref <> '' THEN length(ref) + {len('Reference:') + 3} ELSE 0 END)"


@query(
    st.with_(
        st.QA,
        f"""turns AS (SELECT pair_id::VARCHAR AS conversation_id, trim(question, {WS}) AS question, trim(answer, {WS}) AS answer,
  CASE WHEN pair_id % 2 = 0 THEN 'Others' ELSE 'flow' END AS category, CASE WHEN pair_id % 3 = 0 THEN answer ELSE '' END AS ref
  FROM qa WHERE turn < 2 OR conv_id % 2 = 0)""",
    )
    + f""" SELECT conversation_id, question, answer, 'English' AS language, category, 'manuals' AS source, 'chips' AS domain, substr(ref, 1, 500) AS original_text_preview,
  CASE WHEN {_COT_LEN} % 3 = 0 THEN {st.default_cot("question")}
  ELSE 'n=' || {_COT_LEN} END AS cot FROM turns WHERE question <> '' AND answer <> ''"""
)
def answered_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-answer pairs keep their texts and gain reasoning, a fixed one where the model gave none."""
    pairs = qa_pairs(spark, sf_dir)
    rows = pairs.select(
        F.col("pair_id").cast("string").alias("conversation_id"),
        F.when(F.col("pair_id") % 2 == 1, "flow").alias("category"),
        F.array(
            F.struct("question", "answer", F.when(F.col("pair_id") % 3 == 0, F.col("answer")).alias("reference_content"))
        ).alias("conversation"),
        "turn",
        "conv_id",
    )
    done = pairs.filter("turn >= 2 and conv_id % 2 = 1").select(
        F.col("pair_id").cast("string").alias("conversation_id"), tx.strip(F.col("question")).alias("question")
    )
    return cu.answered_rows(rows, _THINKER, "manuals", "chips", done=done)


@query(
    """SELECT count(*) AS total, count(*) FILTER (quality = 1 AND toxic = 0) AS success, count(*) FILTER (quality = 0) AS filtered,
  count(*) FILTER (quality = 1 AND toxic = 1) AS failed FROM labels"""
)
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("quality") == 0, "filtered").when(F.col("toxic") == 0, "success").otherwise("failed")
    return cu.run_counts(table(spark, sf_dir, "labels").withColumn("status", status))


@query(
    """SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source
UNION ALL SELECT 'size', (n_chars // 1000)::VARCHAR, count(*) FROM documents GROUP BY n_chars // 1000
UNION ALL SELECT 'initial', upper(substr(text, 1, 1)), count(*) FROM documents GROUP BY upper(substr(text, 1, 1))"""
)
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four distributions in one pass."""
    rows = docs(spark, sf_dir).select(
        "lang", "source", F.expr("n_chars div 1000").alias("size"), tx.initial(F.col("text")).alias("initial")
    )
    return cu.value_counts(rows, ["lang", "source", "size", "initial"])


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def value_counts_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most common sources first."""
    return docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run limited to the first hundred input rows."""
    return cu.head_rows(docs(spark, sf_dir).select("doc_id", "source"), ["doc_id"], 100)


_SPLIT = """uniq AS (SELECT * FROM (SELECT doc_id, lang, md5(text) AS k, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1),
placed AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS place FROM uniq)"""


@query(st.with_(_SPLIT) + " SELECT doc_id, lang, CASE WHEN place <= 30 THEN 'test' ELSE 'train' END AS part, md5('43:' || doc_id) AS seeded FROM placed")
def seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty test rows per language in a seeded order, the rest train, after removing exact repeats."""
    unique = cu.drop_repeats(docs(spark, sf_dir), F.md5(F.col("text").cast("binary")), "doc_id").select("doc_id", "lang")
    test, train = cu.split_rows(unique, "lang", "doc_id")
    parts = test.withColumn("part", F.lit("test")).unionByName(train.withColumn("part", F.lit("train")))
    return parts.withColumn("seeded", cu.shuffle_key(43, "doc_id"))


_RAW_SPLIT = "placed AS (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS place FROM documents)"


@query(
    st.with_(_RAW_SPLIT)
    + " SELECT doc_id, lang FROM placed WHERE place > 30 AND md5(text) IN (SELECT md5(text) FROM placed WHERE place <= 30)"
)
def split_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows that repeat a test row when the split is made without removing repeats."""
    keyed = docs(spark, sf_dir).select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("k"))
    test, train = cu.split_rows(keyed, "lang", "doc_id")
    return cu.leaked(test, train, F.col("k")).select("doc_id", "lang")


_NEG = f"""{st.QA},
{st.vectors("av", "qa", "pair_id", "question")},
{st.vectors("pv", "qa", "pair_id", "answer")},
near AS (SELECT a.pair_id, p.pair_id AS negative_id, round(list_inner_product(a.v, p.v), 9) AS score FROM av a, pv p),
own AS (SELECT pair_id, score AS positive_score FROM near WHERE pair_id = negative_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, negative_id) AS rk FROM near WHERE pair_id <> negative_id),
fit AS (SELECT r.*, positive_score FROM ranked r JOIN own USING (pair_id) WHERE rk BETWEEN 21 AND 50 AND score <= {{0}} AND round(score + {{1}}, 9) <= positive_score),
neg AS (SELECT * FROM (SELECT pair_id, negative_id, score, positive_score, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, negative_id) AS rank FROM fit) WHERE rank <= 5)"""
# The letter vectors of any two texts are close, so the stand-in run uses wider limits than the defaults.
_MAX, _MARGIN = 0.995, 0.0005


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    embed = LetterRowEmbedder().embed
    pairs = qa_pairs(spark, sf_dir).withColumns({"anchor_vector": embed(F.col("question")), "positive_vector": embed(F.col("answer"))})
    path = scratch_path(spark, "pairs")
    pairs.write.parquet(path)
    return spark.read.parquet(path)


def _mined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    stored = _paired(spark, sf_dir)
    return stored, pr.hard_negatives(stored, max_score=_MAX, absolute_margin=_MARGIN)


@query(
    st.with_(_NEG.format(_MAX, _MARGIN))
    + " SELECT pair_id, negative_id, round(score, 6) AS score, round(positive_score, 6) AS positive_score, rank FROM neg"
)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined negatives: ranks 21 to 50, score ceiling and margin, best five."""
    _, mined = _mined(spark, sf_dir)
    return mined.withColumns({"score": F.round("score", 6), "positive_score": F.round("positive_score", 6)})


@query(ORACLES["hard_negatives"])
def hard_negatives_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same negatives from stored cells: an anchor meets only cells that can hold one of its nearest 51."""
    mined = pr.hard_negatives(_paired(spark, sf_dir), max_score=_MAX, absolute_margin=_MARGIN, path=scratch_path(spark, "cells"))
    return mined.withColumns({"score": F.round("score", 6), "positive_score": F.round("positive_score", 6)})


_LISTED = """,
listed AS (SELECT n.pair_id, q.question, q.answer AS positive, list(t.answer ORDER BY n.rank) AS negatives
  FROM neg n JOIN qa q ON q.pair_id = n.pair_id JOIN qa t ON t.pair_id = n.negative_id GROUP BY ALL)"""


def _labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, mined = _mined(spark, sf_dir)
    return pr.labeled_list(pairs, mined, "pair_id", "question", "answer")


@query(
    st.with_(_NEG.format(_MAX, _MARGIN)) + _LISTED
    + """ SELECT pair_id, question AS message, positive, len(negatives) AS n_negatives, array_to_string(negatives, '|') AS negatives FROM listed"""
)
def contrastive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor, positive and negative message lists."""
    rows = pr.contrastive_rows(_labeled(spark, sf_dir))
    contents = lambda c: F.transform(c, lambda m: F.get(m, F.lit(0))["content"])
    return rows.select(
        "pair_id",
        F.get("messages", F.lit(0))["content"].alias("message"),
        F.get(contents("positive_messages"), F.lit(0)).alias("positive"),
        F.size("negative_messages").alias("n_negatives"),
        F.array_join(contents("negative_messages"), "|").alias("negatives"),
    )


@query(
    st.with_(_NEG.format(_MAX, _MARGIN)) + _LISTED
    + """, judged AS (SELECT pair_id, question, unnest(list_append(negatives, positive)) AS text, unnest(range(0, len(negatives) + 1)) AS row_no, len(negatives) AS n FROM listed)
SELECT pair_id, row_no, 'system|user|assistant' AS roles, '<Instruct>: Given a search query, retrieve relevant passages that answer the query''' || chr(10) || '<Query>: ' || question || chr(10) || '<Document>: ' || text AS asked,
  '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) || CASE WHEN row_no = n THEN 'yes' ELSE 'no' END AS verdict FROM judged"""
)
def pointwise_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One judged record per negative, then one for the positive."""
    rows = pr.pointwise_rows(pr.rerank_rows(_labeled(spark, sf_dir)))
    part = lambda i: F.get("messages", F.lit(i))["content"]
    return rows.select(
        "pair_id", F.col("at").cast("long").alias("row_no"), F.array_join(F.col("messages.role"), "|").alias("roles"),
        part(1).alias("asked"), part(2).alias("verdict"),
    )


_WORDS = lambda e: f"list_filter(regexp_split_to_array({e}, '\\s+'), lambda w: w <> '')"
_IDS = lambda e: f"list_transform({_WORDS(e)}, lambda w: ('0x' || substr(md5(w), 1, 6))::INT)"
_CHATML = f"'<|im_start|>system' || chr(10) || '{en.SYSTEM}<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || question || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"


@query(
    st.with_(
        st.QA,
        f"""ids AS (SELECT pair_id, {_IDS(_CHATML)} AS a, list_append({_IDS("'<think>because</think>' || chr(10) || answer")}, 2) AS b FROM qa)""",
    )
    + """ SELECT pair_id, array_to_string(list_concat(a, b), ' ') AS input_ids, array_to_string(list_concat(list_transform(a, lambda x: -100), b), ' ') AS labels,
  len(list_concat(a, b)) AS n_mask FROM ids"""
)
def sft_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked labels with the offline word encoder, whole rows."""
    rows = qa_pairs(spark, sf_dir).select("pair_id", "question", F.lit("because").alias("cot"), "answer")
    coded = en.encode_rows(rows, en.word_encoder, eos=2)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return coded.select("pair_id", text("input_ids"), text("labels"), F.size("attention_mask").alias("n_mask"))


@query("SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two sources appended."""
    a = docs(spark, sf_dir).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    return a.unionByName(table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"), "text"))
