"""Answer-quality queries. Predictions and references come from the conversations table: the user
turn of a pair is scored against the assistant turn, which stands in for a model's answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom import sizing
from corpusloom.functions import text as tx
from corpusloom.functions.models import LetterEmbedder
from corpusloom.operators import metrics as mt
from corpusloom.plans import statements as st
from corpusloom.plans.registry import query, table
from corpusloom.plans.text_queries import MTEVAL_SQL, docs, qa_pairs

_ROUGE = lambda e: f"regexp_extract_all(lower({e}), '[a-z0-9]+')"


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prediction = the question, references = the answer and its first half."""
    half = F.substring(F.col("answer"), F.lit(1), F.floor(F.length("answer") / 2).cast("int"))
    pairs = sizing.spread(qa_pairs(spark, sf_dir), "pair_id")
    return pairs.select("pair_id", F.col("question").alias("prediction"), F.array(F.col("answer"), half).alias("references"))


_PAIRS = f"""{st.QA},
side AS (SELECT pair_id, -1 AS ref, question AS text FROM qa UNION ALL SELECT pair_id, 0, answer FROM qa
  UNION ALL SELECT pair_id, 1, substr(answer, 1, length(answer) // 2) FROM qa)"""


def _grams(name: str, tokens: str, n: int) -> str:
    gram = "w[i]" if n == 1 else f"array_to_string(w[i:i + {n - 1}], chr(1))"
    return f"""
{name} AS (SELECT pair_id, ref, gram, count(*) AS c FROM (SELECT pair_id, ref, {gram} AS gram
  FROM (SELECT pair_id, ref, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT pair_id, ref, {tokens} AS w FROM side)))
  GROUP BY pair_id, ref, gram)"""


def _rouge(n: int) -> str:
    return f"""{_grams(f"g{n}", _ROUGE("text"), n)},
t{n} AS (SELECT pair_id, ref, sum(c) AS total FROM g{n} GROUP BY pair_id, ref),
m{n} AS (SELECT p.pair_id, r.ref, sum(least(p.c, r.c)) AS hit FROM g{n} p JOIN g{n} r ON p.pair_id = r.pair_id AND p.gram = r.gram AND p.ref = -1 AND r.ref >= 0 GROUP BY p.pair_id, r.ref),
f{n} AS (SELECT m.pair_id, max(2e0 * (hit / a.total) * (hit / b.total) / (hit / a.total + hit / b.total)) AS f
  FROM m{n} m JOIN t{n} a ON a.pair_id = m.pair_id AND a.ref = -1 JOIN t{n} b ON b.pair_id = m.pair_id AND b.ref = m.ref GROUP BY m.pair_id)"""


_ROUGE_ROWS = st.with_(_PAIRS, _rouge(1), _rouge(2))


@query(
    _ROUGE_ROWS
    + """ SELECT pair_id, round(coalesce(f1.f, 0), 6) AS rouge1, round(coalesce(f2.f, 0), 6) AS rouge2
  FROM qa LEFT JOIN f1 USING (pair_id) LEFT JOIN f2 USING (pair_id)"""
)
def rouge_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-1 and ROUGE-2 F1 per pair, best of two references."""
    scored = mt.rouge_n(scored_pairs(spark, sf_dir))
    return scored.select("pair_id", F.round("rouge1", 6).alias("rouge1"), F.round("rouge2", 6).alias("rouge2"))


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-L and ROUGE-Lsum F1 per pair."""
    scored = mt.rouge_lsum(mt.rouge_l(scored_pairs(spark, sf_dir)))
    return scored.select("pair_id", F.round("rougeL", 6).alias("rougeL"), F.round("rougeLsum", 6).alias("rougeLsum"))


@query(
    _ROUGE_ROWS
    + """ SELECT round(coalesce(avg(coalesce(f1.f, 0)), 0), 2) AS rouge1, round(coalesce(avg(coalesce(f2.f, 0)), 0), 2) AS rouge2
  FROM qa LEFT JOIN f1 USING (pair_id) LEFT JOIN f2 USING (pair_id)"""
)
def rouge_corpus_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus figures: means of the row scores at two decimals."""
    return mt.corpus_means(mt.rouge_n(scored_pairs(spark, sf_dir)), {"rouge1": 1.0, "rouge2": 1.0})


@query(
    _ROUGE_ROWS
    + f""" SELECT language, round(avg(f1), 2) AS rouge1, round(avg(f2), 2) AS rouge2 FROM (
  SELECT CASE WHEN ja > 0 AND ja >= en THEN 'Japanese' WHEN zh > 0 AND zh >= en THEN 'Chinese' ELSE 'English' END AS language, coalesce(f1.f, 0) AS f1, coalesce(f2.f, 0) AS f2
  FROM (SELECT pair_id, len(regexp_extract_all(answer, '{tx.CHINESE}')) AS zh, len(regexp_extract_all(answer, '{tx.JAPANESE}')) AS ja,
    len(regexp_extract_all(answer, '{tx.ENGLISH}')) AS en FROM qa) LEFT JOIN f1 USING (pair_id) LEFT JOIN f2 USING (pair_id)) GROUP BY language"""
)
def metrics_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric means per detected language of the reference."""
    scored = mt.rouge_n(scored_pairs(spark, sf_dir))
    named = scored.withColumn("language", tx.script_language(F.get("references", F.lit(0))))
    return mt.corpus_means(named, {"rouge1": 1.0, "rouge2": 1.0}, ["language"])


def _bleu(smooth: bool) -> str:
    plus = "1e0" if smooth else "0e0"
    tokens = MTEVAL_SQL("text")
    orders = range(1, 5)
    parts = [_PAIRS, f"words AS (SELECT pair_id, ref, len({tokens}) AS n FROM side)"]
    parts.append(
        """lens AS (SELECT sum(p)::DOUBLE AS p_len, sum(r)::DOUBLE AS r_len FROM (SELECT pair_id, max(n) FILTER (ref = -1) AS p, min(n) FILTER (ref >= 0) AS r FROM words GROUP BY pair_id))"""
    )
    for n in orders:
        parts.append(_grams(f"b{n}", tokens, n))
        parts.append(
            f"""x{n} AS (SELECT coalesce(sum(least(p.c, r.c)), 0)::DOUBLE AS hit FROM b{n} p JOIN (SELECT pair_id, gram, max(c) AS c FROM b{n} WHERE ref >= 0 GROUP BY pair_id, gram) r
  ON p.pair_id = r.pair_id AND p.gram = r.gram AND p.ref = -1)"""
        )
        parts.append(f"y{n} AS (SELECT sum(greatest(n - {n - 1}, 0))::DOUBLE AS total FROM words WHERE ref = -1)")
    precision = ", ".join(f"(x{n}.hit + {plus}) / (y{n}.total + {plus}) AS precision{n}" for n in orders)
    parts.append(f"p AS (SELECT {precision} FROM {', '.join(f'x{n}, y{n}' for n in orders)})")
    return (
        st.with_(*parts)
        + """ SELECT round(coalesce(exp((ln(nullif(precision1, 0)) + ln(nullif(precision2, 0)) + ln(nullif(precision3, 0)) + ln(nullif(precision4, 0))) / 4e0), 0) * bp, 6) AS bleu,
  round(precision1, 6) AS precision1, round(precision2, 6) AS precision2, round(precision3, 6) AS precision3, round(precision4, 6) AS precision4,
  round(bp, 6) AS brevity_penalty, round(p_len / r_len, 6) AS length_ratio, p_len::BIGINT AS translation_length, r_len::BIGINT AS reference_length
  FROM p, (SELECT *, CASE WHEN p_len / r_len > 1 THEN 1e0 ELSE exp(1e0 - r_len / p_len) END AS bp FROM lens)"""
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"})


@query(_bleu(False))
def bleu_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus BLEU-4 against two references."""
    return _rounded(mt.bleu(scored_pairs(spark, sf_dir)))


@query(_bleu(True))
def bleu_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus BLEU-4 with add-one smoothing."""
    return _rounded(mt.bleu(scored_pairs(spark, sf_dir), smooth=True))


@query(
    st.with_(
        st.QA,
        f"tok AS (SELECT pair_id, side, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS at FROM "
        f"(SELECT pair_id, 0 AS side, {_ROUGE('question')} AS w FROM qa UNION ALL SELECT pair_id, 1, {_ROUGE('answer')} FROM qa))",
        st.vectors("vec", "(SELECT DISTINCT token FROM tok)", "token", "token"),
        """best AS (SELECT a.pair_id, a.side, a.at, max(list_inner_product(x.v, y.v)) AS near FROM tok a JOIN tok b ON a.pair_id = b.pair_id AND a.side <> b.side
  JOIN vec x ON x.token = a.token JOIN vec y ON y.token = b.token GROUP BY a.pair_id, a.side, a.at)""",
        """pr AS (SELECT pair_id, coalesce(avg(near) FILTER (side = 0), 0) AS p, coalesce(avg(near) FILTER (side = 1), 0) AS r FROM best GROUP BY pair_id)""",
    )
    + """ SELECT pair_id, round(coalesce(p, 0), 6) AS precision, round(coalesce(r, 0), 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1
  FROM qa LEFT JOIN pr USING (pair_id)"""
)
def bert_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy token matching on given vectors: letter vectors of the tokens stand in."""
    embed = LetterEmbedder().embed
    window = lambda c: F.transform(tx.rouge_tokens(F.col(c)), embed)
    pairs = sizing.spread(qa_pairs(spark, sf_dir), "pair_id")
    rows = pairs.select("pair_id", window("question").alias("prediction_vectors"), window("answer").alias("reference_vectors"))
    return _rounded(mt.bert_score(rows).select("pair_id", "precision", "recall", "f1"))


_BASELINE = (0.3, 0.3, 0.3)


@query(
    st.with_(
        st.QA,
        f"words AS (SELECT pair_id, {_ROUGE('question')} AS p, {_ROUGE('answer')} AS r FROM qa)",
        "df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(r)) AS token FROM words) GROUP BY token)",
        "total AS (SELECT count(*) + 1e0 AS n FROM words)",
        """tok AS (SELECT pair_id, side, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS at FROM
  (SELECT pair_id, 0 AS side, p AS w FROM words UNION ALL SELECT pair_id, 1, r FROM words))""",
        st.vectors("vec", "(SELECT DISTINCT token FROM tok)", "token", "token"),
        """best AS (SELECT a.pair_id, a.side, a.at, a.token, max(list_inner_product(x.v, y.v)) AS near FROM tok a JOIN tok b ON a.pair_id = b.pair_id AND a.side <> b.side
  JOIN vec x ON x.token = a.token JOIN vec y ON y.token = b.token GROUP BY a.pair_id, a.side, a.at, a.token)""",
        """weighed AS (SELECT b.*, ln(n / (coalesce(df, 0) + 1)) AS w FROM best b LEFT JOIN df USING (token), total)""",
        """side_mean AS (SELECT pair_id, side, CASE WHEN sum(w) <> 0 THEN sum(w * near) / sum(w) ELSE avg(near) END AS m FROM weighed GROUP BY pair_id, side)""",
        """pr AS (SELECT pair_id, coalesce(max(m) FILTER (side = 0), 0) AS p, coalesce(max(m) FILTER (side = 1), 0) AS r FROM side_mean GROUP BY pair_id)""",
        """f AS (SELECT pair_id, coalesce(p, 0) AS p, coalesce(r, 0) AS r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM qa LEFT JOIN pr USING (pair_id))""",
    )
    + " SELECT pair_id, round((p - 3e-1) / 7e-1, 6) AS precision, round((r - 3e-1) / 7e-1, 6) AS recall, round((f - 3e-1) / 7e-1, 6) AS f1 FROM f"
)
def bert_score_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy token matching weighed by the idf of the references, rescaled with a baseline."""
    embed = LetterEmbedder().embed
    pairs = sizing.spread(qa_pairs(spark, sf_dir), "pair_id")
    rows = pairs.select("pair_id", tx.rouge_tokens(F.col("question")).alias("p"), tx.rouge_tokens(F.col("answer")).alias("r"))
    unseen = F.ln(rows.agg((F.count("*") + 1).cast("double")).scalar())
    weighed = mt.idf_weights(rows, "pair_id", {"p": "pw", "r": "rw"}, mt.reference_idf(rows, "r"), unseen)
    vectors = weighed.withColumns({"pv": F.transform("p", embed), "rv": F.transform("r", embed)})
    return _rounded(mt.bert_score(vectors, "pv", "rv", "pw", "rw", _BASELINE).select("pair_id", "precision", "recall", "f1"))


_RESAMPLES = 200
_DRAWS = " + ".join(f"(u >= {b})::INT" for b in mt.POISSON_BOUNDS)


@query(
    _ROUGE_ROWS
    + f""", score AS (SELECT pair_id, coalesce(f1.f, 0) AS rouge1, coalesce(f2.f, 0) AS rouge2 FROM qa LEFT JOIN f1 USING (pair_id) LEFT JOIN f2 USING (pair_id)),
draw AS (SELECT rouge1, rouge2, sample, {_DRAWS} AS times
  FROM (SELECT *, ('0x' || substr(md5('bootstrap-1:' || pair_id || ':' || sample // 4), (sample % 4) * 8 + 1, 8))::BIGINT AS u FROM score, (SELECT unnest(range({_RESAMPLES})) AS sample))),
means AS (SELECT sample, sum(rouge1 * times) / nullif(sum(times), 0) AS m1, sum(rouge2 * times) / nullif(sum(times), 0) AS m2 FROM draw GROUP BY sample),
flat AS (SELECT 'rouge1' AS metric, m1 AS m FROM means UNION ALL SELECT 'rouge2', m2 FROM means)
SELECT metric, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.5), 6) AS mid, round(quantile_cont(m, 0.975), 6) AS high FROM flat GROUP BY metric"""
)
def rouge_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval and median of the corpus ROUGE figures."""
    scored = mt.rouge_n(scored_pairs(spark, sf_dir))
    return _rounded(mt.bootstrap(scored, ["rouge1", "rouge2"], "pair_id", resamples=_RESAMPLES))


@query()
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics for the answers with and without thinking (even and odd pairs stand for the modes)."""
    embed = LetterEmbedder().embed
    window = lambda c: F.transform(tx.rouge_tokens(F.col(c)), embed)
    rows = scored_pairs(spark, sf_dir).withColumn("answer", F.get("references", F.lit(0)))
    modes = rows.withColumn("mode", F.when(F.col("pair_id") % 2 == 0, "thinking_True").otherwise("thinking_False"))
    return mt.report(modes.withColumns({"prediction_vectors": window("prediction"), "reference_vectors": window("answer")}), ["mode"])


_CHARS = lambda e: f"list_distinct(list_filter(string_split(translate({e}, {st.WS}, ''), ''), lambda c: c <> ''))"


@query(
    st.with_(
        "said AS (SELECT b.item_id, d.doc_id, trim(b.text, " + st.WS + ") AS answer, trim(CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE d.text END, " + st.WS + ") AS ref FROM benchmark b JOIN documents d ON d.doc_id % (SELECT max(item_id) + 1 FROM benchmark) = b.item_id)",
    )
    + f""" SELECT item_id, doc_id, CASE WHEN answer = '' THEN false WHEN ref = '' THEN true
  ELSE len(list_intersect({_CHARS("answer")}, {_CHARS("ref")})) / greatest(len({_CHARS("ref")}), 1)::DOUBLE >= 0.2 END AS passed FROM said"""
)
def char_overlap_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usability verdict of benchmark passages as answers to documents; some have no reference."""
    answers = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("answer"))
    items = table(spark, sf_dir, "benchmark").agg(F.max("item_id") + 1).scalar()
    refs = sizing.spread(docs(spark, sf_dir)).select(
        "doc_id", (F.col("doc_id") % items).alias("item_id"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")).alias("ref")
    )
    pairs = sizing.lookup_join(refs, answers, ["item_id"], "inner", ["doc_id"])
    return pairs.select("item_id", "doc_id", mt.overlap_verdict(F.col("answer"), F.col("ref")).alias("passed"))


@query(
    f"""SELECT conv_id, turn, trim(CASE WHEN role = 'user' THEN text WHEN role = 'assistant' THEN 'a: ' || text ELSE 'o: ' || role END, {st.WS}) AS answer,
  trim(CASE WHEN role = 'assistant' THEN text ELSE 'expected ' || role END, {st.WS}) AS reference FROM conversations"""
)
def answer_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First filled answer and reference field of run records."""
    role, text = F.col("role"), F.col("text")
    blank = F.lit("")
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.struct(
            F.when(role == "user", text).otherwise(blank).alias("response"),
            F.when(role == "assistant", F.concat(F.lit("a: "), text)).alias("answer"),
            F.concat(F.lit("o: "), role).alias("output"),
        ).alias("outputs"),
        F.struct(
            blank.alias("response"),
            F.when(role == "assistant", text).alias("answer"),
            F.lit(None).cast("string").alias("output"),
            F.concat(F.lit("expected "), role).alias("expected_answer"),
        ).alias("wanted"),
    )
    return rows.select("conv_id", "turn", mt.answer_of("outputs").alias("answer"), mt.reference_of("wanted").alias("reference"))
