"""The operators over the given tables with production parameters, as thin queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions.arrays import let
from corpusloom.llm import (
    byte_bpe, decontamination, hard_negatives, line_dedup, main_text, mixing, ngram_join, periodic_runs, pseudonyms, quality, secrets, token_counts, toxicity,
)
from corpusloom.llm.registry import query, table

#: Stands for the secret that a user of the operator hands in.
DEMONSTRATION_KEY = "demonstration"

_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"
_SQL_MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, {_WORDS}::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', 'mix-1', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM sums),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size,
         CASE WHEN level * weight > cap THEN cap
              ELSE least(cap, coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER (), 0) * weight) END AS target
  FROM levels),
rates AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, s.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) * size AS taken FROM rates
"""
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SQL_LINES = f"""
WITH cut AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, source, unnest(parts) AS raw, unnest(range(len(parts))) AS place FROM cut),
named AS (SELECT *, trim(raw, {_SPACES}) AS line FROM lines),
spread AS (SELECT line FROM named WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce(source, chr(0))) >=
  CASE WHEN len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= 21 THEN 2 WHEN len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) >= 4 THEN 3 ELSE 6 END),
marked AS (
  SELECT n.*, s.line IS NOT NULL AND row_number() OVER (PARTITION BY n.line ORDER BY n.doc_id, n.place) > 1 AS gone
  FROM named n LEFT JOIN spread s ON n.line = s.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_SQL_DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
iw AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS m FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS win FROM sized),
lengths AS (SELECT DISTINCT m FROM win),
places AS (SELECT doc_id, m, list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' ')) AS wins FROM dw, lengths WHERE len(w) >= m),
flat AS (SELECT doc_id, m, unnest(wins) AS win, unnest(range(1, len(wins) + 1)) AS i FROM places),
hits AS (SELECT f.doc_id, f.i, f.m, w.item_id FROM flat f JOIN win w ON f.win = w.win AND f.m = w.m),
inside AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN inside USING (doc_id) LEFT JOIN found USING (doc_id)
"""
_SQL_NEAR = rf"""
WITH RECURSIVE dw AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM dw),
named AS (SELECT doc_id, s, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(s)) END AS c FROM sets),
flat AS (SELECT c, n, unnest(s) AS g FROM named WHERE c = doc_id),
links AS (
  SELECT a.c AS x, b.c AS y FROM flat a JOIN flat b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT DISTINCT c AS x, c AS y FROM named UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
least_of AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, n::BIGINT AS n_shingles, component_id FROM named JOIN least_of ON c = x
"""


def _covered(n: int) -> str:
    """Word characters inside windows of n words that a text holds twice or more, and those words."""
    return f"""win{n} AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g,
  unnest(range(1, len(w) - {n - 2})) AS i FROM dw WHERE len(w) >= {n}),
in{n} AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS times FROM win{n}) WHERE times > 1),
cover{n} AS (SELECT doc_id, count(*) AS words{n}, sum(length(w[p])) AS chars{n} FROM in{n} JOIN dw USING (doc_id) GROUP BY doc_id)"""


_SQL_QUALITY = rf"""
WITH dw AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
{_covered(5)},
{_covered(8)},
{_covered(13)},
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM dw),
later AS (
  SELECT doc_id, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY place) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) WHERE n > 1),
dup AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS dup_line_chars FROM later GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(words8, 0)::BIGINT AS n_repeat_words, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
         coalesce(chars5, 0)::BIGINT AS dup_chars_5, coalesce(chars8, 0)::BIGINT AS dup_chars_8, coalesce(chars13, 0)::BIGINT AS dup_chars_13
  FROM dw LEFT JOIN cover5 USING (doc_id) LEFT JOIN cover8 USING (doc_id) LEFT JOIN cover13 USING (doc_id) LEFT JOIN dup USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND dup_line_chars <= word_chars * {quality.LINE_LIMIT} AND dup_chars_5 <= word_chars * {quality.LIMITS[5]}
  AND dup_chars_8 <= word_chars * {quality.LIMITS[8]} AND dup_chars_13 <= word_chars * {quality.LIMITS[13]} AS kept FROM judged
"""


@query(_SQL_DECONTAMINATION)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("row", F.struct("doc_id", F.monotonically_increasing_id().alias("n")))
    found = decontamination.hits(documents, table(spark, sf_dir, "benchmark"), "row")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontamination.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


@query(_SQL_NEAR)
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.document_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query(_SQL_MIXING)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.counted(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query(_SQL_LINES)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.cleaned(table(spark, sf_dir, "documents"), report=True)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query()
def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms.pseudonymised(table(spark, sf_dir, "documents"), key=DEMONSTRATION_KEY)
    return found.select("doc_id", "text", F.size("replaced").cast("long").alias("n_replaced"), F.col("replaced.kind").alias("kinds"))


def _written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query()
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = secrets.found(documents, secrets.train(documents))
    return found.select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans")
    )


@query(_SQL_QUALITY)
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.measured(table(spark, sf_dir, "documents"))
    failed = quality.base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & quality.passed()).alias("kept"), "dup_line_chars",
        *(F.get("dup_gram_chars", i).alias(f"dup_chars_{n}") for i, n in enumerate(quality.LENGTHS)),
    )


@query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_counts.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = toxicity.scored(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))
    return found.select(
        F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query()
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text.extracted(pages, main_text.train(pages)).withColumnRenamed("id", "page_id")


#: Remainder of a document id by CRC-32, bit by bit over the decimal digits.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""
_SQL_RUNS = rf"""
WITH hashed AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, {_CRC} AS h FROM documents),
placed AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM hashed),
dw AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) ELSE w END AS w
  FROM placed),
grams AS (SELECT doc_id, n, unnest(range(n - 7)) AS i, unnest(list_transform(range(1, n - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM dw WHERE n >= 24),
pairs AS (SELECT b.doc_id, b.i, b.i - a.i AS lag FROM grams a JOIN grams b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i AND 3 * (b.i - a.i) <= a.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, min(i) - lag AS start, count(*) + 7 + lag AS length, lag FROM islands GROUP BY doc_id, lag, island HAVING count(*) + 7 + lag >= greatest(24, 3 * lag)),
runs AS (SELECT doc_id, start, length, min(lag) AS period FROM stretches GROUP BY doc_id, start, length),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY doc_id),
greatest_one AS (
  SELECT r.doc_id, r.start, r.length, r.period FROM runs r
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS p FROM runs) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS p FROM dw),
kept AS (
  SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.p) AS collapsed
  FROM words k LEFT JOIN (SELECT doc_id, unnest(gone) AS p FROM gone) g ON k.doc_id = g.doc_id AND k.p = g.p WHERE g.p IS NULL GROUP BY k.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM dw d LEFT JOIN listed USING (doc_id) LEFT JOIN greatest_one USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _with_planted_runs(documents: DataFrame) -> DataFrame:
    """Every tenth document by the hash of its id repeats words of its own from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        places = let(F.struct(a.alias("a"), p.alias("p")), lambda s: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"])))
        return F.array_join(F.transform(places, lambda i: F.get(words, i.cast("int"))), " ")

    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    planted = let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))
    return documents.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def _larger(x: Column, y: Column) -> Column:
    """The run of greater exponent; runs come by start, then period, so the first of equal ones stays."""
    return F.when(x.isNull() | (y["length"] * x["period"] > x["length"] * y["period"]), y).otherwise(x)


@query(_SQL_RUNS)
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.found(_with_planted_runs(table(spark, sf_dir, "documents")))
    nothing = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", nothing, _larger)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query()
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    known = byte_bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    found = byte_bpe.round_trip(table(spark, sf_dir, "documents"), known)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


_SQL_NEGATIVES = """
WITH taken AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM taken a JOIN taken b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
       n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


@query(_SQL_NEGATIVES)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    items = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), hard_negatives.scaled(F.col("embedding")).alias("vector"))
    return hard_negatives.mined(items, F.col("vec_id") % 50 == 0, id_="vec_id")
