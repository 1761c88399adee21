"""Projection, predicate and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import curation as cu, languages
from corpusloom.operators.ranking import top_k
from corpusloom.plans import statements as st
from corpusloom.plans.registry import query, table
from corpusloom.sizing import spread

WS = st.WS


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, lang, source FROM documents WHERE length(trim(text, {WS})) >= 50")
def min_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).filter(tx.long_enough(F.col("text"))).select("doc_id", "lang", "source")


@query("SELECT doc_id, substr(text, 1, 500) AS preview, length(substr(text, 1, 500)) AS n FROM documents")
def preview_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    preview = tx.prefix(F.col("text"), 500)
    return docs(spark, sf_dir).select("doc_id", preview.alias("preview"), F.length(preview).alias("n"))


@query(st.with_(st.QA) + f" SELECT pair_id, question, answer FROM qa WHERE trim(question, {WS}) <> '' AND trim(answer, {WS}) <> ''")
def required_fields_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-answer pairs with both sides filled."""
    filled = (tx.strip(F.col("question")) != "") & (tx.strip(F.col("answer")) != "")
    return qa_pairs(spark, sf_dir).filter(filled).select("pair_id", "question", "answer")


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows: (pair_id, conv_id, turn, question, answer)."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(said, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "conv_id", "turn", "question", "answer"
    )


@query(
    """SELECT doc_id, CASE WHEN coalesce(nullif(CASE WHEN lang = 'en' THEN substr(text, 1, 40) ELSE '' END, ''),
    nullif(CASE WHEN lang = 'fr' THEN source END, ''), lang, '') IS NULL THEN '' ELSE
    coalesce(nullif(CASE WHEN lang = 'en' THEN substr(text, 1, 40) ELSE '' END, ''), nullif(CASE WHEN lang = 'fr' THEN source END, ''), lang, '') END AS chosen
    FROM documents"""
)
def coalesce_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of three descriptions that is filled; empty strings count as missing."""
    a = F.when(F.col("lang") == "en", F.substring("text", 1, 40)).otherwise("")
    b = F.when(F.col("lang") == "fr", F.col("source"))
    return docs(spark, sf_dir).select("doc_id", tx.first_filled(a, b, F.col("lang")).alias("chosen"))


@query(
    f"""SELECT conv_id, trim(arg_min(text, turn), {WS}) AS question, arg_min(role, turn) AS role,
    'English' AS language, 'manuals' AS source, 'chips' AS domain FROM conversations GROUP BY conv_id"""
)
def array_head_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First message of each conversation and the constant columns of that source."""
    first = top_k(table(spark, sf_dir, "conversations"), ["conv_id"], [F.asc("turn")], 3, "n")  # a hot conversation is cut map-side
    conv = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("conversation"))
    head = F.get("conversation", F.lit(0))
    return conv.select(
        "conv_id", tx.strip(head["text"]).alias("question"), head["role"].alias("role"),
        F.lit("English").alias("language"), F.lit("manuals").alias("source"), F.lit("chips").alias("domain"),
    )


_COUNT = lambda p: f"len(regexp_extract_all(text, '{p}'))"
_SCRIPTS = f"""SELECT *, {_COUNT(tx.CHINESE)} AS zh, {_COUNT(tx.JAPANESE)} AS ja, {_COUNT(tx.KOREAN)} AS ko, {_COUNT(tx.ENGLISH)} AS en FROM texts"""
_TEXTS = "texts AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - page_id, html FROM pages)"
_LANGUAGE = """CASE WHEN zh > 0 AND zh >= ja AND zh >= ko AND zh >= en THEN 'Chinese' WHEN ja > 0 AND ja >= ko AND ja >= en THEN 'Japanese'
  WHEN ko > 0 AND ko >= en THEN 'Korean' ELSE 'English' END"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("id"), F.col("html").alias("text"))
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text").unionByName(pages)


@query(st.with_(_TEXTS) + f" SELECT id, {_LANGUAGE} AS language FROM ({_SCRIPTS})")
def language_by_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", tx.script_language(F.col("text")).alias("language"))


@query(
    st.with_(_TEXTS)
    + f""" SELECT id, CASE WHEN zh > 0 THEN 'Chinese' WHEN ja > 0 THEN 'Japanese' WHEN ko > 0 THEN 'Korean' ELSE 'English' END AS language
  FROM ({_SCRIPTS})"""
)
def language_any_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("id", tx.any_script_language(F.col("text")).alias("language"))


_REPLY_OF = {"fr": "It is french.", "de": "German", "es": "spanish, maybe"}


@query(
    "SELECT doc_id, CASE lang WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE "
    + f"{_LANGUAGE} END AS language FROM (SELECT *, {_COUNT(tx.CHINESE)} AS zh, {_COUNT(tx.JAPANESE)} AS ja, {_COUNT(tx.KOREAN)} AS ko, {_COUNT(tx.ENGLISH)} AS en FROM documents)"
)
def language_named_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language named in a model's reply (stand-in replies), falling back on the script count."""
    reply = F.lit("unclear")
    for lang, said in _REPLY_OF.items():
        reply = F.when(F.col("lang") == lang, said).otherwise(reply)
    return docs(spark, sf_dir).select("doc_id", tx.named_language(reply, F.col("text")).alias("language"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, event_type FROM events WHERE event_type <> 'error'")
def fence_strip_parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced, bare and broken replies parsed; broken ones (of error events) are dropped."""
    kind = F.col("event_type")
    fenced = F.when(kind == "click", F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(
        kind == "view", F.concat(F.lit("```"), "props", F.lit("  ```"))
    ).when(kind == "error", F.concat(F.lit("```json\n"), F.substring("props", 1, 4))).otherwise(F.col("props"))
    parsed = table(spark, sf_dir, "events").withColumn("reply", tx.parse_reply(fenced, "k bigint"))
    return parsed.filter("reply.k is not null").select("event_id", F.col("reply.k").alias("k"), "event_type")


@query(
    """SELECT d.doc_id, md5(substr(text, 1, 200)) AS text_key, md5(doc_id || ':' || substr(text, 1, 100)) AS item_key FROM documents d"""
)
def md5_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(
        "doc_id", tx.prefix_key(F.col("text"), 200).alias("text_key"), tx.item_key(F.col("doc_id"), F.col("text"), 100).alias("item_key")
    )


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    "SELECT doc_id, "
    + "CASE lang "
    + " ".join(f"WHEN '{code}' THEN {_quote(cu._ASK_QA[name])}" for code, name in (("de", "Chinese"), ("fr", "Japanese"), ("es", "Korean")))
    + f" ELSE {_quote(cu._ASK_QA['English'])} END || text AS prompt FROM documents"
)
def prompt_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction by language, English where there is none (the four corpus languages stand in)."""
    name = F.when(F.col("lang") == "de", "Chinese").when(F.col("lang") == "fr", "Japanese").when(F.col("lang") == "es", "Korean").otherwise("Other")
    return docs(spark, sf_dir).select("doc_id", cu.qa_prompt(name, F.col("text")).alias("prompt"))


@query(
    st.with_(st.QA)
    + f" SELECT pair_id, {st.default_cot('question')} AS cot FROM qa"
)
def default_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa_pairs(spark, sf_dir).select("pair_id", cu.default_cot(F.col("question")).alias("cot"))


def MTEVAL_SQL(e: str) -> str:
    """The rules of ``tx.mteval_tokens`` in SQL."""
    e = f"replace(replace(replace({e}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for entity, char in tx.MTEVAL_ENTITIES:
        e = f"replace({e}, '{entity}', '{char}')"
    e = f"' ' || {e} || ' '"
    for pattern, replacement in tx.MTEVAL_13A:
        e = f"regexp_replace({e}, '{pattern}', '{replacement.replace('$', chr(92))}', 'g')"
    return rf"list_filter(regexp_split_to_array({e}, '\s+'), lambda w: w <> '')"


@query(f"SELECT doc_id, array_to_string({MTEVAL_SQL('text')}, ' ') AS words FROM documents")
def mteval_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mteval-13a word tokens."""
    return spread(docs(spark, sf_dir)).select("doc_id", F.array_join(tx.mteval_tokens(F.col("text")), " ").alias("words"))


@query(f"SELECT doc_id, array_to_string({st.tokens('text')}, ' ') AS words, len(list_distinct({st.tokens('text')})) AS n FROM documents")
def mixed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search tokens and how many are distinct."""
    words = tx.tokens(F.col("text"))
    return spread(docs(spark, sf_dir)).select("doc_id", F.array_join(words, " ").alias("words"), F.size(F.array_distinct(words)).alias("n"))


@query(st.with_(st.QA) + f" SELECT pair_id, trim(question, chr(10)) AS thinking, trim(answer, chr(10)) AS answer FROM qa")
def split_on_think(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thinking and answer of a model output."""
    output = F.concat(F.lit("<think>\n"), "question", F.lit("\n</think>\n\n"), "answer")
    thinking, answer = tx.after_think(output)
    return qa_pairs(spark, sf_dir).select("pair_id", thinking.alias("thinking"), answer.alias("answer"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 400 + event_id % 100 ELSE 500 END AS code FROM events")
def error_code_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upstream status in an error text."""
    message = F.when(
        F.col("event_type") == "error", F.concat(F.lit("Error code: "), (400 + F.col("event_id") % 100).cast("string"), F.lit(" - {}"))
    ).otherwise("connection lost")
    return table(spark, sf_dir, "events").select("event_id", tx.error_code(message).alias("code"))


@query(
    f"""SELECT page_id, CASE WHEN u LIKE '%/v1/rerank' THEN u ELSE u || '/v1/rerank' END AS endpoint
  FROM (SELECT page_id, rtrim(trim(url, {WS}), '/') AS u FROM pages)"""
)
def endpoint_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service address with the path appended once."""
    return table(spark, sf_dir, "pages").select("page_id", tx.rerank_endpoint(F.col("url")).alias("endpoint"))


@query(
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'PDF' WHEN 1 THEN 'Word' WHEN 2 THEN 'Excel' WHEN 3 THEN 'Word' END AS file_type FROM pages"""
)
def document_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File type by extension in any case; unsupported files give NULL."""
    ext = F.element_at(F.array(*[F.lit(e) for e in (".PDF", ".docx", ".XLS", ".doc", ".md")]), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", tx.document_type(F.concat("url", ext)).alias("file_type"))


@query("SELECT event_id, 'data: {\"type\":\"' || event_type || '\",\"user\":' || user_id || '}' || chr(10) || chr(10) AS event FROM events")
def server_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as server-sent event text."""
    payload = F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))
    return table(spark, sf_dir, "events").select("event_id", tx.server_event(payload).alias("event"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS stamp FROM events")
def iso_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO text of an injected clock (the event time)."""
    return table(spark, sf_dir, "events").select("event_id", tx.iso_timestamp(F.col("ts")).alias("stamp"))


@query("SELECT doc_id, source || '.pdf::p' || (doc_id % 7) || '::l' || (doc_id % 3 + 1) || '::' || doc_id AS chunk_id FROM documents")
def chunk_id_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = tx.chunk_id(F.concat("source", F.lit(".pdf")), F.col("doc_id") % 7, F.col("doc_id") % 3 + 1, F.col("doc_id"))
    return docs(spark, sf_dir).select("doc_id", made.alias("chunk_id"))


_LANGUAGE_SQL = f"""
WITH held AS (SELECT doc_id, lang, coalesce(text, '') AS text, substr(md5(doc_id::VARCHAR), 1, 1) IN ('0', '1', '2') AS held_out FROM documents),
cut AS (SELECT doc_id, lang, held_out, text, list_transform(string_split(' ' || lower(text) || ' ', ''), lambda c: ascii(c)::BIGINT) AS p FROM held),
grams AS (
  SELECT *, CASE WHEN len(p) > 2 AND text <> '' THEN list_transform(range(1, len(p) - 1), lambda i: (p[i] * 961 + p[i + 1] * 31 + p[i + 2]) % {languages.BUCKETS}) ELSE [] END AS g FROM cut),
labelled AS (SELECT lang, g FROM grams WHERE lang IS NOT NULL AND text <> '' AND NOT held_out),
counts AS (SELECT lang, b, count(*) AS n FROM (SELECT lang, unnest(g) AS b FROM labelled) GROUP BY lang, b),
sums AS (SELECT lang, sum(n) AS total FROM counts GROUP BY lang),
profile AS (
  SELECT s.lang, b.b, round({languages.UNIT} * ln((coalesce(c.n, 0) + 5e-1) / (s.total + 5e-1 * {languages.BUCKETS})))::BIGINT AS w
  FROM sums s CROSS JOIN (SELECT unnest(range({languages.BUCKETS})) AS b) b LEFT JOIN counts c ON c.lang = s.lang AND c.b = b.b),
flat AS (SELECT doc_id, b, count(*) AS n FROM (SELECT doc_id, unnest(g) AS b FROM grams) GROUP BY doc_id, b),
scored AS (SELECT doc_id, lang, sum(n * w)::BIGINT AS score FROM flat JOIN profile USING (b) GROUP BY doc_id, lang),
placed AS (
  SELECT doc_id, lang AS language, score - lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS margin,
         row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS place FROM scored)
SELECT h.doc_id, held_out, language, margin::BIGINT AS margin FROM held h LEFT JOIN (SELECT * FROM placed WHERE place = 1) USING (doc_id)
"""


@query(_LANGUAGE_SQL)
def language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by trigram profiles fitted on all texts outside the held-out fold."""
    held = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1).isin("0", "1", "2")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held.alias("held_out"))
    profiles = languages.fit(documents.filter(~F.col("held_out")), "lang", "text", "doc_id")
    found = documents.withColumn("found", languages.identified(F.col("text"), profiles))
    return found.select("doc_id", "held_out", "found.language", "found.margin")
