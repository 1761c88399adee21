"""Session, source, sink and store queries. Written data goes to new paths in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom import sizing
from corpusloom.functions.models import ColumnChat
from corpusloom.operators import chunking, sessions as ss
from corpusloom.plans import statements as st
from corpusloom.plans.registry import ORACLES, query, table
from corpusloom.plans.text_queries import docs
from corpusloom.session import scratch_path, writing
from corpusloom.sources import jsonl, tables
from corpusloom.streaming import ingest, turns

_MESSAGES = """messages AS (SELECT 'user' || conv_id % 7 AS user_id, 's' || conv_id AS session_id, turn,
  CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE role END AS type, text AS content,
  strftime(TIMESTAMP '2024-01-01' + to_hours(conv_id % 500) + to_minutes(turn), '%Y-%m-%dT%H:%M:%S.%f') AS timestamp FROM conversations)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as stored chat messages, with users and times derived from their ids."""
    conv = F.col("conv_id")
    kind = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "ai").otherwise(F.col("role"))
    minutes = (conv % 500) * 60 + F.col("turn")
    stamp = F.concat(
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.floor(minutes / 1440).cast("int")), "yyyy-MM-dd"),
        F.format_string("T%02d:%02d:00.000000", F.floor(minutes % 1440 / 60), minutes % 60),
    )
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("user"), (conv % 7).cast("string")).alias("user_id"),
        F.concat(F.lit("s"), conv.cast("string")).alias("session_id"),
        "turn", kind.alias("type"), F.col("text").alias("content"), stamp.alias("timestamp"),
    )


@query(st.with_(_MESSAGES) + " SELECT user_id, session_id, max(timestamp) AS updated_at, count(*) AS message_count FROM messages GROUP BY ALL")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their last time and size, latest first."""
    return ss.latest_first(ss.summaries(messages(spark, sf_dir)))


@query(st.with_(_MESSAGES) + " SELECT user_id, session_id, arg_max(content, turn) AS content FROM messages GROUP BY ALL")
def last_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ss.last_message(messages(spark, sf_dir))


@query(st.with_(_MESSAGES) + " SELECT user_id, session_id, turn, type, content FROM messages WHERE type IN ('human', 'ai', 'system') AND turn <> 3")
def session_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of known types; every fourth turn is given an unknown one here."""
    rows = messages(spark, sf_dir).withColumn("type", F.when(F.col("turn") == 3, "tool").otherwise(F.col("type")))
    return ss.load(rows).select("user_id", "session_id", "turn", "type", "content")


_LINES = "string_agg(CASE WHEN type = 'human' THEN '用户: ' ELSE 'AI: ' END || content, chr(10) ORDER BY turn)"


@query(st.with_(_MESSAGES) + f" SELECT user_id, session_id, {_LINES} AS transcript FROM messages GROUP BY user_id, session_id")
def format_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of each session as text."""
    return ss.transcript(messages(spark, sf_dir))


_SUMMARISER = ColumnChat(lambda p: F.concat(F.lit("summary of "), F.length(p).cast("string")))
_PROMPT_LENGTH = len(ss.SUMMARY_ASKED) + len(ss.SUMMARY_END)


@query(
    st.with_(
        _MESSAGES,
        "n AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY user_id, session_id) AS size FROM messages)",
    )
    + f""" SELECT user_id, session_id, turn, type, content FROM n WHERE NOT (size > 5 AND n <= 4)
UNION ALL SELECT user_id, session_id, -1, 'system', '之前的对话摘要：' || chr(10) || 'summary of ' || (length({_LINES}) + {_PROMPT_LENGTH}) FROM n WHERE size > 5 AND n <= 4 GROUP BY user_id, session_id"""
)
def history_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions above five messages get their first four summarised (the limits are parameters)."""
    return ss.compact(messages(spark, sf_dir), _SUMMARISER, limit=5, head=4).drop("timestamp")


@query(
    st.with_(_MESSAGES)
    + f""" SELECT user_id, session_id, turn, content, call_no, call_no = first_call AS allowed,
  CASE WHEN call_no <> first_call THEN '{ss.LIMIT_MESSAGE}' END AS reply
  FROM (SELECT user_id, session_id, (turn // 2) AS turn, content, turn AS call_no, min(turn) OVER (PARTITION BY user_id, session_id, turn // 2) AS first_call FROM messages)"""
)
def tool_call_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search call per turn: two messages are taken as the calls of one turn here."""
    return ss.guard_calls(_calls(spark, sf_dir))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select(
        "user_id", "session_id", F.expr("turn div 2").alias("turn"), "content", F.col("turn").alias("call_no")
    )


@query(ORACLES["tool_call_guard"])
def tool_call_guard_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same decisions while the calls arrive, in three runs that share their state; most turns lie in two of them."""
    inbox, progress, out = (scratch_path(spark, n) for n in ("calls", "turns", "guarded"))
    calls = _calls(spark, sf_dir)
    for arriving in (F.col("call_no") < 3, F.col("call_no").isin(3, 4), F.col("call_no") > 4):
        calls.filter(arriving).write.mode("append").parquet(inbox)
        turns.write_available(turns.guard_stream(spark.readStream.schema(calls.schema).parquet(inbox)), out, progress)
    return spark.read.parquet(out)


@query(
    st.with_(_MESSAGES)
    + """ SELECT user_id, session_id, turn, type, content, rag_trace FROM (
  SELECT *, CASE WHEN user_id = 'user3' AND turn = max(turn) OVER (PARTITION BY user_id, session_id) THEN '{"tool_used":true}' END AS rag_trace
  FROM messages WHERE user_id <> 'user3' OR turn < 2) WHERE user_id <> 'user5'"""
)
def session_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save all sessions, save one user's again shortened with a trace on the last message, delete another user's."""
    rows = messages(spark, sf_dir).withColumn("rag_trace", F.lit(None).cast("string"))
    store = tables.session_store(spark, scratch_path(spark, "sessions"), buckets=16)
    store.replace(rows)
    again = rows.filter("user_id = 'user3' and turn < 2")
    last = again.groupBy(*ss.SESSION).agg(F.max("turn").alias("turn")).withColumn("_t", F.lit('{"tool_used":true}'))
    traced = again.join(last, [*ss.SESSION, "turn"], "left").withColumn("rag_trace", F.col("_t")).drop("_t")
    store.replace(traced)
    store.delete(rows.filter("user_id = 'user5'"))
    return store.read().select("user_id", "session_id", "turn", "type", "content", "rag_trace")


@query("SELECT doc_id, text, source FROM documents WHERE doc_id % 3 <> 0")
def jsonl_permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines read back with the malformed and blank ones dropped (every third line is spoilt)."""
    good = F.to_json(F.struct("doc_id", "text", "source"))
    spoilt = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.substring(good, 1, 15))
    path = scratch_path(spark, "lines")
    docs(spark, sf_dir).select(F.when(F.col("doc_id") % 3 == 0, spoilt).otherwise(good).alias("value")).write.text(path)
    return jsonl.read_jsonl(spark, path, "doc_id bigint, text string, source string")


@query("SELECT doc_id, source FROM documents UNION ALL SELECT doc_id, source FROM documents WHERE lang = 'fr'")
def jsonl_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overwrite of a JSON-lines folder and two appends to it."""
    path = scratch_path(spark, "append")
    rows = docs(spark, sf_dir).select("doc_id", "source", "lang")
    jsonl.overwrite_jsonl(rows.filter("lang <> 'fr'"), path)
    jsonl.append_jsonl(rows.filter("lang = 'fr'"), path)
    jsonl.append_jsonl(rows.filter("lang = 'fr'"), path)
    return jsonl.read_jsonl(spark, path, "doc_id bigint, source string")


@query("SELECT lang || ' ' || doc_id AS value FROM documents UNION ALL SELECT 'b ' || item_id FROM benchmark")
def raw_line_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two files concatenated without parsing, blank ones left out."""
    a, b, out = (scratch_path(spark, n) for n in ("a", "b", "all"))
    lines = docs(spark, sf_dir).select(F.explode(F.array(F.concat_ws(" ", "lang", "doc_id"), F.lit("  "))).alias("value"))
    lines.write.text(a)
    table(spark, sf_dir, "benchmark").select(F.concat_ws(" ", F.lit("b"), "item_id").alias("value")).write.text(b)
    return jsonl.concat_lines(spark, [a, b], out)


def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(
        "text", F.col("source").alias("filename"), F.lit("PDF").alias("file_type"), F.lit("").alias("file_path"),
        F.lit(0).cast("long").alias("page_number"), F.col("doc_id").alias("chunk_idx"),
        F.when(F.col("doc_id") % 11 == 0, "  ").otherwise(F.concat(F.lit("c"), (F.col("doc_id") % 300).cast("string"))).alias("chunk_id"),
        F.lit("").alias("parent_chunk_id"), F.lit("").alias("root_chunk_id"), F.lit(1).cast("long").alias("chunk_level"), "doc_id",
    )


@query(
    """SELECT chunk_id, chunk_idx, filename FROM (SELECT 'c' || doc_id % 300 AS chunk_id, doc_id AS chunk_idx, source AS filename,
  row_number() OVER (PARTITION BY doc_id % 300 ORDER BY doc_id DESC) AS n FROM documents WHERE doc_id % 11 <> 0) WHERE n = 1"""
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert in two rounds: the last arrival wins, blank ids are skipped."""
    store = tables.StoredTable(spark, scratch_path(spark, "upsert"), tables.CHUNK, ["chunk_id"], ["chunk_id"], 8)
    rows = _parents(spark, sf_dir)
    early = F.col("text") < "M"
    store.upsert(rows.filter(early), "doc_id")
    store.upsert(rows, "doc_id")
    return store.read().select("chunk_id", "chunk_idx", "filename")


@query("SELECT doc_id AS chunk_idx, source AS filename FROM documents WHERE source NOT IN ('src3', 'src7')")
def delete_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left after deleting two files."""
    store = tables.StoredTable(spark, scratch_path(spark, "delete"), tables.CHUNK, ["filename"], ["chunk_idx"], 8)
    store.append(_parents(spark, sf_dir))
    store.delete(spark.createDataFrame([("src3",), ("src7",)], "filename string"))
    return store.read().select("chunk_idx", "filename")


@query("SELECT source AS filename, 'PDF' AS file_type, count(*) AS chunk_count FROM documents GROUP BY source")
def file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk count and type per file, over all rows."""
    return tables.list_documents(_parents(spark, sf_dir))


@query("SELECT doc_id AS chunk_idx, source AS filename FROM documents WHERE source = 'src4' ORDER BY doc_id LIMIT 10")
def predicate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, projection and limit on a stored table."""
    store = tables.StoredTable(spark, scratch_path(spark, "query"), tables.CHUNK, ["filename"], ["chunk_idx"], 8)
    store.append(_parents(spark, sf_dir))
    return store.query(F.col("filename") == "src4", ["chunk_idx", "filename"], limit=10)


@query("SELECT doc_id AS chunk_idx, text, 'c' || doc_id % 300 AS chunk_id FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 300 IN (1, 2, 250)")
def id_list_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by id list, blank ids ignored, nine or fewer columns read."""
    store = tables.StoredTable(spark, scratch_path(spark, "ids"), tables.CHUNK, ["filename"], ["chunk_idx"], 8)
    store.append(_parents(spark, sf_dir), rows_per_file=50)
    return store.by_ids(["c1", "", "c2", "c250"], fields=["chunk_idx", "text", "chunk_id"])


_UPLOADS = """(SELECT source AS filename, doc_id AS page_number, CASE WHEN doc_id % 2 = 1 AND source IN ('src1', 'src5') THEN 'Second: ' || text ELSE text END AS text
  FROM documents WHERE NOT (source IN ('src1', 'src5') AND doc_id % 2 = 0))"""


def _upload_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(
        F.col("source").alias("filename"), F.lit("").alias("file_path"), F.lit("PDF").alias("file_type"),
        F.col("doc_id").alias("page_number"), "text", F.lit(1).cast("long").alias("version"),
    )


_NUMBERED = """, n AS (SELECT filename, page_number, count(*) AS n FROM chunk GROUP BY ALL),
ahead AS (SELECT filename, page_number, coalesce(sum(n) OVER (PARTITION BY filename ORDER BY page_number
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM n)
SELECT filename, chunk_id, parent_chunk_id, chunk_level, (page_chunk_idx + ahead)::BIGINT AS chunk_idx, text FROM chunk JOIN ahead USING (filename, page_number)"""


def _stored_chunks(store: tables.Collection) -> DataFrame:
    both = store.leaves.read().unionByName(store.parents.read())
    return both.select("filename", "chunk_id", "parent_chunk_id", "chunk_level", "chunk_idx", "text")


def _second_upload(pages: DataFrame) -> DataFrame:
    again = pages.filter("filename in ('src1', 'src5') and page_number % 2 = 1")
    return again.withColumns({"text": F.concat(F.lit("Second: "), "text"), "version": F.lit(2).cast("long")})


@query(st.with_(st.chunks(_UPLOADS)) + _NUMBERED)
def replace_on_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload all files, then two of them again with fewer and changed pages: no old chunk survives."""
    store = tables.Collection(spark, scratch_path(spark, "collection"), buckets=8)
    pages = sizing.spread(_upload_pages(spark, sf_dir), "page_number")
    for batch in (pages, _second_upload(pages)):
        ingest.ingest_pages(batch, store, chunking.window_levels(F.col("text")))
    return _stored_chunks(store)


#: Page files arrive packed, at the codec's fastest.
_PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


@query(st.with_(st.chunks(_UPLOADS)) + _NUMBERED)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same two uploads and a late repeat of an old one, one input file per batch, so that files lie in several batches."""
    inbox, checkpoint = scratch_path(spark, "inbox"), scratch_path(spark, "progress")
    store = tables.Collection(spark, scratch_path(spark, "streamed"), buckets=8)
    pages = _upload_pages(spark, sf_dir)
    for batch, files in ((pages, 2), (_second_upload(pages), 1), (pages.filter("filename = 'src1'"), 1)):
        with writing(spark):
            batch.repartition(files, "page_number").write.mode("append").options(**_PACKED).json(inbox)
        run = ingest.watch_pages(spark, inbox, store, checkpoint, lambda: chunking.window_levels(F.col("text")), max_files=1)
        run.awaitTermination()
    return _stored_chunks(store)
