import io
import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.models import ColumnChat
from corpusloom.operators import chunking, sessions as ss
from corpusloom.session import scratch_path
from corpusloom.sources import documents, jsonl, tables
from corpusloom.streaming import ingest, turns


def chat_rows(spark, n, session="s1"):
    rows = [("u1", session, i, "human" if i % 2 == 0 else "ai", f"m{i}", f"2024-01-01T00:00:{i:02d}") for i in range(n)]
    return spark.createDataFrame(rows, "user_id string, session_id string, turn long, type string, content string, timestamp string")


def test_compaction_at_51_messages(spark):
    chat = ColumnChat(lambda p: F.concat(F.lit("S:"), F.substring(F.substring_index(p, "\n\n", -2), 1, 12)))
    long = ss.compact(chat_rows(spark, 51), chat).orderBy("turn").collect()
    assert len(long) == 12 and long[0].type == "system" and long[0].content.startswith("之前的对话摘要：\nS:用户: m0\nAI: ")
    assert [r.turn for r in long[1:]] == list(range(40, 51))
    assert ss.compact(chat_rows(spark, 50), chat).count() == 50


def test_session_store_replace_delete_and_listing(spark):
    store = tables.session_store(spark, scratch_path(spark, "s"), buckets=2)
    none = F.lit(None).cast("string").alias("rag_trace")
    both = chat_rows(spark, 4).unionByName(chat_rows(spark, 3, "s2")).select("*", none)
    store.replace(both)
    store.replace(chat_rows(spark, 2).select("*", none))
    listed = {r.session_id: r.message_count for r in ss.summaries(store.read()).collect()}
    assert listed == {"s1": 2, "s2": 3}
    assert ss.latest_first(ss.summaries(store.read())).first().session_id == "s2"
    assert store.delete(both.filter("session_id = 's2'")) == 3 and store.delete(both.filter("session_id = 's2'")) == 0
    assert store.delete(both) == 2 and store.read().count() == 0
    assert ss.last_message(chat_rows(spark, 3)).first().content == "m2"


def chunk_rows(spark, rows):
    df = spark.createDataFrame(rows, "chunk_id string, filename string, chunk_level long, text string, seq int")
    blank = [F.lit("").alias(c) for c in ("file_type", "file_path", "parent_chunk_id", "root_chunk_id")]
    return df.select("*", *blank, F.lit(0).cast("long").alias("page_number"), F.lit(0).cast("long").alias("chunk_idx"))


def test_upsert_last_arrival_wins_and_blank_ids_are_skipped(spark):
    store = tables.StoredTable(spark, scratch_path(spark, "u"), tables.CHUNK, ["chunk_id"], ["chunk_id"], 4)
    assert store.read().count() == 0
    assert store.upsert(chunk_rows(spark, [("a", "f", 1, "old", 1), ("a", "f", 1, "new", 2), (" ", "f", 1, "x", 3), (None, "f", 1, "x", 4)]), "seq") == 2
    assert store.upsert(chunk_rows(spark, [("b", "g", 1, "b", 1)]), "seq") == 1
    assert store.upsert(chunk_rows(spark, [("a", "f", 1, "newer", 1)]), "seq") == 1
    assert {r.chunk_id: r.text for r in store.read().collect()} == {"a": "newer", "b": "b"}
    store.drop()
    assert not store.exists() and store.read().count() == 0


def test_collection_replaces_whole_files_and_refuses_leafless_ones(spark):
    store = tables.Collection(spark, scratch_path(spark, "c"), buckets=3)
    first = chunk_rows(spark, [(f"{f}{i}", f, 3 if i else 1, "t", 0) for f in "abcdef" for i in range(5)])
    store.replace_files(first)
    store.replace_files(chunk_rows(spark, [("a9", "a", 3, "new", 0), ("a8", "a", 2, "new", 0)]))
    counts = {r.filename: r.chunk_count for r in store.documents().collect()}
    assert counts == {"a": 1, **{f: 4 for f in "bcdef"}}
    with pytest.raises(ValueError):
        store.replace_files(chunk_rows(spark, [("b9", "b", 1, "only a parent", 0)]))
    assert store.delete_files(spark.createDataFrame([(f,) for f in "abcdef"], "filename string")) == 21
    assert store.leaves.read().count() == 0 and store.parents.read().count() == 0


def test_jsonl_sinks_keep_text_and_skip_bad_lines(spark):
    path = scratch_path(spark, "j")
    df = spark.createDataFrame([(1, "é 电路", None)], "id int, t string, n string")
    jsonl.overwrite_jsonl(df, path)
    jsonl.append_jsonl(df, path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert len(lines) == 2 and "电路" in lines[0] and json.loads(lines[0])["n"] is None
    bad = scratch_path(spark, "b")
    spark.createDataFrame([('{"id": 1}',), ("",), ("  ",), ("{oops",), ("[]",), ('{"id": 2, "x": 1}',)], "value string").coalesce(1).write.text(bad)
    assert sorted(r.id for r in jsonl.read_jsonl(spark, bad, "id int").filter("id is not null").collect()) == [1, 2]
    assert jsonl.read_lines(spark, bad).count() == 4


def test_json_array_scan(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"q": "x"}, {"q": "y"}]', encoding="utf-8")
    assert sorted(r.q for r in jsonl.read_json_array(spark, str(tmp_path), "q string").collect()) == ["x", "y"]


def office_file(parts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, body in parts.items():
            archive.writestr(name, body)
    return buffer.getvalue()


def test_folder_load_skips_broken_and_foreign_files(spark, tmp_path):
    word = office_file({"word/document.xml": '<w:document xmlns:w="x"><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:t>Two</w:t></w:p></w:document>'})
    sheet = office_file(
        {
            "xl/sharedStrings.xml": '<s xmlns="x"><si><t>Name</t></si></s>',
            "xl/worksheets/sheet1.xml": '<w xmlns="x"><sheetData><row><c t="s"><v>0</v></c><c><v>3.5</v></c></row></sheetData></w>',
        }
    )
    for name, data in {"a.DOCX": word, "b.xlsx": sheet, "c.docx": b"broken", "d.txt": b"text", "e.pdf": b"p1\fp2"}.items():
        (tmp_path / name).write_bytes(data)
    pages = documents.load_folder(spark, str(tmp_path), {"PDF": lambda data: data.decode().split("\f")})
    got = sorted((r.filename, r.file_type, r.page_number, r.text) for r in pages.collect())
    assert got == [("a.DOCX", "Word", 0, "One\n\nTwo"), ("b.xlsx", "Excel", 0, "Name 3.5"), ("e.pdf", "PDF", 0, "p1"), ("e.pdf", "PDF", 1, "p2")]
    parsed = {r.filename: r.error for r in documents.parse_files(documents.scan_files(spark, str(tmp_path))).collect()}
    assert set(parsed) == {"a.DOCX", "b.xlsx", "c.docx", "e.pdf"} and parsed["c.docx"] and parsed["a.DOCX"] is None


def test_stream_ingest_replays_without_duplicates(spark):
    inbox, progress = scratch_path(spark, "in"), scratch_path(spark, "cp")
    store = tables.Collection(spark, scratch_path(spark, "st"), buckets=2)
    page = lambda name, n, text, v: (name, "", "PDF", n, text, v)
    ddl = "filename string, file_path string, file_type string, page_number long, text string, version long"
    events = []
    listener = ingest.ProgressEvents(events.append)
    spark.streams.addListener(listener)

    def arrive(rows):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").json(inbox)
        ingest.watch_pages(spark, inbox, store, progress, lambda: chunking.separator_levels(F.col("text"))).awaitTermination()

    arrive([page("a", 0, "alpha " * 300, 1), page("a", 1, "beta", 1), page("b", 0, "gamma", 1)])
    before = store.leaves.read().count()
    assert before > 3
    arrive([page("a", 0, "old", 2), page("a", 0, "fresh", 3)])
    assert {(r.filename, r.text) for r in store.leaves.read().collect()} == {("a", "fresh"), ("b", "gamma")}
    spark.streams.removeListener(listener)
    assert os.path.isdir(progress)


def test_tool_guard(spark):
    calls = spark.createDataFrame([("u", "s", 1, 1), ("u", "s", 1, 2), ("u", "s", 2, 3)], "user_id string, session_id string, turn int, call_no int")
    got = {r.call_no: (r.allowed, r.reply) for r in ss.guard_calls(calls).collect()}
    assert got[1] == (True, None) and got[3] == (True, None) and got[2] == (False, ss.LIMIT_MESSAGE)


def test_turn_guard_over_several_batches(spark):
    """Order within a batch, calls of a turn in several batches, null keys, repeated rows, and a turn that its timer ends."""
    inbox, progress, out = (scratch_path(spark, n) for n in ("calls", "turns", "guarded"))
    ddl = "user_id string, session_id string, turn long, call_no long, args array<long>"
    batches = [
        [("u", "s", 1, 2**60 + 2, None), ("u", "s", 1, 2**60 + 1, [1]), ("u", None, 1, None, None), ("u", None, 1, None, None)],
        [("u", "s", 1, 5, None), ("u", "s", 2, 6, [2, 3]), ("v", "s", 1, 7, None)],
        [],
    ]
    events = []
    listener = ingest.ProgressEvents(events.append)
    spark.streams.addListener(listener)
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(ddl).parquet(inbox)
        turns.write_available(turns.guard_stream(stream, idle_ms=3_600_000), out, progress)
    got = spark.read.parquet(out).collect()
    assert sorted(r.call_no for r in got if r.allowed and r.call_no) == [6, 7, 2**60 + 1]
    assert sorted(r.allowed for r in got if r.session_id is None) == [False, True]
    assert all((r.reply is None) == r.allowed for r in got) and len(got) == 7
    assert {r.call_no: r.args for r in got if r.args} == {2**60 + 1: [1], 6: [2, 3]}
    for _ in range(50):
        counted = [e for e in events if '"counters"' in e]
        if len(counted) >= 2:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert '"calls": 4, "allowed": 2' in counted[0] and '"calls": 3, "allowed": 2' in counted[1]


def test_idle_turn_is_forgotten(spark):
    inbox, progress, out = (scratch_path(spark, n) for n in ("calls", "turns", "guarded"))
    ddl = "user_id string, session_id string, turn long, call_no long"
    for call_no, turn in ((1, 1), (2, 2), (3, 1)):
        spark.createDataFrame([("u", "s", turn, call_no)], ddl).coalesce(1).write.mode("append").parquet(inbox)
        turns.write_available(turns.guard_stream(spark.readStream.schema(ddl).parquet(inbox), idle_ms=1), out, progress)
    assert [r.allowed for r in spark.read.parquet(out).orderBy("call_no").collect()] == [True, True, True]


def page_rows(spark, rows):
    made = spark.createDataFrame(rows, "filename string, page_number long, text string, version long")
    return made.select("filename", F.lit("").alias("file_path"), F.lit("PDF").alias("file_type"), "page_number", "text", "version")


@pytest.mark.parametrize("max_files", [1, 1000])
def test_pages_of_one_file_over_several_batches(spark, max_files):
    inbox, store = scratch_path(spark, "inbox"), tables.Collection(spark, scratch_path(spark, "c"), buckets=2)
    for part in range(4):
        page_rows(spark, [("f", part * 2 + k, f"page {part * 2 + k}", 1) for k in range(2)]).coalesce(1).write.mode("append").json(inbox)
    ingest.watch_pages(spark, inbox, store, scratch_path(spark, "p"), max_files=max_files).awaitTermination()
    assert sorted(r.text for r in store.leaves.read().collect()) == [f"page {i}" for i in range(8)]


def test_late_old_version_changes_nothing(spark):
    store = tables.Collection(spark, scratch_path(spark, "c"), buckets=2)
    for rows in ([("f", i, f"new {i}", 2) for i in range(8)], [("f", 0, "old", 1)], [("f", 8, "new 8", 2), ("f", 0, "new 0", 2)]):
        ingest.ingest_pages(page_rows(spark, rows), store)
    assert sorted(r.text for r in store.leaves.read().collect()) == [f"new {i}" for i in range(9)]


def test_pages_without_version_or_file_are_kept_aside(spark):
    store = tables.Collection(spark, scratch_path(spark, "c"), buckets=2)
    ingest.ingest_pages(page_rows(spark, [("f", 0, "good", 1), ("f", 1, "lost", None), (None, 2, "nameless", 3)]), store)
    assert [r.text for r in store.leaves.read().collect()] == ["good"]
    assert sorted(r.text for r in store.rejected_pages().collect()) == ["lost", "nameless"]


def test_sheets_come_in_workbook_order_and_legacy_files_are_named(spark, tmp_path):
    sheet = "<worksheet><sheetData><row><c t='inlineStr'><is><t>{}</t></is></c></row></sheetData></worksheet>"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as out:
        for i in range(1, 12):
            out.writestr(f"xl/worksheets/sheet{i}.xml", sheet.format(f"s{i}"))
    assert documents.parse_excel((tmp_path / "a.xlsx").read_bytes()) == [f"s{i}" for i in range(1, 12)]
    (tmp_path / "b.doc").write_bytes(b"\xd0\xcf\x11\xe0rest")
    read = documents.parse_files(documents.scan_files(spark, str(tmp_path))).collect()
    assert {r.filename: bool(r.error and "before 2007" in r.error) for r in read} == {"a.xlsx": False, "b.doc": True}


def test_cluster_without_shared_folder_is_an_error(spark):
    from types import SimpleNamespace

    from corpusloom.session import shared_dir

    unset = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: unset, master="yarn"), conf=unset)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)
