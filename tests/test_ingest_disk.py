"""Ingest by groups of buckets: what is stored, what stays behind on disk, and numbers looked up by block of pages."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chunking
from corpusloom.session import scratch_path, shared_dir
from corpusloom.sources import tables
from corpusloom.streaming import ingest

PAGE = "filename string, page_number long, text string, version long"


def page_rows(spark, rows):
    made = spark.createDataFrame(rows, PAGE)
    return made.select("filename", F.lit("").alias("file_path"), F.lit("PDF").alias("file_type"), "page_number", "text", "version")


def stored(collection):
    both = collection.leaves.read().unionByName(collection.parents.read())
    return sorted((r.filename, r.page_number, r.chunk_idx, r.chunk_level, r.chunk_id, r.parent_chunk_id, r.text) for r in both.collect())


def wanted(spark, pages):
    whole = chunking.chunk_pages(spark.createDataFrame(pages, "filename string, page_number long, text string"), chunking.separator_levels(F.col("text"))).localCheckpoint()
    numbered = chunking.number_chunks(whole).collect()
    return sorted((r.filename, r.page_number, r.chunk_idx, r.chunk_level, r.chunk_id, r.parent_chunk_id, r.text) for r in numbered)


def test_files_are_replaced_by_groups_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(tables, "GROUP_BYTES", 1)
    monkeypatch.setattr(tables, "GROUPS", 1_000)
    text = lambda name, page, version: f"{name} {page} {version} " + "words and more words. " * (page % 120)
    first = [(f"f{i}", p, text(i, p, 1), 1) for i in range(12) for p in (0, 1, 5, 999, 1000, 2500)] + [("blank", 0, " ", 1), ("f0", None, "no number", 1)]
    second = [(f"f{i}", p, text(i, p, 2), 2) for i in (3, 7) for p in (2, 1001)]
    late = [("f3", 0, text(3, 0, 1), 1), ("f3", 2, text(3, 2, 2), 2), ("f7", 2, text(7, 2, 2), 2), ("f7", 2, text(7, 2, 2), 2), ("f7", 4, text(7, 4, 2), 2)]
    collection = tables.Collection(spark, scratch_path(spark, "c"), buckets=3)
    for batch in (first, second, late):
        ingest.ingest_pages(page_rows(spark, batch), collection)
    keep = [r[:3] for r in first if r[0] not in ("f3", "f7")] + [r[:3] for r in second] + [("f7", 4, text(7, 4, 2))]
    assert stored(collection) == wanted(spark, keep)
    before = stored(collection)
    spoilt = F.when(F.col("filename") == "f1", F.filter(chunking.separator_levels(F.col("text")), lambda c: c["level"] == 1)).otherwise(chunking.separator_levels(F.col("text")))
    with pytest.raises(ValueError):
        ingest.ingest_pages(page_rows(spark, [(f"f{i}", 0, "new", 3) for i in range(12)]), collection, spoilt)
    assert stored(collection) == before


def test_no_scratch_copies_stay_behind(spark):
    """Before, the chunks of every batch stayed in the shared folder, and shuffled pages and chunks on local disk."""
    letters = random.Random(5)
    rows = [(f"f{i % 7}", i, "".join(letters.choices("abcdefghijklmnopqrstuvwxyz0123456789 ", k=20_000)), 1) for i in range(200)]
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        spark.sparkContext._jvm.System.gc()
        files = blocks.getAllFiles()
        return sum(files.apply(k).length() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_"))

    pages, collection = page_rows(spark, rows).coalesce(4).localCheckpoint(), tables.Collection(spark, scratch_path(spark, "c"), buckets=4)
    made = lambda: {n for n in os.listdir(shared_dir(spark)) if n.startswith("made-")}
    before, kept = made(), shuffled()
    spark.sparkContext._jvm.System.gc()
    ingest.ingest_pages(pages, collection, chunking.window_levels(F.col("text")))
    assert made() == before
    assert collection.leaves.read().select("page_number").distinct().count() == 200
    for _ in range(50):
        if shuffled() - kept < 2_000_000:
            break
        time.sleep(0.2)
    assert shuffled() - kept < 2_000_000  # of 4 MB of letters


def test_offsets_take_a_row_per_block(spark):
    per_page = spark.createDataFrame([("a", p, 3) for p in range(10)] + [("b", 7, 5), ("c", 0, 1), ("c", 9, 1), ("d", None, 4)], "filename string, page_number long, n long")
    got = {(r.filename, r._block): (r._pages, r._aheads) for r in chunking.packed_offsets(per_page, 4).collect()}
    assert got == {("a", 0): ([0, 1, 2, 3], [0, 3, 6, 9]), ("a", 1): ([4, 5, 6, 7], [12, 15, 18, 21]), ("a", 2): ([8, 9], [24, 27]), ("c", 2): ([9], [1])}
