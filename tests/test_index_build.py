import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions.models import LetterEmbedder, LetterRowEmbedder, letter_units
from corpusloom.operators import chunking


def test_texts_are_cut_once(spark):
    pages = spark.createDataFrame([("a", 0, "x y " * 900), ("b", 0, ""), ("c", 0, None)], "filename string, page_number long, text string")
    made = chunking.chunk_pages(pages, chunking.window_levels(F.col("text")))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "size(transform" not in plan.replace("\n", "")
    rows = made.orderBy("page_chunk_idx").collect()
    want = chunking.nest("x y " * 900, separators=("",))
    assert [(r.chunk_level, r.text) for r in rows] == [(w["level"], w["text"]) for w in want]


def test_row_embedder_equals_the_expression(spark):
    texts = ["", None, "Zebra K É ß 漢字 abc", "aaab", "123", "İI", "word " * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    rows = df.select(LetterEmbedder().embed(F.col("text")).alias("a"), LetterRowEmbedder().embed(F.col("text")).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_letter_units_of_slices_and_long_texts():
    texts = pa.array(["skip", "ab", None, "c" * 3_000_000, "é"]).slice(1)
    got = letter_units(texts).to_pylist()
    assert [[i for i, x in enumerate(v) if x] for v in got] == [[0, 1], [], [2], []]
