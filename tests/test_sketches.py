import pytest

from corpusloom.operators import curation, sketches
from pyspark.sql import functions as F


@pytest.mark.parametrize("words", [1, 64, 1 << 12])
def test_anti_join_is_exact_for_any_size_of_sketch(spark, words):
    rows = [(i, f"k{i % 400}" if i % 7 else None, "text") for i in range(1500)] + [(5000 + i, "hot", "t") for i in range(700)] + [(1, "k1", "text")] * 3
    done = {f"k{i}" for i in range(0, 400, 3)} | {"absent"}
    df = spark.createDataFrame(rows, "id long, k string, _other string").repartition(5)
    seen = spark.createDataFrame([(k,) for k in done], "k string")
    got = sorted((r.id, r.k or "", r[2]) for r in sketches.anti_join(df, seen, "k", ["id"], words).collect())
    assert got == sorted((i, k or "", t) for i, k, t in rows if k not in done)
    assert sketches.sketch(seen, "k", words).count() <= words


def test_new_rows_are_not_shuffled(spark):
    df = spark.range(20_000).select("id", F.concat(F.lit("new"), "id").alias("k"), F.lit("a long text").alias("text"))
    seen = spark.range(500).select(F.concat(F.lit("old"), "id").alias("k"))
    word, mask = sketches.place(F.col("k"))
    known = sketches.sketch(seen, "k")
    held = df.withColumns({"_word": word, "_mask": mask}).join(F.broadcast(known), "_word").filter(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"))
    assert held.count() < 20  # of 20,000 rows these would meet the exchange
    assert sketches.anti_join(df, seen, "k", ["id"]).count() == 20_000


def test_done_rows_by_both_ways(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None), (4, "")], "id long, text string")
    done = spark.createDataFrame([("b",), (None,), ("",), ("b",)], "text_key string")
    for rows in (0, 1 << 20):
        rest = curation.without_done(df, done, F.col("text"), curation.done_key(done), ["id"], rows)
        assert sorted(r.id for r in rest.collect()) == [1, 3]
    empty = curation.without_done(df, done.limit(0), F.col("text"), curation.done_key(done), ["id"], 0)
    assert empty.count() == 5 and curation.without_done(df, None, F.col("text"), F.col("x"), ["id"]).count() == 5
