import numpy as np
from brute_force import decontamination as plain
from sample_texts import prose

from corpusloom.llm import blocks, decontamination as dc


def rows_of(df, benchmark):
    from pyspark.sql import functions as F

    keyed = df.withColumn("unit", F.struct("doc_id", F.monotonically_increasing_id().alias("n")))
    return {r.unit.doc_id: (r.n_words, r.n_hit, r["items"]) for r in dc.hits(keyed, benchmark, "unit").collect()}


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_equals_brute_force(spark, documents):
    passages = [prose(i, n) for i, n in enumerate((13, 14, 30, 60, 12, 5, 1, 3))]
    tests = [(i, t) for i, t in enumerate(passages)] + [(20, passages[2]), (21, None), (22, " , ")]
    glue = lambda *parts: " - ".join(parts)
    texts = [
        glue(prose(90), passages[2], prose(91)), passages[0].upper(), " ".join(passages[3].split()[5:17]), " ".join(passages[3].split()[5:18]), passages[4],
        glue(passages[5], passages[5]), passages[6], prose(92, 400), glue(prose(93, 400), passages[1]), None, "", "ÄÖ é", glue(*passages), prose(94, 30_000) + " " + passages[2],
    ]
    got = rows_of(documents([(i, t, "a") for i, t in enumerate(texts)], extra=True), items(spark, tests))
    want = plain(list(enumerate(texts)), tests)
    assert {k: (a, b, len(c)) for k, (a, b, c) in got.items()} == {k: v[:3] for k, v in want.items()}
    kept = dc.remove(documents([(i, t, "a") for i, t in enumerate(texts)], extra=True), items(spark, tests))
    assert {r.doc_id for r in kept.collect()} == {k for k, v in want.items() if not v[4]}


def test_empty_tables_and_repeated_rows(spark, documents):
    df = documents([(1, prose(1), "a"), (1, prose(1), "a"), (None, prose(2), "a")])
    assert dc.remove(df, items(spark, [])).count() == 3
    assert dc.remove(documents([]), items(spark, [(1, prose(1))])).count() == 0
    assert dc.remove(df, items(spark, [(1, prose(1))])).count() == 1
    assert rows_of(df, items(spark, [(None, prose(1))])) == {1: (60, 60, []), None: (60, 0, [])}


def test_every_shared_window_has_a_common_fingerprint():
    rng = np.random.default_rng(0)
    for _ in range(50):
        shared = rng.integers(0, 1 << 60, 13).astype(np.uint64)
        one = np.concatenate([rng.integers(0, 1 << 60, 20).astype(np.uint64), shared, rng.integers(0, 1 << 60, 3).astype(np.uint64)])
        two = np.concatenate([shared, rng.integers(0, 1 << 60, 9).astype(np.uint64)])
        sets = [set(dc.winnow(x, np.array([0, len(x)]), 13, 5)[1].tolist()) for x in (one, two)]
        assert sets[0] & sets[1] & set(blocks.grams(shared, 5).tolist())
