"""Stored posting blocks and vector cells against plain versions and the unstored searches."""

import random

import numpy as np
import pytest
from test_search import TEXTS, plain_bm25

from corpusloom.operators import cell_join, cells, lexical, postings
from corpusloom.session import scratch_path


def indexed(spark, texts, **kw):
    docs = spark.createDataFrame(list(texts.items()), "id string, text string").repartition(4)
    return postings.build(docs.withColumn("token", docs.id).withColumn("place", docs.id), "id", "text", scratch_path(spark, "index"), **kw)


def same(hits, texts, queries, k):
    for number, text in queries.items():
        mine = sorted((r for r in hits if r.question_id == number), key=lambda r: r["rank"])
        assert [(round(-r.score, 9), r.id) for r in mine] == plain_bm25(texts, text)[:k]
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_stored_search_matches_brute_force(spark, bound):
    index = indexed(spark, TEXTS, block=2)
    queries = {1: "the adder", 2: "电 latch unknownword", 3: "nothing here", 4: "", 5: "the the adder"}
    asked = spark.createDataFrame(list(queries.items()), "question_id long, query string")
    same(postings.search(index, asked, 3, max_broadcast_bytes=bound).collect(), TEXTS, queries, 3)
    assert (index.n_docs, index.item) == (6, "id")
    again = postings.open_index(spark, index.blocks.inputFiles()[0].split("/blocks/")[0])
    same(postings.search(again, asked, 2).collect(), TEXTS, queries, 2)


@pytest.mark.parametrize("slice_texts, block", [(4096, 128), (50, 8)])
def test_many_texts_with_hot_tokens_and_copies(spark, slice_texts, block):
    draw = random.Random(7)
    names = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    weights = [1 / (i + 1) for i in range(len(names))]
    texts = {f"t{i:04d}": "all " + " ".join(draw.choices(names, weights, k=draw.randrange(1, 40))) for i in range(500)}
    texts |= {f"x{i:04d}": "all copies of one text" for i in range(250)}  # ties beyond k; a token of every text
    texts |= {"n0": "", "n1": "   "}
    index = indexed(spark, texts, slice_texts=slice_texts, block=block)
    queries = {i: " ".join(draw.choices(names, k=draw.choice([1, 2, 5, 12]))) + draw.choice(["", " all", " copies"]) for i in range(40)} | {99: "copies of all"}
    asked = spark.createDataFrame(list(queries.items()), "question_id long, query string")
    seen = {}
    hits = postings.search(index, asked, 5, report=seen)
    same(hits.collect(), texts, queries, 5)
    assert 0 < seen["near"] + seen["rest"] < seen["all"]  # some postings are never opened
    assert index.blocks.selectExpr("max(size(items))").first()[0] <= block


def test_index_of_nothing(spark):
    texts = spark.createDataFrame([("a", None), ("b", "")], "id string, text string")
    asked = spark.createDataFrame([(1, "the"), (2, None)], "question_id long, query string")
    for given in (texts, texts.limit(0)):
        index = postings.build(given, "id", "text", scratch_path(spark, "index"))
        assert postings.search(index, asked, 3).count() == 0
    assert postings.search(indexed(spark, TEXTS), asked.limit(0), 3).count() == 0


def points(seed, n, size=6, groups=8):
    draw = np.random.default_rng(seed)
    middle = draw.normal(0, 3, (groups, size))
    rows = [(i, [float(x) for x in np.round(middle[i % groups] + draw.normal(0, 0.3, size), 2)]) for i in range(n)]
    return rows + [(n + i, rows[0][1]) for i in range(n // 3)]  # a third are copies


def plain_nearest(rows, asked, k):
    out = []
    for q, v in asked:
        scored = sorted((-round(float(np.dot(v, w)), 9), i) for i, w in rows if w is not None)
        out += [(q, i, -s, rank) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("count, bound", [(None, 1 << 20), (1, 1 << 20), (300, 1 << 20), (20, 0)])
def test_cells_match_brute_force(spark, count, bound):
    rows = points(3, 400) + [(9000, None)]
    asked = [(i, [float(x) for x in np.random.default_rng(i).normal(0, 2, 6)]) for i in range(30)] + [(77, [0.0] * 6)]
    corpus = spark.createDataFrame([(*r, 1) for r in rows], "id long, v array<double>, cell int").repartition(5)
    stored = cells.build(corpus, "id", "v", scratch_path(spark, "cells"), cells=count)
    seen = {}
    found = cells.search(stored, spark.createDataFrame(asked, "question_id long, query_vector array<double>"), 5, max_broadcast_bytes=bound, report=seen)
    got = sorted((r.question_id, r.id, round(r.score, 9), r["rank"]) for r in found.collect())
    assert got == plain_nearest(rows, asked, 5)
    if count is None:
        assert seen["floor"] + seen["near"] < seen["all"]


def test_cells_of_few_vectors(spark):
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "question_id long, query_vector array<double>")
    none = spark.createDataFrame([], "id long, v array<double>")
    assert cells.search(cells.build(none, "id", "v", scratch_path(spark, "cells")), asked, 3).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "id long, v array<double>")
    stored = cells.build(two, "id", "v", scratch_path(spark, "cells"))
    assert [(r.id, r["rank"]) for r in cells.search(stored, asked, 3).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert cells.search(stored, asked.limit(0), 3).count() == 0


def test_sampled_centres_give_the_same_result(spark):
    rows = points(5, 300)
    corpus = spark.createDataFrame(rows, "id long, v array<double>")
    asked = spark.createDataFrame([(i, rows[i][1]) for i in range(20)], "question_id long, query_vector array<double>")
    stored = cells.build(corpus, "id", "v", scratch_path(spark, "cells"), sample=30)
    got = sorted((r.question_id, r.id, round(r.score, 9), r["rank"]) for r in cells.search(stored, asked, 4).collect())
    assert got == plain_nearest(rows, [(i, rows[i][1]) for i in range(20)], 4)


@pytest.mark.parametrize("count, room", [(None, 1 << 25), (1, 1 << 25), (20, 2000), (300, 400)])
def test_cell_join_matches_brute_force(spark, count, room):
    """Cells that share a bin, cells cut into slices, anchors in several shards; a third of the vectors are copies."""
    rows = points(3, 300) + [(9000, None)]
    asked = rows[:60] + [(500 + i, [float(x) for x in np.random.default_rng(i).normal(0, 2, 6)]) for i in range(20)] + [(777, [0.0] * 6), (778, None)]
    corpus = spark.createDataFrame([(*r, 1) for r in rows], "id long, v array<double>, cell int").repartition(5)
    stored = cells.build(corpus, "id", "v", scratch_path(spark, "cells"), cells=count)
    seen = {}
    anchors = spark.createDataFrame([(*r, 2) for r in asked], "pair_id long, q array<double>, cell int").repartition(3)
    found = cell_join.nearest(stored, anchors, 5, "pair_id", "q", seen, bin_bytes=room)
    got = sorted((r.pair_id, r.id, round(r.score, 9), r["rank"]) for r in found.collect())
    assert got == plain_nearest(rows, [a for a in asked if a[1] is not None], 5)
    assert seen["all"] == 81 * 400 and seen["floor"] + seen["near"] <= seen["all"]
    if count is None:
        assert seen["floor"] + seen["near"] < seen["all"] / 2


def test_cell_join_of_few_vectors(spark):
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "pair_id long, q array<double>")
    none = spark.createDataFrame([], "id long, v array<double>")
    assert cell_join.nearest(cells.build(none, "id", "v", scratch_path(spark, "cells")), asked, 3, "pair_id", "q").count() == 0
    two = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0])], "id string, v array<double>")
    stored = cells.build(two, "id", "v", scratch_path(spark, "cells"))
    assert [(r.id, r["rank"]) for r in cell_join.nearest(stored, asked, 3, "pair_id", "q").orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert cell_join.nearest(stored, asked.limit(0), 3, "pair_id", "q").count() == 0


def test_bins_hold_what_fits():
    first, parts = cell_join.bins(np.array([3, 4, 25, 2, 9, 1]), 10.0)
    assert first.tolist() == [0, 0, 1, 4, 5, 5] and parts.tolist() == [1, 1, 3, 1, 1, 1]


def test_stored_and_counted_statistics_agree(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "id string, text string")
    index = indexed(spark, TEXTS)
    counted = {r.token: r.df for r in lexical.document_frequency(lexical.term_rows(docs, "id", "text")).collect()}
    assert {r.token: r.df for r in index.tokens.collect()} == counted


def test_a_text_lies_in_one_slice_and_slices_hand_on_few_rows(spark):
    """A slice holds all postings of its texts, so no posting of a search is shuffled on its own."""
    texts = {f"t{i:03d}": f"all word{'abcdefg'[i % 7]} word{'abc'[i % 3]}" for i in range(300)}
    rows = lexical.term_rows(spark.createDataFrame(list(texts.items()), "id string, text string").repartition(3), "id", "text").checkpoint()
    index = postings.build_counted(rows, "id", scratch_path(spark, "index"), slice_texts=40, block=8)
    names = {r.slice: r.names for r in index.slices.collect()}
    assert sorted(n for listed in names.values() for n in listed) == sorted(texts) and max(map(len, names.values())) <= 40
    for r in index.blocks.collect():
        assert all(r.token in texts[names[r.slice][i]].split() for i in r["items"]) and max(r.parts) == r.max_part == r.parts[0]
    asked = spark.createDataFrame([(1, "all wordb"), (2, "wordc wordg")], "question_id long, query string")
    hits = postings.search(index, asked, 4)
    assert "Generate" not in hits._jdf.queryExecution().optimizedPlan().toString()
    same(hits.collect(), texts, {1: "all wordb", 2: "wordc wordg"}, 4)
