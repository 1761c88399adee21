import numpy as np
import pytest

from corpusloom.operators import blocks, cells, dense
from corpusloom.session import scratch_path


def plain(questions, vectors, k, floor=None, asked=None):
    found = set()
    for q, question in enumerate(questions):
        scores = np.round(vectors @ question, 9)
        best = sorted(range(len(vectors)), key=lambda i: (-scores[i], i))[:k]
        found |= {(q, i) for i in best if (floor is None or scores[i] >= floor[q]) and (asked is None or asked[q])}
    return found


def kept(best):
    return {(int(q), int(i)) for part in best.hits() for q, i in zip(part[0], part[1])}


@pytest.mark.parametrize("scale", [1.0, 2.0**-40, 2.0**20])
@pytest.mark.parametrize("k", [1, 7, 300])
def test_nearest_equals_brute_force(scale, k):
    rng = np.random.default_rng(4)
    whole = lambda *size: rng.integers(-20, 21, size=size).astype(float)  # noqa: E731  sums of products are exact
    vectors = whole(5000, 6) / 8
    vectors[1000:3500] = vectors[1000]  # ties in half of the rows
    vectors[4000:4200] = vectors[4000] + whole(200, 6) * 2.0**-28  # closer than single precision tells apart
    questions = np.vstack([vectors[[1000, 4000, 7]], np.zeros((1, 6)), whole(300, 6)])
    vectors *= scale
    best = blocks.Nearest(questions, k)
    for at, end in ((0, 50), (50, 3000), (3000, 4100), (4100, 5000)):
        best.feed(np.arange(at, end), vectors[at:end])
    assert kept(best) == plain(questions, vectors, k)


def test_nearest_keeps_to_floors_and_asked_questions():
    rng = np.random.default_rng(5)
    vectors, questions = rng.normal(size=(3000, 5)), rng.normal(size=(600, 5))
    floor, asked = rng.normal(size=600) * 6, rng.random(600) < 0.5
    best = blocks.Nearest(questions, 4, floor)
    best.feed(np.arange(3000), vectors, asked)
    assert kept(best) == plain(questions, vectors, 4, floor, asked)


def test_nearest_takes_huge_and_missing_numbers():
    vectors = np.array([[1e30, 0.0], [2e30, 0.0], [np.nan, 1.0], [0.0, 1.0], [1e200, 0.0]])
    best = blocks.Nearest(np.array([[1e30, 1.0], [1.0, 0.0]]), 3)
    best.feed(np.array(["a", "b", "c", "d", "e"]), vectors)
    best.feed(np.array(["long name"]), np.array([[3e30, 0.0]]))
    hits = [(int(q), str(i)) for part in best.hits() for q, i in zip(part[0], part[1])]
    assert hits == [(0, "c"), (0, "e"), (0, "long name"), (1, "c"), (1, "e"), (1, "long name")]


def test_hits_count_towards_the_broadcast(spark):
    asked = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1000)], "question_id long, q array<double>")
    assert dense.fits(asked, 5, 1 << 20)
    assert not dense.fits(asked, 51, 1 << 20)


def test_grid_of_little_data_is_many_tasks(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(6000, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>").repartition(2)
    shape = blocks.hit_schema(df.schema["id"], df.schema["id"])
    shape.fields[0].name = "q"
    grid = dense._grid(df.selectExpr("id", "v AS _v"), df.selectExpr("id AS q", "v AS _q"), 2, "id", "q", shape)
    assert grid.rdd.getNumPartitions() >= 4


def test_cells_hand_on_k_rows_per_task_and_question(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(900, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>")
    stored = cells.build(df, "id", "v", scratch_path(spark, "cells"), cells=30)
    wanted = [r.cell for r in stored.table.select("cell").collect()]
    shape = blocks.hit_schema(df.schema["id"], stored.vectors.schema["item"])
    asked = (np.arange(900), vectors, np.full(900, -np.inf))
    every = {c: np.packbits(np.ones(900, dtype=bool)) for c in wanted}
    one_task = stored.vectors.select("item", "vector", "cell").coalesce(1)
    assert cells._pass(one_task, wanted, asked, every, 3, blocks.arrow_schema(shape), shape).count() == 900 * 3
