import numpy as np
import pytest
from brute_force import near_duplicates
from sample_texts import prose

from corpusloom.llm import ngram_join
from corpusloom.llm.components import components


def found(df, **options):
    return {(r.id, r.n, r.component) for r in ngram_join.document_components(df, **options).collect()}


def edited(text, *places):
    words = text.split()
    for p in places:
        words[p] = f"edit{p}"
    return " ".join(words)


def family(n, seed=5):
    """Copies of one text with more and more edits: some are similar to the first, some only to each other, some to none."""
    base, out = prose(seed, 120), []
    for i in range(n):
        out.append(edited(base, *((7 * i + 31 * k) % 120 for k in range(i % 9))))
    return out


def test_equals_brute_force(documents):
    texts = [prose(i) for i in range(12)] + family(60) + [prose(3)] * 5 + [None, "", " \n ", "one two", "One TWO", "one two three four five", "one two three four"]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    want = near_duplicates([(i, t) for i, t, _ in rows])
    assert found(documents(rows, extra=True)) == {(i, *v) for i, v in want.items()}


def grouped_triple(seed):
    """g1, g2 with the same prefix and set size, similar to each other, and h, similar to g2 but not to g1."""
    g2 = prose(seed, 120)

    def prefix(text):
        values, _ = ngram_join.shingle_sets(np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text.encode())]), ngram_join.WORDS)
        return len(values), values[: len(values) - (len(values) * ngram_join.PERCENT + 99) // 100 + 1].tolist()

    place = next((p for p in range(10, 110) if prefix(edited(g2, p)) == prefix(g2)), None)
    return None if place is None else (edited(g2, place), g2, edited(g2, (place + 30) % 100 + 10, (place + 60) % 100 + 10))


def test_links_of_a_hub_to_all_sets_of_a_group(documents):
    triples = [t for t in map(grouped_triple, range(300, 340)) if t]
    assert len(triples) >= 10
    rows = [(3 * i + k, text, "a") for i, triple in enumerate(triples) for k, text in enumerate(triple)]
    want = near_duplicates([(i, t) for i, t, _ in rows])
    assert {c for _, c in want.values()} == {3 * i for i in range(len(triples))}
    assert found(documents(rows)) == {(i, *v) for i, v in want.items()}


def test_long_text_and_one_long_word(documents):
    long = prose(1, 60_000)
    rows = [(1, long, "a"), (2, edited(long, 5, 500), "a"), (3, "x" * 200_000, "a"), (4, prose(2, 60_000), "a")]
    assert {(i, c) for i, _, c in found(documents(rows))} == {(1, 1), (2, 1), (3, 3), (4, 4)}


def test_null_and_repeated_ids(documents):
    rows = [(None, prose(1), "a"), (7, prose(1), "a"), (7, prose(1), "a"), (7, prose(2), "a"), (None, prose(4), "a"), (None, None, None)]
    got = sorted((r.id or 0, r.n, r.component or 0) for r in ngram_join.document_components(documents(rows)).collect())
    assert [(i, c) for i, _, c in got] == [(0, 0), (0, 0), (0, 7), (7, 7), (7, 7), (7, 7)]


def test_empty_table(documents):
    assert found(documents([])) == set()
    assert ngram_join.keep_one(documents([])).count() == 0


def test_keep_one_keeps_clean_rows_and_all_columns(documents):
    texts = family(30) + [prose(50 + i) for i in range(5)]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(99, texts[0], "b"), (31, texts[31], "a"), (None, None, None)]
    df = documents(rows, extra=True)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    unique = {i: t for i, t, _ in rows if i is not None}
    want = sorted({c for _, c in near_duplicates(list(unique.items())).values()})
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == want
    assert kept.filter("doc_id is null").count() == 1


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)] + [(60, 61), (61, 62), (62, 60)]])
def test_components(spark, links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got, bound = components(spark.createDataFrame(links, "a long, b long"))
    assert got.count() <= bound
    assert {(r.node, r.label) for r in got.collect()} == {(x, root(x)) for x in parent}
