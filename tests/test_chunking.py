import random

from hypothesis import given, settings, strategies as some
from pyspark.sql import functions as F

from corpusloom.operators import chunking as ch
from corpusloom.operators.chunking import Level


def pieces(text, separators):
    """Recursive splitting on strings: (pieces, remaining separators)."""
    for i, sep in enumerate(separators):
        if sep == "":
            return list(text), []
        if sep in text:
            head, *tail = text.split(sep)
            return [p for p in [head, *[sep + t for t in tail]] if p], separators[i + 1 :]
    return [text], []


def pack(parts, size, overlap):
    out, window = [], []
    for part in parts:
        if window and sum(map(len, window)) + len(part) > size:
            out.append("".join(window))
            while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(part) > size):
                window.pop(0)
        window.append(part)
    return out + (["".join(window)] if window else [])


def plain_split(text, size, overlap, separators):
    """The splitter's rules stated on plain strings."""
    parts, rest = pieces(text, list(separators))
    out, good = [], []
    for part in parts:
        if len(part) < size:
            good.append(part)
            continue
        out += pack(good, size, overlap)
        good = []
        out += plain_split(part, size, overlap, rest) if rest else [part]
    return out + pack(good, size, overlap)


ALPHABET = some.sampled_from(list("abc ，。\n") + ["\n\n"])


@settings(max_examples=300, deadline=None)
@given(some.lists(ALPHABET, max_size=120).map("".join), some.integers(3, 30), some.integers(0, 10))
def test_split_matches_plain_rules(text, size, overlap):
    overlap = min(overlap, size - 1)
    want = [c.strip() for c in plain_split(text, size, overlap, ch.SEPARATORS)]
    assert ch.split(text, Level(size, overlap)) == [c for c in want if c]


def test_split_prefers_paragraphs_and_cjk_stops():
    assert ch.split("aaaa\n\nbbbb\n\ncccc", Level(11, 0)) == ["aaaa\n\nbbbb", "cccc"]
    assert ch.split("一二三。四五六。七八九", Level(8, 4)) == ["一二三。四五六", "。四五六。七八九"]


def test_long_run_without_separators():
    chunks = ch.split("x" * 3000, Level(1200, 240))
    assert [len(c) for c in chunks] == [1200, 1200, 1080]


def words(seed, n):
    r = random.Random(seed)
    sep = [" ", " ", " ", "\n", "\n\n", "。", "，"]
    return "".join("".join(r.choice("abcdefg电路") for _ in range(r.randint(1, 9))) + r.choice(sep) for _ in range(n))


def test_nested_levels_invariants():
    chunks = ch.nest(words(1, 1500))
    ids = {(c["level"], c["idx"]) for c in chunks}
    assert len(ids) == len(chunks)
    for c in chunks:
        assert c["text"] == c["text"].strip() != ""
        assert len(c["text"]) <= ch.LEVELS[c["level"] - 1].size
        if c["level"] > 1:
            parent = next(p for p in chunks if p["level"] == c["level"] - 1 and p["idx"] == c["parent"])
            assert c["text"] in parent["text"] and parent["root"] == c["root"]
    order = [(c["level"], c["idx"]) for c in chunks]
    assert [i for lv, i in order if lv == 1] == sorted(i for lv, i in order if lv == 1)


def test_window_expression_equals_separator_free_splitter(spark):
    texts = ["", "   ", "short", words(2, 40), words(3, 900), "x" * 1200, "y" * 1201, " " * 1500 + "z" * 700]
    pages = spark.createDataFrame([(f"f{i}", 0, t) for i, t in enumerate(texts)], "filename string, page_number long, text string")
    a = ch.chunk_pages(pages, ch.window_levels(F.col("text")))
    b = ch.chunk_pages(pages, ch.separator_levels(F.col("text"), separators=("",)))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_chunk_ids_and_file_wide_numbers(spark):
    rows = [("a.pdf", p, words(p, 120)) for p in range(7)] + [("b.pdf", 3, words(9, 60)), ("b.pdf", 12, "tail")]
    pages = spark.createDataFrame(rows, "filename string, page_number long, text string")
    chunks = ch.chunk_pages(pages, ch.separator_levels(F.col("text")))
    numbered = ch.number_chunks(chunks, pages_per_block=3).collect()
    for name in ("a.pdf", "b.pdf"):
        mine = sorted((r for r in numbered if r.filename == name), key=lambda r: r.chunk_idx)
        assert [r.chunk_idx for r in mine] == list(range(len(mine)))
        assert [r.page_number for r in mine] == sorted(r.page_number for r in mine)
    first = next(r for r in numbered if r.filename == "b.pdf" and r.page_number == 12 and r.chunk_level == 3)
    assert first.chunk_id == "b.pdf::p12::l3::0"
    assert first.parent_chunk_id == "b.pdf::p12::l2::0" and first.root_chunk_id == "b.pdf::p12::l1::0"
    assert all(r.parent_chunk_id == "" for r in numbered if r.chunk_level == 1)


def test_pages_are_numbered_where_they_lie(spark):
    """Numbers of stored pages equal those of chunk rows, also for pages without chunks; a small file's texts meet no shuffle."""
    pages = spark.createDataFrame([("f", p, "PDF", "ab " * (p * 300)) for p in range(6)] + [("g", 2, "PDF", None), ("g", 3, "PDF", "one")], "filename string, page_number long, file_type string, text string")
    cut = ch.window_levels(F.col("text"))
    rows = ch.number_chunks(ch.chunk_pages(pages, cut, keep=["file_type"]), 2)
    stored = pages.select("filename", "page_number", "file_type", cut.alias("_chunks")).localCheckpoint()
    mine = ch.number_pages(stored, 2)
    assert sorted(mine.select(rows.columns).collect()) == sorted(rows.collect()) and rows.count() > 10
    mine.collect()
    above = mine._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Generate" in above  # chunks are unfolded after the numbers are known
