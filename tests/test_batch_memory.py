import pyarrow as pa

from corpusloom.operators import chunking, metrics


def test_pages_are_cut_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(chunking, "OBJECT_BYTES", 4096)
    texts = ["skipped", "a b. " * 700, None, "", "漢字 text\n\n" * 300, "c"] + ["short one"] * 100
    made = []
    pages = pa.array(texts).slice(1)
    got = chunking.cut_pages(pages, lambda t: made.append(t) or chunking.nest(t))
    assert got.to_pylist() == [chunking.nest(t) if t else [] for t in texts[1:]]
    assert made == [t for t in texts[1:] if t]
    assert chunking.cut_pages(pages.slice(0, 0), chunking.nest).to_pylist() == []


def test_rows_become_objects_a_few_at_a_time():
    sizes = []

    class Column:
        def __init__(self, rows):
            self.rows = rows

        def __len__(self):
            return len(self.rows)

        def slice(self, at, n):
            sizes.append(len(self.rows[at : at + n]))
            return pa.array(self.rows[at : at + n])

    assert [a for a, _ in metrics._rows(Column(list(range(100))), Column(list(range(100))))] == list(range(100))
    assert max(sizes) == metrics.OBJECT_ROWS
