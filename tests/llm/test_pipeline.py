import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from brute_force import decontamination, near_duplicates
from sample_texts import prose

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A few hundred documents with toxic ones, copies, spread lines and passages of the test set."""
    at = tmp_path_factory.mktemp("corpus")
    rows, labels = [], []
    for i in range(240):
        words = prose(i, 70).split()
        if i % 6 == 0:
            words[5::15] = ["scumbag", "vermin", "ratface", "scumbag", "vermin"]
        rows.append((i, " ".join(words) + "\nshared footer line of every site", "en", f"s{i % 5}"))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000 + i, prose(i, 70), "en", f"s{i % 5}") for i in range(1, 20)]  # copies without the footer, on the same site
    rows += [(1200 + i, prose(i, 70), "en", "s9") for i in (31, 32)]  # on another site: its only line, a long one, stands elsewhere
    rows += [(2000 + i, prose(500 + i, 20) + " " + prose(900, 40), "en", None) for i in range(4)]
    rows += [(2500 + i, "shared footer line of every site", "en", "s1") for i in range(3)]  # nothing is left of these
    rows += [(3000, None, None, None), (3001, "", "en", "s1"), (3002, prose(77, 20_000), "en", "s2"), (3002, prose(77, 20_000), "en", "s2"), (None, prose(78), "en", "s3")]
    documents = [(*r, None if r[1] is None else len(r[1]), i) for i, r in enumerate(rows)]
    names = ["doc_id", "text", "lang", "source", "n_chars", "extra"]
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*documents))))), at / "documents.parquet")
    pq.write_table(pa.table(dict(zip(["doc_id", "quality", "toxic"], map(list, zip(*labels))))), at / "labels.parquet")
    pq.write_table(pa.table({"item_id": [1, 2], "text": [prose(900, 40), prose(901, 40)]}), at / "benchmark.parquet")
    return str(at)


def test_stages_on_their_own_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, folder).cache()
        assert name == "mixing" or out.columns == docs.columns
        seen[name] = (before, [(r.doc_id, r.text) for r in out.collect()])
        docs = out
    before, after = seen["toxicity"]
    assert [r for r in before if r[0] is None or r[0] >= 240 or r[0] % 6] == after
    before, after = seen["line_dedup"]
    assert sum("shared footer" in (t or "") for _, t in after) == 1
    gone = {i for i, _ in before} - {i for i, _ in after}
    assert gone == {1231, 1232, 2500, 2501, 2502} and len(before) == len(after) + 5
    assert not {i for i, t in after if t is not None and not t.strip()} - {i for i, t in before if not t}
    before, after = seen["near_duplicates"]
    named = dict(r for r in before if r[0] is not None)
    assert sorted(i for i, _ in after if i is not None) == sorted({c for _, c in near_duplicates(list(named.items())).values()})
    before, after = seen["decontamination"]
    verdict = decontamination(before, [(1, prose(900, 40)), (2, prose(901, 40))])
    assert sorted(map(str, after)) == sorted(str(r) for r in before if not verdict[r[0]][4]) and len(after) < len(before)
    before, after = seen["mixing"]
    assert {r for r in after} <= {r for r in before} and all(after.count(r) <= 2 for r in set(after))


def test_run_keeps_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
    ids = {r.doc_id for r in out.collect()}
    assert ids and not ids & {i for i in range(0, 240, 6)} and not ids & {2000, 2001, 2002, 2003}
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))


def test_modules_are_whole():
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert os.path.dirname(os.path.abspath(corpus_pipeline.__file__)) == os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
