"""Language profiles against a plain version, edge cases and held-out accuracy."""

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.operators import languages

ROWS = [
    (1, "the cat sat on the mat", "en", "x"), (2, "le chat est sur le tapis", "fr", "x"), (3, "die Katze sitzt auf der Matte", "de", "x"),
    (4, "the dog and the bird", "en", "x"), (5, "le chien et l'oiseau été", "fr", "x"), (6, "", None, "x"), (7, None, "en", "x"),
    (8, "é" * 3, None, "x"), (9, "漢字 ☠𝒳 mixed", None, "x"), (10, "the cat sat on the mat", "en", "x"), (11, "der Hund und der Vogel", "de", None), (12, "a", None, "x"),
]


def grams(text):
    p = [ord(c) for c in " " + (text or "").lower() + " "]
    return [(a * 961 + b * 31 + c) % languages.BUCKETS for a, b, c in zip(p, p[1:], p[2:])]


def plain(rows, per_language):
    counts = {}
    for name in {r[2] for r in rows} - {None}:
        mine = sorted((r for r in rows if r[2] == name and r[1]), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[1] or ""))
        counts[name] = Counter(g for r in mine[:per_language] for g in grams(r[1]))
    weight = lambda c, g: round(1000 * math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * languages.BUCKETS)))
    out = {}
    for r in rows:
        scored = sorted((-sum(weight(c, g) for g in grams(r[1])), name) for name, c in counts.items())
        out[r[0]] = (scored[0][1], scored[1][0] - scored[0][0]) if grams(r[1]) else (None, None)
    return out


def test_profiles_match_a_plain_version(spark):
    df = spark.createDataFrame(ROWS, "doc_id int, text string, lang string, language string")
    for per_language in (1, 100):
        profiles = languages.fit(df, "lang", "text", "doc_id", per_language)
        assert profiles.languages == ("de", "en", "fr")
        found = df.withColumn("found", languages.identified(F.col("text"), profiles)).collect()
        want = plain(ROWS, per_language)
        assert {r.doc_id: (r.found.language, r.found.margin) if r.found else (None, None) for r in found} == want


def test_scores_in_small_blocks_and_stretches_without_interpreted_loops(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc_id int, text string, lang string, language string")
    profiles = languages.fit(df, "lang", "text", "doc_id")
    weights = languages.np.array(profiles.weights, dtype="int32")
    texts = [f" {(r[1] or '').lower()} " for r in ROWS] + ["", "x"]
    want = plain(ROWS, 1000)
    for block, stretch in ((1 << 20, 1 << 18), (1, 1), (40, 7), (10_000, 3)):
        monkeypatch.setattr(languages, "BLOCK_BYTES", block)
        monkeypatch.setattr(languages, "STRETCH", stretch)
        found = [x for b in languages._blocks(languages.pa.array(["skipped", *texts]).slice(1)) for x in zip(*languages._best(*b, weights, profiles.buckets))]
        got = [(None, None) if none else (profiles.languages[first], margin) for first, margin, none in found]
        assert got == [want[r[0]] for r in ROWS] + [(None, None)] * 2
    scored = df.select(languages.identified(F.col("text"), profiles))
    assert "lambdafunction" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_no_labels_one_language_and_long_texts(spark):
    df = spark.createDataFrame(ROWS, "doc_id int, text string, lang string, language string")
    none = languages.fit(df.limit(0), "lang", "text", "doc_id")
    assert none.languages == () and df.filter(languages.identified(F.col("text"), none).isNotNull()).count() == 0
    one = languages.fit(df.filter("lang = 'fr'"), "lang", "text", "doc_id")
    row = df.select(languages.identified(F.repeat(F.lit("le chat "), 50_000), one).alias("x")).first()
    assert (row.x.language, row.x.margin) == ("fr", None)
    assert languages.fit(df, "lang", "text", "doc_id", max_languages=1).languages == ("en",)


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1).isin("0", "1", "2")
    profiles = languages.fit(df.filter(~held), "lang", "text", "doc_id")
    right = df.filter(held).select((languages.identified(F.col("text"), profiles)["language"] == F.col("lang")).alias("ok"))
    n, good = right.agg(F.count("*"), F.count_if("ok")).first()
    assert n > 100 and good >= 0.95 * n, (n, good)


def test_profiles_come_from_all_texts_of_all_languages(spark):
    """Beyond 1,000 texts of a language and 64 languages; before, the rest took no part."""
    many = [(i, f"word{i} {'z' * (i % 9)}", "en" if i % 4 else "fr", None) for i in range(5_000)]
    many += [(10_000 + i, f"{chr(0x4E00 + i) * 5} {i}", f"l{i:03d}", None) for i in range(150)] + [(20_000, None, "nn", None), (20_001, "", "ee", None), (20_002, "zz", None, None)]
    many += many[:300]
    df = spark.createDataFrame(many, "doc_id int, text string, lang string, language string").repartition(5)
    profiles = languages.fit(df, "lang", "text", "doc_id")
    assert profiles.languages == tuple(sorted({r[2] for r in many} - {None, "nn", "ee"})) and len(profiles.languages) == 152
    for place in (0, profiles.languages.index("en"), profiles.languages.index("fr")):
        counted = Counter(g for r in many if r[2] == profiles.languages[place] for g in grams(r[1]))
        total = sum(counted.values())
        want = tuple(round(1000 * math.log((counted[b] + 0.5) / (total + 0.5 * languages.BUCKETS))) for b in range(languages.BUCKETS))
        assert profiles.weights[place] == want


def test_counts_in_small_blocks_and_stretches_with_few_languages_held(monkeypatch):
    rows = [(name, f" {text.lower()} ") for _, text, name, _ in ROWS if text and name] + [("en", "é \U0001d4b3 "), ("x", "abc" * 20), ("fr", " z ")]
    want = Counter((name, (ord(a) * 961 + ord(b) * 31 + ord(c)) % languages.BUCKETS) for name, t in rows for a, b, c in zip(t, t[1:], t[2:]))
    pa = languages.pa
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], pa.string()) for k in (0, 1)], names=["language", "padded"]) for part in (rows[:4], rows[4:], [])]
    for block, stretch, held in ((1 << 20, 1 << 18, 64), (1, 1, 1), (40, 7, 2), (10_000, 3, 3)):
        monkeypatch.setattr(languages, "BLOCK_BYTES", block)
        monkeypatch.setattr(languages, "STRETCH", stretch)
        monkeypatch.setattr(languages, "HELD", held)
        got = Counter()
        for part in languages._counted(batches, languages.BUCKETS):
            for r in part.to_pylist():
                got[r["language"], r["bucket"]] += r["n"]
        assert got == want


def test_the_query_and_its_sql_take_all_labelled_texts(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    rows = [(i, f"{'the' if i % 3 else 'le'} w{i * 7919 % 1000} {'q' * (i % 50)}", ("en" if i % 3 else "fr") if i % 100 else None, "s", 1) for i in range(2_400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in entry.queries()["language_profiles"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(duck.execute(entry.oracle_sql()["language_profiles"]).fetchall()) and len(got) == len(rows)
    held = lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()[0] in "012"
    counts = {n: Counter(g for r in rows if r[2] == n and not held(r) for g in grams(r[1])) for n in ("en", "fr")}
    weight = lambda c, g: round(1000 * math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * languages.BUCKETS)))
    weights = {n: {g: weight(c, g) for g in {g for r in rows for g in grams(r[1])}} for n, c in counts.items()}
    for r in rows:
        en, fr = (sum(weights[n][g] for g in grams(r[1])) for n in ("en", "fr"))
        assert (r[0], held(r), "fr" if fr > en else "en", abs(en - fr)) in got
