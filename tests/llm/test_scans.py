"""Secrets, quality, toxicity, main text and token counts."""

import random

import numpy as np
import pytest
from brute_force import quality as plain_quality
from sample_texts import WORDS, prose

from corpusloom.llm import html_lstm, main_text, quality, secrets, token_counts, toxicity
from corpusloom.llm.html_blocks import Paths, blocks_of

# secrets


@pytest.fixture(scope="module")
def models():
    return secrets.Models(secrets.generated(), secrets.identifiers(WORDS * 40))


def test_rules():
    key = "a1B2c3D4e5F6"
    text = f"é token = \"{key}\" SECRET:'abc' Api_Key={key} AKIA{'A' * 16} AKIAshort {'0af' * 8} 0af PASſWORD=secretvalue1"
    spans = secrets.base_spans(text)
    assert [(k, text[a:b]) for a, b, k in spans] == [
        ("assign", f'token = "{key}'), ("assign", f"Api_Key={key}"), ("access", "AKIA" + "A" * 16), ("hex", "0af" * 8)]
    assert secrets.written(spans[:1]) == f"assign:2:{2 + len(key) + 9}"


def test_secrets_of_whole_texts(documents, models):
    long = prose(1, 50_000)
    rows = [(1, None), (2, ""), (3, "see ghp_16C7e42F292c6912E7710c838347Ae178B4a now"), (4, "my_long_variable_name and getAlphaBetaGammaDelta"), (5, long + " 𝄞 token=abcdef " + "9f" * 15), (5, "x")]
    df = documents([(i, t, "a") for i, t in rows], extra=True)
    got = [(r.id, r.n_assign, r.n_access, r.n_hex, [(s.kind, s.start, s.end) for s in r.spans]) for r in secrets.found(df, models).collect()]
    n = len(long)
    assert got[0][1:] == got[1][1:] == got[3][1:] == got[5][1:] == (0, 0, 0, [])
    assert got[2][4] == [("random", 4, 44)]
    assert got[4][1:] == (1, 0, 1, [("assign", n + 3, n + 15), ("hex", n + 16, n + 46)])
    assert secrets.found(documents([]), models).count() == 0


def test_models_tell_random_strings_from_identifiers(models):
    fresh = secrets.generated(400, seed=99)
    assert np.mean(models.secret(fresh)) > 0.95
    assert np.mean(models.secret(secrets.identifiers(WORDS, seed=98))) < 0.02


def test_random_strings_in_the_sample_do_not_hide_others(documents):
    # Keys that no rule finds stand in the sampled texts, whole and cut short.
    keys = [k.upper() if i % 2 else k for i, k in enumerate(secrets.generated(300, seed=55))]
    joined, pick = [a + b for a in WORDS for b in WORDS], random.Random(5)
    rows = [(i, " ".join(pick.choices(joined, k=60)) + (f" see {keys[i]} or {keys[i][:9]}" if i % 10 < 2 else ""), "a") for i in range(300)]
    trained = secrets.train(documents(rows))
    assert np.mean(trained.secret(secrets.generated(400, seed=99))) > 0.9
    assert np.mean(trained.secret(secrets.identifiers(WORDS, seed=98))) < 0.02


def test_training_on_tables(documents):
    df = documents([(i, prose(i) + (f" token={'ab12' * 8}" if i % 5 == 0 else ""), "a") for i in range(50)])
    assert secrets.train(df).threshold >= 4
    assert secrets.train(documents([])).secret(["ghp_16C7e42F292c6912E7710c838347Ae178B4a"]).all()


# quality


def test_quality_equals_brute_force(documents):
    pick = random.Random(3)
    texts = [None, "", "a", "x " * 5000, "\n".join(["same line here"] * 30), "é|é# " * 30, "a\n\n a\na \n", prose(1, 40_000) + prose(1, 300)]
    texts += [" ".join(pick.choice("a b c\nd é # |\t".split(" ")) for _ in range(pick.randint(1, 400))) for _ in range(150)]
    df = documents([(i, t, "a") for i, t in enumerate(texts)], extra=True)
    out = quality.measured(df).withColumn("failed", quality.base_failed(quality.F.col("n_words"), quality.F.col("n_repeat_words")))
    got = {r.id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.failed) for r in out.collect()}
    assert got == {i: plain_quality(t) for i, t in enumerate(texts)}


def test_coverage_and_verdict(documents):
    clean, shared = prose(4, 300), prose(5, 40)
    texts = [clean, clean + "\n" + shared + "\n" + prose(6, 300) + "\n" + shared, "\n".join([prose(7, 30)] * 6), None]
    out = quality.measured(documents([(i, t, "a") for i, t in enumerate(texts)])).withColumn("ok", quality.passed()).orderBy("id").collect()
    assert [r.ok for r in out] == [True, True, False, True]
    assert out[1].dup_line_chars == len(shared.replace(" ", "")) and list(out[1].dup_gram_chars) == [2 * out[1].dup_line_chars] * 3
    assert out[2].dup_gram_chars[0] == out[2].word_chars
    assert quality.measured(documents([])).count() == 0


# toxicity


@pytest.fixture(scope="module")
def judged(spark, documents):
    rows = []
    for i in range(600):
        words = prose(i, 80).split()
        if i % 4 == 0:
            words[10::20] = ["scumbag", "vermin", "ratface", "scumbag"]
        rows.append((i, " ".join(words), "a"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(3, None), (9999, 1), (None, 1)], "doc_id long, toxic int")
    df = documents(rows)
    return df, labels, toxicity.train(df, labels)


def test_held_out_accuracy(judged):
    df, _, model = judged
    out = toxicity.scored(df, model).filter(toxicity.held_out(toxicity.F.col("id"))).collect()
    assert len(out) > 80 and all((r.score >= 0.5) == (r.id % 4 == 0) and 0 <= r.score <= 1 for r in out)


def test_folding_exceptions_and_odd_texts(judged, documents):
    model = judged[2]
    texts = [None, "", "you 5cumb4g and v3rmin you ѕсumbаg", "SCÜMBAG ｖｅｒｍｉｎ scumbag", prose(7_001), "vermin " * 50_000, "scumbags vermin"]
    df = documents([(i, t, "a") for i, t in enumerate(texts)], extra=True)
    got = [r.score >= 0.5 for r in toxicity.scored(df, model).orderBy("id").collect()]
    assert got == [False, False, True, True, False, True, True]
    excused = toxicity.Model(model.entries, ("vermin control",), model.coefficients)
    assert excused.matcher().features("vermin control")[2] == 0 < excused.matcher().features("vermin controls")[2]
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 4]


def test_toxicity_without_labels_or_rows(spark, documents):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(documents([(1, prose(1), "a")]), empty)
    assert toxicity.scored(documents([(1, "scumbag", "a"), (1, "scumbag", "a")]), model).filter("score < 0.5").count() == 2
    assert toxicity.scored(documents([]), model).count() == 0


# main text


def test_blocks_decode_and_collapse():
    page = """<html><head><title>T &amp; t</title><script>var t="</p>";x(1<2)</script></head><body><p>a &lt;b&gt;\n  c<b>d</b><br>e<p>f<!-- <p>no</p> -->
      <a title="x > y" href=z>g</a> h<ul><li>i<li>j</ul></div><style>p{}</style><td>&amp k &nbsp;l"""
    found = blocks_of(page, Paths())
    assert [b.text for b in found] == ["a <b> cd e", "f g h", "i", "j", "& k \xa0l"]
    assert [b.linked for b in found] == [0, 1, 0, 0, 0]


@pytest.mark.parametrize("quote", "\"'")
def test_attribute_values_of_any_length_are_no_text(quote):
    for value in ("x" * 3_900 + " a>b <p>hidden words</p> y", "<svg><p>hidden words</p> a>b " * 4_000):
        found = blocks_of(f"<article>one <img alt = {quote}{value}{quote}> two<div data-x={quote}{value}{quote}>three</div></article>", Paths())
        assert [b.text for b in found] == ["one two", "three"]


def test_quotes_open_values_only_behind_an_equals_sign():
    later = "words " * 2_000 + "it's"
    assert [b.text for b in blocks_of(f"<p title=it's>{later}</p><p don't>x</p>", Paths())] == [later, "x"]
    assert [b.text for b in blocks_of('<p>a</p><p title="b>c</p>', Paths())] == ["a", "c"]


def test_parser_is_linear_in_bad_markup():
    for page in ("<" * 100_000, '<a "' * 30_000, "<p>" * 30_000 + "x", "<!-- " * 30_000, "<script>" * 20_000):
        blocks_of(page, Paths())


def test_gradients_are_those_of_the_loss():
    maker = main_text._Maker([prose(i) for i in range(5)])
    paths = Paths()
    pages = [maker.page(paths) for _ in range(3)]
    arrays = html_lstm.batch([b for b, _ in pages], paths)
    wanted, model = (np.random.default_rng(0).random(arrays[3].shape) > 0.5) * 1.0, html_lstm.Labeller()

    def loss():
        p = np.clip(model.probabilities(*arrays), 1e-12, 1 - 1e-12)
        return -np.where(arrays[3], wanted * np.log(p) + (1 - wanted) * np.log(1 - p), 0).sum() / arrays[3].sum()

    for name, gradient in model.gradients(*arrays, wanted).items():
        at = np.unravel_index(np.argmax(np.abs(gradient)), gradient.shape)
        value = model.p[name]
        value[at] += 1e-5
        up = loss()
        value[at] -= 2e-5
        down = loss()
        value[at] += 1e-5
        assert abs((up - down) / 2e-5 - gradient[at]) < 1e-6


def test_main_text_of_unseen_pages(spark):
    texts = [f"{prose(i, 20)}. {prose(100 + i, 25)}." for i in range(60)]
    wrap = lambda i, body: f"<html><head><title>t</title></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>buy {prose(i, 5)}</div><article><h1>{prose(i, 4)}</h1>{body}</article><footer>&copy; me</footer></body></html>"
    rows = [(i, f"http://h/{i}", wrap(i, "".join(f"<p>{t}</p>" for t in texts[i % 50 : i % 50 + 1 + i % 9]))) for i in range(120)]
    rows += [(900, None, None), (901, "u", ""), (901, "u", ""), (None, "u", wrap(5, f"<p>{texts[5]}</p>" * 3000))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "page_id AS id", "url AS text")
    got = {(r.id, r.n_chars): r.text for r in main_text.extracted(pages, main_text.train(pages)).collect()}
    by_id = {k[0]: v for k, v in got.items()}
    for i in range(120):
        assert by_id[i] == "\n".join([prose(i, 4), *texts[i % 50 : i % 50 + 1 + i % 9]])
    assert by_id[900] == by_id[901] == "" and by_id[None].count("\n") == 3000
    assert all(n == len(t) for (_, n), t in got.items())
    assert main_text.extracted(pages.limit(0), main_text.train(pages.limit(0))).count() == 0


# token counts


@pytest.fixture(scope="module")
def model_path():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("piece_bpe_32k.model")


def odd_texts():
    pick = random.Random(1)
    return [
        None, "", " ", prose(1, 30_000), "a" * 9000, "x " * 9000, " " * 20_000, "▁" * 12_000 + " abc " * 900, "é𝄞ß" * 6000, "\n" * 9000, "<s> </s> <unk> <0x0A> " * 900,
        "".join(pick.choice("ab \n\t𝄞é▁ﬁ") for _ in range(30_000)), "The " * 3000 + "a" * 12_000 + " end " * 3000,
    ]


def test_token_counts_are_those_of_the_library(documents, model_path):
    from sentencepiece import SentencePieceProcessor

    texts, plain = odd_texts(), SentencePieceProcessor(model_file=model_path)
    df = documents([(i, t, "a") for i, t in enumerate(texts)] + [(3, texts[3], "a")], extra=True)
    got = [(r.id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.counted(df, model_path).collect()]
    want = [(i, len((t or "").encode()), n := len(plain.encode(t or "")), n > 4096) for i, t in enumerate(texts)]
    assert got == [*want, want[3]]
    assert token_counts.counted(documents([]), model_path).count() == 0


def test_small_chunks_widen_until_they_align(model_path):
    with open(model_path, "rb") as file:
        counter = token_counts.Counter(file.read())
    tried, splice = [], counter.spliced
    counter.spliced = lambda *a: tried.append(splice(*a)) or tried[-1]
    texts = ["a" * 3000, prose(2, 400), "𝄞" * 500 + " b" * 900]
    assert counter.counts(texts, chunk=100, overlap=16) == [len(counter.processor.encode(t)) for t in texts]
    assert None in tried and any(tried)
