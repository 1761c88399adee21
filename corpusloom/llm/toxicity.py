"""Toxicity by a weighted lexicon.

Texts and lexicon are folded alike: lower case, no accents, homoglyphs of other scripts and digits that stand for
letters replaced, everything but letters a gap. An Aho-Corasick automaton finds the longest entry at each word: a
word, the beginning of a word, or an exception phrase, which takes the place of the entry inside it and weighs
nothing. The weights found, in all and by length of the text, go into a logistic score.

Entries, weights and score are learned from labelled rows: an entry weighs the log of how much more often it stands in
toxic texts than in others, less two standard errors. Labels are the only thing used of the label table, texts the only
thing used of the documents.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm import blocks
from corpusloom.sizing import is_small

#: Bounds of what is learned: labelled rows, entries of the lexicon.
SAMPLE_ROWS = 20_000
MAX_ENTRIES = 20_000
MIN_TEXTS = 3
MIN_WEIGHT = 1.4
PER_TEXT = 5  # occurrences of an entry that count in one text while learning
PREFIXES = (4, 5, 6, 7, 8)
EXCEPTIONS = ("idiot proof", "trash can", "trash bin", "class clown", "clown fish", "stupid simple", "sore loser")

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "ı": "i", "đ": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
}
_GAP = "  "  # two, so that two words side by side don't share theirs


class _Fold(dict):
    """Code point to folded string, filled as texts need it."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code).lower()):
            c = HOMOGLYPHS.get(c, c)
            out += c if c.isalpha() else ""
        # A lone combining mark vanishes, any other sign separates.
        self[code] = out if out or unicodedata.combining(chr(code)) else _GAP
        return self[code]


def fold(text: str, table: _Fold) -> str:
    return _GAP + text.translate(table) + _GAP


def entries_of(word: str) -> list[str]:
    """The lexicon entries a folded word could match: itself and its beginnings."""
    return [f" {word} ", *(f" {word[:n]}" for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0.0, 0.0, 0.0, 0.0]))

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    def __init__(self, model: Model):
        import ahocorasick

        self.table, self.coefficients = _Fold(), model.coefficients
        self.automaton = ahocorasick.Automaton()
        self.weights = np.zeros(len(model.entries) + 1)
        self.entries = [*model.entries, ""]
        for i, (entry, weight) in enumerate(model.entries.items()):
            self.weights[i] = weight
            self.automaton.add_word(entry, i)
        for phrase in model.exceptions:
            folded = _GAP.join(fold(phrase, self.table).split())
            self.automaton.add_word(f" {folded} ", len(model.entries))
        self.automaton.make_automaton()

    def features(self, text: str) -> tuple[float, ...]:
        folded = fold(text, self.table)
        found = Counter(i for _, i in self.automaton.iter_long(folded))
        if not found:
            return 1.0, 0.0, 0.0, 0.0, 0.0
        ids = np.fromiter(found, dtype=np.int64)
        times = np.fromiter(found.values(), dtype=np.float64)
        weights = self.weights[ids]
        total, words = float(weights @ times), len(folded.split())
        return 1.0, np.log1p(100 * total / (words + 5)), np.log1p(total), np.log1p(np.count_nonzero(weights)), float(weights.max(initial=0.0))

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.coefficients, -30, 30)))


def held_out(id_: Column) -> Column:
    """Rows kept aside: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch of labelled texts: entry, texts and occurrences in toxic texts and in others; the empty entry counts words."""
    table = _Fold()
    for batch in batches:
        sums: dict[str, list[int]] = {}
        for toxic, text in zip(batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "").to_pylist()):
            words = Counter(fold(text, table).split())
            own: Counter[str] = Counter()
            for word, n in words.items():
                for entry in entries_of(word):
                    own[entry] += n
            for entry, n in [*own.items(), ("", sum(min(n, PER_TEXT) for n in words.values()))]:
                row = sums.setdefault(entry, [0, 0, 0])
                row[0] += toxic
                row[1 if toxic else 2] += min(n, PER_TEXT) if entry else n
        columns = list(zip(*sums.values())) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), type=pa.string()), *(pa.array(c, type=pa.int64()) for c in columns)], names=["entry", "texts", "toxic", "other"])


def _features(model: Broadcast):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.value.matcher()
        for batch in batches:
            found = [list(matcher.features(t)) for t in pc.fill_null(batch.column(1), "").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=pa.list_(pa.float64()))], names=["toxic", "features"])

    return rows


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; the first column is the constant and isn't penalised."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge + 1e-9), gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(documents: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", toxic: str = "toxic", rows: int = SAMPLE_ROWS,
          exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """A model from at most about ``rows`` labelled documents, none of them held out, chosen by the hash of their id.

    Rows without label count for nothing, an id labelled twice is toxic if one label says so, copies of a text count
    once. Without labelled rows the model is empty and scores every text low.
    """
    known = labels.filter(F.col(toxic).isNotNull() & ~held_out(F.col(id_))).groupBy(F.col(id_).alias("id")).agg(F.max(toxic).cast("long").alias("toxic"))
    known = known.filter(F.col("id").isNotNull()).checkpoint()
    share = min(1.0, rows / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64(F.lit("toxicity"), F.col("id")), F.lit(1 << 30)) < int(share * (1 << 30)))
    known = F.broadcast(known) if is_small(known) else known
    texts = documents.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text")).join(known, "id")
    texts = texts.groupBy(F.md5("text").alias("of")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("toxic", "text").checkpoint()
    counted = texts.mapInArrow(_counts, "entry string, texts long, toxic long, other long").groupBy("entry")
    counted = counted.agg(*(F.sum(c).alias(c) for c in ("texts", "toxic", "other"))).checkpoint()
    whole = counted.filter(F.col("entry") == "").first()
    if whole is None or not whole.toxic or not whole.other:
        return Model(exceptions=exceptions)
    a, b = F.col("toxic") + 0.5, F.col("other") + 0.5
    weight = F.log(a / b * (whole.other / whole.toxic)) - 2 * F.sqrt(1 / a + 1 / b)
    chosen = counted.filter((F.col("entry") != "") & (F.col("texts") >= MIN_TEXTS)).withColumn("weight", weight).filter(F.col("weight") >= MIN_WEIGHT)
    chosen = chosen.orderBy(F.desc(F.col("weight") * F.log("texts")), "entry").limit(MAX_ENTRIES).select("entry", "weight").collect()
    model = Model({r.entry: r.weight for r in chosen}, exceptions)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    sample = texts.mapInArrow(_features(shared), "toxic long, features array<double>").collect()
    x, y = np.array([r.features for r in sample]), np.array([r.toxic for r in sample], dtype=float)
    order = np.lexsort((*x.T, y))  # rows come in no order; sums of the fit shall not depend on it
    model.coefficients = fit(x[order], y[order])
    return model


def _scored(model: Broadcast):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.value.matcher()
        for batch in batches:
            texts = batch.column(1)
            for first, end, _, _ in blocks.blocks(texts):
                part = pc.fill_null(texts.slice(first, end - first), "").to_pylist()
                score = matcher.score(np.array([matcher.features(t) for t in part]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(score)], names=["id", "score"])

    return rows


def scored(documents: DataFrame, model: Model, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: id, score between 0 and 1.

    Null and empty texts get the score of a text without matches; equal texts get equal scores, one row each; an empty
    table gives none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_scored(shared), f"id {dict(rows.dtypes)['id']}, score double")


def without_toxic(documents: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose score is below ``limit``; copies of the column ride along to the scorer."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return documents.mapInArrow(_kept(shared, documents.columns.index(text), limit), documents.schema)


def _kept(model: Broadcast, column: int, limit: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.value.matcher()
        for batch in batches:
            texts = batch.column(column)
            for first, end, _, _ in blocks.blocks(texts):
                part = pc.fill_null(texts.slice(first, end - first), "").to_pylist()
                score = matcher.score(np.array([matcher.features(t) for t in part]))
                yield batch.slice(first, end - first).filter(pa.array(score < limit))

    return rows
