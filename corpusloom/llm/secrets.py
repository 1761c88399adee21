"""Secret scans: rules for known shapes and a likelihood ratio of two character models for the rest.

Two Markov models of the characters of a token, one of random strings and one of ordinary identifiers, are counted on
labelled samples. A token whose log-likelihood ratio is above the threshold is random enough to be a secret. The samples:
values that the rules found in a bounded, hashed sample of the documents and generated keys over the usual alphabets are
random; the other tokens of that sample, alone and joined as identifiers are, are ordinary. Tokens of letters and digits
that models of the letters-only ones call random are left out first: texts hold secrets that no rule finds. Half of the
samples train, the other half sets the threshold, and generated keys of another draw bound it.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm import blocks

KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_RANDOM = 6, 20, 24, 16
#: Bounds of the training sample.
SAMPLE_ROWS = 2_000
SAMPLE_TOKENS = 50_000
GENERATED = 4_000
#: Evidence of e^4 to 1 at least; shares of ordinary tokens kept aside below the threshold and of generated keys above it.
LEAST = 4.0
BELOW, ABOVE = 0.999, 0.95
#: Words for samples without any.
PLAIN = ["value", "name", "index", "path", "config", "item"]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RANDOM)
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

ALPHABET = string.ascii_letters + string.digits + "+/_.=-"
_PLACE = np.full(256, len(ALPHABET), dtype=np.int64)
_PLACE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
_SIZE = len(ALPHABET) + 1  # the last one stands for any other byte and for the start
_HEX_BYTE = np.zeros(256, dtype=bool)
_HEX_BYTE[[ord(c) for c in "0123456789abcdef"]] = True
_TOKEN_BYTE = np.zeros(256, dtype=bool)
_TOKEN_BYTE[[ord(c) for c in string.ascii_letters + string.digits + "+/_=-"]] = True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the rules, leftmost and not overlapping within a kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_VALUE]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return ordered(found)


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _steps(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row of each token and the flat index (from, to) of each of its character steps."""
    data = np.frombuffer("".join(tokens).encode("ascii", "replace"), dtype=np.uint8)
    size = np.array([len(t) for t in tokens], dtype=np.int64)
    to = _PLACE[data]
    back = np.concatenate([[_SIZE - 1], to[:-1]])
    back[(np.cumsum(size) - size)[size > 0]] = _SIZE - 1
    return np.repeat(np.arange(len(tokens)), size), back * _SIZE + to


class Models:
    """Log-probabilities of the steps in random strings and in identifiers, and the threshold between them."""

    def __init__(self, random: list[str], ordinary: list[str]):
        self.ratio = self._table(random[::2]) - self._table(ordinary[::2])
        # Only tokens of this length are ever judged. A few random strings among the ordinary ones lift neither bound.
        rest = self.scores([t for t in ordinary[1::2] if len(t) >= MIN_RANDOM])
        over = float(np.quantile(rest, BELOW)) + 1.0 if len(rest) else LEAST
        self.threshold = max(LEAST, min(over, float(np.quantile(self.scores(generated(1_000, seed=8)), 1 - ABOVE))))

    @staticmethod
    def _table(tokens: list[str]) -> np.ndarray:
        counts = np.bincount(_steps(tokens)[1], minlength=_SIZE * _SIZE).reshape(_SIZE, _SIZE) + 0.5
        return np.log(counts / counts.sum(axis=1, keepdims=True)).ravel()

    def scores(self, tokens: list[str]) -> np.ndarray:
        row, step = _steps(tokens)
        return np.bincount(row, weights=self.ratio[step], minlength=len(tokens))

    def secret(self, tokens: list[str]) -> np.ndarray:
        """Letters and digits together, and more like a random string."""
        return _mixed(tokens) & (self.scores(tokens) > self.threshold)


def _mixed(tokens: list[str]) -> np.ndarray:
    return np.array([any(c.isdigit() for c in t) and any(c.isalpha() for c in t) for t in tokens], dtype=bool)


def cleaned(words: list[tuple[str, str]], random: list[str]) -> list[str]:
    """Of (word, run it stands in) the words whose run, or they themselves, aren't of letters and digits like the random strings."""
    whole = [run or word for word, run in words]
    mixed = _mixed(whole)
    plain = sorted({w for (w, _), m in zip(words, mixed) if not m}) or PLAIN
    first = Models(random, [w for w in plain for _ in range(2)])  # all of them train
    drop = mixed & (first.scores(whole) > LEAST)
    return sorted({w for (w, _), d in zip(words, drop) if not d})


def generated(count: int = GENERATED, seed: int = 7) -> list[str]:
    """Random strings over the alphabets in which keys are written."""
    draw = np.random.default_rng(seed)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", string.ascii_uppercase + "234567", string.ascii_letters + string.digits, ALPHABET.replace(".", "").replace("=", "")]
    return ["".join(draw.choice(list(alphabets[i % len(alphabets)]), size=int(draw.integers(MIN_RANDOM, 48)))) for i in range(count)]


def identifiers(words: list[str], seed: int = 11) -> list[str]:
    """The words and joints of them as code and addresses write them."""
    draw = np.random.default_rng(seed)
    out = list(words)
    for i in range(len(words)):
        parts = [words[j] for j in draw.integers(0, len(words), size=int(draw.integers(2, 5)))]
        number = str(draw.integers(0, 2100)) if i % 3 == 0 else ""
        style = i % 5
        if style == 0:
            out.append("_".join(p.lower() for p in parts) + number)
        elif style == 1:
            out.append("-".join(p.lower() for p in parts) + number)
        elif style == 2:
            out.append(parts[0].lower() + "".join(p.capitalize() for p in parts[1:]) + number)
        elif style == 3:
            out.append("_".join(p.upper() for p in parts) + number)
        else:
            out.append("/".join(parts) + number)
    return out


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of texts: 1 values that the rules found, 0 other words of ASCII letters and digits with the run of letters and digits around them."""
    word = re.compile(r"[A-Za-z0-9]{3,32}")
    for batch in batches:
        found: dict[tuple[int, str, str], None] = {}
        for text in pc.fill_null(batch.column(0), "").to_pylist():
            spans = base_spans(text)
            for start, end, kind in spans:
                value = text[start:end] if kind != "assign" else ASSIGN.match(text, start).group(2)
                found[1, value[:256], ""] = None
            taken = [(s, e) for s, e, _ in spans]
            runs = [m for m in TOKEN.finditer(text) if _mixed([m.group()])[0]]
            ends = [m.end() for m in runs]
            for m in word.finditer(text):
                if not m.group().isdigit() and not any(s < m.end() and m.start() < e for s, e in taken):
                    at = bisect_left(ends, m.end())
                    found[0, m.group(), runs[at].group()[:256] if at < len(runs) and runs[at].start() <= m.start() else ""] = None
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], type=pa.int32()), *(pa.array([k[i] for k in found], type=pa.string()) for i in (1, 2))], names=["label", "token", "run"])


def train(documents: DataFrame, id_: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, tokens: int = SAMPLE_TOKENS) -> Models:
    """Models from about ``rows`` documents, chosen by the hash of their id, and at most ``tokens`` of their distinct tokens."""
    share = min(1.0, rows / max(1, documents.count()))
    chosen = documents.filter(F.pmod(F.xxhash64(F.lit("secrets"), F.col(id_)), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = chosen.select(F.col(text).cast("string")).mapInArrow(_samples, "label int, token string, run string").distinct()
    sample = sorted((r.label, r.token, r.run) for r in found.orderBy(F.xxhash64("token")).limit(tokens).collect())
    random = [t for label, t, _ in sample if label == 1] + generated()
    words = cleaned([(t, run) for label, t, run in sample if label == 0], random) or PLAIN
    mixed = identifiers(words)
    order = np.random.default_rng(5).permutation(len(mixed))
    return Models(random, [mixed[i] for i in order])


def _runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, least: int) -> np.ndarray:
    """Rows that hold a run of at least ``least`` bytes of a class."""
    starts, ends, bounds = blocks.spans(data, offsets, inside)
    long = np.flatnonzero(ends - starts >= least)
    return np.unique(np.searchsorted(bounds, long, side="right") - 1)


def _hinted(text: str) -> bool:
    low = text.lower()
    return any(hint in low for hint in _HINTS)


def _scanned(models: Broadcast):
    def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        base = base_spans(text)
        starts = [s for s, _, _ in base]
        reach = list(accumulate((e for _, e, _ in base), max))
        rest = []
        for m in TOKEN.finditer(text):
            before = bisect_left(starts, m.end())
            if not before or reach[before - 1] <= m.start():  # no rule's span lies over it
                rest.append((m.start(), m.end(), m.group()))
        picked = models.value.secret([t for _, _, t in rest]) if rest else []
        return base, [(s, e, "random") for (s, e, _), yes in zip(rest, picked) if yes]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for first, end, data, offsets in blocks.blocks(texts):
                asked = set(_runs(data, offsets, _HEX_BYTE, MIN_HEX).tolist()) | set(_runs(data, offsets, _TOKEN_BYTE, MIN_RANDOM).tolist())
                part = texts.slice(first, end - first)
                base, more = [[] for _ in range(end - first)], [[] for _ in range(end - first)]
                for i, text in enumerate(part.to_pylist()):
                    if text and (i in asked or "AKIA" in text or _hinted(text)):
                        base[i], more[i] = scan(text)
                kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
                as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for s, e, k in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        *(pa.array([sum(k == name for _, _, k in b) for b in base], type=pa.int64()) for name in KINDS[:3]),
                        pa.array([as_rows(b) for b in base], type=pa.list_(kind)),
                        pa.array([as_rows(ordered(b + m)) for b, m in zip(base, more)], type=pa.list_(kind)),
                    ],
                    names=["id", "n_assign", "n_access", "n_hex", "base", "spans"],
                )

    return rows


def found(documents: DataFrame, models: Models, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: id, counts by rule, base and spans: arrays of (kind, start, end) in code points, end exclusive.

    Null and empty texts have no spans; equal rows get equal results, one row each; an empty table gives none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(models)
    rows = documents.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text"))
    span = "array<struct<kind:string,start:long,end:long>>"
    return rows.mapInArrow(_scanned(shared), f"id {dict(rows.dtypes)['id']}, n_assign long, n_access long, n_hex long, base {span}, spans {span}")
