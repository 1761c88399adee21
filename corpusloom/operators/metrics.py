"""Answer scores: ROUGE, BLEU, BERTScore and the character-overlap check.

N-gram scores are row-local expressions (see ``arrays.numbered``); corpus figures need one global
aggregate. Only the longest common subsequence and the token-vector match run in Arrow UDFs.
References come as an array; several references score as the best of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import sizing
from corpusloom.functions import arrays, text as tx

Tokenizer = Callable[[Column], Column]


class BatchTokenizer:
    """Tokenizer over a Python ``tokenize(text) -> tokens``, for one text or an array of texts (Arrow UDFs)."""

    def __init__(self, tokenize: Callable[[str], list[str]]):
        self.tokenize = tokenize

    def __call__(self, text: Column) -> Column:
        cut = self.tokenize

        @F.pandas_udf("array<string>")
        def words(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: list(cut(t)) if t is not None else None)

        return words(text)

    def each(self, texts: Column) -> Column:
        cut = self.tokenize

        @F.pandas_udf("array<array<string>>")
        def words(lists: pd.Series) -> pd.Series:
            return lists.map(lambda ts: [list(cut(t)) for t in ts] if ts is not None else None)

        return words(texts)


def _each(tokenizer: Tokenizer, texts: Column) -> Column:
    return tokenizer.each(texts) if hasattr(tokenizer, "each") else F.transform(texts, tokenizer)


def f_score(overlap: Column, predicted: Column, referred: Column) -> Column:
    p = overlap / F.nullif(predicted, F.lit(0))
    r = overlap / F.nullif(referred, F.lit(0))
    return F.coalesce(F.when(overlap > 0, 2.0 * p * r / (p + r)), F.lit(0.0))


def rouge_n(df: DataFrame, orders: tuple[int, ...] = (1, 2), tokenizer: Tokenizer = tx.rouge_tokens) -> DataFrame:
    """Add rouge<n> F1 from ``prediction`` and ``references``."""
    known = df.columns
    out = df.withColumn("_p", tokenizer(F.col("prediction"))).withColumn("_r", _each(tokenizer, F.col("references")))
    for n in orders:
        out = out.withColumn(f"_p{n}", arrays.numbered(arrays.ngrams(F.col("_p"), n)))
        per_reference = F.transform(
            "_r",
            lambda ref: arrays.let(
                arrays.numbered(arrays.ngrams(ref, n)),
                lambda grams: f_score(arrays.shared(F.col(f"_p{n}"), grams), F.size(f"_p{n}"), F.size(grams)),
            ),
        )
        out = out.withColumn(f"rouge{n}", F.coalesce(F.array_max(per_reference), F.lit(0.0)))
    return out.select(*known, *[f"rouge{n}" for n in orders])


#: Tokens occurring as often keep their places as one integer; those of rarer ones are made when asked for.
_FREQUENT = 64


class _Places:
    """For a token the bits of its positions in a text. Memory grows with the text, whatever its number of distinct tokens."""

    def __init__(self, tokens: list[str]):
        self.lists: dict[str, list[int]] = {}
        for i, token in enumerate(tokens):
            self.lists.setdefault(token, []).append(i)
        self.width = len(tokens) // 8 + 1
        self.made = {t: self.bits(at) for t, at in self.lists.items() if len(at) >= _FREQUENT}

    def bits(self, positions: list[int]) -> int:
        out = bytearray(self.width)
        for i in positions:
            out[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(out, "little")

    def __call__(self, token: str) -> int:
        if token in self.made:
            return self.made[token]
        positions = self.lists.get(token)
        return self.bits(positions) if positions else 0


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence length by the bit-vector recurrence, one big-integer step per token."""
    places = _Places(a)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & places(token)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def lcs_positions(ref: list[str], pred: list[str]) -> set[int]:
    """Positions of ``ref`` on one longest common subsequence with ``pred``, walking back from the ends.

    Row i of the length table is one integer over ``pred``, a zero bit where the length grows. Every k-th row is kept, k the root of
    the number of rows, and the rows between two kept ones are made again while the walk crosses them: memory is about
    2 * sqrt(n) * m bits in place of n * m numbers.
    """
    if not ref or not pred:
        return set()
    places = _Places(pred)
    full = (1 << len(pred)) - 1

    def below(row: int, token: str) -> int:
        hit = row & places(token)
        return ((row + hit) | (row - hit)) & full

    step = math.isqrt(len(ref)) + 1
    row, kept = full, []
    for i, token in enumerate(ref):
        if i % step == 0:
            kept.append(row)
        row = below(row, token)
    found: set[int] = set()
    i, j, length = len(ref), len(pred), len(pred) - row.bit_count()
    rows: list[int] = []
    first = len(ref)
    while i and j and length:
        if i - 1 < first:  # make the rows of the block above again
            first = (i - 1) // step * step
            rows = [kept[first // step]]
            for token in ref[first:i]:
                rows.append(below(rows[-1], token))
        here = rows[i - first]
        if ref[i - 1] == pred[j - 1]:
            found.add(i - 1)
            i, j, length = i - 1, j - 1, length - 1
        elif here >> (j - 1) & 1 and length > j - (rows[i - 1 - first] & ((1 << j) - 1)).bit_count():
            j -= 1  # only the row above is shorter
        else:
            i -= 1
    return found


def _f1(hits: int, predicted: int, referred: int) -> float:
    if not hits:
        return 0.0
    p, r = hits / predicted, hits / referred
    return 2 * p * r / (p + r)


def summary_hits(references: list[list[str]], predictions: list[list[str]]) -> int:
    """Union-LCS hits over sentences, each token counted no more often than it occurs on either side."""
    spare: dict[str, int] = {}
    for token in (t for s in predictions for t in s):
        spare[token] = spare.get(token, 0) + 1
    left: dict[str, int] = {}
    for token in (t for s in references for t in s):
        left[token] = left.get(token, 0) + 1
    hits = 0
    for ref in references:
        union: set[int] = set()
        for pred in predictions:
            union |= lcs_positions(ref, pred)
        for at in sorted(union):
            token = ref[at]
            if spare.get(token, 0) > 0 and left.get(token, 0) > 0:
                spare[token] -= 1
                left[token] -= 1
                hits += 1
    return hits


#: Rows of a batch that are Python objects at a time.
OBJECT_ROWS = 16


def _rows(*columns: pa.Array) -> Iterator[tuple]:
    for at in range(0, len(columns[0]), OBJECT_ROWS):
        yield from zip(*(c.slice(at, OBJECT_ROWS).to_pylist() for c in columns))


def rouge_l(df: DataFrame, tokenizer: Tokenizer = tx.rouge_tokens) -> DataFrame:
    """Add rougeL F1; several references give the best."""

    @F.arrow_udf("double")
    def score(pred: pa.Array, refs: pa.Array) -> pa.Array:
        def one(p: list, rs: list) -> float:
            return max((_f1(lcs_length(p, r), len(p), len(r)) for r in rs), default=0.0)

        return pa.array((one(p, rs) for p, rs in _rows(pred, refs)), pa.float64())

    tokens = _each(tokenizer, F.col("references"))
    return df.withColumn("rougeL", score(tokenizer(F.col("prediction")), tokens))


def rouge_lsum(df: DataFrame, tokenizer: Tokenizer = tx.rouge_tokens) -> DataFrame:
    """Add rougeLsum F1: sentences are lines, matched by union-LCS."""
    lines = lambda t: F.filter(_each(tokenizer, F.split(t, "\n")), lambda s: F.size(s) > 0)

    @F.arrow_udf("double")
    def score(pred: pa.Array, refs: pa.Array) -> pa.Array:
        def one(p: list, rs: list) -> float:
            n = sum(map(len, p))
            return max((_f1(summary_hits(r, p), n, sum(map(len, r))) for r in rs), default=0.0)

        return pa.array((one(p, rs) for p, rs in _rows(pred, refs)), pa.float64())

    return df.withColumn("rougeLsum", score(lines(F.col("prediction")), F.transform("references", lines)))


def _grams_of(n: int) -> Callable[[Column], Column]:
    return lambda tokens: arrays.numbered(arrays.ngrams(tokens, n))


def bleu_counts(df: DataFrame, max_order: int = 4, tokenizer: Tokenizer = tx.mteval_tokens) -> DataFrame:
    """Row-local BLEU statistics: p_len, r_len (shortest reference), match<n> and total<n>."""
    known = df.columns
    out = df.withColumn("_p", tokenizer(F.col("prediction"))).withColumn("_r", _each(tokenizer, F.col("references")))
    made = {"p_len": F.size("_p"), "r_len": F.array_min(F.transform("_r", lambda r: F.size(r)))}
    none = F.array().cast("array<string>")
    for n in range(1, max_order + 1):
        grams = _grams_of(n)
        union = F.aggregate(F.transform("_r", grams), none, lambda acc, r: F.array_union(acc, r))
        made[f"match{n}"] = arrays.shared(grams(F.col("_p")), union)
        made[f"total{n}"] = F.greatest(F.size("_p") - (n - 1), F.lit(0))
    return out.withColumns(made).select(*known, *made)


def bleu(
    df: DataFrame,
    max_order: int = 4,
    smooth: bool = False,
    tokenizer: Tokenizer = tx.mteval_tokens,
    by: list[str] | None = None,
) -> DataFrame:
    """Corpus BLEU with clipped n-gram precisions and brevity penalty: one row, or one per ``by`` group.

    ``smooth`` adds one to both counts of every order. An empty prediction side scores 0.
    """
    by = by or []
    counted = bleu_counts(df.select(*by, "prediction", "references"), max_order, tokenizer)
    orders = range(1, max_order + 1)
    names = ["p_len", "r_len", *[f"match{n}" for n in orders], *[f"total{n}" for n in orders]]
    sums = counted.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in names])
    plus = 1.0 if smooth else 0.0
    precision = {
        f"precision{n}": F.when(F.col(f"total{n}") + plus > 0, (F.col(f"match{n}") + plus) / (F.col(f"total{n}") + plus)).otherwise(0.0)
        for n in orders
    }
    logs = sum((F.ln(F.nullif(F.col(p), F.lit(0.0))) for p in precision), F.lit(0.0))
    ratio = F.when(F.col("r_len") > 0, F.col("p_len") / F.col("r_len")).otherwise(0.0)
    penalty = F.when(ratio > 1.0, 1.0).when(ratio > 0, F.exp(1.0 - 1.0 / F.nullif(ratio, F.lit(0.0)))).otherwise(0.0)
    return (
        sums.withColumns({**precision, "length_ratio": ratio})
        .withColumn("brevity_penalty", penalty)
        .withColumn("bleu", F.coalesce(F.exp(logs / float(max_order)), F.lit(0.0)) * F.col("brevity_penalty"))
        .select(
            *by, "bleu", *precision, "brevity_penalty", "length_ratio",
            F.col("p_len").cast("long").alias("translation_length"),
            F.col("r_len").cast("long").alias("reference_length"),
        )
    )


def reference_idf(references: DataFrame, tokens: str) -> DataFrame:
    """(token, idf) over a table of reference texts' tokens: ln((N + 1) / (df + 1)).

    Each row is one text. A token that no reference holds has df 0: see ``idf_weights``.
    """
    total = references.agg((F.count("*") + 1).cast("double")).scalar()
    held = references.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return held.select("token", F.ln(total / (F.col("df") + 1)).alias("idf"))


def idf_weights(rows: DataFrame, row_key: str, sides: dict[str, str], idf: DataFrame, unseen: Column | float) -> DataFrame:
    """Add, for each side {token column: new column}, the idf of its tokens in order; ``unseen`` is that of other tokens.

    Distinct tokens of a row meet the table, so a word in every row is looked up once a row; hot tokens are salted beyond
    the broadcast bound. ``row_key`` must be unique; a row's tokens, one model window, come back as one small map.
    """
    every = F.array_distinct(F.flatten(F.array(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in sides))))
    asked = rows.select(row_key, F.explode(every).alias("token"))
    found = sizing.lookup_join(asked, idf, ["token"], "inner", [row_key])
    maps = found.groupBy(row_key).agg(F.map_from_entries(F.collect_list(F.struct("token", "idf"))).alias("_idf"))
    joined = rows.join(maps, row_key, "left")
    other = unseen if isinstance(unseen, Column) else F.lit(float(unseen))
    weigh = lambda c: F.transform(c, lambda t: F.coalesce(F.try_element_at(F.col("_idf"), t), F.col("_unseen")))
    return joined.withColumn("_unseen", other).withColumns({new: weigh(c) for c, new in sides.items()}).drop("_idf", "_unseen")


def bert_score(
    df: DataFrame,
    predicted: str = "prediction_vectors",
    referred: str = "reference_vectors",
    predicted_weights: str | None = None,
    referred_weights: str | None = None,
    baseline: tuple[float, float, float] | None = None,
) -> DataFrame:
    """Add precision, recall and f1 from two arrays of token vectors (at most one model window long).

    Each token takes its best cosine on the other side. Tokens count alike, or by their weights (such as ``idf_weights``);
    weights that sum to zero count alike. ``baseline`` (precision, recall, f1 of unrelated texts) rescales each figure
    to (x - b) / (1 - b).
    """

    def score_rows(left: pd.Series, right: pd.Series, wl: pd.Series | None, wr: pd.Series | None) -> pd.DataFrame:
        def matrix(vectors) -> np.ndarray:
            m = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

        def mean(best: np.ndarray, weights) -> float:
            if weights is None:
                return best.mean()
            w = np.asarray(weights, dtype=np.float64)
            return float(best @ w / w.sum()) if w.sum() else best.mean()

        def one(a, b, wa, wb) -> tuple[float, float, float]:
            if a is None or b is None or not len(a) or not len(b):
                return 0.0, 0.0, 0.0
            near = matrix(a) @ matrix(b).T
            p, r = mean(near.max(axis=1), wa), mean(near.max(axis=0), wb)
            return p, r, (2 * p * r / (p + r) if p + r else 0.0)

        none = [None] * len(left)
        rows = zip(left, right, none if wl is None else wl, none if wr is None else wr)
        return pd.DataFrame([one(*r) for r in rows], columns=["precision", "recall", "f1"])

    kind = "struct<precision:double,recall:double,f1:double>"
    if predicted_weights is None and referred_weights is None:

        @F.pandas_udf(kind)
        def plain(left: pd.Series, right: pd.Series) -> pd.DataFrame:
            return score_rows(left, right, None, None)

        found = plain(F.col(predicted), F.col(referred))
    else:
        if predicted_weights is None or referred_weights is None:
            raise ValueError("weights are needed for both sides")

        @F.pandas_udf(kind)
        def weighted(left: pd.Series, right: pd.Series, wl: pd.Series, wr: pd.Series) -> pd.DataFrame:
            return score_rows(left, right, wl, wr)

        found = weighted(F.col(predicted), F.col(referred), F.col(predicted_weights), F.col(referred_weights))
    names = ("precision", "recall", "f1")
    shift = dict(zip(names, baseline or ()))
    scale = lambda n: (F.col(f"_s.{n}") - shift[n]) / (1.0 - shift[n]) if n in shift else F.col(f"_s.{n}")
    return df.withColumn("_s", found).withColumns({n: scale(n) for n in names}).drop("_s")


def corpus_means(df: DataFrame, columns: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Means of row scores, scaled and rounded to two decimals; 0 for no rows."""
    grouped = df.groupBy(*(by or []))
    return grouped.agg(
        *[F.round(F.coalesce(F.avg(c), F.lit(0.0)) * scale, 2).alias(c) for c, scale in columns.items()]
    )


# Resamples and the interval of the aggregated figures.
RESAMPLES = 1_000
CONFIDENCE = 0.95
#: A uniform 32-bit number below the k-th bound is drawn fewer than k times: distribution of Poisson(1) up to 12.
POISSON_BOUNDS = [int(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(13)]


def bootstrap(
    df: DataFrame,
    columns: list[str],
    row_key: str,
    by: list[str] | None = None,
    resamples: int = RESAMPLES,
    confidence: float = CONFIDENCE,
    seed: str = "bootstrap-1",
) -> DataFrame:
    """(by, metric, low, mid, high): bootstrap interval and median of the mean of each score column.

    A row counts Poisson(1) times in each resample, drawn from the md5 of seed, row key and resample, four resamples a digest:
    the numbers of draws are independent between rows, so one aggregate forms all resamples, combining in each task to
    ``resamples`` rows per group. Reruns agree. Rows of one key are drawn together, NULL scores don't count, and a group
    without any drawn score has NULL figures.
    """
    by = by or []
    low = (1.0 - confidence) / 2
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(row_key).cast("string"), F.col("_four").cast("string")))
    uniform = F.conv(F.substring("_digest", F.col("_part") * 8 + 1, F.lit(8)), 16, 10).cast("long")
    fours, parts = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (-(-resamples // 4), 4))
    drawn = df.select(*by, row_key, *columns).withColumn("_four", fours).withColumn("_digest", digest).withColumn("_part", parts)
    drawn = drawn.withColumn("_sample", F.col("_four") * 4 + F.col("_part")).filter(F.col("_sample") < resamples)
    drawn = drawn.withColumn("_times", sum((uniform >= b).cast("int") for b in POISSON_BOUNDS)).filter("_times > 0")
    means = drawn.groupBy(*by, "_sample").agg(
        *((F.sum(F.col(c) * F.col("_times")) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), F.col("_times"))), F.lit(0))).alias(c) for c in columns)
    )
    long = means.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("mean")) for c in columns))).alias("_m"))
    cut = lambda share: F.percentile("_m.mean", F.lit(share))
    return long.groupBy(*by, F.col("_m.metric").alias("metric")).agg(cut(low).alias("low"), cut(0.5).alias("mid"), cut(1.0 - low).alias("high"))


def report(df: DataFrame, by: list[str], tokenizer: Tokenizer = tx.rouge_tokens) -> DataFrame:
    """The evaluation table, one row per ``by`` group (such as the thinking mode).

    ROUGE means stay on 0 to 1, BLEU and BERTScore are times 100, all at two decimals. ``df`` has
    ``prediction``, ``references`` and the two token-vector columns.
    """
    rows = bert_score(rouge_l(rouge_n(df, tokenizer=tokenizer), tokenizer))
    scales = {"rouge1": 1.0, "rouge2": 1.0, "rougeL": 1.0, "precision": 100.0, "recall": 100.0, "f1": 100.0}
    means = corpus_means(rows, scales, by)
    for name in ("precision", "recall", "f1"):
        means = means.withColumnRenamed(name, f"bertscore_{name}")
    corpus = bleu(df, by=by).select(*by, F.round(F.col("bleu") * 100, 2).alias("bleu"))
    return means.join(F.broadcast(corpus) if sizing.is_small(corpus) else corpus, by)


# The marker of a raw retrieval dump and the overlap an answer needs.
DUMP_MARKER = "Retrieved Chunks:"
MIN_OVERLAP = 0.2


def characters(text: Column) -> Column:
    """Distinct characters that are not white space."""
    bare = F.translate(text, tx.WHITESPACE, "")
    return F.filter(F.array_distinct(F.split(bare, "")), lambda c: c != "")


def overlap_share(answer: Column, reference: Column) -> Column:
    wanted = characters(reference)
    return F.size(F.array_intersect(characters(answer), wanted)) / F.greatest(F.size(wanted), F.lit(1))


def overlap_verdict(answer: Column, reference: Column) -> Column:
    """True when the answer is usable: not empty, not a retrieval dump, and close enough to the reference."""
    said = tx.strip(F.coalesce(answer, F.lit("")))
    wanted = tx.strip(F.coalesce(reference, F.lit("")))
    return (
        F.when(said == "", False)
        .when(F.contains(said, F.lit(DUMP_MARKER)), False)
        .when(wanted == "", True)
        .otherwise(overlap_share(said, wanted) >= MIN_OVERLAP)
    )


def answer_of(outputs: str) -> Column:
    """Final answer of a run's output struct."""
    return tx.strip(tx.first_filled(*[F.col(f"{outputs}.{k}") for k in ("response", "answer", "output")]))


def reference_of(outputs: str) -> Column:
    """Reference answer of a reference struct."""
    keys = ("response", "answer", "output", "expected_answer")
    return tx.strip(tx.first_filled(*[F.col(f"{outputs}.{k}") for k in keys]))
