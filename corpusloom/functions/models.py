"""Model services as Column functions.

A chat model is anything that turns a prompt Column into a reply Column; an embedder turns text
into a vector Column; a reranker turns (query, text) into a score Column. ``batch_chat`` and
friends lift a plain batch callable (an HTTP client, say) into that shape as an Arrow UDF. The
``Offline*`` classes are deterministic stand-ins built from SQL expressions: they make results
reproducible without a network and say nothing about the quality of any real model.
"""

from __future__ import annotations

import logging
import string
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F

from corpusloom.functions import arrays, text as tx

log = logging.getLogger(__name__)


class ChatModel(Protocol):
    def reply(self, prompt: Column) -> Column: ...


class Embedder(Protocol):
    def embed(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def score(self, query: Column, text: Column) -> Column: ...


class BatchChat:
    """Chat model over ``call(list of prompts) -> list of replies``; a failed call gives NULLs
    and a NULL prompt is not sent.

    The UDF is marked nondeterministic, which keeps the optimizer from asking a second time for a
    filter it would otherwise copy below the call.
    """

    def __init__(self, call: Callable[[list[str]], Sequence[str | None]], batch: int = 16):
        self.call, self.batch = call, batch

    def reply(self, prompt: Column) -> Column:
        call, step = self.call, self.batch

        @F.pandas_udf("string")
        def ask(prompts: pd.Series) -> pd.Series:
            replies = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
            wanted = prompts[prompts.notna()]
            for at in range(0, len(wanted), step):
                part = wanted.iloc[at : at + step]
                try:
                    answers = list(call(part.tolist()))
                    if len(answers) != len(part):
                        raise ValueError("reply count differs from prompt count")
                except Exception:
                    continue
                for where, answer in zip(part.index, answers):
                    replies[where] = answer
            return replies

        return ask.asNondeterministic()(prompt)


class BatchEmbedder:
    """Embedder over ``call(list of texts) -> list of vectors``.

    ``embed`` is for a corpus: errors surface and fail the task. ``try_embed`` is for questions: texts of a failed
    call are sent again one by one, and only those that fail alone get NULL, as does a NULL text, which isn't sent.
    """

    def __init__(self, call: Callable[[list[str]], Sequence[Sequence[float]]], batch: int = 50):
        self.call, self.batch = call, batch

    def embed(self, text: Column) -> Column:
        call, step = self.call, self.batch

        @F.pandas_udf("array<float>")
        def vectors(texts: pd.Series) -> pd.Series:
            out: list[list[float]] = []
            for at in range(0, len(texts), step):
                out.extend(list(v) for v in call(texts.iloc[at : at + step].tolist()))
            return pd.Series(out, dtype=object)

        return vectors.asNondeterministic()(text)

    def try_embed(self, text: Column) -> Column:
        call, step = self.call, self.batch

        def one_call(texts: list[str]) -> list[list[float]] | None:
            try:
                found = [list(v) for v in call(texts)]
            except Exception as failure:  # the client's own error, no error of the engine
                log.warning("embedding of %d texts failed: %s", len(texts), failure)
                return None
            return found if len(found) == len(texts) else None

        @F.pandas_udf("array<float>")
        def vectors(texts: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            sent = texts[texts.notna()]
            for at in range(0, len(sent), step):
                part = sent.iloc[at : at + step]
                found = one_call(part.tolist())
                if found is None:
                    found = [(one_call([t]) or [None])[0] if len(part) > 1 else None for t in part]
                for where, vector in zip(part.index, found):
                    out[where] = vector
            return out

        return vectors.asNondeterministic()(text)


class BatchReranker:
    """Reranker over ``call(queries, texts) -> scores``; a failed call gives NULL scores."""

    def __init__(self, call: Callable[[list[str], list[str]], Sequence[float | None]]):
        self.call = call

    def score(self, query: Column, text: Column) -> Column:
        call = self.call

        @F.pandas_udf("double")
        def scores(queries: pd.Series, texts: pd.Series) -> pd.Series:
            try:
                return pd.Series(list(call(queries.tolist(), texts.tolist())), dtype="float64")
            except Exception:
                return pd.Series([None] * len(queries), dtype="float64")

        return scores.asNondeterministic()(query, text)


class ColumnChat:
    """Chat model given as a Column expression.

    The always-true guard on the partition number makes it nondeterministic to the optimizer, like
    a real model, so that filters on the reply are not copied below it with the whole expression.
    """

    def __init__(self, expression: Callable[[Column], Column]):
        self.expression = expression

    def reply(self, prompt: Column) -> Column:
        return F.when(F.spark_partition_id() >= 0, self.expression(prompt))


class LetterEmbedder:
    """Offline embedder: unit vector of the 26 Latin letter counts."""

    letters = string.ascii_lowercase

    def embed(self, text: Column) -> Column:
        def vector(low: Column) -> Column:
            n = F.length(low)
            found = [(n - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in self.letters]
            return arrays.let(F.array(*found), arrays.unit)

        return arrays.let(F.lower(text), vector)


#: Bytes of text whose letters are counted at a time.
LETTER_STEP = 1 << 20


class LetterRowEmbedder(LetterEmbedder):
    """``LetterEmbedder`` for columns of a table: the same vectors, counted over Arrow batches in one pass over the bytes.

    It can't be named inside a lambda.
    """

    def embed(self, text: Column) -> Column:
        return F.arrow_udf(letter_units, "array<double>")(F.lower(text))


def letter_units(texts: pa.Array) -> pa.Array:
    """Unit vectors of the 26 letter counts of lower-cased texts; without a letter, or for NULL, zeros."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, places, data = texts.buffers()
    ends = np.frombuffer(places, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    read = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    units = np.zeros((len(texts), 26))
    at = 0
    while at < len(texts):
        last = max(at + 1, int(np.searchsorted(ends, ends[at] + LETTER_STEP, side="right")) - 1)
        letters = read[ends[at] : ends[last]] - np.uint8(ord("a"))  # no byte of another character is a letter in UTF-8
        here = letters < 26
        owner = np.repeat(np.arange(last - at) * 26, np.diff(ends[at : last + 1]))
        counts = np.bincount(owner[here] + letters[here], minlength=(last - at) * 26).reshape(-1, 26).astype(np.float64)
        length = np.sqrt((counts * counts).sum(axis=1))
        units[at:last] = counts / np.where(length > 0, length, 1.0)[:, None]
        at = last
    return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * 26, units.ravel())


class OverlapReranker:
    """Offline reranker: share of the query's distinct tokens that the text contains."""

    def score(self, query: Column, text: Column) -> Column:
        asked = F.array_distinct(tx.tokens(query))
        return F.size(F.array_intersect(asked, tx.tokens(text))) / F.greatest(F.size(asked), F.lit(1))
