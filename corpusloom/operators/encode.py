"""Token ids, masks and labels for supervised fine-tuning."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# The masked label, the length limit, and the system message of every sample.
IGNORED = -100
MAX_LENGTH = 2048
SYSTEM = "You are a helpful integrated circuit assistant. 你是一个有用的集成电路助手。"

Encoder = Callable[[Column], Column]


def batch_encoder(encode: Callable[[str], list[int]]) -> Encoder:
    """Lift a tokenizer's ``encode(text) -> ids`` into a Column function (Arrow UDF)."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(encode(t)))

    return ids


def word_encoder(text: Column) -> Column:
    """Offline encoder: 24 bits of the md5 of every whitespace-separated word."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 6), 16, 10).cast("int"))


def chat_prompt(question: Column, system: str = SYSTEM) -> Column:
    """ChatML prompt up to and including the assistant header."""
    return F.concat(
        F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"),
        question,
        F.lit("<|im_end|>\n<|im_start|>assistant\n"),
    )


def encode_rows(
    df: DataFrame, encoder: Encoder, eos: int, max_length: int | None = None, prompt: Callable[[Column], Column] = chat_prompt
) -> DataFrame:
    """Add input_ids, attention_mask and labels; prompt positions are masked; with ``max_length`` long rows are cut.

    Rows whose question, cot or answer is NULL get empty arrays, as a failed sample does.
    """
    response = F.concat(F.lit("<think>"), F.col("cot"), F.lit("</think>\n"), F.col("answer"))
    ids = df.withColumn("_asked", encoder(prompt(F.col("question")))).withColumn(
        "_said", F.concat(encoder(response), F.array(F.lit(eos)))
    )
    cut = lambda a: F.coalesce(a if max_length is None else F.slice(a, 1, max_length), F.array().cast("array<int>"))
    both = F.concat("_asked", "_said")
    return ids.withColumns(
        {
            "input_ids": cut(both),
            "attention_mask": cut(F.transform(both, lambda _: F.lit(1))),
            "labels": cut(F.concat(F.transform("_asked", lambda _: F.lit(IGNORED)), F.col("_said"))),
        }
    ).drop("_asked", "_said")
