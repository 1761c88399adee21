"""A Bloom sketch of keys as a table of fixed size, so that rows with surely new keys need no shuffle.

The sketch is an array of 64-bit words. A key sets two bits of one word, so a look-up is one join with a broadcast of at most
``WORDS`` rows, however many keys there are. Words are built by a bitwise-or aggregate, which combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import sizing
from corpusloom.session import shared_dir

#: Words of 64 bits: 67 million bits, 16 MB of rows. Ten million keys leave about one new row in 20 to the join.
WORDS = 1 << 20


def place(key: Column, words: int = WORDS) -> tuple[Column, Column]:
    """Word and bit mask of a key."""
    h = F.xxhash64(F.lit("sketch"), key)
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(63).cast("int"))
    return F.pmod(h, F.lit(words).cast("long")), bit(40).bitwiseOR(bit(48))


def sketch(keys: DataFrame, key: str, words: int = WORDS) -> DataFrame:
    """(_word, _bits) of all keys, at most ``words`` rows; null keys are left out."""
    word, mask = place(F.col(key), words)
    return keys.filter(F.col(key).isNotNull()).select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))


def perhaps_in(rows: DataFrame, seen: DataFrame, key: str, words: int = WORDS) -> DataFrame:
    """Rows whose ``key`` may be one of ``seen``: all that are and a few others, without a shuffle of the rows."""
    shared_dir(rows.sparkSession)
    word, mask = place(F.col(key), words)
    marked = rows.withColumns({"_word": word, "_mask": mask}).join(F.broadcast(sketch(seen, key, words).checkpoint()), "_word")
    return marked.filter(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask")).drop("_word", "_mask", "_bits")


def anti_join(rows: DataFrame, seen: DataFrame, key: str, row_key: list[str], words: int = WORDS, salts: int = sizing.SALTS) -> DataFrame:
    """Rows whose ``key`` is none of ``seen``; only rows that the sketch can't clear are shuffled, over ``salts`` for hot keys.

    ``seen`` has the one column ``key``, each value once. A row with a null key stays, repeated rows stay as often as they come.
    """
    shared_dir(rows.sparkSession)
    known = F.broadcast(sketch(seen, key, words).checkpoint())
    word, mask = place(F.col(key), words)
    marked = rows.withColumns({"_word": word, "_mask": mask}).join(known, "_word", "left")
    perhaps = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False)) & F.col(key).isNotNull()
    new = marked.filter(~perhaps).drop("_word", "_mask", "_bits")
    rest = sizing.salted_join(marked.filter(perhaps).drop("_word", "_mask", "_bits"), seen, [key], "left_anti", row_key, salts)
    return new.unionByName(rest)
