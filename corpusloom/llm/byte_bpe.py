"""Byte-level BPE by DuckDB's recursive queries, one in-process engine per task.

A text is split into pieces by the vocabulary's pattern. The pieces of a block that were not seen before become rows
(word, position, token), at first one per byte; a recursive query joins neighbours with the merge table and contracts the
leftmost pair of least rank of every word until no word has a pair left. Decoding joins the ids of a text with the bytes of
their tokens and aggregates these in order.

One pair a step takes as many steps as a word has merges. A step for words of over 32 bytes also contracts what is proven to
come out the same:

* A pair is contracted ahead of its turn if every token of the vocabulary that stands in the word across its left or right
  edge has a higher rank: until its turn nothing can take a part of it, and nothing that it makes possible comes before it.
* Occurrences of the least pair that don't overlap are contracted together, from the left, where no two tokens that make up
  a token of lower rank contain the merged one: no new pair can come before the next occurrence.

The engine lives in memory within the Python worker: it opens no port, writes no file, and is given the new pieces of some
blocks of about one megabyte of text at a time, a megabyte of pieces at most. Pieces are numbered as they come; a block waits as
the numbers of its pieces.
"""

from __future__ import annotations

import base64
import itertools
import re
import unicodedata
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm import blocks

#: Pieces that a task remembers with their tokens; beyond it the memory starts anew.
KEPT_PIECES = 300_000
#: Bytes of new pieces for which blocks wait to be encoded together, and of text that waits for so many.
NEW_BYTES = 1 << 19
WAITING_BYTES = 8 << 20
#: Bytes of pieces that one encoding query gets, unless a single piece is longer.
WORD_BYTES = 1 << 20
#: Ids that one decoding query gets, unless a single text has more.
DECODED_IDS = 250_000
_NONE = 2**31 - 1

#: Bytes up to which a word's pairs are contracted one a step.
SHORT = 32
#: Each row also names the token that follows, -1 at the end of a word, so that no step has to sort. The row behind the
#: contracted place takes it over, the row before it gets a new follower.
_ENCODE_SHORT = """
WITH RECURSIVE state(word, pos, tok, following, step) AS (
  SELECT word, pos, tok, following, 0::UTINYINT FROM seed
  UNION ALL
  SELECT s.word, s.pos - (s.pos > b.at)::UTINYINT, CASE WHEN s.pos = b.past THEN b.id ELSE s.tok END, CASE WHEN s.pos = b.past - 2 THEN b.id ELSE s.following END, s.step + 1::UTINYINT
  FROM state s JOIN (
    SELECT word, (best >> 8)::INT AS id, (best & 255)::INT AS at, (best & 255)::INT + 1 AS past
    FROM (SELECT word, min(m.id << 8 | pos) AS best FROM state p JOIN merges m ON p.tok = m.head AND p.following = m.tail GROUP BY word)) b ON s.word = b.word
  WHERE s.pos <> b.at),
ends AS (SELECT word, max(step) AS step FROM state GROUP BY word)
SELECT s.word, s.pos, s.tok FROM state s JOIN ends e ON s.word = e.word AND s.step = e.step
"""
_ENCODE_LONG = """
WITH RECURSIVE state(word, pos, tok, bound, step) AS (
  SELECT word, pos, tok, bound, 0 FROM seed
  UNION ALL
  SELECT word, pos, CASE WHEN taken THEN id ELSE tok END, bound, step + 1
  FROM (
    SELECT *, coalesce(lag(taken) OVER (PARTITION BY word ORDER BY pos), false) AS swallowed
    FROM (
      SELECT *, coalesce(id < bound AND id < beyond, false)
                OR id = best AND CASE WHEN together THEN (n - run) % 2 = 0 ELSE pos = leftmost END AS taken
      FROM (
        SELECT *, min(pos) FILTER (id = best) OVER (PARTITION BY word) AS leftmost,
               max(n + 1) FILTER (id IS DISTINCT FROM best) OVER (PARTITION BY word ORDER BY pos) AS run_after
        FROM (
          SELECT p.*, m.id, m.together, min(m.id) OVER (PARTITION BY word) AS best
          FROM (
            SELECT word, pos, tok, bound, step, lead(tok) OVER w AS following, coalesce(lead(bound, 2) OVER w, 2147483647) AS beyond, row_number() OVER w AS n
            FROM state WINDOW w AS (PARTITION BY word ORDER BY pos)) p
          LEFT JOIN merges m ON p.tok = m.head AND p.following = m.tail)
        WHERE best IS NOT NULL), LATERAL (SELECT coalesce(run_after, 1) AS run)))
  WHERE NOT swallowed),
ends AS (SELECT word, max(step) AS step FROM state GROUP BY word)
SELECT s.word, s.pos, s.tok FROM state s JOIN ends e ON s.word = e.word AND s.step = e.step
"""
_DECODE = "SELECT doc, unhex(array_to_string(list(hex ORDER BY pos), '')) AS bytes FROM flat JOIN vocabulary USING (id) GROUP BY doc"


class Vocabulary(NamedTuple):
    """Ranks of byte strings, their merges, the pattern of pieces, and what of it only texts with odd characters need."""

    ranks: dict[bytes, int]
    merges: pa.Table
    pattern: str
    exact: str
    odd: str  # a class of the characters on which the two patterns differ, empty if there are none
    least_odd: int


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a file of base64 lines."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def _ranges(points: list[int]) -> str:
    runs = (list(g) for _, g in itertools.groupby(enumerate(points), lambda x: x[1] - x[0]))
    return "".join(f"\\U{r[0][1]:08X}-\\U{r[-1][1]:08X}" for r in runs)


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Reads the ranks; finds the characters on which the pattern engine and the library hold different Unicode versions.

    The two can differ only on characters that Python's own, older tables don't know; the library is asked for each of them.
    """
    import regex
    import tiktoken

    unknown = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")
    one_byte = {bytes([i]): i for i in range(256)}
    exact, odd, least = pattern, "", 0x10FFFF
    for name in (r"\p{L}", r"\p{N}"):
        mine = set(regex.findall(name, unknown))
        library = tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=one_byte, special_tokens={})
        newer = sorted(map(ord, mine - set(bytes(library.encode_ordinary(unknown)).decode())))
        if newer:
            exact = exact.replace(name, f"[{name}--[{_ranges(newer)}]]")
            odd += _ranges(newer)
            least = min(least, newer[0])
    ranks = read_ranks(path)
    return Vocabulary(ranks, merge_table(ranks), pattern, exact, f"[{odd}]" if odd else "", least)


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(head, tail, id, together): every way to put a token together from two, and whether its occurrences can be contracted at once."""
    rows: list[tuple[int, int, int]] = []
    together = np.ones(max(ranks.values(), default=0) + 1, dtype=bool)
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            head, tail = ranks.get(token[:cut]), ranks.get(token[cut:])
            if head is not None and tail is not None:
                rows.append((head, tail, rank))
                for part in (head, tail):
                    if part > rank:
                        together[part] = False  # an earlier token begins or ends with this one
    head, tail, ids = (np.array([r[k] for r in rows], dtype=np.int32) for k in range(3))
    return pa.table({"head": head, "tail": tail, "id": ids, "together": together[ids]})


class _Numbers(dict):
    """Numbers pieces as they come and lists those that are new."""

    def __init__(self, pieces: Iterable[str]):
        super().__init__(zip(pieces, itertools.count()))
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.fresh.append(piece)
        return number


class Codec:
    """An engine in memory with the merge table and the bytes of all tokens."""

    def __init__(self, known: Vocabulary):
        import duckdb
        import regex

        self.known = known
        self.pieces_of = regex.compile(known.pattern, regex.V1).findall
        self.exact_pieces_of = regex.compile(known.exact, regex.V1).findall
        self.odd = re.compile(known.odd).search if known.odd else lambda text: None
        #: A text all of whose bytes are lower holds no odd character.
        self.odd_byte = chr(known.least_odd).encode()[0] if known.odd else 256
        self.byte = np.full(256, -1, dtype=np.int32)
        for token, rank in known.ranks.items():
            if len(token) == 1:
                self.byte[token[0]] = rank
        self.engine = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        tokens = known.ranks
        vocabulary_rows = pa.table({"id": pa.array(tokens.values(), type=pa.int32()), "hex": [t.hex() for t in tokens]})
        for name, rows in (("merges", known.merges), ("vocabulary", vocabulary_rows)):
            self.engine.register("given", rows)
            self.engine.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.engine.unregister("given")
        self.longest = max(map(len, known.ranks), default=0)
        #: Pieces that are tokens of their own; no piece holds a part of a character.
        self.whole = {piece: rank for token, rank in known.ranks.items() if "\ufffd" not in (piece := token.decode("utf-8", "replace")) or piece.encode() == token}
        self.forget()

    def forget(self) -> None:
        """Keep only the pieces that are tokens: their numbers, and by number where their tokens lie and how many they are."""
        self.kept = _Numbers(self.whole)
        self.tokens = np.fromiter(self.whole.values(), dtype=np.int32, count=len(self.whole))
        self.first, self.sizes = np.arange(len(self.whole)), np.ones(len(self.whole), dtype=np.int64)

    def ask(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, rows in tables.items():
            self.engine.register(name, rows)
        found = self.engine.sql(sql).to_arrow_table()
        for name in tables:
            self.engine.unregister(name)
        return found

    def pieces(self, text: str, plain: bool = False) -> list[str]:
        """Pieces of a text, ``plain`` if it is known to hold none of the odd characters."""
        return self.pieces_of(text) if plain or not self.odd(text) else self.exact_pieces_of(text)

    def least_across(self, word: bytes) -> list[int]:
        """For each byte of a word the least rank of a token that stands in it across the byte's left edge."""
        ranks, n, longest = self.known.ranks, len(word), self.longest
        least = [_NONE] * n
        for first in range(n):
            for end in range(first + 2, min(n, first + longest) + 1):
                rank = ranks.get(word[first:end])
                if rank is not None:
                    for edge in range(first + 1, end):
                        if rank < least[edge]:
                            least[edge] = rank
        return least

    def merged(self, words: list[bytes], long: bool) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words that are no tokens themselves, in a row, and how many each has."""
        lengths = np.array([len(w) for w in words])
        tok = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = (np.arange(len(tok)) - np.repeat(ends - lengths, lengths)).astype(np.int32)
        if long:
            bound = itertools.chain.from_iterable(map(self.least_across, words))
            found = self.ask(_ENCODE_LONG, seed=pa.table({"word": word, "pos": pos, "tok": tok, "bound": pa.array(bound, type=pa.int32())}))
        else:
            following = np.append(tok[1:], np.int32(-1))
            following[ends - 1] = -1
            found = self.ask(_ENCODE_SHORT, seed=pa.table({"word": word, "pos": pos.astype(np.uint8), "tok": tok, "following": following}))
        word, pos, tok = (found.column(name).to_numpy().astype(np.int64) for name in ("word", "pos", "tok"))
        return tok[np.argsort(word << 32 | pos)].astype(np.int32), np.bincount(word, minlength=len(words))

    def learn(self) -> None:
        """Find the tokens of the pieces that are new."""
        new, self.kept.fresh = self.kept.fresh, []
        raw = [p.encode() for p in new]
        tokens, first, sizes, held = [self.tokens], np.zeros(len(new), dtype=np.int64), np.zeros(len(new), dtype=np.int64), len(self.tokens)
        for long in (False, True):
            words = np.array([i for i, word in enumerate(raw) if (len(word) > SHORT) is long], dtype=np.int64)
            ends = np.cumsum([len(raw[i]) for i in words])
            at = 0
            while at < len(words):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORD_BYTES, side="right")))
                some = words[at:end]
                found, count = self.merged([raw[i] for i in some], long)
                first[some], sizes[some] = held + np.cumsum(count) - count, count
                tokens.append(found)
                held, at = held + len(found), end
        self.tokens = np.concatenate(tokens)
        self.first, self.sizes = np.concatenate([self.first, first]), np.concatenate([self.sizes, sizes])

    def cut(self, texts: list[str], plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts in a row, and n + 1 places where those of each begin."""
        bounds, numbers = [0], []
        for text in texts:
            numbers += map(self.kept.__getitem__, self.pieces(text, plain))
            bounds.append(len(numbers))
        return np.array(numbers, dtype=np.int32), np.array(bounds)

    def ids(self, numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of numbered pieces that were learnt, and where those of each text begin."""
        sizes = self.sizes[numbers]
        return _gathered(self.tokens, self.first[numbers], sizes), np.concatenate([[0], np.cumsum(sizes)])[bounds]

    def encode(self, texts: list[str], plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts in a row, and n + 1 places where those of each begin."""
        if len(self.kept) > KEPT_PIECES:
            self.forget()
        cut = self.cut(texts, plain)
        self.learn()
        return self.ids(*cut)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Bytes of each row of ids."""
        sizes = np.diff(bounds)
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        pos = (np.arange(len(ids)) - np.repeat(bounds[:-1], sizes)).astype(np.int32)
        found = self.ask(_DECODE, flat=pa.table({"doc": doc, "pos": pos, "id": ids}))
        out = [b""] * len(sizes)
        for i, raw in zip(found.column("doc").to_pylist(), found.column("bytes").to_pylist()):
            out[i] = raw
        return out


def _gathered(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of an array in a row."""
    ends = np.cumsum(sizes)
    return values[np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


_CODECS: list[tuple[Broadcast, Codec]] = []


def _codec(known: Broadcast) -> Codec:
    """The codec of a worker, which serves one task after the other."""
    if not _CODECS or _CODECS[0][0] is not known:
        _CODECS[:] = [(known, Codec(known.value))]
    return _CODECS[0][1]


def _encoded(known: Broadcast, back: bool = False):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(known)
        for batch in batches:
            for names, ids, bounds in _tokens(codec, batch):
                columns = [names, blocks.list_array(ids, bounds, pa.int32())]
                if not back:
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "ids"])
                    continue
                for row, end, raw in _bytes(codec, ids, bounds):
                    yield pa.RecordBatch.from_arrays([*(c.slice(row, end - row) for c in columns), raw], names=["id", "ids", "bytes"])

    return rows


def _tokens(codec: Codec, batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Names of the rows of a block, their ids and where those of each begin."""
    texts, waiting, size = pc.fill_null(batch.column(1), ""), [], 0
    for first, end, data, _ in blocks.blocks(texts):
        if not waiting and len(codec.kept) > KEPT_PIECES:
            codec.forget()
        cut = codec.cut(texts.slice(first, end - first).to_pylist(), plain=int(data.max(initial=0)) < codec.odd_byte)
        waiting.append((batch.column(0).slice(first, end - first), *cut))
        size += len(data)
        if end == len(texts) or size >= WAITING_BYTES or sum(map(len, codec.kept.fresh)) >= NEW_BYTES:
            codec.learn()
            for names, numbers, bounds in waiting:
                yield names, *codec.ids(numbers, bounds)
            waiting, size = [], 0


def _bytes(codec: Codec, ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, pa.Array]]:
    """First row, end row and the bytes of some rows of ids at a time."""
    row = 0
    while row < len(bounds) - 1:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + DECODED_IDS, side="right")) - 1)
        raw = codec.decode(ids[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row])
        yield row, end, pa.array(raw, type=pa.binary())
        row = end


def _decoded(known: Broadcast):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(known)
        for batch in batches:
            lists = pc.fill_null(batch.column(1), [])
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            for row, end, raw in _bytes(codec, pc.list_flatten(lists).to_numpy(zero_copy_only=False), bounds):
                yield pa.RecordBatch.from_arrays([*(c.slice(row, end - row) for c in batch.columns), raw], names=["id", "ids", "bytes"])

    return rows


def encoded(documents: DataFrame, known: Vocabulary, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: id, ids (array of token numbers), as the library's ``encode_ordinary`` gives them for the whole text.

    Null counts as the empty text and gives no ids. Texts of any length are encoded whole, those over a megabyte in a block
    of their own; special tokens' strings are ordinary text. Equal rows get equal ids, one row each; other columns are not
    read; an empty table gives none. Pairs of equal rank go from the left. The vocabulary, a few megabytes, is broadcast.
    """
    rows = documents.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(known)
    return rows.mapInArrow(_encoded(shared), f"id {dict(rows.dtypes)['id']}, ids array<int>")


def round_trip(documents: DataFrame, known: Vocabulary, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: id, ids, bytes: ``decoded`` of ``encoded`` within one task, so ids don't travel and one engine serves both."""
    rows = documents.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(known)
    return rows.mapInArrow(_encoded(shared, back=True), f"id {dict(rows.dtypes)['id']}, ids array<int>, bytes binary")


def decoded(tokens: DataFrame, known: Vocabulary, id_: str = "id", ids: str = "ids") -> DataFrame:
    """Per row: id, ids, bytes (the tokens' bytes in order; no UTF-8 if ids were cut within a character).

    Null and empty lists give no bytes; an id that the vocabulary lacks gives none for itself. Lists of any length are decoded
    whole; equal rows give equal bytes, one row each; an empty table gives none.
    """
    rows = tokens.select(F.col(id_).alias("id"), F.col(ids).cast("array<int>").alias("ids"))
    shared = tokens.sparkSession.sparkContext.broadcast(known)
    return rows.mapInArrow(_decoded(shared), f"id {dict(rows.dtypes)['id']}, ids array<int>, bytes binary")
