"""Token counts of whole texts by a sentencepiece model.

A long text is encoded in overlapping chunks, all chunks of a batch in one call. Two neighbouring chunks are
spliced inside their overlap at a boundary that both encodings have and that is proven stable: no piece of the
vocabulary holds the two characters beside it one after the other, so no merge can ever cross it and the text on
either side is encoded by itself. Where an overlap has no such boundary, or the pieces of a chunk don't add up to its
bytes, the text is encoded again in wider chunks with wider overlaps, at last as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm import blocks

CHUNK = 8_000
OVERLAP = 64
LIMIT = 4_096
_SPACE = "▁"


class Counter:
    """A loaded model and what its vocabulary proves about boundaries."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_proto=model)
        pieces = [self.processor.id_to_piece(i).replace(_SPACE, " ") for i in range(self.processor.vocab_size())]
        plain = [not (self.processor.is_byte(i) or self.processor.is_control(i) or self.processor.is_unknown(i)) for i in range(len(pieces))]
        #: Bytes of text behind each piece; an unknown piece breaks every sum on purpose.
        self.size = np.array([
            1 if self.processor.is_byte(i) else len(p.encode()) if plain[i] else 0 if self.processor.is_control(i) else 1 << 40
            for i, p in enumerate(pieces)
        ])
        self.inside = {pair for p, ok in zip(pieces, plain) if ok for pair in zip(p, p[1:])}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(ids, dtype=np.int64) for ids in self.processor.encode(texts, num_threads=1)]

    def stable(self, left: str, right: str) -> bool:
        return (left, right) not in self.inside

    def splice(self, overlap: str, before: np.ndarray, after: np.ndarray) -> int | None:
        """Bytes into the overlap of the first proven boundary common to both chunks, None if there is none."""
        at, offset = {}, 0
        for left, right in zip(overlap, overlap[1:]):
            offset += len(left.encode())
            at[offset] = (left, right)
        for cut in np.intersect1d(before, after):
            if int(cut) in at and self.stable(*at[int(cut)]):
                return int(cut)
        return None

    def spliced(self, steps: list[str], overlaps: list[str], ids: list[np.ndarray]) -> int | None:
        """Tokens of a text cut into steps, each encoded together with the overlap that follows it."""
        ends = []
        for step, overlap, found in zip(steps, overlaps, ids):
            end = np.cumsum(self.size[found]) - 1  # the encoder puts one space before each chunk
            if end[-1] != len((step + overlap).encode()):
                return None
            ends.append(end)
        total, done = 0, -1
        for i, end in enumerate(ends):
            if i == len(ends) - 1:
                return total + int(np.count_nonzero(end > done))
            length = len(steps[i].encode())
            cut = self.splice(overlaps[i], end - length, ends[i + 1])
            if cut is None:
                return None
            total += int(np.count_nonzero((end > done) & (end <= length + cut)))
            done = cut
        return total

    def counts(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        """Tokens of each text."""
        parts, cuts = [], []
        for text in texts:
            at = range(0, max(1, len(text) - overlap), chunk) if len(text) > chunk + overlap else range(1)
            steps = [text[i : i + chunk] for i in at][:-1] + [text[at[-1] :]]
            overlaps = [text[i + chunk : i + chunk + overlap] for i in at][:-1] + [""]
            cuts.append((steps, overlaps))
            parts.extend(s + o for s, o in zip(steps, overlaps))
        encoded, out, at = self.encode(parts), [], 0
        for text, (steps, overlaps) in zip(texts, cuts):
            ids = encoded[at : at + len(steps)]
            at += len(steps)
            count = len(ids[0]) if len(steps) == 1 else self.spliced(steps, overlaps, ids)
            out.append(self.counts([text], 4 * chunk, 8 * overlap)[0] if count is None else count)
        return out


def _counted(model: Broadcast):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(model.value)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            tokens: list[int] = []
            for first, end, _, _ in blocks.blocks(texts):
                tokens.extend(counter.counts(texts.slice(first, end - first).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens, type=pa.int64())], names=["id", "n_bytes", "n_tokens"]
            )

    return rows


def counted(documents: DataFrame, model_path: str, id_: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per document row: id, n_bytes, n_tokens, over_limit, as the library's ``encode`` gives them for the whole text.

    Null counts as the empty text: no bytes, no tokens. Equal rows get equal counts, one row each; an empty table gives none.
    The model file, a few hundred KB to a few MB, is read on the driver and broadcast.
    """
    with open(model_path, "rb") as file:
        model = documents.sparkSession.sparkContext.broadcast(file.read())
    rows = documents.select(F.col(id_).alias("id"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(_counted(model), f"id {dict(rows.dtypes)['id']}, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
