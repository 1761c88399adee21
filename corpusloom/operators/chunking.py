"""Three nested levels of overlapping chunks.

``split`` is the boundary-aware splitter: cut at the first separator of the list that occurs, keep
the separator at the head of the piece it starts, pack pieces greedily up to ``size``, and begin
the next chunk with the trailing pieces that fit in ``overlap``; a piece that is itself too long is
cut with the remaining separators. It works on offsets, so no text is copied until a chunk is done.

``window_levels`` is the case without any natural separator (fixed windows), where the same
nesting is a closed-form expression and needs no Python at all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom import sizing
from corpusloom.functions import arrays, text as tx

# Separators in order of preference; the empty one cuts between any two characters.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "，", "、", " ", "")


@dataclass(frozen=True)
class Level:
    size: int
    overlap: int


def levels(chunk_size: int = 500, chunk_overlap: int = 50) -> tuple[Level, Level, Level]:
    """Level sizes in characters; the floors apply with the default arguments."""
    # Floors and factors of the three levels.
    return (
        Level(max(1200, chunk_size * 2), max(240, chunk_overlap * 2)),
        Level(max(600, chunk_size), max(120, chunk_overlap)),
        Level(max(300, chunk_size // 2), max(60, chunk_overlap // 2)),
    )


LEVELS = levels()

#: Texts of a batch that are cut into Python objects at a time, in bytes.
OBJECT_BYTES = 1 << 18

CHUNK_SCHEMA = "array<struct<level:int,idx:int,parent:int,root:int,text:string>>"


def _cuts(text: str, start: int, end: int, separator: str) -> list[int]:
    if separator == "":
        return list(range(start, end + 1))
    heads = [m.start() for m in re.compile(re.escape(separator)).finditer(text, start, end)]
    return [start, *[h for h in heads if h > start], end]


def _spans(text: str, start: int, end: int, level: Level, separators: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    at = next((i for i, s in enumerate(separators) if s == "" or text.find(s, start, end) >= 0), len(separators) - 1)
    rest = separators[at + 1 :] if separators[at] and text.find(separators[at], start, end) >= 0 else ()
    cuts = _cuts(text, start, end, separators[at])
    run: list[int] = []
    for left, right in zip(cuts, cuts[1:]):
        if right - left < level.size:
            run = run or [left]
            run.append(right)
            continue
        yield from _packed(run, level)
        run = []
        if rest:
            yield from _spans(text, left, right, level, rest)
        else:
            yield left, right
    yield from _packed(run, level)


def _packed(edges: list[int], level: Level) -> Iterator[tuple[int, int]]:
    """Greedy packing of the pieces between consecutive ``edges``."""
    if len(edges) < 2:
        return
    first = 0
    for i in range(1, len(edges)):
        if edges[i] - edges[first] > level.size and i - 1 > first:
            yield edges[first], edges[i - 1]
            while edges[i - 1] - edges[first] > level.overlap or (
                edges[i] - edges[first] > level.size and first < i - 1
            ):
                first += 1
    yield edges[first], edges[-1]


def split(text: str, level: Level, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of ``text``, stripped, blank ones left out."""
    found = (text[a:b].strip() for a, b in _spans(text, 0, len(text), level, separators))
    return [chunk for chunk in found if chunk]


def nest(text: str, sizes: tuple[Level, ...] = LEVELS, separators: tuple[str, ...] = SEPARATORS) -> list[dict]:
    """Preorder list of a page's chunks; every counter restarts per page."""
    out: list[dict] = []
    middle = leaf = 0
    for root, top in enumerate(split(text.strip(), sizes[0], separators)):
        out.append({"level": 1, "idx": root, "parent": -1, "root": root, "text": top})
        for mid in split(top, sizes[1], separators):
            out.append({"level": 2, "idx": middle, "parent": root, "root": root, "text": mid})
            for low in split(mid, sizes[2], separators):
                out.append({"level": 3, "idx": leaf, "parent": middle, "root": root, "text": low})
                leaf += 1
            middle += 1
    return out


def separator_levels(text: Column, sizes: tuple[Level, ...] = LEVELS, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """Array of a page's chunks in preorder, split at natural separators (Arrow UDF)."""

    @F.arrow_udf(CHUNK_SCHEMA)
    def chunks(pages: pa.Array) -> pa.Array:
        return cut_pages(pages, lambda page: nest(page, sizes, separators))

    return chunks(text)


def cut_pages(pages: pa.Array, cut: Callable[[str], list[dict]]) -> pa.Array:
    """Chunks of each page as an Arrow array; pages of ``OBJECT_BYTES``, or one longer page, are Python objects at a time."""
    kind = pa.list_(pa.struct([*((n, pa.int32()) for n in ("level", "idx", "parent", "root")), ("text", pa.string())]))
    ends = np.cumsum(pc.fill_null(pc.binary_length(pages), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    parts, at = [], 0
    while at < len(pages):
        before = ends[at - 1] if at else 0
        last = max(at + 1, int(np.searchsorted(ends, before + OBJECT_BYTES, side="right")))
        last = min(last, at + OBJECT_BYTES // 256)
        parts.append(pa.array([cut(page) if page else [] for page in pages.slice(at, last - at).to_pylist()], kind))
        at = last
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _windows(text: Column, level: Level) -> Column:
    """Fixed windows over one text: stripped, blank ones left out."""
    stride = level.size - level.overlap

    def cut(t: Column) -> Column:
        extra = F.greatest(F.lit(0), F.ceil((F.length(t) - level.size) / F.lit(float(stride)))).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), extra), lambda i: tx.strip(F.substring(t, i * stride + 1, F.lit(level.size))))
        return F.filter(pieces, lambda piece: piece != "")

    return arrays.let(text, cut)


def window_levels(text: Column, sizes: tuple[Level, ...] = LEVELS) -> Column:
    """Array of a page's chunks in preorder for fixed windows; equals ``nest`` with separators ("",)."""

    def chunk(level: int, idx: Column, parent: Column, root: Column, body: Column) -> Column:
        return F.struct(
            F.lit(level).alias("level"),
            idx.cast("int").alias("idx"),
            parent.cast("int").alias("parent"),
            root.cast("int").alias("root"),
            body.alias("text"),
        )

    def below(parents: Column, level: int) -> Column:
        nested = F.transform(
            parents,
            lambda p: F.transform(
                _windows(p["text"], sizes[level - 1]), lambda t: F.struct(p["idx"].alias("p"), p["root"].alias("r"), t.alias("t"))
            ),
        )
        return F.transform(F.flatten(nested), lambda s, i: chunk(level, i, s["p"], s["r"], s["t"]))

    def preorder(a: Column, b: Column, c: Column) -> Column:
        keyed = F.flatten(
            F.array(
                F.transform(a, lambda s: F.struct(s["root"], F.lit(-1).alias("m"), F.lit(-1).alias("l"), s.alias("c"))),
                F.transform(b, lambda s: F.struct(s["root"], s["idx"].alias("m"), F.lit(-1).alias("l"), s.alias("c"))),
                F.transform(c, lambda s: F.struct(s["root"], s["parent"].alias("m"), s["idx"].alias("l"), s.alias("c"))),
            )
        )
        return F.transform(F.sort_array(keyed), lambda s: s["c"])  # array_sort would compare by an interpreted lambda

    tops = F.transform(
        _windows(tx.strip(text), sizes[0]), lambda t, i: chunk(1, i, F.lit(-1), i, t)
    )
    return arrays.let(
        tops,
        lambda a: arrays.let(below(a, 2), lambda b: arrays.let(below(b, 3), lambda c: preorder(a, b, c))),
    )


def chunk_pages(
    pages: DataFrame, chunks: Column, filename: str = "filename", page: str = "page_number", keep: list[str] | None = None
) -> DataFrame:
    """Chunk rows of a pages table; ``chunks`` is an expression such as ``separator_levels``.

    ``page_chunk_idx`` numbers the chunks of one page in preorder. For files of several pages
    ``number_chunks`` turns it into the file-wide ``chunk_idx``.
    """
    carried = [c for c in (keep or []) if c not in (filename, page)]
    name, number = F.col("filename"), F.col("page_number")
    made = lambda level, idx: tx.chunk_id(name, number, level, idx)
    return (
        pages.select(
            F.col(filename).alias("filename"), F.col(page).cast("long").alias("page_number"), *carried, chunks.alias("_chunks")
        )
        # Below a plain generator Spark infers size(_chunks) > 0 and would cut every text once more for that filter.
        .select("filename", "page_number", *carried, F.posexplode_outer("_chunks").alias("page_chunk_idx", "_c"))
        .filter("_c is not null")
        .select(
            "filename",
            "page_number",
            *carried,
            F.col("page_chunk_idx").cast("long").alias("page_chunk_idx"),
            F.col("_c.text").alias("text"),
            F.col("_c.level").cast("long").alias("chunk_level"),
            made(F.col("_c.level"), F.col("_c.idx")).alias("chunk_id"),
            F.when(F.col("_c.level") == 1, "")
            .otherwise(made(F.col("_c.level") - 1, F.col("_c.parent")))
            .alias("parent_chunk_id"),
            made(F.lit(1), F.col("_c.root")).alias("root_chunk_id"),
        )
    )


def number_chunks(chunks: DataFrame, pages_per_block: int = 1000) -> DataFrame:
    """Add ``chunk_idx``: preorder position of a chunk in its file, across the pages.

    The running total goes over per-page counts, first inside blocks of pages and then over block
    totals, so no window ever spans a whole large file. ``chunks`` is read twice: hand in a stored
    or checkpointed table.
    """
    per_page = chunks.groupBy("filename", "page_number").agg(F.count("*").alias("n"))
    return (
        chunks.join(page_offsets(per_page, pages_per_block), ["filename", "page_number"])
        .withColumn("chunk_idx", F.col("page_chunk_idx") + F.col("_ahead"))
        .drop("_ahead", "page_chunk_idx")
    )


def page_offsets(per_page: DataFrame, pages_per_block: int = 1000) -> DataFrame:
    """(filename, page_number, _ahead): chunks of the pages ahead, from the number ``n`` of each page."""
    per_page = per_page.withColumn("block", F.floor(F.col("page_number") / pages_per_block))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    in_block = per_page.withColumn(
        "ahead_pages", F.coalesce(F.sum("n").over(before("filename", "block").orderBy("page_number")), F.lit(0))
    )
    blocks = (
        per_page.groupBy("filename", "block")
        .agg(F.sum("n").alias("block_n"))
        .withColumn("ahead_blocks", F.coalesce(F.sum("block_n").over(before("filename").orderBy("block")), F.lit(0)))
    )
    return in_block.join(blocks, ["filename", "block"]).select(
        "filename", "page_number", (F.col("ahead_pages") + F.col("ahead_blocks")).alias("_ahead")
    )


def packed_offsets(per_page: DataFrame, pages_per_block: int = 1000) -> DataFrame:
    """``page_offsets`` in a row per file and block: (filename, _block, _pages, _aheads) with one number per page in each array.

    Blocks in which no chunk lies ahead of any page are left out: a file of one page takes no row.
    """
    place = F.struct("page_number", "_ahead")
    ahead = page_offsets(per_page, pages_per_block).filter("page_number is not null")
    block = F.floor(F.col("page_number") / pages_per_block).alias("_block")
    blocks = ahead.groupBy("filename", block).agg(F.sort_array(F.collect_list(place)).alias("_p"), F.max("_ahead").alias("_most")).filter("_most > 0")
    return blocks.select("filename", "_block", F.col("_p.page_number").alias("_pages"), F.col("_p._ahead").alias("_aheads"))


def number_pages(pages: DataFrame, pages_per_block: int = 1000, offsets: DataFrame | None = None) -> DataFrame:
    """Numbered chunk rows of a stored table of pages with the array ``_chunks`` of each: texts are numbered where they lie.

    Only ``packed_offsets`` are looked up, those handed in or those of ``pages``, and a page's chunks are unfolded after that.
    """
    if offsets is None:
        n = F.size("_chunks")
        offsets = packed_offsets(pages.filter(n > 0).groupBy("filename", "page_number").agg(F.sum(n).alias("n")), pages_per_block)
    offsets = F.broadcast(offsets) if sizing.is_small(offsets) else offsets
    keyed = pages.filter("filename is not null and page_number is not null").withColumn("_block", F.floor(F.col("page_number") / pages_per_block))
    ahead = F.get("_aheads", (F.array_position("_pages", F.col("page_number")) - 1).cast("int"))
    placed = keyed.join(offsets, ["filename", "_block"], "left").withColumn("_ahead", F.coalesce(ahead, F.lit(0).cast("long"))).drop("_block", "_pages", "_aheads")
    kept = [c for c in placed.columns if c not in ("filename", "page_number", "_chunks")]
    made = chunk_pages(placed, F.col("_chunks"), keep=kept)
    return made.withColumn("chunk_idx", F.col("page_chunk_idx") + F.col("_ahead")).drop("_ahead", "page_chunk_idx")
