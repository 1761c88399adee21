"""Main text of web pages by a recurrent block labeller.

Pages are cut into blocks, a bidirectional LSTM labels every block with the whole page in view, and the blocks labelled
as main text make the result. It is trained here, on two kinds of labelled pages: a bounded sample of the given pages,
labelled by the names of the tags around each block where these say something, and pages put together from the texts of
that sample with menus, notices, sidebars, forms, adverts and reader comments in many markups, whose labels are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm import html_lstm
from corpusloom.llm.html_blocks import Block, Paths, blocks_of

#: Bounds of the training sample: pages read, blocks of one page that train, pages made.
SAMPLE_PAGES = 150
SAMPLE_BLOCKS = 80
MADE_PAGES = 450
BATCH_PAGES = 512

ASIDE_TAGS = frozenset("nav footer aside form button select menu dialog".split())
ASIDE_NAMES = frozenset(
    "nav navigation navbar menu header masthead footer sidebar aside widget notice cookie consent banner ad ads advert advertisement sponsor promo form comment comments "
    "reply respond share social related recommended subscribe newsletter breadcrumb breadcrumbs pagination pager login search popup modal toolbar copyright legal".split()
)
MAIN_TAGS = frozenset("article main".split())
MAIN_NAMES = frozenset("article content main post entry story body text page".split())


def named_label(labels: tuple[str, ...]) -> int | None:
    """1 main text, 0 not, None if the names on the path say nothing."""
    names = {x.removeprefix(".") for x in labels if x.startswith(".")}
    tags = [x for x in labels if not x.startswith(".")]
    if ASIDE_TAGS & set(tags) or ASIDE_NAMES & names or ("header" in tags and not MAIN_TAGS & set(tags)):
        return 0
    return 1 if MAIN_TAGS & set(tags) or MAIN_NAMES & names else None


class _Maker:
    """Pages of known labels. Every piece is wrapped in one of many markups; its label stands in a mark that goes before parsing."""

    def __init__(self, texts: list[str], seed: int = 9):
        self.draw, self.texts = np.random.default_rng(seed), texts

    def pick(self, *options: str) -> str:
        return options[int(self.draw.integers(len(options)))]

    def words(self, low: int, high: int) -> str:
        words = self.texts[int(self.draw.integers(len(self.texts)))].split()
        n = int(self.draw.integers(low, high + 1))
        at = int(self.draw.integers(max(1, len(words) - n)))
        return " ".join(words[at : at + n]).replace("&", "&amp;").replace("<", "&lt;") or "More"

    def sentence(self, low: int = 8, high: int = 60) -> str:
        return self.words(low, high).rstrip(".,") + self.pick(".", ".", ".", "!", "?")

    def times(self, low: int, high: int, make) -> str:
        return "".join(make() for _ in range(int(self.draw.integers(low, high + 1))))

    def box(self, inner: str, *names: str, tags: tuple[str, ...] = ("div", "section")) -> str:
        tag, kind = self.pick(*tags), self.pick("class", "id")
        name = self.pick(*names) if names else ""
        return f'<{tag} {kind}="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    def links(self) -> str:
        return "<ul>" + self.times(2, 9, lambda: f'<li><a href="/x">{self.words(1, 4)}</a></li>') + "</ul>"

    def main(self) -> str:
        def part() -> str:
            kind = int(self.draw.integers(10))
            if kind < 6:
                return f"<p>{self.sentence()}</p>"
            if kind == 6:
                return f"<h2>{self.words(2, 8)}</h2><p>{self.sentence()}"
            if kind == 7:
                return "<ul>" + self.times(2, 5, lambda: f"<li>{self.sentence(3, 15)}</li>") + "</ul>"
            if kind == 8:
                return f"<blockquote><p>{self.sentence()}</p></blockquote>"
            return f"<p><b>{self.sentence(3, 20)}<br><p>{self.words(1, 12)}."

        inner = f"<h1>{self.words(3, 12)}</h1>" + self.times(1, 12, part)
        if self.draw.random() < 0.3:
            inner = "<div>" + inner + "</div>"
        if self.draw.random() < 0.55:
            return self.box(inner, "", "post", "content", tags=("article", "main"))
        return self.box(inner, "content", "post-content", "entry", "article-body", "story", "main-text", "c1", "")

    def before(self) -> str:
        options = (
            lambda: f"<nav>{self.links()}</nav>",
            lambda: self.box(self.links(), "menu", "navbar", "top-nav", "m2"),
            lambda: f"<header><div>{self.words(1, 4)}</div>{self.links() if self.draw.random() < 0.5 else ''}</header>",
            lambda: self.box(f"<p>{self.sentence(6, 25)} <a href='#'>{self.words(1, 2)}</a></p>", "cookie-notice", "notice", "consent", "banner"),
            lambda: self.box(self.words(4, 14) + ".", "ad", "ads", "advert", "sponsor"),
            lambda: self.box(f"<a href='/'>{self.words(1, 2)}</a> &gt; <a href='/a'>{self.words(1, 2)}</a>", "breadcrumb"),
        )
        return self.times(1, 3, lambda: options[int(self.draw.integers(len(options)))]())

    def comment(self) -> str:
        inner = f"<h4>{self.words(1, 2)}</h4><p>{self.sentence(4, 30)}</p>"
        return self.box(inner, "comment", "comment-body", "reply", tags=("div", "li", "article"))

    def after(self) -> str:
        options = (
            lambda: f"<footer>&copy; {self.words(1, 3)} &middot; {self.sentence(3, 12)}</footer>",
            lambda: self.box(f"<p>&copy; {self.words(1, 4)}</p>{self.links()}", "footer", "bottom"),
            lambda: self.box(f"<h3>{self.words(1, 3)}</h3>{self.links()}", "sidebar", "related", "widget", tags=("div", "aside", "section")),
            lambda: f"<form><label>{self.words(1, 3)}</label><input><button>{self.words(1, 2)}</button></form>",
            lambda: self.box(f"<p>{self.sentence(5, 15)}</p><form><input><button>{self.words(1, 2)}</button></form>", "newsletter", "subscribe"),
            lambda: self.box(self.times(1, 5, self.comment), "comments", "responses", "discussion"),
            lambda: self.box(self.words(4, 14) + ".", "ad", "promo", "advert"),
            lambda: self.box(self.links(), "share", "social"),
        )
        return self.times(1, 3, lambda: options[int(self.draw.integers(len(options)))]())

    def page(self, paths: Paths) -> tuple[list[Block], list[int]]:
        main = self.main()
        inside = ""  # what isn't main text can stand within it
        if self.draw.random() < 0.25:
            inside = self.box(self.words(4, 14) + ".", "ad", "share", "related", "comments", tags=("div", "aside"))
        head = f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>"
        pieces = [(head + self.before(), 0), (main, 1), (inside, 0), (self.after() + "</body></html>", 0)]
        if inside and self.draw.random() < 0.5:
            cut = main.find("</p>")
            if cut >= 0:
                pieces[1:3] = [(main[: cut + 4], 1), (inside, 0), (main[cut + 4 :], 1)]
        # Invisible marks at the front of each text tell the pieces apart after parsing the whole page.
        marked = "".join(_mark(piece, label) for piece, label in pieces)
        found, wanted = [], []
        for block in blocks_of(marked, paths):
            label = 1 if _MARKS[1] in block.text else 0
            text = block.text.replace(_MARKS[0], "").replace(_MARKS[1], "").strip()
            if text:
                found.append(block._replace(text=text, linked=min(block.linked, len(text))))
                wanted.append(label)
        return found, wanted


_MARKS = ("", "")


def _mark(piece: str, label: int) -> str:
    out = []
    for part in piece.split(">"):
        tag_at = part.rfind("<")
        text = part if tag_at < 0 else part[:tag_at]
        out.append((_MARKS[label] if text.strip() else "") + part)
    return ">".join(out)


def _sampled(blocks: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = Paths()
            found = [blocks_of(page, paths)[:blocks] for page in pc.fill_null(batch.column(0), "").to_pylist()]
            kind = pa.list_(pa.struct([("path", pa.list_(pa.string())), ("text", pa.string()), ("linked", pa.int64())]))
            listed = [[{"path": list(paths.labels[b.path]), "text": b.text[:600], "linked": b.linked} for b in page] for page in found]
            yield pa.RecordBatch.from_arrays([pa.array(listed, type=kind)], names=["blocks"])

    return rows


def train(pages: DataFrame, url: str = "url", html: str = "html", sample: int = SAMPLE_PAGES, made: int = MADE_PAGES) -> html_lstm.Labeller:
    """A labeller from about ``sample`` pages, chosen by the hash of their address and text, and ``made`` pages made of their texts.

    Only training looks at the beginnings of pages; labelling reads whole pages.
    """
    share = min(1.0, sample / max(1, pages.count()))
    key = F.pmod(F.xxhash64(F.lit("pages"), F.col(url), F.length(html)), F.lit(1 << 30))
    chosen = pages.filter(key < int(share * (1 << 30))).select(F.col(html).cast("string"))
    read = chosen.mapInArrow(_sampled(SAMPLE_BLOCKS), "blocks array<struct<path:array<string>,text:string,linked:long>>").collect()
    paths, found, wanted = Paths(), [], []
    numbers: dict[tuple[str, ...], int] = {}
    for row in sorted(read, key=lambda r: [(list(b.path), b.text) for b in r.blocks[:4]]):
        labels = [named_label(tuple(b.path)) for b in row.blocks]
        if row.blocks and None not in labels:
            for b in row.blocks:
                if tuple(b.path) not in numbers:
                    numbers[tuple(b.path)] = len(paths.labels)
                    paths.labels.append(tuple(b.path))
            found.append([Block(numbers[tuple(b.path)], b.text, min(b.linked, len(b.text))) for b in row.blocks])
            wanted.append([int(x) for x in labels])
    texts = [b.text for page in found for b in page if len(b.text) > 60] or ["Some words of a text that stands for others in a made page, short as it is."]
    maker = _Maker(texts)
    for _ in range(made):
        blocks, labels = maker.page(paths)
        found.append(blocks)
        wanted.append(labels)
    return html_lstm.fit(found, wanted, paths)


def _extracted(model: Broadcast):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_PAGES):
                part = batch.slice(at, BATCH_PAGES)
                paths = Paths()
                pages = [blocks_of(page, paths) for page in pc.fill_null(part.column(2), "").to_pylist()]
                chosen = html_lstm.label(model.value, pages, paths)
                texts = ["\n".join(b.text for b, p in zip(page, label) if p >= 0.5) for page, label in zip(pages, chosen)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, type=pa.string())], names=["id", "url", "text"])

    return rows


def extracted(pages: DataFrame, model: html_lstm.Labeller, id_: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page row: id, url, text, n_chars.

    Null and empty pages and pages without main text have the empty text; equal rows get equal texts, one row each; an
    empty table gives none.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col(id_).alias("id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    kinds = dict(rows.dtypes)
    found = rows.mapInArrow(_extracted(shared), f"id {kinds['id']}, url {kinds['url']}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
