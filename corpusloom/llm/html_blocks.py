"""Blocks of a web page: runs of text between block-level tags, each with the path of tags it stands in."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

# Elements that begin a block, have no content, or hold no text to read.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul button".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style title textarea xmp".split())
HIDDEN_TAGS = frozenset("svg noscript template iframe noframes".split())
#: What an opening tag ends if it is still open right above.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_ENDS_P = BLOCK_TAGS - {"option", "body", "html", "button"}

#: A quote opens a value only behind =, and the value may have any length. This is linear: a search for the closing quote
#: that fails reaches the end of the page, and no later quote of that kind is left to start another.
_TAG = re.compile(r"""<!--|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>?""", re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_SPACES = " \t\n\r\f\v"
_RUNS = ("  ", *_SPACES[1:])
_SPACE_RUN = re.compile(f"[{_SPACES}]+")


class Block(NamedTuple):
    path: int  # number in Paths
    text: str
    linked: int  # code points inside links


class Paths:
    """Numbers for paths of open blocks, so that a path seen before costs one look-up."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, str, str], int] = {}
        self.labels: list[tuple[str, ...]] = [()]

    def number(self, parent: int, tag: str, attributes: str) -> int:
        key = (parent, tag, attributes)
        found = self.numbers.get(key)
        if found is None:
            names = re.findall(r"[a-z]+", " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower())
            self.labels.append((*self.labels[parent], tag, *(f".{name}" for name in names)))
            found = self.numbers[key] = len(self.labels) - 1
        return found


class _Reader:
    """The tags of a page in order. What a page never ends is remembered, so that nothing is looked for twice."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        place = self.page.find(what, at)
        if place < 0:
            self.missing.add(what)
        return place

    def comment_end(self, at: int) -> int:
        """Behind a comment whose text begins at ``at``; one that is never ended goes to the next > only."""
        if self.page.startswith(">", at):
            return at + 1
        if self.page.startswith("->", at):
            return at + 2
        ends = [place + len(mark) for mark in ("-->", "--!>") if (place := self.find(mark, at)) >= 0]
        return min(ends) if ends else self.find(">", at) + 1 or len(self.page)

    def raw_end(self, tag: str, at: int) -> tuple[int, int]:
        """Where the text of a raw element ends and where reading goes on; scripts and styles without end go on to the page's end."""
        end = None if tag in self.missing else re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(self.page, at)
        if end is None:
            self.missing.add(tag)
            return (len(self.page),) * 2 if tag in ("script", "style") else (at, at)
        return end.start(), self.find(">", end.start()) + 1 or len(self.page)

    def tags(self, at: int = 0) -> Iterator[re.Match]:
        """All tags but those within comments and raw elements; a raw element's own tags are given."""
        while (match := _TAG.search(self.page, at)) is not None:
            at = match.end()
            if match.group(0) == "<!--":
                at = self.comment_end(at)
            elif match.group(2) is not None:
                yield match
                if match.group(2).lower() in RAW_TAGS and not match.group(1):
                    at = self.raw_end(match.group(2).lower(), at)[1]

    def hidden_ends(self) -> dict[int, int]:
        """Place behind the end tag of each hidden element, by the place behind its opening tag.

        An element that isn't ended within the block it stands in hides nothing.
        """
        ends: dict[int, int] = {}
        open_: list[tuple[str, int]] = []
        times: Counter[str] = Counter()
        for match in self.tags():
            tag = match.group(2).lower()
            if tag not in HIDDEN_TAGS and (tag not in BLOCK_TAGS or tag in VOID_TAGS):
                continue
            if not match.group(1):
                if not match.group(3).endswith("/"):
                    open_.append((tag, match.end()))
                    times[tag] += 1
            elif times[tag]:
                name = place = None
                while name != tag:
                    name, place = open_.pop()
                    times[name] -= 1
                if tag in HIDDEN_TAGS:
                    ends[place] = match.end()
        return ends


def blocks_of(page: str, paths: Paths) -> list[Block]:
    """The blocks of a page in order: references decoded, white space runs made one space, no empty ones.

    Text of scripts, styles, titles, text fields and of elements that are not shown (``HIDDEN_TAGS``) is left out. Broken markup
    loses no text around it: an element that is not shown must be ended, within the block that it stands in.
    """
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    linked = links = at = 0
    reader, ends = _Reader(page), None

    def end_block() -> None:
        nonlocal linked
        text = "".join(parts)
        if any(run in text for run in _RUNS):
            text = _SPACE_RUN.sub(" ", text)
        text = text.strip(" ")
        if text:
            out.append(Block(stack[-1][1] if stack else 0, text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def add(text: str, raw: bool = False) -> None:
        nonlocal linked
        if "&" in text and not raw:
            text = html.unescape(text)
        parts.append(text)
        if links:
            linked += len(text.strip(_SPACES))

    def close(tag: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return

    while True:
        match = _TAG.search(page, at)
        if match is None:
            add(page[at:])
            break
        if match.start() > at:
            add(page[at : match.start()])
        at = match.end()
        if match.group(2) is None:
            at = reader.comment_end(at) if match.group(0) == "<!--" else at
            continue
        closing, tag, attributes = match.group(1), match.group(2).lower(), match.group(3)
        if tag in RAW_TAGS and not closing:
            first, (end, at) = at, reader.raw_end(tag, at)
            if tag == "xmp":
                add(page[first:end], raw=True)
        elif tag in HIDDEN_TAGS and not closing:
            if ends is None:
                ends = reader.hidden_ends()
            at = ends.get(at, at)
        elif tag in BLOCK_TAGS:
            end_block()
            if closing:
                close(tag)
                links = 0 if tag not in ("p", "li", "td") else links
            else:
                if stack and (stack[-1][0] in CLOSES.get(tag, ()) or (stack[-1][0] == "p" and tag in _ENDS_P)):
                    ended = CLOSES.get(tag, {"p"}) | {"p"}
                    while stack and stack[-1][0] in ended:
                        stack.pop()
                if tag not in VOID_TAGS:
                    stack.append((tag, paths.number(stack[-1][1] if stack else 0, tag, attributes)))
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            links = 0 if closing else 1
    end_block()
    return out
