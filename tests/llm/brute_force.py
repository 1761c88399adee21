"""Plain Python statements of the contracts, for comparison on small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def decontamination(documents, items):
    """{doc_id: (n_words, n_hit, n_items, sha, contaminated)} from (id, text) lists."""
    windows = {}
    for item, text in items:
        words = tuple(ALNUM.findall(lower(text)))
        m = min(13, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            windows.setdefault(words[i : i + m], set()).add(item)
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in documents:
        words, hit, found = tuple(ALNUM.findall(lower(text))), set(), set()
        for m in lengths:
            for i in range(len(words) - m + 1):
                if words[i : i + m] in windows:
                    hit.update(range(i, i + m))
                    found |= windows[words[i : i + m]]
        names = sorted(str(x) for x in found if x is not None)
        sha = hashlib.sha256(",".join(names).encode()).hexdigest()
        out[doc] = (len(words), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(words))
    return out


def shingles(text, words=5):
    found = WORD.findall(lower(text))
    if not found:
        return frozenset()
    if len(found) < words:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def near_duplicates(documents):
    """{doc_id: (set size, smallest doc_id of the component)} by comparing all pairs that share a shingle."""
    sets = {doc: shingles(text) for doc, text in documents}
    classes, by = {}, {}
    for doc in sorted(sets):
        classes.setdefault(sets[doc], []).append(doc)
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(x, y):
        x, y = sorted((root(x), root(y)))
        parent[y] = x

    for s, docs in classes.items():
        if s:
            for d in docs:
                link(docs[0], d)
            for g in s:
                by.setdefault(g, []).append(docs[0])
    seen = set()
    for docs in by.values():
        for i, x in enumerate(docs):
            for y in docs[i + 1 :]:
                if (x, y) not in seen:
                    seen.add((x, y))
                    a, b = sets[x], sets[y]
                    if min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)):
                        both = len(a & b)
                        if 100 * both >= 80 * (len(a) + len(b) - both):
                            link(x, y)
    return {doc: (len(sets[doc]), root(doc)) for doc in sets}


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), n < 20 or 100 * len(inside) > 30 * n
