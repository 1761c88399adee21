"""A bidirectional LSTM in numpy that labels every block of a page as main text or not.

A block is read as hashed tag-path names, hashed words and a few numbers. Because the network runs over all blocks of a
page in both directions, a label depends on the whole page: on what stands before and after.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

from corpusloom.llm.html_blocks import Block, Paths

PATH_SIZE, WORD_SIZE, NUMBERS = 192, 24, 5
HIDDEN = 16
INPUT = PATH_SIZE + WORD_SIZE + NUMBERS


@lru_cache(maxsize=200_000)
def _bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % size


def path_vector(labels: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(PATH_SIZE)
    for label in labels:
        out[_bucket(label, PATH_SIZE)] = 1.0
    return out


def word_vector(block: Block) -> np.ndarray:
    """Hashed words, all of them, as counts of length 1 whatever the block's length; length, link share, marks, words, last mark."""
    words = block.text.split(" ")
    counts = np.bincount([_bucket(word, WORD_SIZE) for word in words], minlength=WORD_SIZE)
    out = np.zeros(WORD_SIZE + NUMBERS)
    out[:WORD_SIZE] = counts / np.sqrt(counts @ counts)
    text, n = block.text, len(block.text)
    out[WORD_SIZE:] = np.log1p(n) / 8, block.linked / n, min(1.0, sum(map(text.count, ".,;:!?")) * 20 / n), len(words) / n, text[-1:] in ".!?\"'"
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Parameters: per direction input and recurrent weights of the four gates and their bias; output weights and bias."""

    def __init__(self, seed: int = 3):
        draw = np.random.default_rng(seed)
        scale = 1 / np.sqrt(HIDDEN)
        self.p: dict[str, np.ndarray] = {"out": draw.normal(0, scale, 2 * HIDDEN), "bias": np.zeros(1)}
        for d in "fb":
            self.p[f"wx{d}"] = draw.normal(0, 0.15, (INPUT, 4 * HIDDEN))
            self.p[f"wh{d}"] = draw.normal(0, scale / 2, (HIDDEN, 4 * HIDDEN))
            self.p[f"b{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])

    def _run(self, xs: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, page, unit) of projected inputs; masked steps carry the state on."""
        steps, pages = mask.shape
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        out = np.empty((steps, pages, HIDDEN))
        wh = self.p[f"wh{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = xs[t] + h @ wh
            i, f, o = np.split(_sigmoid(z[:, : 3 * HIDDEN]), 3, axis=1)
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            th = np.tanh(new)
            if keep is not None:
                keep.append((t, i, f, o, g, c, th, h, m))
            c = np.where(m, new, c)
            h = np.where(m, o * th, h)
            out[t] = h
        return out

    def _project(self, paths: np.ndarray, path_of: np.ndarray, words: np.ndarray, d: str) -> np.ndarray:
        """Input part of the gates; each path is multiplied once, however many blocks stand in it."""
        w = self.p[f"wx{d}"]
        return (paths @ w[:PATH_SIZE])[path_of] + words @ w[PATH_SIZE:] + self.p[f"b{d}"]

    def probabilities(self, paths: np.ndarray, path_of: np.ndarray, words: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(time, page): paths (n, PATH_SIZE); path_of (time, page); words (time, page, WORD_SIZE + NUMBERS)."""
        h = np.concatenate([self._run(self._project(paths, path_of, words, d), mask, d) for d in "fb"], axis=2)
        return _sigmoid(h @ self.p["out"] + self.p["bias"])

    def gradients(self, paths: np.ndarray, path_of: np.ndarray, words: np.ndarray, mask: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over the blocks that ``mask`` marks."""
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self._run(self._project(paths, path_of, words, d), mask, d, kept[d]) for d in "fb"}
        h = np.concatenate([states["f"], states["b"]], axis=2)
        error = np.where(mask, _sigmoid(h @ self.p["out"] + self.p["bias"]) - wanted, 0) / max(1, mask.sum())
        grads = {"out": np.einsum("tp,tph->h", error, h), "bias": np.array([error.sum()])}
        x = np.concatenate([paths[path_of], words], axis=2)
        for k, d in enumerate("fb"):
            wh = self.p[f"wh{d}"]
            gh, changes = np.zeros_like(wh), np.zeros((*mask.shape, 4 * HIDDEN))
            dh, dc = np.zeros(kept[d][0][5].shape), np.zeros(kept[d][0][5].shape)
            from_out = error[:, :, None] * self.p["out"][k * HIDDEN : (k + 1) * HIDDEN]
            for t, i, f, o, g, c, th, before, m in reversed(kept[d]):
                dh = dh + from_out[t]
                dh_new, dc_new = np.where(m, dh, 0), np.where(m, dc, 0)
                do = dh_new * th
                dnew = dc_new + dh_new * o * (1 - th * th)
                dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), do * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
                changes[t] = dz
                gh += before.T @ dz
                dh = np.where(m, 0, dh) + dz @ wh.T
                dc = np.where(m, dnew * f, dc)
            flat = changes.reshape(-1, 4 * HIDDEN)
            grads |= {f"wx{d}": x.reshape(len(flat), -1).T @ flat, f"wh{d}": gh, f"b{d}": flat.sum(axis=0)}
        return grads


def batch(pages: list[list[Block]], paths: Paths) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arrays of pages of about the same number of blocks."""
    steps = max(1, max(map(len, pages), default=1))
    used = sorted({b.path for page in pages for b in page})
    place = {p: i for i, p in enumerate(used)}
    vectors = np.stack([path_vector(paths.labels[p]) for p in used]) if used else np.zeros((1, PATH_SIZE))
    path_of, mask = np.zeros((steps, len(pages)), dtype=np.int64), np.zeros((steps, len(pages)), dtype=bool)
    words = np.zeros((steps, len(pages), WORD_SIZE + NUMBERS))
    for j, page in enumerate(pages):
        for t, block in enumerate(page):
            path_of[t, j], mask[t, j], words[t, j] = place[block.path], True, word_vector(block)
    return vectors, path_of, words, mask


def label(model: Labeller, pages: list[list[Block]], paths: Paths, size: int = 128) -> list[np.ndarray]:
    """Per page the probability of each block; pages of like length go through the network together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        to, longest = at + 1, len(pages[order[at]])
        while to < len(order) and to - at < size and len(pages[order[to]]) <= 1.3 * longest + 4 and (to - at) * len(pages[order[to]]) < 50_000:
            to += 1
        some = order[at:to]
        probability = model.probabilities(*batch([pages[i] for i in some], paths))
        for j, i in enumerate(some):
            out[i] = probability[: len(pages[i]), j]
        at = to
    return out


def fit(pages: list[list[Block]], wanted: list[list[int]], paths: Paths, rounds: int = 8, size: int = 48, rate: float = 0.02, hide: float = 0.35, seed: int = 3) -> Labeller:
    """Adam on batches of pages of like length. A part of the path names is hidden, so that texts and neighbours count, too."""
    model, draw = Labeller(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: (len(pages[i]), i))
    groups = [order[i : i + size] for i in range(0, len(order), size)]
    ready = [batch([pages[i] for i in g], paths) for g in groups]
    targets = []
    for g, (_, path_of, _, _) in zip(groups, ready):
        y = np.zeros(path_of.shape)
        for j, i in enumerate(g):
            y[: len(wanted[i]), j] = wanted[i]
        targets.append(y)
    turn = 0
    for _ in range(rounds):
        for k in draw.permutation(len(groups)):
            vectors, path_of, words, mask = ready[k]
            shown = vectors * (draw.random(vectors.shape) > hide * draw.random()) if turn % 2 else vectors
            turn += 1
            for name, g in model.gradients(shown, path_of, words, mask, targets[k]).items():
                g = np.clip(g, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                model.p[name] = model.p[name] - rate * (first[name] / (1 - 0.9**turn)) / (np.sqrt(second[name] / (1 - 0.99**turn)) + 1e-6)
    return model
