"""Main-text extraction from HTML by a recurrent block labeller: a bidirectional LSTM over a page's leaf blocks, in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped
from .html_blocks import Block, PageMaker, read_blocks

PATHS, WORDS, NUMBERS = 2048, 512, 5


@lru_cache(maxsize=100_000)
def slot(token: str, slots: int) -> int:
    return zlib.crc32(token.encode()) % slots


@dataclass
class Features:
    """Hashed tag-path tokens and words of a page's blocks, end to end, with how many each block has (one at least), and a few figures."""

    paths: np.ndarray
    path_sizes: np.ndarray
    words: np.ndarray
    word_sizes: np.ndarray
    numbers: np.ndarray


def features(blocks: list[Block]) -> Features:
    paths = [[slot(t, PATHS) for t in b.path] + [slot("|" + (b.path[-1] if b.path else ""), PATHS)] for b in blocks]
    split = [b.text.lower().split() for b in blocks]
    words = [slot(w, WORDS) for s in split for w in s]
    numbers = np.array([[np.log1p(len(s)) / 4, b.linked, float(b.text[-1:] in ".!?"), len(b.path) / 10, 1.0] for b, s in zip(blocks, split, strict=True)]).reshape(-1, NUMBERS)
    return Features(np.array([t for p in paths for t in p], np.int64), np.array(list(map(len, paths)), np.int64), np.array(words, np.int64), np.array(list(map(len, split)), np.int64), numbers)


def joined(pages: list[Features]) -> Features:
    return Features(*(np.concatenate([getattr(p, f.name) for p in pages]) for f in fields(Features)))


def summed(table: np.ndarray, slots: np.ndarray, sizes: np.ndarray, piece: int = 1 << 18) -> np.ndarray:
    """The sum of the rows of ``table`` for each run of ``sizes`` slots, a piece of the runs at a time."""
    out = np.zeros((len(sizes), table.shape[1]))
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        start = int(ends[a] - sizes[a])
        b = max(a + 1, int(np.searchsorted(ends, start + piece, "right")))
        out[a:b] = np.add.reduceat(table[slots[start : ends[b - 1]]], ends[a:b] - sizes[a:b] - start)
        a = b
    return out


def scattered(slots: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by their slots of ``n``."""
    order = np.argsort(slots, kind="stable")
    starts = np.flatnonzero(np.diff(slots[order], prepend=-1))
    out = np.zeros((n, rows.shape[1]))
    out[slots[order][starts]] = np.add.reduceat(rows[order], starts)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Embeddings of path tokens and words, an LSTM each way over the blocks, and a logistic output for every block."""

    def __init__(self, seed: int = 5, path_size: int = 24, word_size: int = 8, hidden: int = 16) -> None:
        r = np.random.RandomState(seed)
        self.hidden, size = hidden, path_size + word_size + NUMBERS
        self.w = {"path": r.randn(PATHS, path_size) * 0.3, "word": r.randn(WORDS, word_size) * 0.1, "out": r.randn(2 * hidden + size) * 0.1, "bias": np.zeros(1)}
        for way in "fb":
            self.w[way + "x"] = r.randn(size, 4 * hidden) / np.sqrt(size)
            self.w[way + "h"] = r.randn(hidden, 4 * hidden) / np.sqrt(hidden)
            self.w[way + "b"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])

    def embed(self, page: Features) -> np.ndarray:
        """Inputs of blocks that lie end to end."""
        path = summed(self.w["path"], page.paths, page.path_sizes) / np.sqrt(page.path_sizes)[:, None]
        word = summed(self.w["word"], page.words, page.word_sizes) / page.word_sizes[:, None]
        return np.concatenate([path, word, page.numbers], 1)

    def padded(self, pages: list[Features]) -> tuple[np.ndarray, np.ndarray]:
        """Inputs (pages x blocks x size) of a batch of pages, and which places hold a block."""
        sizes = np.array([len(p.numbers) for p in pages])
        there = np.arange(sizes.max()) < sizes[:, None]
        own = self.embed(joined(pages))
        x = np.zeros((*there.shape, own.shape[1]))
        x[there] = own
        return x, there

    def _run(self, way: str, x: np.ndarray, there: np.ndarray, keep: bool, piece: int = 2048) -> tuple[np.ndarray, list]:
        n, steps, _ = x.shape
        h, c, z = np.zeros((n, self.hidden)), np.zeros((n, self.hidden)), self.hidden
        out, tape = np.zeros((n, steps, z)), []
        starts = list(range(0, steps, piece))
        for a in starts if way == "f" else starts[::-1]:
            drive = x[:, a : a + piece] @ self.w[way + "x"] + self.w[way + "b"]
            times = range(a, min(steps, a + piece))
            for t in times if way == "f" else times[::-1]:
                gates = drive[:, t - a] + h @ self.w[way + "h"]
                s = _sigmoid(gates[:, : 3 * z])
                i, f, o, g = s[:, :z], s[:, z : 2 * z], s[:, 2 * z :], np.tanh(gates[:, 3 * z :])
                live = there[:, t : t + 1]
                new = np.where(live, f * c + i * g, 0)
                tc = np.tanh(new)
                if keep:
                    tape.append((t, h, c, i, f, o, g, tc))
                c = new
                h = np.where(live, o * tc, 0)
                out[:, t] = h
        return out, tape

    def chances(self, pages: list[Features]) -> list[np.ndarray]:
        x, there = self.padded(pages)
        z, w = self.hidden, self.w["out"]
        f, _ = self._run("f", x, there, False)
        score = f @ w[:z] + x @ w[2 * z :] + self.w["bias"]
        del f
        b, _ = self._run("b", x, there, False)
        p = _sigmoid(score + b @ w[z : 2 * z])
        return [p[k, : len(page.numbers)] for k, page in enumerate(pages)]

    def gradient(self, pages: list[Features], labels: list[np.ndarray]) -> tuple[dict[str, np.ndarray], float]:
        """Gradient of the mean cross-entropy of all blocks, by back-propagation through time."""
        x, there = self.padded(pages)
        y = np.zeros(there.shape)
        for k, v in enumerate(labels):
            y[k, : len(v)] = v
        f, ftape = self._run("f", x, there, True)
        b, btape = self._run("b", x, there, True)
        z = np.concatenate([f, b, x], 2)
        p = _sigmoid(z @ self.w["out"] + self.w["bias"])
        n = there.sum()
        d = np.where(there, p - y, 0) / n
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["out"], g["bias"] = np.tensordot(d, z, 2), np.array([d.sum()])
        dz = d[:, :, None] * self.w["out"]
        dx = dz[:, :, 2 * self.hidden :].copy()
        for way, tape, dh_out in (("f", ftape, dz[:, :, : self.hidden]), ("b", btape, dz[:, :, self.hidden : 2 * self.hidden])):
            dh, dc = np.zeros((len(pages), self.hidden)), np.zeros((len(pages), self.hidden))
            for t, h, c, i, fg, o, gg, tc in reversed(tape):
                live = there[:, t : t + 1]
                dh = np.where(live, dh + dh_out[:, t], 0)
                dc = np.where(live, dc + dh * o * (1 - tc**2), 0)
                gates = np.concatenate([dc * gg * i * (1 - i), dc * c * fg * (1 - fg), dh * tc * o * (1 - o), dc * i * (1 - gg**2)], 1)
                g[way + "x"] += x[:, t].T @ gates
                g[way + "h"] += h.T @ gates
                g[way + "b"] += gates.sum(0)
                dx[:, t] += gates @ self.w[way + "x"].T
                dh, dc = gates @ self.w[way + "h"].T, dc * fg
        a, e = self.w["path"].shape[1], x.shape[2] - NUMBERS
        page, own = joined(pages), dx[there]
        g["path"] = scattered(page.paths, np.repeat(own[:, :a] / np.sqrt(page.path_sizes)[:, None], page.path_sizes, 0), PATHS)
        g["word"] = scattered(page.words, np.repeat(own[:, a:e] / page.word_sizes[:, None], page.word_sizes, 0), WORDS)
        loss = -np.where(there, y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12), 0).sum() / n
        return g, float(loss)


def train(pages: int = 1500, epochs: int = 5, batch: int = 25, rate: float = 0.01, seed: int = 11) -> BlockLabeller:
    """A labeller fitted by Adam on ``pages`` synthetic pages of known labels; the same for the same parameters."""
    made = [p for p in (PageMaker(seed).page() for seed in range(seed * 100_000, seed * 100_000 + pages)) if len(p[0])]
    data = [(features(blocks), label) for blocks, label in made]
    model, r = BlockLabeller(), np.random.RandomState(seed)
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    s = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for epoch in range(epochs):
        order = sorted(r.permutation(len(data)).tolist(), key=lambda k: len(data[k][1]))  # pages of like length go together
        for a in r.permutation(-(-len(order) // batch)) * batch:
            chosen = [data[k] for k in order[a : a + batch]]
            g, _ = model.gradient([c[0] for c in chosen], [c[1] for c in chosen])
            step += 1
            speed = rate * (1 - epoch / epochs)
            for k, v in g.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s[k] = 0.999 * s[k] + 0.001 * v * v
                model.w[k] -= speed * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return model


@lru_cache(maxsize=1)
def labeller() -> BlockLabeller:
    """The production labeller, fitted once in a driver process."""
    return train()


def main_texts(pages: list[str | None], model: BlockLabeller, batch: int = 32, places: int = 1 << 13) -> list[str]:
    """Each page's main blocks in page order, joined by line feeds.

    Pages of similar length are labelled together, ``batch`` and ``places`` (pages times blocks of the longest) of them at most.
    """
    read = [read_blocks(h) for h in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(pages)) if read[k]), key=lambda k: len(read[k]))
    a = 0
    while a < len(order):
        n = 1
        while n < batch and a + n < len(order) and (n + 1) * len(read[order[a + n]]) <= places:
            n += 1
        chosen = order[a : a + n]
        for k, p in zip(chosen, model.chances([features(read[k]) for k in chosen]), strict=True):
            out[k] = "\n".join(b.text for b, v in zip(read[k], p.tolist(), strict=True) if v >= 0.5)
            read[k] = []
        a += n
    return out


def _portions(pages: list[str | None], rows: int = 512, chars: int = 8_000_000) -> Iterator[list[str | None]]:
    """Pages in turn, so many that their blocks have a bound; a longer page is alone."""
    held, size = [], 0
    for p in pages:
        n = len(p) if isinstance(p, str) else 0
        if held and (len(held) == rows or size + n > chars):
            yield held
            held, size = [], 0
        held.append(p)
        size += n
    if held:
        yield held


def extract_main_text(pages: DataFrame, model: BlockLabeller | None = None) -> DataFrame:
    """``(page_id, url, text)`` for every row of ``pages(page_id, url, html)``, from the whole html.

    Blocks are the texts between block-level tags, character references decoded and white space made single spaces; scripts, styles
    and the head hold none. The labeller sees all blocks of a page at once. A null, empty or blockless page has an empty text; broken
    markup is read as far as it goes; null ids and repeated rows stay; other columns are ignored; an empty table stays empty.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(model or labeller())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = [t for part in _portions(pdf["html"].tolist()) for t in main_texts(part, shipped.value)]
            yield pdf.drop(columns="html").assign(text=texts)

    return mapped(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), run, "page_id long, url string, text string")
