"""Substring deduplication of word sequences by relative Lempel-Ziv parsing against indexed reference blocks."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounds, mapped
from .repeats import WordUnit, WindowRepeats, _spans, covered, with_tag


class ReferenceBlock:
    """The segments of one anchor, indexed by their short word sequences."""

    def __init__(self, segments: list[list[bytes]], copies: list[int], seed: int) -> None:
        self.segments, self.copies, self.seed = segments, copies, seed
        self.index: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for k, s in enumerate(segments if len(segments) > 1 or copies[0] < 2 else ()):
            for j in range(len(s) - seed + 1):
                self.index[tuple(s[j : j + seed])].append((k, j))

    def longest(self, k: int, i: int, least: int = 0) -> int:
        """Words that the factor at ``i`` of segment ``k`` has: its longest match at any other place (0: under ``seed``, or ``least``)."""
        own = self.segments[k]
        best = 0
        for other, j in self.index.get(tuple(own[i : i + self.seed]), ()):
            if other == k and j == i:
                continue
            there = self.segments[other]
            top = min(len(own) - i, len(there) - j)
            if top <= best or top < least:
                continue
            reach = max(best, least)
            if own[i : i + reach] != there[j : j + reach]:
                continue
            n = max(reach, self.seed)
            while n < top and own[i + n] == there[j + n]:
                n += 1
            best = max(best, n)
        return best

    def parse(self, k: int, count: int, width: int) -> np.ndarray:
        """Greedy factors of segment ``k``, long ones marked, and the windows over factor boundaries looked up one by one.

        A segment of two or more copies is one factor: its other copy.
        """
        if self.copies[k] > 1:
            return np.ones(count, bool)
        hit = np.zeros(count, bool)
        i = 0
        while i < count:
            n = self.longest(k, i)
            if n >= width:
                hit[i : i + n - width + 1] = True
            for t in range(max(i + 1, i + n - width + 1), min(i + n, count)):
                hit[t] = self.longest(k, t, width) >= width
            i += max(n, 1)
        return hit


def parsed_windows(segments: list[list[bytes]], counts: list[int], copies: np.ndarray, width: int, groups: np.ndarray, seed: int = 8) -> list[np.ndarray]:
    """For each segment, which of its first ``counts`` windows of ``width`` words occur at another place of its anchor's block."""
    out: list[np.ndarray] = []
    edges = bounds(groups)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        block = ReferenceBlock(segments[a:b], copies[a:b].tolist(), min(seed, width))
        out += [block.parse(k, counts[a + k], width) for k in range(b - a)]
    return out


def substring_dedup(docs: DataFrame, width: int = 35, grams: tuple[int, ...] = (9, 28)) -> DataFrame:
    """Adds ``n_words, spans, n_removed, kept`` to each row of ``docs(doc_id, text, ...)``.

    A word goes if any window of ``width`` words over it also starts at another place of the corpus, in the same document or another.
    ``spans`` are the maximal removed runs as (start, length) in words; ``kept`` are the other words, joined by one space. Words are
    runs without white space (space and the characters 9 to 13), unchanged. Null and empty texts have no words; rows with a null
    doc_id count as any other; equal rows are repeats of one another; other columns stay (those named like an added one are
    replaced); an empty table gives an empty result.
    """
    rest = [c for c in docs.columns if c not in ("n_words", "spans", "n_removed", "kept")]
    docs = with_tag(docs.select(*rest), "_tag")
    spans = WindowRepeats(WordUnit, parsed_windows, width, grams).spans(docs.select(F.col("_key").alias("doc_id"), F.col("_tag").alias("tag"), "text"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            n_words, runs, removed, kept = [], [], [], []
            for text, found in zip(pdf["text"], pdf.pop("_spans_found"), strict=True):
                words = text.encode().split() if isinstance(text, str) else []
                gone = covered(found, len(words), width)
                n_words.append(len(words))
                runs.append(_spans(gone))
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode())
            yield pdf.assign(n_words=n_words, spans=runs, n_removed=removed, kept=kept)

    joined = docs.join(spans.select(F.col("doc_id").alias("_key"), F.col("tag").alias("_tag"), F.col("spans").alias("_spans_found")), ["_key", "_tag"], "left").select(*rest, "_spans_found")
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*rest).dtypes) + ", n_words long, spans array<struct<start:int,length:int>>, n_removed long, kept string"
    return mapped(joined, cut, schema)
