"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores the copies."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped
from .repeats import Sums

ASCII = bytes(range(128))
#: ASCII characters that no word holds become spaces; the others of that kind are found among what is not ASCII.
SPACED = bytes(c if c >= 128 or chr(c).isalnum() or chr(c) == "_" else 32 for c in range(256))
NO_WORD = re.compile(r"[^\w\x00-\x7f]")


def normal_words(text: str | None) -> list[bytes]:
    """The runs of letters, digits and underscores of a text in lower case, as UTF-8."""
    if not isinstance(text, str):
        return []
    low = text.lower()
    raw = low.encode("utf-8", "surrogatepass")
    if len(raw) != len(low) and NO_WORD.search(raw.translate(None, ASCII).decode("utf-8", "surrogatepass")):
        raw = NO_WORD.sub(" ", low).encode("utf-8", "surrogatepass")
    return raw.translate(SPACED).split()


def sure_hits(n: int, least: float, gram: int) -> int:
    """How many n-grams of an item of ``n`` words any alignment that scores ``least`` of it holds unbroken, at the fewest.

    With e edits it has at least ``equal + e`` equal words, in at most e + 1 runs, and e is at most ``n - equal``.
    """
    equal = math.ceil(least * n - 1e-9)
    return min(equal + e - (gram - 1) * (e + 1) for e in (0, n - equal))


class Items:
    """A block of test items as word numbers, with the places of their n-grams. Number 0 is any word that no item has.

    An item's n-grams have ``gram`` words, or fewer if it is so short that a copy that reaches ``least`` need not hold one of that size.
    An item of fewer than ``gram`` words is one n-gram, as only whole copies of it are told from chance.
    """

    def __init__(self, items: list[tuple[int, str | None]], gram: int, least: float) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.least = least
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        for item, text in items:
            words = normal_words(text)
            if words:
                self.ids.append(item)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]))
        self.sizes = [len(w) if len(w) < gram else next((q for q in range(gram, 1, -1) if sure_hits(len(w), least, q) > 0), 1) for w in self.words]
        self.sure = [1 if len(w) < gram else max(1, sure_hits(len(w), least, q)) for w, q in zip(self.words, self.sizes, strict=True)]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, w in enumerate(self.words):
            for j, h in enumerate(self.grams(w, self.sizes[k]).tolist()):
                self.places[h].append((k, j))
        self.keys = np.array(sorted(self.places), np.uint64)

    def numbers(self, text: str | None) -> np.ndarray:
        words = normal_words(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    @staticmethod
    def grams(words: np.ndarray, size: int, sums: Sums | None = None) -> np.ndarray:
        """Hashes of the n-grams of ``size`` words, different ones for each size."""
        if len(words) < size:
            return np.zeros(0, np.uint64)
        return (sums or Sums(words.astype(np.uint64))).all(size) ^ np.uint64(size)

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the document has an n-gram of an item, and which; in order of place for each size."""
        where, which = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        sums = Sums(numbers.astype(np.uint64)) if len(self.keys) else None
        for size in sorted(set(self.sizes)) if sums else ():
            found = self.grams(numbers, size, sums)
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            where.append(np.flatnonzero(self.keys[at] == found))
            which.append(found[where[-1]])
        return np.concatenate(where), np.concatenate(which)


def rare_seeds(items: Items, frequency: dict[int, int]) -> set[int]:
    """The n-grams of each item but for those at its most frequent places, one fewer than any copy holds unbroken.

    So every copy holds a seed, wherever its edits lie and whatever other copies the corpus has.
    """
    seeds = set()
    for words, size, sure in zip(items.words, items.sizes, items.sure, strict=True):
        grams = sorted(items.grams(words, size).tolist(), key=lambda g: (frequency.get(g, 0), g))
        seeds.update(grams[: len(grams) - sure + 1])
    return seeds & frequency.keys()


def smith_waterman(item: np.ndarray, passage: np.ndarray, mismatch: int = 1, gap: int = 1) -> tuple[int, int]:
    """The best local alignment's score (1 for an equal word) and where it ends in the passage."""
    n = len(item)
    steps = np.arange(n + 1) * gap
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    for k, w in enumerate(passage.tolist()):
        new = np.zeros(n + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(item == w, 1, -mismatch), row[1:] - gap)
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + steps) - steps
        top = int(row.max())
        if top > best:
            best, end = top, k + 1
    return best, end


def alignments(items: Items, seeds: set[int], numbers: np.ndarray) -> list[tuple[int, float, int, int]]:
    """``(item number, score, start, end)``: the best alignment of each item that reaches ``items.least`` of its length."""
    where, found = items.hits(numbers)
    spans: dict[int, list[list[int]]] = defaultdict(list)
    every: dict[int, list[int]] = defaultdict(list)
    for at, gram in zip(where.tolist(), found.tolist(), strict=True):
        for k, j in items.places[gram]:
            every[k].append(at)
            if gram not in seeds:
                continue
            n = len(items.words[k])
            slack = n // 2 + 2
            a, b = max(0, at - j - slack), min(len(numbers), at - j + n + slack)
            if spans[k] and a <= spans[k][-1][1]:
                spans[k][-1] = [min(a, spans[k][-1][0]), max(b, spans[k][-1][1])]
            else:
                spans[k].append([a, b])
    out = []
    for k, parts in spans.items():
        item = items.words[k]
        known = np.isin(numbers, item) if len(parts) > 8 else None
        best = (0.0, 0, 0)
        for a, b in parts:
            if bisect_left(every[k], b) - bisect_left(every[k], a) < items.sure[k]:
                continue
            passage = numbers[a:b]
            shared = known[a:b].sum() if known is not None else np.isin(passage, item).sum()
            if shared < items.least * len(item) - 1e-9:  # a score needs that many equal words
                continue
            score, end = smith_waterman(item, passage)
            if score / len(item) > best[0]:
                best = (score / len(item), a, a + end)
        if best[0] >= items.least:
            out.append((k, *best))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str | None]]]:
    """The test items in blocks of at most ``block_bytes`` of text (or one item), so that what is broadcast has a bound."""
    block, size = [], 0
    for r in benchmark.where("text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if block and size + len(r["text"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, gram: int = 3, least: float = 0.6, block_bytes: int = 8_000_000) -> DataFrame:
    """``(doc_id, item_id, score, start_word, end_word)`` for every document that holds a copy of a test item, edited or not.

    Words are compared in lower case without punctuation. Seeds are an item's n-grams that the whole corpus has least often, as many as
    make sure that any copy holds one; where a document does, Smith-Waterman aligns the item with the passage around it (1 for an equal word, -1 for another or a gap), and
    the best score over the item's length counts from ``least`` on. Items are broadcast in blocks of bounded size, one pass each.
    Null and empty texts leak nothing; items of fewer than ``gram`` words count where a document has them whole; of alignments that
    score alike the first counts; equal rows give equal results; other columns are ignored; empty tables give an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, score double, start_word int, end_word int"
    for block in _blocks(benchmark, block_bytes):
        items = Items(block, gram, least)
        shipped = spark.sparkContext.broadcast(items)

        def count(frames: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            it = shipped.value
            total = np.zeros(len(it.keys), np.int64)
            for pdf in frames:
                for text in pdf["text"]:
                    _, found = it.hits(it.numbers(text))
                    total += np.bincount(np.searchsorted(it.keys, np.unique(found)), minlength=len(total))
            live = np.flatnonzero(total)
            yield pd.DataFrame({"gram": it.keys[live].view(np.int64), "n": total[live]})

        rows = mapped(docs.select("text"), count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
        frequency = {r["gram"] % (1 << 64): r["n"] for r in rows}
        seeds = spark.sparkContext.broadcast(rare_seeds(items, frequency))

        def align(frames: Iterator[pd.DataFrame], shipped=shipped, seeds=seeds) -> Iterator[pd.DataFrame]:
            it, keys = shipped.value, seeds.value
            for pdf in frames:
                rows = []
                for doc, text in zip(pdf["doc_id"].array, pdf["text"], strict=True):
                    rows += [(doc, it.ids[k], s, a, b) for k, s, a, b in alignments(it, keys, it.numbers(text))]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "start_word", "end_word"])

        own = mapped(docs, align, schema)
        out = own if out is None else out.unionByName(own)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no copy of a test item; a null doc_id is kept."""
    hit = leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)
