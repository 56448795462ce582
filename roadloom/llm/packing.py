"""Best-fit-decreasing packing of token sequences, planned on the histogram of lengths with a segment tree over capacities."""

from __future__ import annotations

import re
import string
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, written

#: A word of plain letters, which are one pre-token whatever stands around them, and the marks after it, which are another one.
PLAIN = re.compile(rb"((?:[A-Za-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++)([!-/:-@\[-`{-~]*+)").fullmatch
MARKS = string.punctuation.encode()


def words_of(text: str) -> list[bytes]:
    """What stands between white space, which the tokenizer drops and no token spans; in lower case where that is surely the same.

    Outside Latin-1 a letter may combine with what follows in one case only; and special strings are told by their case.
    """
    if "<|" not in text:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
    return text.encode().split()


class WordEncoder:
    """Ids of texts as little-endian 32-bit integers, through a bounded cache from words to their ids.

    New words of plain letters are encoded many at a time, as one text whose ids the tokenizer's word ends divide again. Such letters
    are their own normal form but for their case, and one pre-token each, so they are divided at spaces alone.
    """

    def __init__(self, tokenizer: str, cached: int = 900_000, group: int = 500) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.cached, self.group, self.known = cached, group, {}
        self.model, self.letters = Tokenizer.from_file(tokenizer), Tokenizer.from_file(tokenizer)
        for model in (self.model, self.letters):
            model.no_truncation()
            model.no_padding()
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _each(self, words: list[bytes]) -> None:
        for w, e in zip(words, self.model.encode_batch_fast([w.decode() for w in words], add_special_tokens=False), strict=True):
            self.known[w] = array("I", e.ids).tobytes()

    def _joined(self, words: list[bytes]) -> None:
        ids = np.array(self.letters.encode_batch_fast([b" ".join(words).decode().lower()], add_special_tokens=False)[0].ids, "<u4")
        at = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(at) != len(words):
            self._each(words)
            return
        data, stops = ids.tobytes(), at.tolist()
        self.known.update(zip(words, map(data.__getitem__, map(slice, [0, *stops], stops)), strict=True))

    def learn(self, fresh: set[bytes]) -> None:
        known, plain, other, marked = self.known, set(), set(), []
        for w in fresh:
            letters = w.rstrip(MARKS)
            if not letters.isalpha():  # not of ASCII letters alone
                m = PLAIN(w)
                if not m:
                    other.add(w)
                    continue
                letters = m[1]
            if letters not in known:
                plain.add(letters)
            if len(letters) < len(w):
                marks = w[len(letters) :]
                marked.append((w, letters, marks))
                if marks not in known:
                    other.add(marks)
        order = list(plain)
        for k in range(0, len(order), self.group):
            self._joined(order[k : k + self.group])
        if other:
            self._each(list(other))
        for w, letters, marks in marked:
            known[w] = known[letters] + known[marks]

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [words_of(t) for t in texts]
        parts = [list(map(self.known.get, words)) for words in split]
        gaps = [[k for k, part in enumerate(p) if part is None] for p in parts]
        fresh = {words[k] for words, gap in zip(split, gaps, strict=True) for k in gap}
        if fresh:
            if len(self.known) + len(fresh) > self.cached:
                self.known.clear()
            self.learn(fresh)
            for words, p, gap in zip(split, parts, gaps, strict=True):
                for k in gap:
                    p[k] = self.known[words[k]]
        return list(map(b"".join, parts))


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids and ``end_id``, cut at ``capacity``.

    A task's encoder goes with it, before its worker gives memory back: idle workers of an executor hold no caches.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = WordEncoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for pdf in frames:
            rows = []
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            encoded = [ids + end for k in range(0, len(texts), 64) for ids in encode(texts[k : k + 64])]
            for doc, ids in zip(pdf["doc_id"].array, encoded, strict=True):
                rows += [(doc, k, k * capacity, len(part) // 4, zlib.crc32(part)) for k in range(-(-len(ids) // (4 * capacity))) for part in (ids[4 * capacity * k : 4 * capacity * (k + 1)],)]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """Ranges of open bins by remaining capacity; a segment tree over capacities finds the tightest that fits."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def push(self, left: int, base: int, bins: int) -> None:
        if bins and left:
            if not self.ranges[left]:
                self._mark(left, 1)
            self.ranges[left].append((base, bins))

    def pop(self, left: int) -> tuple[int, int]:
        out = self.ranges[left].pop()
        if not self.ranges[left]:
            self._mark(left, 0)
        return out

    def _mark(self, left: int, on: int) -> None:
        i = left + self.leaves
        self.tree[i] = on
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] | self.tree[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of an open bin that is at least ``length``."""
        i = length + self.leaves
        if self.tree[i]:
            return length
        while i > 1 and not (i % 2 == 0 and self.tree[i + 1]):
            i //= 2
        if i <= 1:
            return None
        i += 1
        while i < self.leaves:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing for ``histogram[length]`` pieces of each length, as ``(length, first_rank, per_bin, bin, offset)`` rows.

    The pieces of a length with ranks from ``first_rank`` on go, ``per_bin`` to each, into consecutive bins from ``bin``, from
    ``offset`` on. Pieces of one length are alike, and so are bins with the same room: what best-fit decreasing does piece by piece
    is done here for a whole range of bins, with the same outcome. Each length opens at most two new ranges, so the state stays
    under two ranges a length however many pieces there are.
    """
    bins, plan, opened = OpenBins(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        left, rank = histogram[length], 0
        while left:
            room = bins.tightest(length)
            if room is None:
                room, base, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            else:
                base, many = bins.pop(room)
            each = room // length
            full = min(many, left // each)
            if full:
                plan.append((length, rank, each, base, capacity - room))
                bins.push(room - each * length, base, full)
                rank, left = rank + full * each, left - full * each
            if left and full < many:
                plan.append((length, rank, left, base + full, capacity - room))
                bins.push(room - left * length, base + full, 1)
                full, left = full + 1, 0
            bins.push(room, base + full, many - full)
    return plan


def pack(pieces: DataFrame, capacity: int = 4096, salted_rows: int = 4096) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces(doc_id, piece, ..., length)``; ``length`` in 1..capacity.

    Only the histogram of lengths (at most ``capacity`` rows) reaches the driver. A length with more than ``salted_rows`` pieces is dealt
    out at random to groups of about that many, so that no length, nor any number of equal rows, is one task's work; a piece's rank is
    its place in its group and the sizes of the groups before. Ties and repeated rows take any order.
    """
    columns = pieces.columns
    pieces = written(pieces.withColumn("_draw", F.rand(7)))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = sorted(best_fit_plan(histogram, capacity))
    shift = 44
    keys = np.array([(p[0] << shift) | p[1] for p in plan], np.int64)
    firsts, each, base, offset = (np.array([p[k] for p in plan], np.int64) for k in (1, 2, 3, 4))
    salts = pieces.sparkSession.createDataFrame([(n, -(-c // salted_rows)) for n, c in histogram.items()], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.floor(F.col("_draw") * F.col("salts"))).drop("salts")
    sums = salted.groupBy("length", "salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    sums = written(sums.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before")))
    order = Window.partitionBy("length", "salt").orderBy("_draw")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(sums.hint("merge"), ["length", "salt"])
    ranked = ranked.select(*columns, (F.col("rank") + F.col("before")).alias("rank"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            length, rank = pdf["length"].to_numpy(np.int64), pdf.pop("rank").to_numpy(np.int64)
            at = np.searchsorted(keys, (length << shift) | rank, "right") - 1
            k = rank - firsts[at]
            yield pdf.assign(sequence_id=base[at] + k // each[at], offset=offset[at] + k % each[at] * length)

    schema = ", ".join(f"{c} {t}" for c, t in pieces.select(*columns).dtypes) + ", sequence_id long, offset long"
    return mapped(ranked, place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Packs tokenized documents, each ended by ``end_id``, into sequences of at most ``capacity`` tokens.

    Only documents longer than ``capacity`` are cut. A null or empty text is the end id alone; repeated rows are packed as often as
    they occur; other columns are ignored; an empty table gives no rows. The result has one row per piece.
    """
    return pack(tokenized_pieces(docs, tokenizer, capacity, end_id), capacity)
