"""Exact repeats of fixed-width windows over a whole corpus: candidate groups, oversize groups, and the way back to documents.

A window is ``width`` consecutive symbols (bytes or words) of one document. Each window belongs to the smallest hashed ``gram`` of
symbols in it (its anchor), so equal windows have equal anchors, and consecutive windows with the same anchor form a run whose text
is one short segment. Runs whose anchor occurs once in the corpus hold no repeat and are left out before any text moves. Equal
segments are counted before they are shuffled, and one of each goes, with the others of its anchor, to a kernel that finds the
windows with an equal elsewhere; what it finds is joined back to every run with that segment. Anchors shared by more than
``group_limit`` different segments (frequent lines and passages) do not go to one task: their segments are dealt out anew by longer
anchors, and the windows of what is still wide after that are counted by 128-bit digests with map-side sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import AT_TASK_END, mapped, mix, whole_groups, written

MASK = np.uint64((1 << 24) - 1)
BASE = 0x9E3779B97F4A7C15
#: The largest prime below 2**31, and bases of two polynomial hashes modulo it.
PRIME, PRIME_BASES = (1 << 31) - 1, (1_103_515_247, 1_664_525_013)


class Powers:
    """Powers of a base and of its inverse modulo 2**64, or modulo ``PRIME``, as far as a document needed them so far."""

    def __init__(self, base: int, prime: bool = False) -> None:
        self.modulus = PRIME if prime else 1 << 64
        self.prime = np.uint64(PRIME) if prime else None
        self.bases = [base, pow(base, -1, self.modulus)]
        self.reset()

    def reset(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) <= n:
            self.up, self.down = (self._run(max(n + 1, 1 << 16), b) for b in self.bases)

    def _run(self, n: int, base: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done = 1
        while done < n:
            part = out[: min(done, n - done)] * np.uint64(pow(base, done, self.modulus))
            out[done : done + len(part)] = part if self.prime is None else part % self.prime
            done *= 2
        return out


POWERS = Powers(BASE)
PRIME_POWERS = [Powers(b, True) for b in PRIME_BASES]


def _forget_long() -> None:
    for p in (POWERS, *PRIME_POWERS):
        if len(p.up) > 1 << 18:
            p.reset()


AT_TASK_END.append(_forget_long)


class Sums:
    """Prefix sums from which the hash of any slice of a symbol sequence follows in constant time.

    The hash is a polynomial modulo 2**64: quick, for choosing anchors, shingles and samples.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        POWERS.to(len(symbols) + 1)
        self.n = len(symbols)
        self.p = np.zeros(self.n + 1, np.uint64)
        np.cumsum(symbols * POWERS.up[: self.n], dtype=np.uint64, out=self.p[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.p[start + length] - self.p[start]) * POWERS.down[start])

    def all(self, length: int) -> np.ndarray:
        n = self.n - length + 1
        return mix((self.p[length:] - self.p[:n]) * POWERS.down[:n])


class Digests:
    """Digests of slices by which equal segments are told: two polynomials modulo a prime, which no structure of a text defeats."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.sums = []
        own = [symbols & np.uint64(0x3FFFFFFF), symbols >> np.uint64(34)]
        for s, powers in zip(own, PRIME_POWERS, strict=True):
            powers.to(len(s) + 1)
            p = np.zeros(len(s) + 1, np.uint64)
            np.cumsum(s * powers.up[: len(s)] % powers.prime, dtype=np.uint64, out=p[1:])
            self.sums.append((p, powers))

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        one, two = ((p[start + length] - p[start]) % w.prime * w.down[start] % w.prime for p, w in self.sums)
        return (one << np.uint64(32)) | two


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every ``w`` consecutive values."""
    if w == 1:
        return x
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs_of(symbols: np.ndarray, lengths: np.ndarray, width: int, gram: int, chunk: int = 1 << 22) -> tuple[np.ndarray, ...]:
    """``(document, anchor, digest, start, count)`` of every run of windows in documents laid end to end.

    A run's segment is ``count + width - 1`` symbols long; ``start`` counts from the start of its document.
    """
    n = len(symbols) - width + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    first, second = Sums(symbols), Digests(symbols)
    grams = first.all(gram)
    ends = np.cumsum(lengths)
    open_ = np.ones(n + width, bool)  # windows that lie within one document
    for e in ends[:-1].tolist() if len(ends) > 1 else ():
        open_[max(0, e - width + 1) : e] = False
    parts = []
    for at in range(0, n, chunk):
        m = min(chunk, n - at)
        own = grams[at : at + m + width - gram]
        packed = (own & ~MASK) | np.arange(len(own), dtype=np.uint64)
        where = (sliding_min(packed, width - gram + 1) & MASK).astype(np.int64)
        inside = open_[at : at + m]
        heads = np.concatenate([[0], np.flatnonzero((where[1:] != where[:-1]) | (inside[1:] != inside[:-1])) + 1])
        counts = np.diff(np.concatenate([heads, [m]]))
        heads, counts = heads[inside[heads]], counts[inside[heads]]
        starts = heads + at
        parts.append((own[where[heads]], second.of(starts, counts + (width - 1)), starts, counts))
    anchor, digest, start, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    document = np.searchsorted(ends, start, "right")
    return document, anchor, digest, start - (ends - lengths)[document], count


class ByteUnit:
    """Documents as their UTF-8 bytes."""

    def __init__(self) -> None:
        self.codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))

    def items(self, text: str | None) -> bytes:
        return text.encode() if isinstance(text, str) else b""

    def symbols(self, items: bytes) -> np.ndarray:
        return self.codes[np.frombuffer(items, np.uint8)]

    def segment(self, items: bytes, start: int, length: int) -> bytes:
        return items[start : start + length]

    def parts(self, segment: bytes) -> bytes:
        return segment


class WordUnit:
    """Documents as their words: the longest runs without a space or one of the characters 9 to 13."""

    def items(self, text: str | None) -> list[bytes]:
        return text.encode().split() if isinstance(text, str) else []

    def symbols(self, items: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, items), np.uint64, len(items))

    def segment(self, items: list[bytes], start: int, length: int) -> bytes:
        return b" ".join(items[start : start + length])

    def parts(self, segment: bytes) -> list[bytes]:
        return segment.split(b" ")


Unit = type[ByteUnit] | type[WordUnit]
Kernel = Callable[[list, list[int], np.ndarray, int, np.ndarray], list[np.ndarray]]


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of set flags as ``(start, length)``."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [(int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


HITS = "anchor long, digest long, spans array<struct<start:int,length:int>>"


class WindowRepeats:
    """Finds the windows of ``width`` symbols that start at two or more places of a corpus.

    ``kernel(segments, counts, copies, width, groups)`` gets the different segments of whole anchor groups and returns for each which
    of its first ``counts`` windows occur elsewhere, ``copies`` being 2 for a segment that itself occurs at two or more places.
    ``grams`` are the anchor lengths: the first for the corpus; the others deal oversize groups out anew, over finer anchors.
    """

    def __init__(self, unit: Unit, kernel: Kernel, width: int, grams: tuple[int, ...], group_limit: int = 200, block: int = 100_000) -> None:
        self.unit, self.kernel, self.width, self.grams = unit, kernel, width, grams
        self.group_limit, self.block = group_limit, block

    def spans(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, tag, spans)`` for ``docs(doc_id, tag, text)`` as ``with_tag`` gives them: where repeated windows start, as (start, length)."""
        unit, width, gram = self.unit, self.width, self.grams[0]

        def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            u = unit()

            def runs(rows: list[tuple], symbols: list[np.ndarray]) -> pd.DataFrame:
                k, anchor, digest, start, count = runs_of(np.concatenate(symbols), np.array(list(map(len, symbols))), width, gram)
                ids = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
                return pd.DataFrame({"doc_id": ids[0][k], "tag": ids[1][k], "anchor": anchor.view(np.int64), "digest": digest.view(np.int64), "start": start, "count": count})

            for pdf in frames:
                rows, symbols, held = [], [], 0
                for doc, tag, text in zip(pdf["doc_id"].array, pdf["tag"].array, pdf["text"], strict=True):
                    own = u.symbols(u.items(text))
                    if len(own) < width:
                        continue
                    rows.append((doc, tag))
                    symbols.append(own)
                    held += len(own)
                    if held >= 1 << 16:
                        yield runs(rows, symbols)
                        rows, symbols, held = [], [], 0
                if rows:
                    yield runs(rows, symbols)

        runs = written(mapped(docs.where("length(text) > 0"), find, "doc_id long, tag long, anchor long, digest long, start int, count int"))
        shared = written(runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
        found = written(runs.join(shared.hint("merge"), "anchor").select("anchor", "digest", "doc_id", "tag", "start", "count"))
        firsts = [F.first(c).alias(c) for c in ("doc_id", "tag", "start", "count")]
        kinds = written(found.groupBy("anchor", "digest").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("copies"), *firsts))
        wide = written(kinds.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > self.group_limit).select("anchor", F.lit(True).alias("wide")))
        kinds = kinds.join(wide, "anchor", "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
        wanted = kinds.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", "digest", "copies", "start", "count", "wide")).alias("w"))

        def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            u = unit()
            for pdf in frames:
                rows = []
                for text, w in zip(pdf["text"], pdf["w"], strict=True):
                    items = u.items(text)
                    rows += [(x["anchor"], x["digest"], x["copies"], x["count"], x["wide"], u.segment(items, x["start"], x["count"] + width - 1)) for x in w]
                for k in range(0, len(rows), 20_000):
                    yield pd.DataFrame(rows[k : k + 20_000], columns=["anchor", "digest", "copies", "count", "wide", "segment"])

        texts = docs.select("doc_id", "tag", "text").join(wanted, ["doc_id", "tag"]).select("text", "w")
        segments = written(mapped(texts, cut, "anchor long, digest long, copies int, count int, wide boolean, segment binary"))
        hits = written(self._resolve(segments, 1))
        back = found.join(hits, ["anchor", "digest"]).select("doc_id", "tag", F.expr("transform(spans, s -> named_struct('start', s.start + start, 'length', s.length))").alias("s"))
        return back.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("s")).alias("spans"))

    def _resolve(self, segments: DataFrame, level: int) -> DataFrame:
        """Hits among ``segments``: small groups by the kernel, wide ones over finer anchors, the last of them window by window."""
        narrow = self._judged(segments.where("not wide").drop("wide"))
        broad = segments.where("wide").dropDuplicates(["anchor", "digest"]).drop("wide")
        if segments.where("wide").isEmpty():
            return narrow
        return narrow.unionByName(self._refined(broad, level) if level < len(self.grams) else self._counted(broad))

    def _judged(self, segments: DataFrame) -> DataFrame:
        unit, kernel, width, block = self.unit, self.kernel, self.width, self.block

        def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            u = unit()
            for pdf in whole_groups(frames, "anchor", block, lambda p: int(p["segment"].str.len().sum())):
                pdf = pdf.drop_duplicates(["anchor", "digest"])
                flags = kernel([u.parts(s) for s in pdf["segment"]], pdf["count"].tolist(), pdf["copies"].to_numpy(), width, pdf["anchor"].to_numpy())
                rows = [(a, d, s) for a, d, f in zip(pdf["anchor"], pdf["digest"], flags, strict=True) if (s := _spans(f))]
                yield pd.DataFrame(rows, columns=["anchor", "digest", "spans"])

        return mapped(segments.repartition("anchor").sortWithinPartitions("anchor"), judge, HITS)

    def _refined(self, segments: DataFrame, level: int) -> DataFrame:
        unit, width, gram = self.unit, self.width, self.grams[level]

        def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            u = unit()
            for pdf in frames:
                parts = [u.parts(s) for s in pdf["segment"]]
                symbols = list(map(u.symbols, parts))
                k, anchor, digest, start, count = runs_of(np.concatenate(symbols), np.array(list(map(len, symbols))), width, gram)
                out = pdf[["anchor", "digest", "copies"]].iloc[k].rename(columns={"anchor": "up_anchor", "digest": "up_digest"})
                text = [u.segment(parts[a], b, c + width - 1) for a, b, c in zip(k.tolist(), start.tolist(), count.tolist(), strict=True)]
                yield out.assign(anchor=anchor.view(np.int64), digest=digest.view(np.int64), at=start, count=count, segment=text)

        schema = "up_anchor long, up_digest long, copies int, anchor long, digest long, at int, count int, segment binary"
        pieces = written(mapped(segments, split, schema))
        kinds = written(pieces.groupBy("anchor", "digest").agg(F.least(F.sum("copies"), F.lit(2)).cast("int").alias("copies"), F.first("count").alias("count"), F.first("segment").alias("segment")))
        groups = kinds.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("copies").alias("c")).where("c > 1")
        groups = written(groups.select("anchor", (F.col("n") > self.group_limit).alias("wide")))
        hits = written(self._resolve(kinds.join(groups, "anchor"), level + 1))
        return self._lifted(pieces.select("up_anchor", "up_digest", "anchor", "digest", "at").join(hits, ["anchor", "digest"]))

    def _counted(self, segments: DataFrame) -> DataFrame:
        """The last anchors are whole windows: a group is one string, and repeated if it has two copies, as any group of one segment."""
        unit, width = self.unit, self.width

        def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            u = unit()
            for pdf in frames:
                out = []
                for a, d, c, n, s in zip(pdf["anchor"], pdf["digest"], pdf["copies"], pdf["count"], pdf["segment"], strict=True):
                    parts = u.parts(s)
                    prints = [xxhash.xxh3_128_intdigest(u.segment(parts, k, width)) for k in range(n)]
                    out += [((p >> 64) - (1 << 63), (p & ((1 << 64) - 1)) - (1 << 63), a, d, c, k) for k, p in enumerate(prints)]
                for k in range(0, len(out), 50_000):
                    yield pd.DataFrame(out[k : k + 50_000], columns=["one", "two", "up_anchor", "up_digest", "copies", "at"])

        every = written(mapped(segments, windows, "one long, two long, up_anchor long, up_digest long, copies int, at int"))
        twice = written(every.groupBy("one", "two").agg(F.sum("copies").alias("n")).where("n > 1").select("one", "two"))
        return self._lifted(every.join(twice, ["one", "two"]).withColumn("spans", F.expr("array(named_struct('start', 0, 'length', 1))")))

    @staticmethod
    def _lifted(pieces: DataFrame) -> DataFrame:
        moved = F.expr("transform(spans, s -> named_struct('start', s.start + at, 'length', s.length))").alias("s")
        lifted = pieces.select(F.col("up_anchor").alias("anchor"), F.col("up_digest").alias("digest"), moved)
        return lifted.groupBy("anchor", "digest").agg(F.flatten(F.collect_list("s")).alias("spans"))


def covered(spans: list, n: int, width: int) -> np.ndarray:
    """Which of ``n`` symbols a window that starts in one of ``spans`` covers."""
    step = np.zeros(n + 1, np.int64)
    if spans is not None and len(spans):
        start = np.array([s["start"] for s in spans])
        stop = start + np.array([s["length"] for s in spans]) + width - 1
        np.add.at(step, start, 1)
        np.add.at(step, stop, -1)
    return np.cumsum(step[:n]) > 0


def with_tag(docs: DataFrame, tag: str = "tag") -> DataFrame:
    """Adds ``tag`` and ``_key``: the tag tells apart the rows of a repeated doc_id by their text; rows without a doc_id are known by their text alone."""
    tagged = docs.withColumn(tag, F.xxhash64("text"))
    return tagged.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.col(tag)))
