"""Suffix-array deduplication of byte strings: two-stage sorting and adjacent common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped
from .repeats import ByteUnit, WindowRepeats, _spans, covered, with_tag


def two_stage_order(data: np.ndarray, text: bytes, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The ``wanted`` suffixes of ``text`` in the order of their first ``depth`` bytes or more.

    Suffixes smaller than their successors are sorted directly. Every other one begins with a byte at least as large as the next, so
    it follows from its successor's place: scanning the buckets of first bytes upwards, each bucket being complete when its turn
    comes, puts the predecessors of its suffixes in order into the buckets of larger bytes, or, round by round, of the same byte.
    """
    step = np.sign(np.diff(data.astype(np.int16)))
    turns = np.flatnonzero(step)
    following = turns[np.minimum(np.searchsorted(turns, np.arange(len(step))), len(turns) - 1)]
    small = step[following] > 0
    direct = np.flatnonzero(small & wanted[: len(small)])
    slices = [text[i : i + depth] for i in direct.tolist()]
    direct = direct[sorted(range(len(slices)), key=slices.__getitem__)] if len(slices) else direct
    first = data[direct]
    ends = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    none = np.zeros(0, np.int64)
    for c in range(256):
        scanned = np.concatenate(waiting[c]) if waiting[c] else none
        induced = [scanned]
        while scanned.size:
            before = scanned[scanned > 0] - 1
            scanned = before[(data[before] == c) & wanted[before]]
            induced.append(scanned)
        bucket = np.concatenate([*induced, direct[ends[c] : ends[c + 1]]])
        if not bucket.size:
            continue
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(data[before] > c) & wanted[before]]
        if before.size:
            into = data[before]
            by = np.argsort(into, kind="stable")
            before, into = before[by], into[by]
            cuts = np.flatnonzero(np.diff(into)) + 1
            for part, b in zip(np.split(before, cuts), into[np.concatenate([[0], cuts])].tolist(), strict=True):
                waiting[b].append(part)
    return np.concatenate(order) if order else none


def repeated_windows(segments: list[bytes], counts: list[int], copies: np.ndarray, width: int, groups: np.ndarray | None = None) -> list[np.ndarray]:
    """For each segment, which of its first ``counts`` windows of ``width`` bytes occur at another place among the segments.

    Window starts, and the suffixes from which theirs are induced, are sorted; a window is repeated if it shares at least ``width``
    bytes with its neighbour in that order, or if its segment counts for two copies. A group that is one such segment needs no order.
    """
    alone = np.zeros(len(segments), bool)
    if groups is not None and len(segments):
        edges = np.concatenate([[True], groups[1:] != groups[:-1], [True]])
        alone = edges[:-1] & edges[1:] & (copies > 1)
    laid = [(k, s) for k, s in enumerate(segments) if not alone[k]]
    if not laid:
        return [np.ones(c, bool) for c in counts]
    sizes = np.array([len(s) for _, s in laid], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    text = b"".join([s for _, s in laid] + [b"\x00\xff" * width])
    data = np.frombuffer(text, np.uint8)
    span = np.array([counts[k] for k, _ in laid], np.int64)
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + span, -1)
    window = np.cumsum(change[:-1]) > 0
    step = np.sign(np.diff(data.astype(np.int16)))
    rises = np.flatnonzero(step > 0)
    # the chain of larger suffixes after the last window of a segment ends at the next rise
    until = rises[np.searchsorted(rises, starts + span - 1)]
    np.add.at(change, starts + span, 1)
    np.add.at(change, np.maximum(until + 1, starts + span), -1)
    wanted = np.cumsum(change[:-1]) > 0
    order = two_stage_order(data, text, wanted, width)
    order = order[window[order]]
    view = np.lib.stride_tricks.sliding_window_view(data, width)
    hit = np.zeros(len(data), bool)
    for k in range(0, len(order) - 1, 16_384):
        a, b = order[k : k + 16_384], order[k + 1 : k + 16_385]
        a = a[: len(b)]
        same = (view[a] == view[b]).all(axis=1)
        hit[a[same]] = True
        hit[b[same]] = True
    out = [np.ones(c, bool) for c in counts]
    for (k, _), at in zip(laid, starts.tolist(), strict=True):
        if copies[k] < 2:
            out[k] = hit[at : at + counts[k]]
    return out


def suffix_dedup(docs: DataFrame, width: int = 200, grams: tuple[int, ...] = (40, 160)) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)``: what is left of each text once every repeated ``width``-byte string is taken out.

    A byte goes if any ``width``-byte string over it also starts at another place of the corpus, in the same document or another;
    matches never cross documents. ``spans`` are the maximal removed runs as (start, length) in bytes, ``kept`` is the rest. Null and
    empty texts have 0 bytes and no spans; rows with a null doc_id count as any other; equal rows are repeats of one another;
    texts shorter than ``width`` stay; further columns are ignored; an empty table gives an empty result.
    """
    docs = with_tag(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = WindowRepeats(ByteUnit, repeated_windows, width, grams).spans(docs.select(F.col("_key").alias("doc_id"), "tag", "text"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for doc, text, found in zip(pdf["doc_id"].array, pdf["text"], pdf["spans"], strict=True):
                data = text.encode() if isinstance(text, str) else b""
                gone = covered(found, len(data), width)
                rows.append((doc, len(data), _spans(gone), np.frombuffer(data, np.uint8)[~gone].tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "spans", "kept"])

    joined = docs.join(spans.withColumnRenamed("doc_id", "_key"), ["_key", "tag"], "left").select("doc_id", "text", "spans")
    return mapped(joined, cut, "doc_id long, n_bytes long, spans array<struct<start:int,length:int>>, kept binary")

