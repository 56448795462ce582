"""Embedding near-dedup: an exact metric range join over pivot cells with boundary replication by the triangle inequality."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, give_back, mapped, written

#: Distances from a pivot are at most 2; so many steps of them are told apart in a cell.
STEPS = 64


def unit_rows(vectors: list) -> list[np.ndarray]:
    """Unit vectors in double precision of sound vectors; scaled by the largest component first, so that no square overflows."""
    out = []
    for v in vectors:
        x = np.asarray(v, float)
        x = x / np.abs(x).max()
        out.append(x / np.sqrt((x * x).sum()))
    return out


class Pivots:
    """Pivots by vector length. Cells have numbers of their own; a length without a pivot is one cell, at distance 0 of all."""

    def __init__(self, units: list[np.ndarray], radius: float) -> None:
        self.radius = radius
        by_size = defaultdict(list)
        for u in units:
            by_size[len(u)].append(u)
        self.first, self.points, self.between, n = {}, {}, {}, 0
        for size in sorted(by_size):
            p = np.array(by_size[size])
            self.first[size], self.points[size] = n, p
            self.between[size] = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
            n += len(p)

    def spread(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Home cells of vectors of one length, their distances there, and all cells that hold what may be in reach, with distances."""
        size = x.shape[1]
        if size not in self.points:
            zero = np.zeros(len(x))
            return np.full(len(x), -size), zero, [np.array([-size])] * len(x), [np.zeros(1)] * len(x)
        d2 = np.maximum(0, 2 - 2 * (x @ self.points[size].T))
        d, k = np.sqrt(d2), np.arange(len(x))
        home = d.argmin(1)
        near = (d - d[k, home][:, None]) / 2 <= self.radius
        near &= (d2 - d2[k, home][:, None]) <= 2 * self.radius * self.between[size][home] + 1e-9  # the bisecting plane
        cells = [np.flatnonzero(r) for r in near]
        return home + self.first[size], d[k, home], [c + self.first[size] for c in cells], [d[j, c] for j, c in enumerate(cells)]


class Rings:
    """Each cell's home vectors in rings of like distance from the pivot, wide rings in several parts: the chunks, numbered."""

    def __init__(self, counts: list[tuple[int, int, int]], chunk_rows: int) -> None:
        by_cell: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(STEPS + 1, np.int64))
        for cell, step, n in counts:
            by_cell[cell][step] += n
        self.ring_of, self.first, self.parts, self.chunks = {}, {}, {}, 0
        for cell in sorted(by_cell):
            rings, held, parts = np.zeros(STEPS + 1, np.int64), 0, [0]
            for step, n in enumerate(by_cell[cell].tolist()):
                if held and held + n > chunk_rows:
                    parts.append(0)
                    held = 0
                held += n
                rings[step], parts[-1] = len(parts) - 1, -(-held // chunk_rows)
            self.ring_of[cell], self.parts[cell] = rings, np.maximum(parts, 1)
            self.first[cell] = self.chunks + np.concatenate([[0], np.cumsum(self.parts[cell])])
            self.chunks += int(self.parts[cell].sum())

    def home(self, cell: int, distance: float, draw: int) -> int:
        ring = self.ring_of[cell][step_of(distance)]
        return int(self.first[cell][ring] + draw % self.parts[cell][ring])

    def within(self, cell: int, low: float, high: float) -> np.ndarray:
        if cell not in self.first:
            return np.zeros(0, np.int64)
        rings = self.ring_of[cell]
        return np.arange(self.first[cell][rings[step_of(max(low, 0.0))]], self.first[cell][rings[step_of(high)] + 1])


def step_of(distance: float) -> int:
    return min(STEPS, int(distance * (STEPS / 2)))


class Chunk:
    """The home vectors of a chunk, whom they are linked with, and the labels of those linked through what was seen so far."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, least: float, cells: int = 1 << 22) -> None:
        self.ids, self.x, self.least = ids, x, least
        self.links, self.label, self.block = np.zeros(len(ids), np.int64), np.arange(len(ids)), max(1, cells // max(1, len(ids)))
        self.copies = copies
        for a in range(0, len(ids), self.block):
            hit = self.x @ x[a : a + self.block].T >= least
            own = np.arange(a, min(len(ids), a + self.block))
            hit[own, own - a] = True
            self._merge(hit)
            hit[own, own - a] = False
            self.links += hit @ copies[a : a + self.block]

    def _merge(self, hit: np.ndarray) -> None:
        """Gives the vectors that one column has the same label; most columns only have equal ones already."""
        columns = np.flatnonzero(hit.any(0))
        hit = hit[:, columns]
        low = np.where(hit, self.label[:, None], len(self.label)).min(0) if len(columns) else columns
        high = np.where(hit, self.label[:, None], -1).max(0) if len(columns) else columns
        for c in np.flatnonzero(low != high).tolist():
            labels = np.unique(self.label[hit[:, c]])
            if len(labels) > 1:
                self.label[np.isin(self.label, labels)] = labels[0]

    def meet(self, ids: np.ndarray, copies: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(id, links, to)`` of the guests that are linked with home vectors, which count the guests in turn."""
        for a in range(0, len(ids) if len(self.ids) else 0, self.block):
            hit = self.x @ x[a : a + self.block].T >= self.least
            columns = np.flatnonzero(hit.any(0))
            if columns.size:
                self._merge(hit)
                hit = hit[:, columns]
                self.links += hit @ copies[a : a + self.block][columns]
                yield ids[a : a + self.block][columns], self.copies @ hit, self.ids[hit.argmax(0)]

    def linked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = np.flatnonzero(self.links)
        return self.ids[some], self.links[some], self.ids[self.label[some]]


def _meeting(least: float):
    """Streams chunks, each one's home vectors before its guests, into ``(id, links, to)`` rows."""

    def batch_of(part: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in part], names=["id", "links", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, chunk, held = None, None, []

        def settled() -> Chunk:
            return chunk or Chunk(*(np.concatenate(p) for p in zip(*held, strict=True)), least)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, guest, ids, copies = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            units = batch.column(4).to_pylist()
            edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]) | (guest[1:] != guest[:-1])) + 1, [len(keys)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if keys[a] != g:
                    if chunk or held:
                        yield batch_of(settled().linked())
                    g, chunk, held = keys[a], None, []
                x = np.frombuffer(b"".join(units[a:b]), float).reshape(b - a, -1)
                if not guest[a]:
                    held.append((ids[a:b], copies[a:b], x))
                elif chunk or held:
                    chunk, held = settled(), []
                    for part in chunk.meet(ids[a:b], copies[a:b], x):
                        yield batch_of(part)
        if chunk or held:
            yield batch_of(settled().linked())
        chunk, held = None, []
        give_back()

    return run


def metric_join(vectors: DataFrame, least: float = 0.95, chunk_rows: int | None = None, max_pivots: int = 1024, chunk_bytes: int = 1 << 25) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for ``vectors(vec_id, embedding)``: links are pairs with a cosine of ``least`` or more.

    On unit vectors that is a Euclidean distance of r = sqrt(2 - 2 least) at most. Every vector's home is the cell of its nearest
    pivot; by the triangle inequality what is in its reach lies in cells with (d - d_home) / 2 <= r whose bisecting plane is in reach,
    and there in rings between d - r and d + r from the pivot. Rings of up to ``chunk_rows`` vectors (larger ones in parts) are chunks,
    and of two chunks one hosts the other's vectors as guests, which are streamed, so that a task holds a chunk and a batch. Chunks are
    for three tasks a core, unless that is more than ``chunk_bytes`` of vectors. Equal vectors count once, with their number. The
    pivots, one a chunk and at most ``max_pivots``, are the vectors with the smallest hashes.

    ``n_links`` counts other rows directly linked, ``component_id`` is the smallest vec_id reachable (null if all are null), ``kept``
    marks the rows that have it. Null, empty, zero and non-finite vectors and those with nulls link with nothing and are kept; vectors
    of different lengths do not link; rows that repeat a vec_id count as different vectors; other columns are ignored; an empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("embedding", lambda c: c != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    kinds = rows.where("sound").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    kinds = written(kinds.withColumn("id", F.monotonically_increasing_id()))
    sizes = kinds.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    if chunk_rows is None:
        chunk_rows = max(1024, min(chunk_bytes // (8 * (sizes["width"] or 1)), -(-sizes["n"] // (3 * spark.sparkContext.defaultParallelism))))
    picked = kinds.orderBy(F.xxhash64("embedding"), "id").limit(max(1, min(max_pivots, -(-sizes["n"] // chunk_rows)))).select("embedding").collect()
    radius = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    pivots = spark.sparkContext.broadcast(Pivots(unit_rows([r["embedding"] for r in picked]), radius))

    def homes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            units = unit_rows(pdf["embedding"].tolist())
            lengths = np.array([len(u) for u in units])
            for size in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == size)
                home, distance, cells, away = pivots.value.spread(np.array([units[k] for k in own]))
                yield pd.DataFrame({"id": pdf["id"].iloc[own], "copies": pdf["copies"].iloc[own], "home": home, "distance": distance, "cells": cells, "away": away, "unit": [units[k].tobytes() for k in own]})

    placed = mapped(kinds.select("id", "copies", "embedding"), homes, "id long, copies long, home long, distance double, cells array<long>, away array<double>, unit binary")
    placed = written(placed)
    step = F.least(F.lit(STEPS), F.floor(F.col("distance") * (STEPS / 2))).cast("int")
    counts = placed.groupBy("home", step.alias("step")).count().collect()
    rings = Rings([tuple(r) for r in counts], chunk_rows)
    shipped = spark.sparkContext.broadcast(rings)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of two chunks, the one with the smaller number is host if the numbers' sum is even."""
        r = shipped.value
        for pdf in frames:
            draws = (pd.util.hash_array(pdf["id"].to_numpy()) >> np.uint64(1)).astype(np.int64).tolist()
            own = [r.home(c, d, k) for c, d, k in zip(pdf["home"].tolist(), pdf["distance"].tolist(), draws, strict=True)]
            hosts = []
            for g, cells, away in zip(own, pdf.pop("cells"), pdf.pop("away"), strict=True):
                all_ = np.concatenate([r.within(c, d - radius, d + radius) for c, d in zip(cells.tolist(), away.tolist(), strict=True)])
                hosts.append(all_[(all_ != g) & ((all_ < g) == ((all_ + g) % 2 == 0))])
            yield pdf.drop(columns=["home", "distance"]).assign(own=own, hosts=hosts)

    dealt = mapped(placed, deal, "id long, copies long, unit binary, own long, hosts array<long>")
    dealt = dealt.select("id", "copies", "unit", F.posexplode(F.concat(F.array("own"), "hosts")).alias("at", "g"))
    dealt = dealt.select("g", (F.col("at") > 0).alias("guest"), "id", "copies", "unit")
    dealt = dealt.repartition(max(1, min(4 * rings.chunks, 20_000)), "g").sortWithinPartitions("g", "guest")
    found = written(dealt.mapInArrow(_meeting(least), "id long, links long, to long"))
    linked = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    by_kind = kinds.join(links, "id", "left").join(linked.withColumnRenamed("node", "id"), "id", "left")
    by_kind = written(by_kind.select("embedding", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component")))
    least_id = by_kind.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_kind = by_kind.join(least_id, "component").select("embedding", "links", "component_id")
    joined = rows.where("sound").drop("sound").join(by_kind, "embedding").select("vec_id", F.col("links").cast("long").alias("n_links"), "component_id")
    rest = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
