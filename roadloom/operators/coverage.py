"""Coverage: the smallest whole distance at which an edge's curve follows some path of another graph."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import curve as C
from .spatial import box_join


def _intervals(a: np.ndarray, d: np.ndarray, p: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Where on each segment from ``a`` along ``d`` (in [0, 1]) each point of ``p`` is at most ``reach`` away: (low, high), or nan."""
    f = a[:, None] - p[None]
    qa, qb = (d * d).sum(1)[:, None], 2 * (f * d[:, None]).sum(2)
    qc = (f * f).sum(2) - reach * reach
    disc = qb * qb - 4 * qa * qc
    root, flat = np.sqrt(np.maximum(disc, 0.0)), qa < 1e-18
    with np.errstate(divide="ignore", invalid="ignore"):
        low, high = np.maximum(0.0, (-qb - root) / (2 * qa)), np.minimum(1.0, (-qb + root) / (2 * qa))
    low, high = np.where(flat, 0.0, low), np.where(flat, 1.0, high)
    none = np.where(flat, qc > 1e-12, (disc < -1e-9) | (low > high + 1e-12))
    return np.where(none, np.nan, low), np.where(none, np.nan, high)


class Paths:
    """A small graph of straight edges, and the walks on it that follow curves."""

    def __init__(self, nodes: dict, edges: list[tuple]) -> None:
        self.names = sorted(nodes)
        number = {n: i for i, n in enumerate(self.names)}
        self.place = np.array([nodes[n] for n in self.names], float).reshape(-1, 2)
        pairs = [(number[u], number[v]) for u, v in edges]
        self.tails, self.heads = [u for u, v in pairs for u in (u, v)], [w for u, v in pairs for w in (v, u)]
        self.out: list[list[int]] = [[] for _ in self.names]
        for e, t in enumerate(self.tails):
            self.out[t].append(e)

    def matching(self, curve: np.ndarray, reach: float) -> list | None:
        """The nodes of a walk, from and to anywhere on an edge, whose Frechet distance to ``curve`` is at most ``reach``; or None.

        Column by column of curve segments: where on each directed edge a walk can be at the segment's start, then, in the order of
        the curve's parameter, at which nodes it can be meanwhile, and so where on each edge at the segment's end.
        """
        tail, head = self.place[self.tails], self.place[self.heads]
        on_low, on_high = (x.T.tolist() for x in _intervals(tail, head - tail, curve, reach))
        free_low, free_high = (x.tolist() for x in _intervals(curve[:-1], np.diff(curve, axis=0), self.place, reach))
        left = {e: (low, (e, None)) for e, low in enumerate(on_low[0]) if low == low}
        for k in range(len(curve) - 1):
            low_at, high_at = free_low[k], free_high[k]
            turn = itertools.count()
            heap = [(low_at[n], next(turn), n, trail) for e, (_, trail) in left.items() if low_at[n := self.heads[e]] == low_at[n]]
            heapq.heapify(heap)
            reached: dict = {}
            while heap:
                t, _, n, trail = heapq.heappop(heap)
                if n in reached:
                    continue
                reached[n] = trail
                for e in self.out[n]:
                    m = self.heads[e]
                    if m not in reached and max(t, low_at[m]) <= high_at[m]:  # never true of nan
                        heapq.heappush(heap, (max(t, low_at[m]), next(turn), m, (e, trail)))
            right = {}
            for e, low in enumerate(on_low[k + 1]):
                if low != low:
                    continue
                if e in left and left[e][0] <= low:  # the walk just goes on
                    right[e] = (low, left[e][1])
                elif self.tails[e] in reached:
                    right[e] = (low, (e, reached[self.tails[e]]))
                elif e in left and max(left[e][0], low) <= on_high[k + 1][e]:
                    right[e] = (max(left[e][0], low), left[e][1])
            left = right
            if not left:
                return None
        if not left:
            return None
        trail, walk = left[min(left)][1], []
        while trail:
            walk.append(trail[0])
            trail = trail[1]
        walk.reverse()
        return [self.names[i] for i in (self.tails[walk[0]], *[self.heads[e] for e in walk])]


def matching_path(curve: np.ndarray, nodes: dict, edges: list[tuple], reach: float) -> list | None:
    return Paths(nodes, edges).matching(np.asarray(curve, float), reach) if edges else None


def smallest_reach(curve: np.ndarray, nodes: dict, edges: list[tuple], most: int) -> tuple[float, list]:
    """The smallest whole distance from 1 to ``most`` that matches, found by bisection (matching is monotone), and its path."""
    paths = Paths(nodes, edges)
    best = paths.matching(curve, most) if edges else None
    if best is None:
        return float("inf"), []
    low, high = 0, most
    while high - low > 1:
        middle = (low + high) // 2
        found = paths.matching(curve, middle)
        if found is None:
            low = middle
        else:
            high, best = middle, found
    return float(high), best


def curves_covered(ps: Iterator, qs: Iterator, reach: float) -> list[bool]:
    """For each pair of curves, whether the first follows a part of the second, either way round, within ``reach``."""
    out = []
    for p, q in zip(ps, qs, strict=True):
        line = np.array([[a["y"], a["x"]] for a in q])
        paths = Paths(dict(enumerate(line)), [(i, i + 1) for i in range(len(line) - 1)])
        out.append(paths.matching(np.array([[a["y"], a["x"]] for a in p]), reach) is not None)
    return out


def edge_coverage(source: DataFrame, target: DataFrame, max_threshold: int = 50) -> DataFrame:
    """``(graph_id, u, v, k, threshold, covered_by)`` for edges ``source(graph_id, u, v, k, curve)`` against straight ``target`` edges.

    ``target(tgraph, tu, tv, a, b)`` holds the segments of the graph that ``tgraph`` = graph_id names. Candidates meet over grid cells;
    each source edge with its candidates is one group of bounded size. No candidate or no match means infinity and an empty path.
    """
    left = source.select("graph_id", "u", "v", "k", "curve", C.bounding_box(F.col("curve")).alias("lbox"))
    right = target.select("tgraph", "tu", "tv", "a", "b", C.bounding_box(F.array("a", "b")).alias("rbox"))
    met = box_join(left, right, float(max_threshold), float(max(max_threshold, 1)), by=("graph_id", "tgraph"))
    near = met.groupBy("graph_id", "u", "v", "k").agg(F.collect_list(F.struct("tu", "tv", "a", "b")).alias("near"))
    asked = source.select("graph_id", "u", "v", "k", "curve").join(near.hint("merge"), ["graph_id", "u", "v", "k"], "left")
    # the groups are small and dear: a count of partitions of its own keeps them from being coalesced into few tasks
    asked = asked.repartition(4 * max(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), source.sparkSession.sparkContext.defaultParallelism), "graph_id", "u", "v", "k")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = []
            for curve, near in zip(pdf["curve"], pdf["near"], strict=True):
                nodes, edges = {}, set()
                for s in near if near is not None else ():
                    nodes[s["tu"]] = np.array([s["a"]["y"], s["a"]["x"]])
                    nodes[s["tv"]] = np.array([s["b"]["y"], s["b"]["x"]])
                    edges.add((s["tu"], s["tv"]))
                line = np.array([[p["y"], p["x"]] for p in curve])
                reach, path = smallest_reach(line, nodes, sorted(edges), max_threshold)
                found.append((reach, [{"u": a, "v": b} for a, b in dict.fromkeys((min(p), max(p)) for p in zip(path, path[1:]))]))
            yield pdf[["graph_id", "u", "v", "k"]].assign(threshold=[f[0] for f in found], covered_by=[f[1] for f in found])

    return asked.mapInPandas(run, "graph_id string, u long, v long, k int, threshold double, covered_by array<struct<u:long,v:long>>")
