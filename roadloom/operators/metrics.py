"""Path-length and topology similarity of graphs."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import curve as C
from ..scratch import settled
from . import graph, spatial


def _dijkstra(near: dict, source: int) -> dict[int, float]:
    done, heap = {}, [(0.0, source)]
    while heap:
        d, n = heapq.heappop(heap)
        if n in done:
            continue
        done[n] = d
        for m, w in near.get(n, ()):
            if m not in done:
                heapq.heappush(heap, (d + w, m))
    return done


def shortest_paths(edges: DataFrame, sources: DataFrame | None = None, chunk: int = 256, rows: int = 100_000) -> DataFrame:
    """``(graph_id, u, v, dist)`` with v >= u, itself at 0 included, from edges ``(graph_id, u, v, length)``.

    Sources (all nodes, or those of ``sources(graph_id, nid)``, from which then all v are given) are dealt out in chunks of about
    ``chunk``; every chunk has its graph's edges, and gives its rows out in frames of about ``rows``.
    """
    own = edges.select("graph_id", "u", "v", "length")
    nodes = own.select("graph_id", F.explode(F.array("u", "v")).alias("nid")).distinct()
    asked = nodes if sources is None else sources.select("graph_id", "nid").distinct().join(nodes, ["graph_id", "nid"], "left_semi")
    asked = settled(asked)
    chunks = settled(asked.groupBy("graph_id").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")))
    dealt = asked.join(chunks, "graph_id").select("graph_id", F.pmod(F.xxhash64("nid"), F.col("chunks")).cast("int").alias("c"), F.col("nid").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(None).cast("double").alias("length"))
    copies = own.join(chunks, "graph_id").select("graph_id", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"), "u", "v", "length")

    half = sources is None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _groups(frames):
            graph, near, starts, held = pdf["graph_id"].iloc[0], {}, [], []
            for u, v, w in zip(pdf["u"].tolist(), pdf["v"].tolist(), pdf["length"].tolist(), strict=True):
                if v != v or v is None:
                    starts.append(u)
                else:
                    near.setdefault(u, []).append((int(v), w))
                    near.setdefault(int(v), []).append((u, w))
            for u in starts:
                held += [(graph, u, v, d) for v, d in _dijkstra(near, u).items() if v >= u or not half]
                if len(held) >= rows:
                    yield pd.DataFrame(held, columns=["graph_id", "u", "v", "dist"])
                    held = []
            if held:
                yield pd.DataFrame(held, columns=["graph_id", "u", "v", "dist"])

    both = copies.select("graph_id", "c", "u", "v", F.col("length").cast("double").alias("length")).unionByName(dealt)
    return both.repartition("graph_id", "c").sortWithinPartitions("graph_id", "c").mapInPandas(run, "graph_id string, u long, v long, dist double")


def _groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole groups of (graph_id, c) from frames sorted by them."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        for key, part in pdf.groupby(["graph_id", "c"], sort=False):
            if held and (held[0]["graph_id"].iloc[0], held[0]["c"].iloc[0]) != key:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def sample_score(a: Column, b: Column) -> Column:
    """1 - min(|a - b| / a, 1); null for a zero or unknown length."""
    d = F.try_divide(F.abs(a - b), a)
    return 1 - F.when(d > 1, F.lit(1.0)).otherwise(d)


def apls(samples: DataFrame, *groups: str, prime: bool = False) -> DataFrame:
    """Mean score of samples ``(category, score)``; prime leaves out category A. Null when there are none."""
    kept = samples.where("category != 'A'") if prime else samples
    return kept.groupBy(*groups).agg(F.avg("score").alias("apls"), F.count("*").alias("n_samples"))


def topo(samples: DataFrame, *groups: str, prime: bool = False) -> DataFrame:
    """Pooled precision, recall and F1 of samples ``(tp, fp, fn)``, each 0 on a zero denominator."""
    kept = samples.where("not (tp = 0 and fp = 0)") if prime else samples
    pooled = kept.groupBy(*groups).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    out = pooled.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def match_marbles(holes: np.ndarray, marbles: np.ndarray, reach: float) -> tuple[int, int, int]:
    """Greedy one-to-one matching in marble order within a closed radius: (tp, fp, fn)."""
    free, tp = np.ones(len(holes), bool), 0
    for m in marbles:
        d = np.where(free, np.hypot(*(holes - m).T), np.inf) if len(holes) else np.zeros(0)
        if len(d) and d.min() <= reach:
            free[d.argmin()] = False
            tp += 1
    return tp, len(marbles) - tp, len(holes) - tp


def topo_samples(holes: DataFrame, marbles: DataFrame, reach: float = 5.0) -> DataFrame:
    """``(seed, tp, fp, fn)`` from points ``(seed, y, x)`` around each seed; a seed's points are bounded by its radius."""
    both = holes.select("seed", "y", "x", F.lit(0).alias("side")).unionByName(marbles.select("seed", "y", "x", F.lit(1).alias("side")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "y", "x"])
        h, m = (pdf.loc[pdf["side"] == k, ["y", "x"]].to_numpy(float).reshape(-1, 2) for k in (0, 1))
        return pd.DataFrame([(pdf["seed"].iloc[0], *match_marbles(h, m, reach))], columns=["seed", "tp", "fp", "fn"])

    return both.groupBy("seed").applyInPandas(run, "seed long, tp int, fp int, fn int")


def random_positions(edges: DataFrame, count: int, seed: int, weighted: bool = True) -> DataFrame:
    """``count`` seeded positions ``(sample_id, u, v, k, fraction)`` on edges ``(u, v, k, length)``, by length or uniformly.

    Each edge draws how many samples it gets by its share of a running sum, so that nothing is collected.
    """
    w = F.col("length") if weighted else F.lit(1.0)
    upto = edges.withColumn("w", w).withColumn("bucket", F.pmod(F.xxhash64("u", "v", "k"), F.lit(1024)))
    parts = upto.groupBy("bucket").agg(F.sum("w").alias("part")).withColumn("before", F.coalesce(F.sum("part").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    total = parts.agg(F.sum("part").alias("total"))
    inner = F.sum("w").over(Window.partitionBy("bucket").orderBy("u", "v", "k").rowsBetween(Window.unboundedPreceding, 0))
    spans = upto.withColumn("high", inner).join(F.broadcast(parts), "bucket").crossJoin(F.broadcast(total))
    low = (F.col("before") + F.col("high") - F.col("w")) / F.col("total") * count
    high = (F.col("before") + F.col("high")) / F.col("total") * count
    # stratified: sample i falls at i + rand
    ids = F.sequence(F.floor(low).cast("long"), F.floor(high).cast("long"))
    drawn = spans.select("u", "v", "k", low.alias("low"), high.alias("high"), F.explode(ids).alias("sample_id"))
    spot = F.col("sample_id") + F.pmod(F.xxhash64(F.lit(seed), "sample_id"), F.lit(1 << 30)) / float(1 << 30)
    return drawn.withColumn("spot", spot).where((F.col("spot") >= F.col("low")) & (F.col("spot") < F.col("high")) & (F.col("sample_id") < count)).select("sample_id", "u", "v", "k", ((F.col("spot") - F.col("low")) / (F.col("high") - F.col("low"))).alias("fraction"))


def path_between(samples: DataFrame, paths: DataFrame) -> DataFrame:
    """Adds ``path`` to ``samples(sample_id, graph_id, u1, v1, d1, len1, u2, v2, d2, len2, same)``: the least over end pairs with offsets.

    On one edge (``same``) it is also at most the offsets' difference.
    """
    ends = F.explode(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b"), (x + y).alias("extra")) for a, x in (("u1", F.col("d1")), ("v1", F.col("len1") - F.col("d1"))) for b, y in (("u2", F.col("d2")), ("v2", F.col("len2") - F.col("d2")))]))
    pairs = samples.select("sample_id", "graph_id", ends.alias("e")).select("sample_id", "graph_id", F.least("e.a", "e.b").alias("u"), F.greatest("e.a", "e.b").alias("v"), "e.extra")
    best = pairs.join(paths, ["graph_id", "u", "v"]).groupBy("sample_id", "graph_id").agg(F.min(F.col("dist") + F.col("extra")).alias("path"))
    direct = F.when(F.col("same"), F.abs(F.col("d1") - F.col("d2")))
    return samples.join(best, ["sample_id", "graph_id"], "left").withColumn("path", F.least("path", direct))


def category(near1: Column, near2: Column, path: Column, most: float = 5.0) -> Column:
    """A: an end is not strictly within ``most``; B: no path in the other graph; C: both."""
    return F.when(~((near1 < most) & (near2 < most)), "A").when(path.isNull(), "B").otherwise("C")


def position_pairs(edges: DataFrame, other: DataFrame, pairs: int, seed: int, radius: float = 50.0) -> DataFrame:
    """``(sample_id, side, ...)``: two seeded positions on ``edges`` a sample, and the nearest place to each on ``other``.

    Side 1 and 2 are the ends; ``u, v, k, offset, length, y, x`` lie on the first graph, ``tu, tv, tk, toffset, tlength, distance`` on
    the other. Both are one graph of the same graph_id.
    """
    named = settled(edges.select("graph_id", "u", "v", "k", "curve", C.length(F.col("curve")).alias("length")))
    drawn = random_positions(named.select("u", "v", "k", "length"), 2 * pairs, seed)
    spots = drawn.join(named, ["u", "v", "k"]).withColumn("p", C.position_at(F.col("curve"), F.col("fraction")))
    # neighbouring draws lie on neighbouring edges: ends are paired at random
    shuffled = Window.orderBy(F.xxhash64(F.lit(seed + 1), "sample_id"), "sample_id")  # as many rows as samples were asked for
    order = drawn.select("sample_id").withColumn("r", F.row_number().over(shuffled) - 1)
    spots = spots.join(order, "sample_id").select(F.col("r").alias("lid"), "graph_id", "u", "v", "k", (F.col("fraction") * F.col("length")).alias("offset"), "length", F.col("p.y").alias("y"), F.col("p.x").alias("x"))
    spots = settled(spots)
    near = graph.nearest_position(spots.select("lid", "graph_id", "y", "x"), other, radius)
    sizes = other.select(F.col("u").alias("tu"), F.col("v").alias("tv"), F.col("k").alias("tk"), C.length(F.col("curve")).alias("tlength"))
    near = near.select("lid", F.col("u").alias("tu"), F.col("v").alias("tv"), F.col("k").alias("tk"), "distance", "fraction").join(sizes, ["tu", "tv", "tk"])
    near = near.withColumn("toffset", F.col("fraction") * F.col("tlength")).drop("fraction")
    return spots.join(near, "lid", "left").withColumn("sample_id", F.floor(F.col("lid") / 2)).withColumn("side", (F.col("lid") % 2 + 1).cast("int")).drop("lid")


def _between(ends: DataFrame, edges: DataFrame, prefix: str, offset: str, length: str) -> DataFrame:
    """``(sample_id, path)`` in one graph for samples with an end of each side there."""
    a, b = (ends.where(F.col("side") == s) for s in (1, 2))
    part = lambda df, s: df.select("sample_id", "graph_id", *[F.col(prefix + c).alias(f"{c}{s}") for c in ("u", "v", "k")], F.col(offset).alias(f"d{s}"), F.col(length).alias(f"len{s}"))
    both = settled(part(a, 1).join(part(b, 2).drop("graph_id"), "sample_id").withColumn("same", (F.col("u1") == F.col("u2")) & (F.col("v1") == F.col("v2")) & (F.col("k1") == F.col("k2"))))
    starts = both.select("graph_id", F.explode(F.array("u1", "v1")).alias("nid"))
    paths = shortest_paths(edges.select("graph_id", "u", "v", C.length(F.col("curve")).alias("length")), starts)
    paths = settled(paths.select("graph_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "dist").distinct())
    return path_between(both, paths).select("sample_id", "path")


def apls_samples(edges: DataFrame, other: DataFrame, pairs: int, seed: int, max_distance: float = 5.0) -> DataFrame:
    """``(sample_id, category, path, other_path, score)`` of ``pairs`` random pairs of positions on ``edges`` against ``other``.

    Category A: an end has nothing of the other graph within ``max_distance``; B: there is a path here, but not there; C: there are
    both, and the score is how alike their lengths are. A and B score 0. Pairs without a path here are left out, as they ask nothing.
    """
    ends = settled(position_pairs(edges, other, pairs, seed))
    here = _between(ends, edges, "", "offset", "length").where("path is not null")
    there = _between(ends.where("tu is not null"), other, "t", "toffset", "tlength").withColumnRenamed("path", "other_path")
    far = ends.groupBy("sample_id").agg(*[F.max(F.when(F.col("side") == s, F.col("distance"))).alias(f"n{s}") for s in (1, 2)])
    rows = here.join(far, "sample_id").join(there, "sample_id", "left")
    kind = category(F.coalesce("n1", F.lit(float("inf"))), F.coalesce("n2", F.lit(float("inf"))), F.col("other_path"), max_distance)
    score = F.when(F.col("category") == "C", sample_score(F.col("path"), F.col("other_path"))).otherwise(0.0)
    return rows.withColumn("category", kind).withColumn("score", score).select("sample_id", "category", "path", "other_path", "score")


def symmetric_apls(forward: DataFrame, backward: DataFrame, prime: bool = False) -> DataFrame:
    """The mean of both directions' scores."""
    both = apls(forward, prime=prime).unionByName(apls(backward, prime=prime))
    return both.agg(F.avg("apls").alias("apls"), F.sum("n_samples").alias("n_samples"))


def marks_around(edges: DataFrame, seeds: DataFrame, interval: float = 5.0, radius: float = 300.0) -> DataFrame:
    """``(seed, y, x)``: marks at every ``interval`` of path length from ``seeds(seed, graph_id, u, v, k, offset)`` up to ``radius``.

    A mark stands on an edge wherever the shorter way to it, over either end or along the seed's own edge, has a whole number of
    intervals. The seed itself is one.
    """
    own = settled(edges.select("graph_id", "u", "v", "k", "curve", C.length(F.col("curve")).alias("length")))
    at = settled(seeds.join(own.select("graph_id", "u", "v", "k", "length"), ["graph_id", "u", "v", "k"]))
    ends = at.select("seed", "graph_id", F.inline(F.array(F.struct(F.col("u").alias("nid"), F.col("offset").alias("extra")), F.struct(F.col("v").alias("nid"), (F.col("length") - F.col("offset")).alias("extra")))))
    paths = shortest_paths(own.select("graph_id", "u", "v", "length"), ends.select("graph_id", "nid")).withColumnRenamed("u", "nid")
    near = ends.join(paths, ["graph_id", "nid"]).groupBy("seed", "graph_id", F.col("v").alias("nid")).agg(F.min(F.col("dist") + F.col("extra")).alias("far")).where(F.col("far") <= radius)
    near = settled(near)
    a, b = (own.join(near.select("seed", "graph_id", F.col("nid").alias(e), F.col("far").alias(f"far_{e}")), ["graph_id", e]) for e in ("u", "v"))
    met = a.unionByName(b, allowMissingColumns=True)
    reach = met.groupBy("seed", "graph_id", "u", "v", "k").agg(F.min("far_u").alias("far_u"), F.min("far_v").alias("far_v"), F.first("curve").alias("curve"), F.first("length").alias("length"))
    mine = at.select("seed", "graph_id", "u", "v", "k", F.col("offset").alias("own"))
    reach = reach.join(mine, ["seed", "graph_id", "u", "v", "k"], "full").drop("curve", "length").join(own, ["graph_id", "u", "v", "k"])
    inf = F.lit(float("inf"))

    def way(o: Column) -> Column:
        own_way = F.when(F.col("own").isNotNull(), F.abs(o - F.col("own"))).otherwise(inf)
        return F.least(F.coalesce("far_u", inf) + o, F.coalesce("far_v", inf) + F.col("length") - o, own_way)

    def offsets(start: Column, sign: int, zero: Column) -> Column:
        """Places where a way that grows from ``start`` at ``zero`` has whole intervals."""
        steps = F.when(start <= radius, F.sequence(F.ceil((start - 1e-9) / interval).cast("long"), F.floor((F.least(start + F.col("length"), F.lit(radius)) + 1e-9) / interval).cast("long")))
        steps = F.when(F.ceil((start - 1e-9) / interval) <= F.floor((F.least(start + F.col("length"), F.lit(radius)) + 1e-9) / interval), steps)
        return F.coalesce(F.transform(steps, lambda i: zero + sign * (i * interval - start)), F.array().cast("array<double>"))

    every = F.concat(
        offsets(F.col("far_u"), 1, F.lit(0.0)), offsets(F.col("far_v"), -1, F.col("length")),
        F.when(F.col("own").isNotNull(), F.concat(offsets(F.lit(0.0), 1, F.col("own")), offsets(F.lit(0.0), -1, F.col("own")))).otherwise(F.array().cast("array<double>")),
    )
    spots = reach.select("*", F.explode(every).alias("o")).where((F.col("o") >= -1e-9) & (F.col("o") <= F.col("length") + 1e-9))
    whole = F.abs(way(F.col("o")) / interval - F.round(way(F.col("o")) / interval)) <= 1e-6
    spots = spots.where(whole & (way(F.col("o")) <= radius + 1e-9))
    fraction = F.when(F.col("length") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("o") / F.col("length")))).otherwise(0.0)
    placed = spots.select("seed", C.position_at(F.col("curve"), fraction).alias("p")).select("seed", F.round("p.y", 6).alias("y"), F.round("p.x", 6).alias("x"))
    return placed.distinct()


def topo_sampling(edges: DataFrame, other: DataFrame, seeds: int, seed: int, interval: float = 5.0, radius: float = 300.0, reach: float = 5.5, most: float = 50.0) -> DataFrame:
    """``(seed, tp, fp, fn)`` for random places on ``edges``: holes there, marbles from the nearest place of ``other``, matched.

    A seed that has nothing of the other graph within ``most`` has no marbles, and all of its holes are missed.
    """
    ends = settled(position_pairs(edges, other, -(-seeds // 2), seed, most).withColumn("seed", F.col("sample_id") * 2 + F.col("side") - 1).where(F.col("seed") < seeds))
    holes = marks_around(edges, ends.select("seed", "graph_id", "u", "v", "k", "offset"), interval, radius)
    there = ends.where(F.col("distance") <= most).select("seed", "graph_id", F.col("tu").alias("u"), F.col("tv").alias("v"), F.col("tk").alias("k"), F.col("toffset").alias("offset"))
    return topo_samples(holes, marks_around(other, there, interval, radius), reach)
