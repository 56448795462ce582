"""Whole-graph operators: attributes, subgraphs, cutting, contraction with curves, projection and distances.

Nodes are ``(graph_id, nid, y, x, ...)``, edges ``(graph_id, u, v, k, curve, ...)``; all graph_ids are worked on at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import curve as C
from ..functions import geodesy as G
from ..scratch import settled
from . import coverage, spatial, structure

KEY = ["graph_id", "u", "v", "k"]


def filter_by_attributes(rows: DataFrame, **wanted: object) -> DataFrame:
    """The nodes or edges whose attributes have the given values; None asks for null."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]).eqNullSafe(F.lit(kv[1]))), wanted.items(), rows)


def set_attributes(rows: DataFrame, values: dict[str, object], ids: DataFrame | None = None) -> DataFrame:
    """``rows`` with the given attribute values; where ``ids`` (their key columns) is given, on those rows only."""
    if ids is None:
        return rows.withColumns({c: F.lit(v) for c, v in values.items()})
    marked = rows.join(ids.distinct().withColumn("_hit", F.lit(True)), ids.columns, "left")
    for c, v in values.items():
        old = F.col(c) if c in rows.columns else F.lit(None)
        marked = marked.withColumn(c, F.when(F.col("_hit"), F.lit(v)).otherwise(old))
    return marked.drop("_hit").select(*rows.columns, *[c for c in values if c not in rows.columns])


def attributes_of(rows: DataFrame, ids: DataFrame, *names: str) -> DataFrame:
    """The named attributes of the rows with the given ids."""
    return rows.join(ids.distinct(), ids.columns, "left_semi").select(*ids.columns, *names)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two sets has."""
    key = a.columns
    both = a.distinct().withColumn("_a", F.lit(1)).unionByName(b.distinct().withColumn("_a", F.lit(2)))
    return both.groupBy(*key).agg(F.count("*").alias("_n")).where("_n = 1").select(*key)


def incident_edges(edges: DataFrame, nids: DataFrame) -> DataFrame:
    """``(graph_id, nid, u, v, k)``: the edges at each of ``nids(graph_id, nid)``; a self-loop once."""
    ends = edges.select(*KEY, F.explode(F.array_distinct(F.array("u", "v"))).alias("nid"))
    return ends.join(nids.distinct(), ["graph_id", "nid"]).select("graph_id", "nid", "u", "v", "k")


def positions(nodes: DataFrame) -> DataFrame:
    return nodes.select("graph_id", "nid", "y", "x")


def node_at(nodes: DataFrame) -> DataFrame:
    """``(graph_id, y, x, nid)``: the last node, by id, at each position."""
    return nodes.groupBy("graph_id", "y", "x").agg(F.max("nid").alias("nid"))


def region(nodes: DataFrame) -> DataFrame:
    """Bounding box and middle latitude (the mean of y) of each graph."""
    return nodes.groupBy("graph_id").agg(F.min("y").alias("miny"), F.min("x").alias("minx"), F.max("y").alias("maxy"), F.max("x").alias("maxx"), F.avg("y").alias("middle"))


def square(miny: Column, minx: Column, maxy: Column, maxx: Column) -> Column:
    """A box whose short side is widened to the long one, by the floor of half the gap below and the ceiling above."""
    gap = (maxy - miny) - (maxx - minx)
    y, x = F.greatest(-gap, F.lit(0.0)) / 2, F.greatest(gap, F.lit(0.0)) / 2
    return F.struct((miny - F.floor(y)).alias("miny"), (minx - F.floor(x)).alias("minx"), (maxy + F.ceil(y)).alias("maxy"), (maxx + F.ceil(x)).alias("maxx"))


def _projected(nodes: DataFrame, edges: DataFrame, move) -> tuple[DataFrame, DataFrame]:
    """Positions and curves moved by ``move(y, x, zone)``, the zone being that of the graph's mean longitude (``zone`` in the result)."""

    def point(p: Column) -> Column:
        y, x = move(p["y"], p["x"], F.col("zone"))
        return F.struct(y.alias("y"), x.alias("x"))

    nodes = nodes.withColumn("_p", point(F.struct("y", "x"))).withColumns({"y": F.col("_p.y"), "x": F.col("_p.x")}).drop("_p")
    return nodes, edges.withColumn("curve", F.transform("curve", point)).withColumn("length", C.length(F.col("curve")))


def to_utm(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From degrees to metres, each graph in the zone of its mean longitude, which both results carry as ``zone``."""
    zones = nodes.groupBy("graph_id").agg(F.avg("x").alias("lon")).select("graph_id", G.utm_zone(F.col("lon")).alias("zone"))
    return _projected(nodes.join(zones, "graph_id"), edges.join(zones, "graph_id"), G.utm_from_latlon)


def to_latlon(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Back to degrees, by each row's ``zone``."""
    back_nodes, back_edges = _projected(nodes, edges, G.latlon_from_utm)
    return back_nodes.drop("zone"), back_edges.drop("zone")


def near_curve(edges: DataFrame, curve: Column, reach: float) -> DataFrame:
    """The edges whose box meets a curve's box, padded by ``reach``."""
    return edges.where(C.boxes_overlap(C.bounding_box(curve, reach), C.bounding_box(F.col("curve"))))


def near_graph(edges: DataFrame, other: DataFrame, reach: float, size: float | None = None) -> DataFrame:
    """The edges whose box meets that of any edge of ``other`` (of the same graph_id), padded by ``reach``."""
    left = other.select(F.col("graph_id").alias("lgraph"), C.bounding_box(F.col("curve")).alias("lbox"))
    right = edges.select(*KEY, C.bounding_box(F.col("curve")).alias("rbox"))
    hit = spatial.box_join(left, right, reach, size or max(reach, 1.0), by=("lgraph", "graph_id")).select(*KEY).distinct()
    return edges.join(hit, KEY, "left_semi")


def distances(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs(graph_id, u, v)`` with the straight distance of the two nodes."""
    at = lambda end: nodes.select("graph_id", F.col("nid").alias(end), F.struct("y", "x").alias(f"_{end}"))
    both = pairs.join(at("u"), ["graph_id", "u"]).join(at("v"), ["graph_id", "v"])
    return both.withColumn("distance", C.distance(F.col("_u"), F.col("_v"))).select(*pairs.columns, "distance")


def edge_distances(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs(graph_id, u, v, k, y, x)`` with the distance of the position from the edge, where it is nearest, and at which fraction."""
    near = C.nearest_on_curve(F.col("curve"), F.struct("y", "x"))
    found = pairs.join(edges.select(*KEY, "curve"), KEY).withColumn("_n", near)
    return found.select(*pairs.columns, F.col("_n.distance").alias("distance"), F.col("_n.y").alias("near_y"), F.col("_n.x").alias("near_x"), F.col("_n.fraction").alias("fraction"))


def nearest_position(points: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """``(lid, u, v, k, distance, near_y, near_x, fraction)``: the nearest place on any edge for ``points(lid, graph_id, y, x)``.

    Of equally near edges the one with the smallest key hash counts; graphs without edges give no row.
    """
    name = F.xxhash64(*KEY)
    left = points.select("lid", F.col("graph_id").alias("lgraph"), F.col("y").alias("ly"), F.col("x").alias("lx"))
    right = edges.select(name.alias("rid"), "graph_id", "curve")
    left = left.withColumn("lbox", spatial.point_box("ly", "lx"))
    right = right.withColumn("rbox", C.bounding_box(F.col("curve")))
    away = C.nearest_on_curve(F.col("curve"), C.point(F.col("ly"), F.col("lx")))["distance"]
    near = spatial.nearest(left, right, F.when(F.col("lgraph") == F.col("graph_id"), away), radius).select("lid", "rid")
    asked = near.join(points, "lid").join(edges.select(name.alias("rid"), "u", "v", "k"), "rid").select("lid", *KEY, "y", "x")
    return edge_distances(asked, edges).select("lid", "u", "v", "k", "distance", "near_y", "near_x", "fraction")


def numbered(rows: DataFrame, count: Column, order: list[str], buckets: int = 1024) -> DataFrame:
    """``rows`` with ``before``: how many numbers all earlier rows of the graph took, in two levels, so that no task sorts a graph."""
    rows = rows.withColumn("_n", count.cast("long")).withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    parts = rows.groupBy("graph_id", "_b").agg(F.sum("_n").alias("_part"))
    upto = F.sum("_part").over(Window.partitionBy("graph_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("graph_id", "_b", F.coalesce(upto, F.lit(0)).alias("_upto"))
    own = F.sum("_n").over(Window.partitionBy("graph_id", "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_own", F.coalesce(own, F.lit(0))).join(parts, ["graph_id", "_b"]).withColumn("before", F.col("_upto") + F.col("_own")).drop("_n", "_b", "_own", "_upto")


def relabelled(nodes: DataFrame, edges: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """New node ids from ``first`` on in each graph; edges follow and keep u <= v."""
    new = settled(numbered(nodes.select("graph_id", "nid"), F.lit(1), ["nid"]).select("graph_id", "nid", (F.col("before") + first).alias("new")))
    moved = edges
    for end in ("u", "v"):
        moved = moved.join(new.withColumnsRenamed({"nid": end, "new": "_new"}), ["graph_id", end]).withColumn(end, F.col("_new")).drop("_new")
    kept = nodes.join(new, ["graph_id", "nid"]).withColumn("nid", F.col("new")).drop("new")
    return kept.select(*nodes.columns), structure.canonical(moved.select(*edges.columns))


def replace_by_parts(nodes: DataFrame, edges: DataFrame, parts: Column) -> tuple[DataFrame, DataFrame]:
    """Every edge replaced by its parts, an array of curves that follow one another; one part leaves an edge as it is.

    New nodes stand between parts, with ids after the graph's largest and the other attributes of the edge's ``u``. Every part has the
    edge's other attributes, its own length, and ``cut_from``, the key of the edge that it is part of.
    """
    top = nodes.groupBy("graph_id").agg(F.max("nid").alias("_top"))
    cut = numbered(edges.withColumn("_parts", parts), F.size("_parts") - 1, ["u", "v", "k"]).join(top, "graph_id")
    cut = settled(cut.withColumn("_first", F.col("_top") + F.col("before") + 1).drop("before", "_top"))
    many = cut.where(F.size("_parts") > 1).select("*", F.posexplode("_parts").alias("_i", "_c")).withColumn("_last", F.size("_parts") - 1)
    rest = [c for c in edges.columns if c not in (*KEY, "curve", "length")]
    own = F.struct(*[F.col(c).alias(c) for c in ("u", "v", "k")])
    a = F.when(F.col("_i") == 0, F.col("u")).otherwise(F.col("_first") + F.col("_i") - 1)
    b = F.when(F.col("_i") == F.col("_last"), F.col("v")).otherwise(F.col("_first") + F.col("_i"))
    pieces = many.select("graph_id", a.alias("u"), b.alias("v"), F.lit(0).alias("k"), F.col("_c").alias("curve"), *rest, own.alias("cut_from"))
    whole = cut.where(F.size("_parts") <= 1).select("graph_id", "u", "v", F.col("k").cast("int").alias("k"), "curve", *rest, F.lit(None).cast("struct<u:bigint,v:bigint,k:int>").alias("cut_from"))
    pieces = structure.canonical(pieces.withColumn("cut_from", F.col("cut_from").cast("struct<u:bigint,v:bigint,k:int>")))
    # parallel edges of one part keep their numbers; parts of different edges share no two new ends
    out = whole.unionByName(pieces).withColumn("length", C.length(F.col("curve")))
    names = [c for c in nodes.columns if c not in ("graph_id", "nid", "y", "x")]
    at = many.where("_i > 0").select("graph_id", (F.col("_first") + F.col("_i") - 1).alias("_nid"), F.col("_c")[0].alias("_p"), F.col("u").alias("nid"))
    fresh = at.join(nodes.select("graph_id", "nid", *names), ["graph_id", "nid"]).select("graph_id", F.col("_nid").alias("nid"), F.col("_p.y").alias("y"), F.col("_p.x").alias("x"), *names)
    return nodes.select("graph_id", "nid", "y", "x", *names).unionByName(fresh), out


def vectorized(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every edge of more than two points as straight edges over new nodes."""
    return replace_by_parts(nodes, edges, F.transform(C.segments(F.col("curve")), lambda s: F.array(s["a"], s["b"])))


def cut_at(nodes: DataFrame, edges: DataFrame, fractions: Column) -> tuple[DataFrame, DataFrame]:
    """Every edge cut at fractions of its length (null or none inside (0, 1): left whole)."""
    return replace_by_parts(nodes, edges, F.when(F.size(fractions) > 0, C.cut_intervals(F.col("curve"), fractions)).otherwise(F.array("curve")))


def bounded_edges(nodes: DataFrame, edges: DataFrame, most: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """Edges longer than ``most`` cut into equal pieces that are not."""
    return replace_by_parts(nodes, edges, C.cut_max_distance(F.col("curve"), most))


def simplified(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every maximal chain contracted to one edge with the curves laid end to end, from the smaller end to the larger.

    ``path`` holds the nodes along it. Attributes that are alike on all of a chain's edges stay, others become null. A pure cycle has
    no end and stays as it is. A chain is one group: its size is that of a road between two junctions.
    """
    marks = settled(structure.endpoints(edges).select("graph_id", "nid", "is_endpoint"))
    m = lambda end: marks.select("graph_id", F.col("nid").alias(end), F.col("is_endpoint").alias(f"{end}_end"))
    e = settled(edges.join(m("u"), ["graph_id", "u"]).join(m("v"), ["graph_id", "v"]))
    inner = structure.components(e.where("not u_end and not v_end"))
    e = e.withColumn("_in", F.when(~F.col("u_end"), F.col("u")).when(~F.col("v_end"), F.col("v")))
    e = e.join(inner.select("graph_id", F.col("nid").alias("_in"), "component"), ["graph_id", "_in"], "left").withColumn("component", F.coalesce("component", "_in"))
    rest = [c for c in edges.columns if c not in (*KEY, "curve", "length")]
    single = e.where("component is null").select("graph_id", "u", "v", "curve", *rest, F.array("u", "v").alias("path"))
    schema = "graph_id string, u long, v long, curve array<struct<y:double,x:double>>, path array<long>, _group long"

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(pdf["u"].tolist(), pdf["v"].tolist(), pdf["u_end"], pdf["v_end"], pdf["curve"], strict=True))
        ends = sorted({n for u, v, a, b, _ in rows for n, end in ((u, a), (v, b)) if end})
        graph, group = pdf["graph_id"].iloc[0], pdf["component"].iloc[0]
        if not ends:
            return pd.DataFrame([(graph, u, v, list(c), [u, v], group) for u, v, _, _, c in rows], columns=["graph_id", "u", "v", "curve", "path", "_group"])
        at: dict[int, list[int]] = {}
        for i, (u, v, *_) in enumerate(rows):
            at.setdefault(u, []).append(i)
            at.setdefault(v, []).append(i)
        here, path, curve, used = ends[0], [ends[0]], [], set()
        while len(used) < len(rows):
            i = min((j for j in at[here] if j not in used), key=lambda j: rows[j][:2])
            used.add(i)
            u, v, _, _, c = rows[i]
            step = list(c) if u == here else list(c)[::-1]
            here = v if u == here else u
            path.append(here)
            curve += step[1:] if curve else step
        return pd.DataFrame([(graph, path[0], path[-1], curve, path, group)], columns=["graph_id", "u", "v", "curve", "path", "_group"])

    chained = e.where("component is not null")
    laid = chained.select("graph_id", "component", "u", "v", "u_end", "v_end", "curve").groupBy("graph_id", "component").applyInPandas(lay, schema)
    alike = [F.when((F.count_distinct(c) <= 1) & (F.count(c) == F.count("*")), F.first(c)).alias(c) for c in rest]
    kept = chained.groupBy("graph_id", F.col("component").alias("_group")).agg(F.count("*").alias("_edges"), *alike)
    laid = laid.join(kept, ["graph_id", "_group"]).select("graph_id", "u", "v", "curve", *rest, "path")
    out = settled(single.unionByName(laid).withColumn("length", C.length(F.col("curve"))))
    left = structure.incidence(out).select("graph_id", "nid").distinct()
    return nodes.join(left, ["graph_id", "nid"], "left_semi"), structure.keyed(out, "length", F.xxhash64("curve"))


def sanitized(nodes: DataFrame, edges: DataFrame, eps: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """From vectorized degrees to metres, duplicate nodes merged, chains contracted: one graph, as it is kept."""
    metres, _ = to_utm(nodes, edges)
    merged_nodes, merged = structure.deduplicate(metres, edges.select("graph_id", "u", "v"), eps)
    return simplified(merged_nodes, settled(merged.withColumn("k", F.lit(0))))


def graph_of_paths(paths: DataFrame, jitter: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """One graph from ``paths(graph_id, path_id, curve)``: a node for each point, moved by up to ``jitter`` so that paths do not touch.

    ``gid`` tells the paths apart; positions are numbered by path and place, and moved by what their number hashes to.
    """
    points = paths.select("graph_id", "path_id", F.posexplode("curve").alias("i", "p"))
    counted = numbered(paths.select("graph_id", "path_id", F.size("curve").alias("n")), F.col("n"), ["path_id"]).drop("n")
    off = lambda salt: (F.pmod(F.xxhash64("path_id", "i", F.lit(salt)), F.lit(1 << 20)) / (1 << 20) - 0.5) * 2 * jitter
    nodes = points.join(counted, ["graph_id", "path_id"]).select("graph_id", (F.col("before") + F.col("i") + 1).alias("nid"), (F.col("p.y") + off(1)).alias("y"), (F.col("p.x") + off(2)).alias("x"), F.col("path_id").alias("gid"), "i")
    following = Window.partitionBy("graph_id", "gid").orderBy("i")
    pairs = nodes.select("graph_id", F.col("nid").alias("u"), F.lead("nid").over(following).alias("v"), F.struct("y", "x").alias("a"), F.lead(F.struct("y", "x")).over(following).alias("b"), "gid")
    edges = pairs.where("v is not null").select("graph_id", "u", "v", F.lit(0).alias("k"), F.array("a", "b").alias("curve"), "gid")
    return nodes.drop("i"), edges.withColumn("length", C.length(F.col("curve")))


def crossings_over(edges: DataFrame, degree: int = 4) -> DataFrame:
    """Nodes with more than ``degree`` edges: complicated intersections."""
    return structure.degrees(edges).where(F.col("degree") > degree).select("graph_id", "nid", "degree")


def without_coverage(edges: DataFrame) -> DataFrame:
    return edges.drop("threshold", "max_threshold", "covered_by")


def with_coverage(edges: DataFrame, target: DataFrame, most: int = 50) -> DataFrame:
    """Edges with ``threshold`` and ``covered_by``: how near some path of ``target`` (edges of the same graph_id) follows each one."""
    segments = structure.vectorize(target)
    points = segments.select(F.col("graph_id").alias("tgraph"), F.xxhash64("a").alias("tu"), F.xxhash64("b").alias("tv"), "a", "b")
    found = coverage.edge_coverage(edges.select(*KEY, "curve"), points, most)
    return without_coverage(edges).join(found.hint("merge"), KEY)


def split_by_coverage(edges: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Edges over the threshold, and the others."""
    return edges.where(F.col("threshold") > threshold), edges.where(F.col("threshold") <= threshold)


def densified(edges: DataFrame, step: float) -> DataFrame:
    """Edges whose curves have further points, so that none of a segment's equal parts is longer than ``step``."""
    many = lambda s: F.greatest(F.lit(1), F.ceil(C.distance(s["a"], s["b"]) / step).cast("int"))
    at = lambda s, t: F.struct((s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"])).alias("y"), (s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"])).alias("x"))
    inner = F.flatten(F.transform(C.segments(F.col("curve")), lambda s: C.let(many(s), lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(s, i / n)))))
    return edges.withColumn("curve", F.concat(inner, F.array(F.element_at("curve", -1))))


def inserted(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(graph_id, u, v)`` with further pairs, each once and in order, without self-loops."""
    every = edges.select("graph_id", "u", "v").unionByName(pairs.select("graph_id", "u", "v"))
    return structure.canonical(every).where("u != v").distinct()


def moved_nodes(nodes: DataFrame, edges: DataFrame, shifts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes shifted by ``shifts(graph_id, nid, dy, dx)``; straight edges follow them."""
    by = shifts.groupBy("graph_id", "nid").agg(F.sum("dy").alias("dy"), F.sum("dx").alias("dx"))
    there = nodes.join(by, ["graph_id", "nid"], "left")
    there = there.withColumn("y", F.col("y") + F.coalesce("dy", F.lit(0.0))).withColumn("x", F.col("x") + F.coalesce("dx", F.lit(0.0))).select(*nodes.columns)
    return there, structure.annotate(edges.drop("curve", "length"), there)
