"""Conflation of a base graph with a coverage-annotated patch graph: inject, delete, reconnect."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import curve as C
from ..scratch import settled
from .coverage import edge_coverage
from .spatial import box_join, point_box
from .structure import incidence, vectorize

NODE = "graph_id string, nid long, y double, x double, render string, origin string"
EDGE = "graph_id string, u long, v long, k int, curve array<struct<y:double,x:double>>, render string, origin string"


def _nearest(curve: np.ndarray, p: np.ndarray) -> tuple[float, np.ndarray, int, float]:
    a, d = curve[:-1], np.diff(curve, axis=0)
    size = (d * d).sum(1)
    t = np.clip(np.divide(((p - a) * d).sum(1), size, out=np.zeros(len(d)), where=size > 1e-12), 0, 1)
    q = a + t[:, None] * d
    r = np.hypot(*(q - p).T)
    k = int(r.argmin())
    return float(r[k]), q[k], k, float(t[k])


def reconnect_graph(nodes: pd.DataFrame, edges: pd.DataFrame, starts: list[int], render: str, origin: str, node_origin: str, distance: float = 10.0) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Connects each start (ascending) to its nearest target node or, if an edge is over ``distance`` nearer, to a cut in it.

    Targets are the rows whose ``target`` is set; later starts see the cuts of earlier ones, which makes this step sequential.
    """
    place = {r.nid: np.array([r.y, r.x]) for r in nodes.itertuples()}
    graph = nodes["graph_id"].iloc[0] if len(nodes) else ""
    live = {(r.u, r.v, r.k): [np.array([[p["y"], p["x"]] for p in r.curve]), r.render, r.origin, r.target] for r in edges.itertuples()}
    targets = set(nodes.loc[nodes["target"], "nid"])
    fresh = (max(place) if place else 0) + 1
    added = []
    for s in sorted(starts):
        p = place[s]
        near = min(((float(np.hypot(*(place[n] - p))), n) for n in targets if n != s), default=None)
        cut = min(((*_nearest(e[0], p), key) for key, e in live.items() if e[3] and s not in key[:2]), key=lambda c: (c[0], c[4]), default=None)
        if near is None and cut is None:
            continue
        if cut is not None and (near is None or near[0] - cut[0] > distance):
            _, q, part, _, key = cut
            curve, *rest = live.pop(key)
            place[fresh] = q
            targets.add(fresh)
            added.append((graph, fresh, q[0], q[1], "connection", node_origin))
            live[(key[0], fresh, 0)] = [np.vstack([curve[: part + 1], q]), *rest]
            live[(key[1], fresh, 0)] = [np.vstack([curve[part + 1 :][::-1], q]), *rest]
            end, fresh = fresh, fresh + 1
        else:
            end = near[1]
        a, b = min(s, end), max(s, end)
        k = 1 + max((key[2] for key in live if key[:2] == (a, b)), default=-1)
        live[(a, b, k)] = [np.array([place[a], place[b]]), render, origin, False]
    out = pd.DataFrame([(graph, u, v, k, [{"y": float(y), "x": float(x)} for y, x in c], r, o) for (u, v, k), (c, r, o, _) in live.items()], columns=["graph_id", "u", "v", "k", "curve", "render", "origin"])
    names = ["graph_id", "nid", "y", "x", "render", "origin"]
    return pd.DataFrame(nodes[names].values.tolist() + added, columns=names), out


def _reconnected(nodes: DataFrame, edges: DataFrame, starts: DataFrame, render: str, origin: str, node_origin: str) -> tuple[DataFrame, DataFrame]:
    """``reconnect_graph`` for every graph_id; one graph fits a task (see README), the sweep over graphs is what is distributed."""
    rows = nodes.select(F.lit("n").alias("kind"), "graph_id", "nid", "y", "x", "render", "origin", "target")
    rows = rows.unionByName(edges.select(F.lit("e").alias("kind"), "graph_id", "u", "v", "k", "curve", "render", "origin", "target"), allowMissingColumns=True)
    rows = rows.unionByName(starts.select(F.lit("s").alias("kind"), "graph_id", "nid"), allowMissingColumns=True)
    rows = rows.withColumn("curve", F.coalesce("curve", F.array().cast("array<struct<y:double,x:double>>")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = {k: pdf[pdf["kind"] == k] for k in "nes"}
        n = part["n"][["graph_id", "nid", "y", "x", "render", "origin", "target"]].astype({"nid": "int64", "target": bool})
        e = part["e"][["u", "v", "k", "curve", "render", "origin", "target"]].astype({"u": "int64", "v": "int64", "k": "int64", "target": bool})
        new_nodes, new_edges = reconnect_graph(n, e, part["s"]["nid"].astype("int64").tolist(), render, origin, node_origin)
        out = [{"kind": "n", "curve": [], **r} for r in new_nodes.to_dict("records")] + new_edges.assign(kind="e").to_dict("records")
        frame = pd.DataFrame(out, columns=["kind", "graph_id", "nid", "y", "x", "u", "v", "k", "curve", "render", "origin"])
        frame["graph_id"] = pdf["graph_id"].iloc[0]
        return frame.astype({"nid": "Int64", "u": "Int64", "v": "Int64", "k": "Int64"})

    schema = "kind string, graph_id string, nid long, y double, x double, u long, v long, k int, curve array<struct<y:double,x:double>>, render string, origin string"
    both = settled(rows.groupBy("graph_id").applyInPandas(run, schema))
    return both.where("kind = 'n'").select("graph_id", "nid", "y", "x", "render", "origin"), both.where("kind = 'e'").select("graph_id", "u", "v", "k", "curve", "render", "origin")


def fuse(base_nodes: DataFrame, base_edges: DataFrame, patch_nodes: DataFrame, patch_edges: DataFrame, threshold: float = 20.0, covered_injection_only: bool = False) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Variants a (patch edges over ``threshold`` injected), b (base edges that they cover marked deleted), c (loose ends reconnected).

    Patch ids must lie past the base's. ``patch_edges`` carries ``threshold``, its coverage by the base.
    """
    above = patch_edges.where(F.col("threshold") > threshold)
    if covered_injection_only:
        # places are nodes, so that patch edges meet where they share one
        back = settled(vectorize(above).select(F.col("graph_id").alias("tgraph"), F.xxhash64("a").alias("tu"), F.xxhash64("b").alias("tv"), "a", "b", "u", "v", "k"))
        cover = edge_coverage(base_edges.select("graph_id", "u", "v", "k", "curve"), back.select("tgraph", "tu", "tv", "a", "b"), int(threshold))
        used = cover.where(F.col("threshold") <= threshold).select("graph_id", F.explode("covered_by").alias("c")).select(F.col("graph_id").alias("tgraph"), F.col("c.u").alias("lo"), F.col("c.v").alias("hi")).distinct()
        ends = back.withColumn("lo", F.least("tu", "tv")).withColumn("hi", F.greatest("tu", "tv"))
        keep = ends.join(used.hint("merge"), ["tgraph", "lo", "hi"], "left_semi").select(F.col("tgraph").alias("graph_id"), "u", "v", "k").distinct()
        above = above.join(keep.hint("merge"), ["graph_id", "u", "v", "k"], "left_semi")
    below = patch_edges.where(F.col("threshold") <= threshold)
    starts = incidence(above).select("graph_id", "nid").distinct().join(incidence(below).select("graph_id", "nid").distinct().hint("merge"), ["graph_id", "nid"], "left_semi")
    used = incidence(above).select("graph_id", "nid").distinct()
    mark = lambda df, render, origin: df.withColumn("render", F.lit(render)).withColumn("origin", F.lit(origin))
    nodes = mark(base_nodes.select("graph_id", "nid", "y", "x"), "original", "C").withColumn("target", F.lit(True)).unionByName(
        mark(patch_nodes.select("graph_id", "nid", "y", "x").join(used.hint("merge"), ["graph_id", "nid"], "left_semi"), "injected", "B").withColumn("target", F.lit(False)))
    cols = ["graph_id", "u", "v", F.col("k").cast("int").alias("k"), "curve"]
    edges = mark(base_edges.select(*cols), "original", "C").withColumn("target", F.lit(True)).unionByName(mark(above.select(*cols), "injected", "B").withColumn("target", F.lit(False)))
    a_nodes, a_edges = _reconnected(nodes, edges, starts, "connection", "B", "C")
    # delete: base edges that the injected ones cover, unless a dead end of the patch needs them
    own = (F.col("origin") == "B") | (F.col("render") == "connection")
    patch, rest = a_edges.where(own), a_edges.where(~own)
    seg = vectorize(patch).select(F.col("graph_id").alias("tgraph"), F.concat_ws("_", "u", "v", "k", "part").alias("id"), "a", "b", "part")
    seg = seg.select("tgraph", F.xxhash64("a").alias("tu"), F.xxhash64("b").alias("tv"), "a", "b")
    cover = settled(edge_coverage(rest.select("graph_id", "u", "v", "k", "curve"), seg, int(threshold)))
    ends = incidence(a_edges.where("origin = 'B'")).groupBy("graph_id", "nid").count().where("count = 1").join(a_nodes.select("graph_id", "nid", "y", "x").hint("merge"), ["graph_id", "nid"])
    tips = ends.select(F.col("graph_id").alias("tip_graph"), F.struct("y", "x").alias("p"), point_box("y", "x").alias("lbox"))
    near = box_join(tips, rest.withColumn("rbox", C.bounding_box(F.col("curve"))), float(threshold), float(max(threshold, 1.0)), by=("tip_graph", "graph_id"))
    far = near.where(F.array_max(F.transform("curve", lambda q: C.distance(q, F.col("p")))) <= threshold)
    spared = far.select("graph_id", "u", "v", "k").distinct()
    covered = cover.where(F.col("threshold") <= threshold)
    gone = settled(covered.join(spared.hint("merge"), ["graph_id", "u", "v", "k"], "left_anti").select("graph_id", "u", "v", "k", F.lit(True).alias("gone"), "covered_by"))
    kept_nodes = incidence(cover.where(F.col("threshold") > threshold)).select("graph_id", "nid").distinct()
    gone_nodes = settled(incidence(covered).select("graph_id", "nid").distinct().join(kept_nodes.hint("merge"), ["graph_id", "nid"], "left_anti").withColumn("gone", F.lit(True)))
    b_edges = settled(a_edges.join(gone.drop("covered_by").hint("merge"), ["graph_id", "u", "v", "k"], "left").withColumn("render", F.when(F.col("gone"), "deleted").otherwise(F.col("render"))).drop("gone"))
    b_nodes = settled(a_nodes.join(gone_nodes.hint("merge"), ["graph_id", "nid"], "left").withColumn("render", F.when(F.col("gone"), "deleted").otherwise(F.col("render"))).drop("gone"))
    # reconnect: nodes left at two deleted edges that one patch element covers
    parts = gone.select("graph_id", F.explode(F.array("u", "v")).alias("nid"), "u", "v", "k", F.explode("covered_by").alias("c"))
    loose = parts.groupBy("graph_id", "nid", "c").agg(F.count_distinct("u", "v", "k").alias("n")).where("n >= 2").select("graph_id", "nid").distinct().join(gone_nodes.select("graph_id", "nid").hint("merge"), ["graph_id", "nid"], "left_anti")
    c_nodes, c_edges = _reconnected(b_nodes.withColumn("target", F.col("origin") == "B"), b_edges.withColumn("target", F.col("origin") == "B"), loose, "connection", "C", "B")
    return {"a": (a_nodes, a_edges), "b": (b_nodes, b_edges), "c": (c_nodes, c_edges)}


def action_counts(edges: DataFrame, *groups: str) -> DataFrame:
    """Edges by what was done to them; totals with and without the deleted ones."""
    n = lambda r: F.sum(F.when(F.col("render") == r, 1).otherwise(0)).alias(r)
    return edges.groupBy(*groups).agg(n("original"), n("injected"), n("connection"), n("deleted"), F.count("*").alias("total"), F.sum(F.when(F.col("render") != "deleted", 1).otherwise(0)).alias("live"))
