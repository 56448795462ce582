"""Structural operators on graphs as node and edge DataFrames; every one works on all graph_ids at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import curve as C
from ..scratch import settled
from .spatial import radius_join


def canonical(edges: DataFrame) -> DataFrame:
    """Edges with u <= v, their curves turned to run from u to v."""
    turned = F.col("u") > F.col("v")
    out = edges.withColumn("_u", F.least("u", "v")).withColumn("_v", F.greatest("u", "v"))
    if "curve" in edges.columns:
        out = out.withColumn("curve", F.when(turned, F.reverse("curve")).otherwise(F.col("curve")))
    return out.withColumn("u", F.col("_u")).withColumn("v", F.col("_v")).drop("_u", "_v")


def annotate(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Straight curves where none is given, lengths, and no self-loops of (nearly) no length."""
    at = nodes.select("graph_id", "nid", F.struct("y", "x").alias("p"))
    e = canonical(edges).join(at.select("graph_id", F.col("nid").alias("u"), F.col("p").alias("pu")), ["graph_id", "u"]).join(at.select("graph_id", F.col("nid").alias("v"), F.col("p").alias("pv")), ["graph_id", "v"])
    if "curve" not in edges.columns:
        e = e.withColumn("curve", F.lit(None).cast("array<struct<y:double,x:double>>"))
    e = e.withColumn("curve", F.coalesce("curve", F.array("pu", "pv"))).drop("pu", "pv")
    e = e.withColumn("length", C.length(F.col("curve")))
    return e.where(~((F.col("u") == F.col("v")) & (F.col("length") <= 1e-4)))


def incidence(edges: DataFrame) -> DataFrame:
    """A row for each end of each edge: (graph_id, nid, other)."""
    return edges.select("graph_id", F.explode(F.array(F.struct(F.col("u").alias("nid"), F.col("v").alias("other")), F.struct(F.col("v").alias("nid"), F.col("u").alias("other")))).alias("i")).select("graph_id", "i.nid", "i.other")


def degrees(edges: DataFrame) -> DataFrame:
    """(graph_id, nid, degree, neighbours, loops); a self-loop counts twice."""
    return incidence(edges).groupBy("graph_id", "nid").agg(
        F.count("*").alias("degree"), F.count_distinct("other").alias("neighbours"), F.sum((F.col("nid") == F.col("other")).cast("int")).alias("loops")
    )


def endpoints(edges: DataFrame) -> DataFrame:
    """Nodes where chains end: with a self-loop, or not exactly two neighbours by two edges."""
    return degrees(edges).withColumn("is_endpoint", (F.col("loops") > 0) | (F.col("neighbours") != 2) | (F.col("degree") != 2))


def multi_edges(edges: DataFrame) -> DataFrame:
    """Node pairs with more than one edge."""
    return canonical(edges).groupBy("graph_id", "u", "v").agg(F.count("*").alias("n_edges")).where("n_edges > 1")


def keyed(edges: DataFrame, *order: str) -> DataFrame:
    """``k`` numbers parallel edges from 0."""
    return edges.withColumn("k", F.row_number().over(Window.partitionBy("graph_id", "u", "v").orderBy(*order)) - 1)


def sanitize_simplified(edges: DataFrame) -> DataFrame:
    return edges.where("u != v and k = 0")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(graph_id, nid, component): the smallest node reachable, by minimum propagation with pointer jumping."""
    ends = settled(incidence(edges).where("nid != other").distinct())
    label = settled(incidence(edges).select("graph_id", "nid").distinct().withColumn("component", F.col("nid")))
    for _ in range(rounds):
        near = ends.join(label.withColumnRenamed("nid", "other"), ["graph_id", "other"]).groupBy("graph_id", "nid").agg(F.min("component").alias("low"))
        new = label.join(near, ["graph_id", "nid"], "left").select("graph_id", "nid", F.least("component", F.coalesce("low", "component")).alias("new"), F.col("component").alias("old"))
        jump = new.select("graph_id", F.col("nid").alias("new"), F.col("new").alias("far"))
        new = settled(new.join(jump, ["graph_id", "new"], "left").select("graph_id", "nid", F.coalesce("far", "new").alias("component"), "old"))
        label = new.drop("old")
        if new.where("component != old").isEmpty():
            return label
    raise RuntimeError("components did not settle")


def duplicated_nodes(nodes: DataFrame, eps: float = 0.001) -> DataFrame:
    """(nid, canonical) of nodes with another within ``eps`` on both axes: clusters are connected, the smallest id stands for all."""
    left = nodes.select(F.col("nid").alias("lid"), F.col("y").alias("ly"), F.col("x").alias("lx"))
    right = nodes.select(F.col("nid").alias("rid"), F.col("y").alias("ry"), F.col("x").alias("rx"))
    near = radius_join(left, right, eps * 1.5).where((F.col("lid") < F.col("rid")) & (F.abs(F.col("ly") - F.col("ry")) <= eps) & (F.abs(F.col("lx") - F.col("rx")) <= eps))
    links = near.select(F.lit("g").alias("graph_id"), F.col("lid").alias("u"), F.col("rid").alias("v"))
    return components(links).select("nid", F.col("component").alias("canonical"))


def deduplicate(nodes: DataFrame, edges: DataFrame, eps: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """Nodes and straight edges with duplicates relinked to the smallest id of their cluster (one graph)."""
    twin = duplicated_nodes(nodes, eps)
    kept = nodes.join(twin.where("nid != canonical").select("nid"), "nid", "left_anti").select(*nodes.columns)
    for end in ("u", "v"):
        edges = edges.join(twin.select(F.col("nid").alias(end), F.col("canonical").alias("_c")), end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    edges = canonical(edges.drop("curve", "length")).where("u != v").dropDuplicates(["graph_id", "u", "v"])
    return kept, annotate(edges, kept)


def chains(edges: DataFrame) -> DataFrame:
    """Maximal chains between endpoints: (graph_id, head, tail, n_edges, length) from edges (graph_id, u, v, length).

    Every chain edge ends at interior nodes of the same component of the graph without its endpoints; edges between two endpoints are
    chains of their own. The edges of a pure cycle, which has no endpoint, stay as they are.
    """
    marks = settled(endpoints(edges).select("graph_id", "nid", "is_endpoint"))
    m = lambda end: marks.select("graph_id", F.col("nid").alias(end), F.col("is_endpoint").alias(f"{end}_end"))
    e = settled(edges.select("graph_id", "u", "v", "length").join(m("u"), ["graph_id", "u"]).join(m("v"), ["graph_id", "v"]))
    inner = components(e.where("not u_end and not v_end"))
    e = e.withColumn("inner", F.when(~F.col("u_end"), F.col("u")).when(~F.col("v_end"), F.col("v")))
    e = e.join(inner.select("graph_id", F.col("nid").alias("inner"), "component"), ["graph_id", "inner"], "left").withColumn("component", F.coalesce("component", "inner"))
    single = e.where("u_end and v_end").select("graph_id", F.col("u").alias("head"), F.col("v").alias("tail"), F.lit(1).cast("long").alias("n_edges"), "length")
    ends = F.flatten(F.collect_list(F.array_compact(F.array(F.when(F.col("u_end"), F.col("u")), F.when(F.col("v_end"), F.col("v"))))))
    many = e.where("component is not null").groupBy("graph_id", "component").agg(ends.alias("ends"), F.count("*").alias("n_edges"), F.sum("length").alias("length"))
    cycles = many.where(F.size("ends") == 0).select("graph_id", "component")
    single = single.unionByName(e.join(cycles, ["graph_id", "component"], "left_semi").select("graph_id", F.col("u").alias("head"), F.col("v").alias("tail"), F.lit(1).cast("long").alias("n_edges"), "length"))
    return single.unionByName(many.where(F.size("ends") > 0).select("graph_id", F.array_min("ends").alias("head"), F.array_max("ends").alias("tail"), "n_edges", "length"))


def vectorize(edges: DataFrame) -> DataFrame:
    """Straight segments of every curve: (graph_id, u, v, k, part, a, b, length)."""
    s = edges.select("graph_id", "u", "v", "k", F.posexplode(C.segments(F.col("curve"))).alias("part", "s"))
    return s.select("graph_id", "u", "v", "k", "part", F.col("s.a").alias("a"), F.col("s.b").alias("b"), C.distance(F.col("s.a"), F.col("s.b")).alias("length"))


def cut_out(nodes: DataFrame, edges: DataFrame, low: tuple[float, float], high: tuple[float, float]) -> tuple[DataFrame, DataFrame]:
    """The subgraph of the nodes in a closed box, (y, x) corners."""
    inside = nodes.where(F.col("y").between(low[0], high[0]) & F.col("x").between(low[1], high[1]))
    ids = inside.select("graph_id", "nid")
    kept = edges.join(ids.withColumnRenamed("nid", "u"), ["graph_id", "u"], "left_semi").join(ids.withColumnRenamed("nid", "v"), ["graph_id", "v"], "left_semi")
    return inside, kept


def remove_deleted(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without deleted edges, deleted nodes, and the edges at deleted nodes."""
    gone = nodes.where("render = 'deleted'").select("graph_id", "nid")
    left = edges.where("render is null or render != 'deleted'")
    for end in ("u", "v"):
        left = left.join(gone.withColumnRenamed("nid", end), ["graph_id", end], "left_anti")
    return nodes.where("render is null or render != 'deleted'"), left.select(*edges.columns)


def prune(edges: DataFrame, threshold: float = 10.0, invert: bool = False) -> DataFrame:
    return edges.where(F.col("threshold") > threshold if invert else F.col("threshold") <= threshold)


def hops(edges: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """(graph_id, root, nid, depth): nodes within ``most`` edges of each root, by the fewest."""
    ends = incidence(edges).distinct()
    seen = settled(roots.select("graph_id", F.col("nid").alias("root"), "nid", F.lit(0).alias("depth")))
    front = seen
    for k in range(1, most + 1):
        step = front.join(ends, ["graph_id", "nid"]).select("graph_id", "root", F.col("other").alias("nid")).distinct()
        front = settled(step.join(seen, ["graph_id", "root", "nid"], "left_anti").withColumn("depth", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def violations(nodes: DataFrame, edges: DataFrame, utm: bool = True) -> DataFrame:
    """Counts of broken invariants by name: order, curve ends, lengths, coordinates."""
    at = nodes.select("graph_id", "nid", F.struct("y", "x").alias("p"))
    e = edges.join(at.select("graph_id", F.col("nid").alias("u"), F.col("p").alias("pu")), ["graph_id", "u"], "left").join(at.select("graph_id", F.col("nid").alias("v"), F.col("p").alias("pv")), ["graph_id", "v"], "left")
    fails = lambda c: F.coalesce(F.sum(F.when(c, 0).otherwise(1)), F.lit(0)).cast("long")
    checks = e.agg(
        fails(F.col("u") <= F.col("v")).alias("order"), fails(F.col("curve")[0] == F.col("pu")).alias("head"), fails(F.element_at("curve", -1) == F.col("pv")).alias("tail"),
        fails((F.col("length") > 0.0001) & (F.col("length") < 10000)).alias("length"),
    )
    low = nodes.agg(fails((F.col("y") > 100) & (F.col("x") > 100) | F.lit(not utm)).alias("coordinates"))
    return checks.crossJoin(F.broadcast(low)).unpivot([], ["order", "head", "tail", "length", "coordinates"], "invariant", "violations")  # one row each


def drop_small_parts(edges: DataFrame, least_nodes: int = 2, least_length: float = 150.0, spur: float = 30.0) -> DataFrame:
    """Without components that are too small or short, and without short spurs at junctions (graph_id, u, v, length)."""
    part = components(edges)
    with_part = edges.join(part.select("graph_id", F.col("nid").alias("u"), "component"), ["graph_id", "u"])
    size = part.groupBy("graph_id", "component").agg(F.count("*").alias("n_nodes"))
    whole = with_part.groupBy("graph_id", "component").agg(F.sum("length").alias("total"))
    fine = size.join(whole, ["graph_id", "component"]).where((F.col("n_nodes") >= least_nodes) & (F.col("total") > least_length))
    left = with_part.join(fine.select("graph_id", "component"), ["graph_id", "component"], "left_semi").select(*edges.columns)
    d = degrees(left).select("graph_id", "nid", "degree")
    for end in ("u", "v"):
        left = left.join(d.select("graph_id", F.col("nid").alias(end), F.col("degree").alias(f"d{end}")), ["graph_id", end])
    is_spur = (F.least("du", "dv") == 1) & (F.greatest("du", "dv") >= 3) & (F.col("length") < spur)
    return left.where(~is_spur).select(*edges.columns)
