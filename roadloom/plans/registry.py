"""Every query of the road-network engine by name, with its SQL where SQL can express it.

The given tables stand in for road data: events are trace points, embeddings are polylines of 32 points and, by their first two
numbers, nodes; conversations are chains, lineitem is a multigraph of suppliers and parts with annotated edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import curve as C
from ..functions import geodesy as G
from ..operators import coverage, fusion, graph, metrics, spatial, structure
from ..sources import traces
from . import sweeps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("trip"), F.col("value").alias("y"), (F.col("event_id") % 97).cast("double").alias("x"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    at = lambda i: F.element_at("embedding", i).cast("double")
    curve = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(at(2 * i + 1).alias("y"), at(2 * i + 2).alias("x")))
    return e.select("vec_id", curve.alias("curve"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.lit("g").alias("graph_id"), F.col("vec_id").alias("nid"), (F.element_at("embedding", 1).cast("double") * 1000).alias("y"), (F.element_at("embedding", 2).cast("double") * 1000).alias("x"))


def short_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twentieth of each polyline's first segment, scaled like the nodes."""
    c = polylines(spark, sf_dir).select("vec_id", F.col("curve")[0].alias("p"), F.col("curve")[1].alias("q"))
    p = lambda k: F.struct(*[((F.col("p")[a] + (F.col("q")[a] - F.col("p")[a]) * k) * 1000).alias(a) for a in ("y", "x")])
    return c.select(F.col("vec_id").alias("id"), p(0.0).alias("a"), p(0.05).alias("b"))


def multigraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    t = F.ceil("l_quantity").cast("double")
    return li.select(
        F.lit("g").alias("graph_id"), F.col("l_suppkey").alias("u"), (F.col("l_partkey") + 1_000_000).alias("v"), F.col("l_quantity").alias("length"),
        F.when(t > 40, F.lit(float("inf"))).otherwise(t).alias("threshold"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus",
    )


def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("length"))
    nxt = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    e = c.select("conv_id", "turn", "length", nxt.alias("next")).where("next is not null")
    return e.select(F.col("conv_id").cast("string").alias("graph_id"), F.col("turn").alias("u"), F.col("next").alias("v"), "length")


POINTS = "p AS (SELECT user_id AS trip, value AS y, CAST(event_id % 97 AS DOUBLE) AS x, epoch_us(ts) / 1e6 AS t FROM events)"
LINES = """pts AS (SELECT vec_id, i, CAST(embedding[2*i+1] AS DOUBLE) AS y, CAST(embedding[2*i+2] AS DOUBLE) AS x FROM embeddings, range(0, 32) AS r(i)),
seg AS (SELECT vec_id, i, y, x, ny, nx, sqrt((ny-y)*(ny-y)+(nx-x)*(nx-x)) AS len FROM (SELECT *, lead(y) OVER w AS ny, lead(x) OVER w AS nx FROM pts WINDOW w AS (PARTITION BY vec_id ORDER BY i)) WHERE ny IS NOT NULL),
cum AS (SELECT *, sum(len) OVER (PARTITION BY vec_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto, sum(len) OVER (PARTITION BY vec_id) AS whole FROM seg)"""
NODES = "n AS (SELECT vec_id AS nid, CAST(embedding[1] AS DOUBLE)*1000 AS y, CAST(embedding[2] AS DOUBLE)*1000 AS x FROM embeddings)"
SHORT = """s AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE)*1000 AS ay, CAST(embedding[2] AS DOUBLE)*1000 AS ax,
  (CAST(embedding[1] AS DOUBLE) + (CAST(embedding[3] AS DOUBLE) - CAST(embedding[1] AS DOUBLE))*0.05)*1000 AS byy, (CAST(embedding[2] AS DOUBLE) + (CAST(embedding[4] AS DOUBLE) - CAST(embedding[2] AS DOUBLE))*0.05)*1000 AS bx FROM embeddings)"""
MULTI = "e AS (SELECT l_suppkey AS u, l_partkey + 1000000 AS v, l_quantity AS length, CASE WHEN ceil(l_quantity) > 40 THEN CAST('inf' AS DOUBLE) ELSE ceil(l_quantity) END AS threshold, * FROM lineitem)"
CHAIN = "e AS (SELECT * FROM (SELECT CAST(conv_id AS VARCHAR) AS graph_id, turn AS u, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS v, CAST(length(text) AS DOUBLE) AS length FROM conversations) WHERE v IS NOT NULL)"


@query(f"""WITH {POINTS}, s AS (SELECT trip, sqrt(pow(y - lag(y) OVER w, 2) + pow(x - lag(x) OVER w, 2)) AS step, t - lag(t) OVER w AS dt FROM p WINDOW w AS (PARTITION BY trip ORDER BY t)),
g AS (SELECT trip, count(*) AS n, coalesce(sum(step), 0) AS d, sum(dt) AS dt, count(dt) AS k FROM s GROUP BY trip)
SELECT count(*) AS trips, CAST(sum(n) AS BIGINT) AS samples, round(sum(d), 4) AS distance, round(avg(n), 6) AS samples_per_trip, round(avg(d), 4) AS distance_per_trip, round(sum(dt)/sum(k), 4) AS mean_interval FROM g""")
def trip_statistics(spark, sf_dir):
    s = traces.trip_statistics(points(spark, sf_dir))
    return s.select("trips", "samples", r(F.col("distance"), 4).alias("distance"), r(F.col("samples_per_trip")).alias("samples_per_trip"), r(F.col("distance_per_trip"), 4).alias("distance_per_trip"), r(F.col("mean_interval"), 4).alias("mean_interval"))


@query(f"WITH {POINTS} SELECT min(y) AS miny, min(x) AS minx, max(y) AS maxy, max(x) AS maxx FROM p")
def trip_roi(spark, sf_dir):
    return points(spark, sf_dir).agg(F.min("y").alias("miny"), F.min("x").alias("minx"), F.max("y").alias("maxy"), F.max("x").alias("maxx"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
f AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '[ \\t\\n\\x0B\\f\\r]+'), lambda s: s <> '') AS f FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, f[1] AS f1, f[2] AS f2, f[3] AS f3 FROM f WHERE len(f) = 3""")
def trip_parse_filter(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    f = F.filter(F.split("line", r"[ \t\n\x0B\f\r]+"), lambda s: s != "")
    return d.select("doc_id", "line_no", f.alias("f")).where(F.size("f") == 3).select("doc_id", "line_no", *[F.col("f")[k].alias(f"f{k + 1}") for k in range(3)])


@query(f"WITH {LINES} SELECT vec_id, round(sum(len), 6) AS length FROM seg GROUP BY vec_id")
def curve_length(spark, sf_dir):
    return polylines(spark, sf_dir).select("vec_id", r(C.length(F.col("curve"))).alias("length"))


@query(f"WITH {LINES} SELECT vec_id, min(y) AS miny, min(x) AS minx, max(y) AS maxy, max(x) AS maxx FROM pts GROUP BY vec_id")
def curve_bbox(spark, sf_dir):
    return polylines(spark, sf_dir).select("vec_id", C.bounding_box(F.col("curve")).alias("b")).select("vec_id", "b.*")


AT = "SELECT vec_id, f, round(y + (goal - (upto - len)) / len * (ny - y), 6) AS y, round(x + (goal - (upto - len)) / len * (nx - x), 6) AS x FROM (SELECT *, f * whole AS goal, row_number() OVER (PARTITION BY vec_id, f ORDER BY i) AS k FROM cum, (VALUES (0.25), (0.5), (0.9)) AS v(f) WHERE upto > f * whole) WHERE k = 1"


@query(f"WITH {LINES} SELECT vec_id, CAST(f AS DOUBLE) AS fraction, y, x FROM ({AT})")
def curve_position_at(spark, sf_dir):
    c = polylines(spark, sf_dir).select("vec_id", "curve", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9))).alias("fraction"))
    return c.select("vec_id", "fraction", C.position_at(F.col("curve"), F.col("fraction")).alias("p")).select("vec_id", "fraction", r(F.col("p.y")).alias("y"), r(F.col("p.x")).alias("x"))


# a piece's length along the original curve is a quarter of the whole; cut points keep every vertex between
@query(f"WITH {LINES}, w AS (SELECT vec_id, max(whole) AS whole FROM cum GROUP BY vec_id) SELECT vec_id, CAST(k AS INTEGER) AS piece, round(whole / 4, 6) AS length FROM w, range(0, 4) AS q(k)")
def curve_cut_pieces(spark, sf_dir):
    c = polylines(spark, sf_dir).select("vec_id", F.posexplode(C.cut_pieces(F.col("curve"), 4)).alias("piece", "part"))
    return c.select("vec_id", "piece", r(C.length(F.col("part"))).alias("length"))


@query(f"""WITH {LINES}, q AS (SELECT vec_id + 1 AS pid, y AS py, x AS px FROM pts WHERE i = 0),
t AS (SELECT s.vec_id, s.i, s.y, s.x, s.ny, s.nx, py, px, CASE WHEN abs(ny-y) < 1e-4 AND abs(nx-x) < 1e-4 THEN 0 ELSE greatest(0, least(1, ((py-y)*(ny-y)+(px-x)*(nx-x))/((ny-y)*(ny-y)+(nx-x)*(nx-x)))) END AS t FROM seg s JOIN q ON s.vec_id = q.pid)
SELECT vec_id, round(min(sqrt(pow(y+t*(ny-y)-py,2)+pow(x+t*(nx-x)-px,2))), 6) AS distance FROM t GROUP BY vec_id""")
def nearest_on_curve(spark, sf_dir):
    c = polylines(spark, sf_dir)
    q = c.select((F.col("vec_id") + 1).alias("vec_id"), F.col("curve")[0].alias("p"))
    return c.join(q, "vec_id").select("vec_id", r(C.nearest_on_curve(F.col("curve"), F.col("p"))["distance"]).alias("distance"))


@query(f"""WITH {SHORT}, b AS (SELECT id, least(ay,byy) AS miny, least(ax,bx) AS minx, greatest(ay,byy) AS maxy, greatest(ax,bx) AS maxx FROM s)
SELECT l.id AS lid, q.id AS rid FROM b l JOIN b q ON l.miny - 5 <= q.maxy AND q.miny <= l.maxy + 5 AND l.minx - 5 <= q.maxx AND q.minx <= l.maxx + 5 AND l.id < q.id""")
def bbox_range_join(spark, sf_dir):
    s = short_segments(spark, sf_dir).withColumn("box", C.bounding_box(F.array("a", "b")))
    met = spatial.box_join(s.select(F.col("id").alias("lid"), F.col("box").alias("lbox")), s.select(F.col("id").alias("rid"), F.col("box").alias("rbox")), 5.0, 20.0)
    return met.where("lid < rid").select("lid", "rid")


def _sides(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return n.select(F.col("nid").alias("lid"), F.col("y").alias("ly"), F.col("x").alias("lx")), n.select(F.col("nid").alias("rid"), F.col("y").alias("ry"), F.col("x").alias("rx"))


@query(f"""WITH {NODES} SELECT lid, rid, round(d, 6) AS distance FROM (SELECT a.nid AS lid, b.nid AS rid, sqrt(pow(a.y-b.y,2)+pow(a.x-b.x,2)) AS d, row_number() OVER (PARTITION BY a.nid ORDER BY sqrt(pow(a.y-b.y,2)+pow(a.x-b.x,2)), b.nid) AS k FROM n a JOIN n b ON a.nid <> b.nid) WHERE k = 1""")
def nearest_node(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return spatial.nearest_point(left, right, 40.0).select("lid", "rid", r(F.col("distance")).alias("distance"))


@query(f"""WITH {NODES}, {SHORT}, t AS (SELECT n.nid AS lid, n.y AS py, n.x AS px, s.*, CASE WHEN abs(byy-ay) < 1e-4 AND abs(bx-ax) < 1e-4 THEN 0 ELSE greatest(0, least(1, ((n.y-ay)*(byy-ay)+(n.x-ax)*(bx-ax))/((byy-ay)*(byy-ay)+(bx-ax)*(bx-ax)))) END AS t FROM n JOIN s ON n.nid <> s.id)
SELECT lid, round(min(sqrt(pow(ay+t*(byy-ay)-py,2)+pow(ax+t*(bx-ax)-px,2))), 6) AS distance FROM t GROUP BY lid""")
def nearest_edge(spark, sf_dir):
    left, _ = _sides(spark, sf_dir)
    curves = short_segments(spark, sf_dir).select(F.col("id").alias("rid"), F.array("a", "b").alias("curve"))
    return spatial.nearest_curve(left, curves, 40.0).select("lid", r(F.col("distance")).alias("distance"))


@query(f"WITH {NODES} SELECT a.nid AS lid, b.nid AS rid, round(sqrt(pow(a.y-b.y,2)+pow(a.x-b.x,2)), 6) AS distance FROM n a JOIN n b ON sqrt(pow(a.y-b.y,2)+pow(a.x-b.x,2)) <= 10 QUALIFY row_number() OVER (PARTITION BY a.nid ORDER BY sqrt(pow(a.y-b.y,2)+pow(a.x-b.x,2)), b.nid) <= 500")
def radius_kd_ball(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return spatial.kd_ball(left, right, 10.0, 500).select("lid", "rid", r(F.col("distance")).alias("distance"))


@query(f"WITH {NODES} SELECT nid FROM n WHERE y BETWEEN -100 AND 100 AND x BETWEEN -50 AND 150")
def roi_cut(spark, sf_dir):
    n = nodes(spark, sf_dir)
    no_edges = n.select("graph_id", F.col("nid").alias("u"), F.col("nid").alias("v"))
    return structure.cut_out(n, no_edges, (-100.0, -50.0), (100.0, 150.0))[0].select("nid")


@query(f"""WITH RECURSIVE {NODES}, p AS (SELECT a.nid AS a, b.nid AS b FROM n a JOIN n b ON a.nid <> b.nid AND abs(a.y-b.y) <= 10 AND abs(a.x-b.x) <= 10),
c AS (SELECT DISTINCT a AS nid, a AS root FROM p UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.nid)
SELECT nid, min(root) AS canonical FROM c GROUP BY nid""")
def dedupe_nodes(spark, sf_dir):
    return structure.duplicated_nodes(nodes(spark, sf_dir), 10.0)


@query(f"WITH {MULTI}, i AS (SELECT u AS nid, v AS other FROM e UNION ALL SELECT v, u FROM e) SELECT nid, count(*) AS degree, count(DISTINCT other) AS neighbours FROM i GROUP BY nid")
def node_degree(spark, sf_dir):
    return structure.degrees(multigraph(spark, sf_dir)).select("nid", "degree", "neighbours")


@query(f"WITH {CHAIN}, i AS (SELECT graph_id, u AS nid, v AS other FROM e UNION ALL SELECT graph_id, v, u FROM e) SELECT graph_id, nid, count(DISTINCT other) <> 2 OR count(*) <> 2 AS is_endpoint FROM i GROUP BY graph_id, nid")
def endpoints(spark, sf_dir):
    return structure.endpoints(chain_edges(spark, sf_dir)).select("graph_id", "nid", "is_endpoint")


@query(f"WITH {MULTI} SELECT u, v, count(*) AS n_edges FROM e GROUP BY u, v HAVING count(*) > 1")
def multi_edges(spark, sf_dir):
    return structure.multi_edges(multigraph(spark, sf_dir)).select("u", "v", "n_edges")


@query(f"WITH {MULTI} SELECT u, v, min(l_extendedprice) AS price FROM e GROUP BY u, v")
def sanitize_edges(spark, sf_dir):
    keyed = structure.keyed(structure.canonical(multigraph(spark, sf_dir)), "l_extendedprice", "l_orderkey", "l_linenumber")
    return structure.sanitize_simplified(keyed).select("u", "v", F.col("l_extendedprice").alias("price"))


@query(f"WITH {CHAIN} SELECT graph_id, min(u) AS head, max(v) AS tail, count(*) AS n_edges, sum(length) AS length FROM e GROUP BY graph_id")
def simplify_chains(spark, sf_dir):
    return structure.chains(chain_edges(spark, sf_dir))


@query(f"WITH {LINES} SELECT vec_id AS u, CAST(i AS INTEGER) AS part, round(len, 6) AS length FROM seg")
def vectorize_edges(spark, sf_dir):
    e = polylines(spark, sf_dir).select(F.lit("g").alias("graph_id"), F.col("vec_id").alias("u"), (F.col("vec_id") + 1).alias("v"), F.lit(0).alias("k"), "curve")
    return structure.vectorize(e).select("u", "part", r(F.col("length")).alias("length"))


def tree(spark, sf_dir):
    n, c = load(spark, sf_dir, "nation"), load(spark, sf_dir, "customer")
    up = n.select((F.col("n_regionkey") + 1).cast("long").alias("u"), (F.col("n_nationkey") + 100).cast("long").alias("v"))
    return up.unionAll(c.select((F.col("c_nationkey") + 100).cast("long").alias("u"), (F.col("c_custkey") + 1000).alias("v"))).select(F.lit("g").alias("graph_id"), "u", "v", F.lit(1.0).alias("length"))


@query("""WITH RECURSIVE e AS (SELECT n_regionkey + 1 AS a, n_nationkey + 100 AS b FROM nation UNION ALL SELECT c_nationkey + 100, c_custkey + 1000 FROM customer),
i AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), h AS (SELECT r_regionkey + 1 AS root, r_regionkey + 1 AS nid, 0 AS depth FROM region UNION SELECT h.root, i.b, h.depth + 1 FROM h JOIN i ON h.nid = i.a WHERE h.depth < 2),
m AS (SELECT root, nid, min(depth) AS depth FROM h GROUP BY root, nid) SELECT CAST(root AS BIGINT) AS root, depth, count(*) AS n FROM m GROUP BY root, depth""")
def khop(spark, sf_dir):
    roots = load(spark, sf_dir, "region").select(F.lit("g").alias("graph_id"), (F.col("r_regionkey") + 1).cast("long").alias("nid"))
    return structure.hops(tree(spark, sf_dir), roots, 2).groupBy("root", "depth").agg(F.count("*").alias("n"))


@query(f"WITH {CHAIN}, c AS (SELECT graph_id, u AS n, coalesce(sum(length) OVER (PARTITION BY graph_id ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM (SELECT * FROM e UNION ALL SELECT graph_id, max(v), NULL, 0 FROM e GROUP BY graph_id)) SELECT a.graph_id, a.n AS u, b.n AS v, b.at - a.at AS dist FROM c a JOIN c b ON a.graph_id = b.graph_id AND a.n <= b.n")
def shortest_paths(spark, sf_dir):
    return metrics.shortest_paths(chain_edges(spark, sf_dir))


@query(f"WITH {MULTI} SELECT u, v, threshold, count(*) AS n FROM e WHERE threshold <= 10 GROUP BY ALL")
def prune_threshold(spark, sf_dir):
    return structure.prune(multigraph(spark, sf_dir), 10.0).groupBy("u", "v", "threshold").agg(F.count("*").alias("n"))


RENDER = "CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'deleted' WHEN l_returnflag = 'A' THEN 'injected' WHEN l_linestatus = 'O' THEN 'original' ELSE 'connection' END"


def rendered(spark, sf_dir):
    return multigraph(spark, sf_dir).withColumn("render", F.expr(RENDER))


@query(f"WITH {MULTI} SELECT u, v, count(*) AS n FROM e WHERE {RENDER} <> 'deleted' AND u % 10 <> 0 GROUP BY u, v")
def remove_deleted(spark, sf_dir):
    e = rendered(spark, sf_dir)
    n = structure.incidence(e).select("graph_id", "nid").distinct().withColumn("render", F.when((F.col("nid") % 10 == 0) & (F.col("nid") < 1_000_000), "deleted").otherwise("original"))
    return structure.remove_deleted(n, e)[1].groupBy("u", "v").agg(F.count("*").alias("n"))


@query(f"WITH {MULTI} SELECT threshold, count(*) FILTER ({RENDER} = 'original') AS original, count(*) FILTER ({RENDER} = 'injected') AS injected, count(*) FILTER ({RENDER} = 'connection') AS connection, count(*) FILTER ({RENDER} = 'deleted') AS deleted, count(*) AS total, count(*) FILTER ({RENDER} <> 'deleted') AS live FROM e GROUP BY threshold")
def action_counts(spark, sf_dir):
    return fusion.action_counts(rendered(spark, sf_dir), "threshold")


@query(f"WITH {MULTI}, h AS (SELECT t, count(u) AS n FROM range(1, 51) AS q(t) LEFT JOIN e ON e.threshold = t GROUP BY t) SELECT CAST(t AS INTEGER) AS threshold, n, CAST(sum(n) OVER (ORDER BY t) AS BIGINT) AS upto FROM h")
def coverage_ecdf(spark, sf_dir):
    h = multigraph(spark, sf_dir).where("threshold <= 50").groupBy(F.col("threshold").cast("int").alias("threshold")).agg(F.count("*").alias("n"))
    full = spark.range(1, 51).select(F.col("id").cast("int").alias("threshold")).join(h, "threshold", "left").select("threshold", F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("upto", F.sum("n").over(Window.orderBy("threshold").rowsBetween(Window.unboundedPreceding, 0)))


@query(f"WITH {MULTI} SELECT (SELECT count(*) FROM (SELECT u FROM e UNION SELECT v FROM e)) AS n_nodes, count(*) AS n_edges, round(2.0 * count(*) / (SELECT count(*) FROM (SELECT u FROM e UNION SELECT v FROM e)), 6) AS mean_degree, sum(length) AS total_length, round(avg(length), 6) AS mean_length FROM e")
def graph_info(spark, sf_dir):
    e = multigraph(spark, sf_dir)
    n = structure.incidence(e).agg(F.count_distinct("nid").alias("n_nodes"))
    g = e.agg(F.count("*").alias("n_edges"), F.sum("length").alias("total_length"), r(F.avg("length")).alias("mean_length"))
    return n.crossJoin(F.broadcast(g)).select("n_nodes", "n_edges", r(2.0 * F.col("n_edges") / F.col("n_nodes")).alias("mean_degree"), "total_length", "mean_length")  # two single rows


@query("""WITH s AS (SELECT o_orderpriority AS kind, (o_orderkey % 3 > 0)::INT AS tp, (o_orderkey % 7 = 0)::INT AS fp, (o_custkey % 5 = 0)::INT AS fn FROM orders WHERE NOT ((o_orderkey % 3 > 0)::INT = 0 AND (o_orderkey % 7 = 0)::INT = 0)),
g AS (SELECT kind, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM s GROUP BY kind)
SELECT kind, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp/(tp+fp), 6) AS precision, round(tp/(tp+fn), 6) AS recall, round(2*(tp/(tp+fp))*(tp/(tp+fn))/((tp/(tp+fp))+(tp/(tp+fn))), 6) AS f1 FROM g""")
def topo_score(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    s = o.select(F.col("o_orderpriority").alias("kind"), (F.col("o_orderkey") % 3 > 0).cast("int").alias("tp"), (F.col("o_orderkey") % 7 == 0).cast("int").alias("fp"), (F.col("o_custkey") % 5 == 0).cast("int").alias("fn"))
    t = metrics.topo(s, "kind", prime=True)
    return t.select("kind", "tp", "fp", "fn", *[r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


SCORE = "CASE WHEN category = 'C' THEN 1 - least(abs(a - b) / a, 1) ELSE 0 END"
SAMPLES = "s AS (SELECT o_orderkey AS sample_id, o_orderpriority AS kind, CASE WHEN o_orderkey % 5 = 0 THEN 'A' WHEN o_orderkey % 7 = 0 THEN 'B' ELSE 'C' END AS category, o_totalprice AS a, o_totalprice * (0.5 + (o_custkey % 11) / 10.0) AS b FROM orders)"


def apls_rows(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    cat = F.when(F.col("o_orderkey") % 5 == 0, "A").when(F.col("o_orderkey") % 7 == 0, "B").otherwise("C")
    s = o.select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("kind"), cat.alias("category"), F.col("o_totalprice").alias("a"), (F.col("o_totalprice") * (0.5 + (F.col("o_custkey") % 11) / 10.0)).alias("b"))
    return s.withColumn("score", F.when(F.col("category") == "C", metrics.sample_score(F.col("a"), F.col("b"))).otherwise(0.0))


@query(f"WITH {SAMPLES} SELECT kind, round(avg({SCORE}), 6) AS apls, count(*) AS n_samples FROM s WHERE category <> 'A' GROUP BY kind")
def apls_score(spark, sf_dir):
    return metrics.apls(apls_rows(spark, sf_dir), "kind", prime=True).select("kind", r(F.col("apls")).alias("apls"), "n_samples")


@query(f"WITH {SAMPLES} SELECT kind, CAST(k AS INTEGER) AS n, round(m, 9) AS score FROM (SELECT kind, row_number() OVER w AS k, avg({SCORE}) OVER (PARTITION BY kind ORDER BY sample_id ROWS UNBOUNDED PRECEDING) AS m FROM s WINDOW w AS (PARTITION BY kind ORDER BY sample_id)) WHERE k % 10 = 0 AND k <= 1000")
def score_stabilisation(spark, sf_dir):
    w = Window.partitionBy("kind").orderBy("sample_id")
    s = apls_rows(spark, sf_dir).select("kind", F.row_number().over(w).alias("n"), F.avg("score").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("m"))
    return s.where("n % 10 = 0 and n <= 1000").select("kind", "n", r(F.col("m"), 9).alias("score"))


@query("SELECT o_orderstatus AS place, round(corr(o_totalprice, o_custkey), 6) AS price_customer, round(corr(o_totalprice, o_orderkey), 6) AS price_order FROM orders GROUP BY o_orderstatus")
def continuation_corr(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("place")).agg(r(F.corr("o_totalprice", "o_custkey")).alias("price_customer"), r(F.corr("o_totalprice", "o_orderkey")).alias("price_order"))


PLACES = "c AS (SELECT c_custkey, 41.8::DOUBLE + (c_custkey % 100)/1000.0::DOUBLE AS lat, (-87.6)::DOUBLE - (c_custkey % 70)/1000.0::DOUBLE AS lon FROM customer)"


def places(spark, sf_dir):
    k = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(k, (F.lit(41.8) + (k % 100) / F.lit(1000.0)).alias("lat"), (F.lit(-87.6) - (k % 70) / F.lit(1000.0)).alias("lon"))


MERC_Y = "(pi() - ln(1/cos(radians(lat)) + tan(radians(lat)))) / (2*pi())"


@query(f"WITH {PLACES} SELECT c_custkey, round({MERC_Y}, 9) AS y, round((pi() + radians(lon)) / (2*pi()), 9) AS x FROM c")
def mercator(spark, sf_dir):
    y, x = G.mercator_from_latlon(F.col("lat"), F.col("lon"))
    return places(spark, sf_dir).select("c_custkey", r(y, 9).alias("y"), r(x, 9).alias("x"))


@query(f"""WITH {PLACES}, k AS (SELECT *, log2(2*pi()*6371007*cos(radians(lat))/(256*0.5)) AS ideal FROM c)
SELECT c_custkey, round(2*pi()*6371007*cos(radians(lat))/(256*pow(2,16)), 6) AS gsd,
CAST(CASE WHEN 2*pi()*6371007*cos(radians(lat))/(256*pow(2,floor(ideal)-1)) <= 0.75 THEN floor(ideal)-1 WHEN 2*pi()*6371007*cos(radians(lat))/(256*pow(2,floor(ideal))) <= 0.75 THEN floor(ideal) ELSE ceil(ideal) END AS INTEGER) AS zoom FROM k""")
def gsd_zoom(spark, sf_dir):
    return places(spark, sf_dir).select("c_custkey", r(G.ground_resolution(F.col("lat"), F.lit(16))).alias("gsd"), G.derive_zoom(F.col("lat"), 0.5, 0.25).alias("zoom"))


@query(f"""WITH {PLACES}, k AS (SELECT c_custkey, radians(lat) AS phi, floor((lon+180)/6)+1 AS zone, lon, lat, 0.0066943799901413165::DOUBLE AS e2 FROM c),
m AS (SELECT *, radians(lon - ((zone-1)*6-177)) * cos(phi) AS a, pow(tan(phi),2) AS t, e2/(1-e2)*pow(cos(phi),2) AS q, e2/(1-e2) AS ep, 6378137/sqrt(1-e2*pow(sin(phi),2)) AS n,
 6378137*((1-e2/4-3*e2*e2/64-5*e2*e2*e2/256)*phi-(3*e2/8+3*e2*e2/32+45*e2*e2*e2/1024)*sin(2*phi)+(15*e2*e2/256+45*e2*e2*e2/1024)*sin(4*phi)-35*e2*e2*e2/3072*sin(6*phi)) AS arc FROM k)
SELECT c_custkey, CAST(zone AS INTEGER) AS zone, round(0.9996*(arc+n*tan(phi)*(a*a/2+(5-t+9*q+4*q*q)*pow(a,4)/24+(61-58*t+t*t+600*q-330*ep)*pow(a,6)/720)), 3) AS north,
round(0.9996*n*(a+(1-t+q)*pow(a,3)/6+(5-18*t+t*t+72*q-58*ep)*pow(a,5)/120)+500000, 3) AS east FROM m""")
def utm_project(spark, sf_dir):
    north, east = G.utm_from_latlon(F.col("lat"), F.col("lon"))
    return places(spark, sf_dir).select("c_custkey", G.utm_zone(F.col("lon")).alias("zone"), r(north, 3).alias("north"), r(east, 3).alias("east"))


def _ccw(a: str, b: str, c: str) -> str:
    return f"(({c[1]}-{a[1]})*({b[0]}-{a[0]}) > ({b[1]}-{a[1]})*({c[0]}-{a[0]}))"


_P = {n: (f"{t}.{p}x" if p == "a" else f"{t}.bx", f"{t}.ay" if p == "a" else f"{t}.byy") for n, (t, p) in {"a": ("l", "a"), "b": ("l", "b"), "c": ("q", "a"), "d": ("q", "b")}.items()}


@query(f"WITH {SHORT} SELECT l.id AS lid, q.id AS rid FROM s l JOIN s q ON l.id < q.id AND {_ccw(_P['a'], _P['c'], _P['d'])} <> {_ccw(_P['b'], _P['c'], _P['d'])} AND {_ccw(_P['a'], _P['b'], _P['c'])} <> {_ccw(_P['a'], _P['b'], _P['d'])}")
def segment_crossings(spark, sf_dir):
    return spatial.crossings(short_segments(spark, sf_dir), 20.0)


_COS = "((l.byy-l.ay)*(q.byy-q.ay)+(l.bx-l.ax)*(q.bx-q.ax))/(sqrt(pow(l.byy-l.ay,2)+pow(l.bx-l.ax,2))*sqrt(pow(q.byy-q.ay,2)+pow(q.bx-q.ax,2)))"


@query(f"WITH {SHORT}, f AS (SELECT * FROM s WHERE sqrt(pow(byy-ay,2)+pow(bx-ax,2)) >= 10) SELECT l.id AS lid, q.id AS rid, round(abs({_COS}), 6) AS cosine FROM f l JOIN f q ON l.id < q.id AND least(l.ay,l.byy)-20 <= greatest(q.ay,q.byy) AND least(q.ay,q.byy) <= greatest(l.ay,l.byy)+20 AND least(l.ax,l.bx)-20 <= greatest(q.ax,q.bx) AND least(q.ax,q.bx) <= greatest(l.ax,l.bx)+20 WHERE abs({_COS}) > 0.985")
def parallel_edges(spark, sf_dir):
    return spatial.parallels(short_segments(spark, sf_dir), 20.0).select("lid", "rid", r(F.col("cosine")).alias("cosine"))


@query(f"WITH {CHAIN}, g AS (SELECT graph_id, count(*) + 1 AS n, sum(length) AS total FROM e GROUP BY graph_id) SELECT e.graph_id, u, v, length FROM e JOIN g ON e.graph_id = g.graph_id WHERE n >= 3 AND total > 1500")
def spur_filter(spark, sf_dir):
    return structure.drop_small_parts(chain_edges(spark, sf_dir), 3, 1500.0, 30.0).select("graph_id", "u", "v", "length")


def _shifted(spark, sf_dir, by: float) -> tuple[DataFrame, DataFrame]:
    """Every polyline as one edge of its own graph, scaled, and its segments moved ``by``."""
    c = polylines(spark, sf_dir).select(F.col("vec_id").cast("string").alias("graph_id"), F.lit(1).cast("long").alias("u"), F.lit(2).cast("long").alias("v"), F.lit(0).alias("k"), F.transform("curve", lambda p: F.struct((p["y"] * 1000).alias("y"), (p["x"] * 1000).alias("x"))).alias("curve"))
    s = structure.vectorize(c).select(F.col("graph_id").alias("tgraph"), F.col("part").cast("long").alias("tu"), (F.col("part") + 1).cast("long").alias("tv"), *[F.struct((F.col(f"{p}.y") + by).alias("y"), F.col(f"{p}.x").alias("x")).alias(p) for p in ("a", "b")])
    return c, s


@query()
def coverage_match(spark, sf_dir):
    edges, target = _shifted(spark, sf_dir, 4.2)
    return coverage.edge_coverage(edges, target, 20).select("graph_id", "threshold", F.size("covered_by").alias("n_covered"))


def _fused(spark, sf_dir, variant: str) -> DataFrame:
    """Two parallel chains a graph: a base along y = 0 and a patch beside it, of which what comes after the third node is injected."""
    chain = chain_edges(spark, sf_dir).select("graph_id", "u", "v")
    p = lambda y, x: F.struct(F.lit(y).alias("y"), x.cast("double").alias("x"))
    line = lambda y: F.array(p(y, F.col("u") * 100.0), p(y, F.col("v") * 100.0))
    base = chain.select("graph_id", "u", "v", F.lit(0).alias("k"), line(0.0).alias("curve"))
    patch = chain.select("graph_id", (F.col("u") + 1000).alias("u"), (F.col("v") + 1000).alias("v"), F.lit(0).alias("k"), line(4.0).alias("curve"), F.when(F.col("v") <= 2, 4.0).otherwise(float("inf")).alias("threshold"))
    ends = lambda e: e.select("graph_id", F.inline(F.array(F.struct(F.col("u").alias("nid"), F.col("curve")[0].alias("p")), F.struct(F.col("v").alias("nid"), F.element_at("curve", -1).alias("p"))))).distinct().select("graph_id", "nid", "p.*")
    n, e = fusion.fuse(ends(base), base, ends(patch), patch, 20.0)[variant]
    return fusion.action_counts(e, "graph_id").join(n.groupBy("graph_id").agg(F.count("*").alias("n_nodes")), "graph_id")


# every injected edge covers the base edge beside it; one connection joins the injected part to the base where the other part begins
_FUSED = f"WITH {CHAIN}, g AS (SELECT graph_id, count(*) AS m, count(*) FILTER (v > 2) AS i, CAST(count(*) FILTER (v > 2) > 0 AND count(*) FILTER (v <= 2) > 0 AS BIGINT) AS c FROM e GROUP BY graph_id)"
_FUSED_NODES = "m + 1 + CASE WHEN i > 0 THEN i + 1 ELSE 0 END AS n_nodes"
_CUT_BACK = f"{_FUSED} SELECT graph_id, m - i AS original, i AS injected, c AS connection, i AS deleted, m + i + c AS total, m + c AS live, {_FUSED_NODES} FROM g"


@query(f"{_FUSED} SELECT graph_id, m AS original, i AS injected, c AS connection, CAST(0 AS BIGINT) AS deleted, m + i + c AS total, m + i + c AS live, {_FUSED_NODES} FROM g")
def fuse_inject(spark, sf_dir):
    return _fused(spark, sf_dir, "a")


@query(_CUT_BACK)
def fuse_delete(spark, sf_dir):
    return _fused(spark, sf_dir, "b")


@query(_CUT_BACK)
def fuse_reconnect(spark, sf_dir):
    return _fused(spark, sf_dir, "c")


@query("SELECT CAST(vec_id AS VARCHAR) AS graph_id, CASE vec_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 5.0::DOUBLE ELSE CAST('inf' AS DOUBLE) END AS threshold, CASE WHEN vec_id % 3 < 2 THEN 1 ELSE 0 END AS n_covered FROM embeddings")
def coverage_shifted(spark, sf_dir):
    """Straight edges against themselves moved sideways by 0.5, 4.2 or 100."""
    s = short_segments(spark, sf_dir).select(F.col("id").cast("string").alias("graph_id"), "a", "b", F.element_at(F.array(F.lit(0.5), F.lit(4.2), F.lit(100.0)), (F.col("id") % 3 + 1).cast("int")).alias("by"))
    size = C.distance(F.col("a"), F.col("b"))
    moved = lambda p: F.struct((F.col(p)["y"] + (F.col("b.x") - F.col("a.x")) / size * F.col("by")).alias("y"), (F.col(p)["x"] - (F.col("b.y") - F.col("a.y")) / size * F.col("by")).alias("x"))
    one, two = F.lit(1).cast("long"), F.lit(2).cast("long")
    edges = s.select("graph_id", one.alias("u"), two.alias("v"), F.lit(0).alias("k"), F.array("a", "b").alias("curve"))
    target = s.select(F.col("graph_id").alias("tgraph"), one.alias("tu"), two.alias("tv"), moved("a").alias("a"), moved("b").alias("b"))
    return coverage.edge_coverage(edges, target, 20).select("graph_id", "threshold", F.size("covered_by").alias("n_covered"))


def chain_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Each conversation's turns as nodes along a zigzag, joined in turn by straight edges."""
    e = chain_edges(spark, sf_dir).select("graph_id", "u", "v")
    at = lambda n: F.struct((n * 3.0).alias("y"), (n % 3).cast("double").alias("x"))
    edges = e.select("graph_id", "u", "v", F.lit(0).alias("k"), F.array(at(F.col("u")), at(F.col("v"))).alias("curve"))
    n = structure.incidence(e).select("graph_id", "nid").distinct().withColumn("p", at(F.col("nid"))).select("graph_id", "nid", "p.*")
    return n, edges.withColumn("length", C.length(F.col("curve")))


@query(f"""WITH {CHAIN}, n AS (SELECT graph_id, u AS n FROM e UNION SELECT graph_id, v FROM e), s AS (SELECT graph_id, n, sqrt(pow((lead(n) OVER w - n) * 3.0, 2) + pow(lead(n) OVER w % 3 - n % 3, 2)) AS len FROM n WINDOW w AS (PARTITION BY graph_id ORDER BY n))
SELECT graph_id, min(n) AS u, max(n) AS v, string_agg(CAST(n AS VARCHAR) || ':' || CAST(n * 3 AS VARCHAR) || ',' || CAST(n % 3 AS VARCHAR), ' ' ORDER BY n) AS curve, round(sum(len), 6) AS length FROM s GROUP BY graph_id""")
def simplify_graph(spark, sf_dir):
    e = graph.simplified(*chain_graph(spark, sf_dir))[1]
    said = F.zip_with("path", "curve", lambda n, p: F.concat_ws("", n.cast("string"), F.lit(":"), p["y"].cast("long").cast("string"), F.lit(","), p["x"].cast("long").cast("string")))
    return e.select("graph_id", "u", "v", F.array_join(said, " ").alias("curve"), r(F.col("length")).alias("length"))


def line_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every polyline as the one edge of its own graph, from node 1 to node 2."""
    c = polylines(spark, sf_dir).withColumn("graph_id", F.col("vec_id").cast("string"))
    ends = F.inline(F.array(F.struct(F.lit(1).cast("long").alias("nid"), F.col("curve")[0].alias("p")), F.struct(F.lit(2).cast("long").alias("nid"), F.element_at("curve", -1).alias("p"))))
    n = c.select("graph_id", ends).select("graph_id", "nid", "p.*")
    return n, c.select("graph_id", F.lit(1).cast("long").alias("u"), F.lit(2).cast("long").alias("v"), F.lit(0).alias("k"), "curve")


@query(f"WITH {LINES}, t AS (SELECT vec_id, CASE WHEN i = 0 THEN 1 ELSE 2 + i END AS a, CASE WHEN i = 30 THEN 2 ELSE 3 + i END AS b, y, x, ny, nx, len FROM seg) SELECT CAST(vec_id AS VARCHAR) AS graph_id, CAST(least(a, b) AS BIGINT) AS u, CAST(greatest(a, b) AS BIGINT) AS v, round(len, 6) AS length, round(CASE WHEN a <= b THEN y ELSE ny END, 6) AS y, round(CASE WHEN a <= b THEN x ELSE nx END, 6) AS x FROM t")
def vectorize_graph(spark, sf_dir):
    e = graph.vectorized(*line_graph(spark, sf_dir))[1]
    return e.select("graph_id", "u", "v", r(F.col("length")).alias("length"), r(F.col("curve")[0]["y"]).alias("y"), r(F.col("curve")[0]["x"]).alias("x"))


@query(f"WITH {LINES}, w AS (SELECT vec_id, max(whole) AS whole FROM cum GROUP BY vec_id) SELECT CAST(vec_id AS VARCHAR) AS graph_id, CAST(greatest(1, ceil(whole / 2.0)) AS BIGINT) AS n_edges, CAST(greatest(1, ceil(whole / 2.0)) AS BIGINT) + 1 AS n_nodes, round(whole, 6) AS length, round(whole / greatest(1, ceil(whole / 2.0)), 6) AS longest FROM w")
def max_edge_length(spark, sf_dir):
    n, e = graph.bounded_edges(*line_graph(spark, sf_dir), 2.0)
    sums = e.groupBy("graph_id").agg(F.count("*").alias("n_edges"), r(F.sum("length")).alias("length"), r(F.max("length")).alias("longest"))
    return sums.join(n.groupBy("graph_id").agg(F.count("*").alias("n_nodes")), "graph_id").select("graph_id", "n_edges", "n_nodes", "length", "longest")


@query(f"WITH {SHORT}, b AS (SELECT id, least(ay,byy) AS miny, least(ax,bx) AS minx, greatest(ay,byy) AS maxy, greatest(ax,bx) AS maxx FROM s) SELECT q.id FROM b q WHERE EXISTS (SELECT 1 FROM b l WHERE l.id % 7 = 0 AND l.miny - 15 <= q.maxy AND q.miny <= l.maxy + 15 AND l.minx - 15 <= q.maxx AND q.minx <= l.maxx + 15)")
def subgraph_by_graph(spark, sf_dir):
    e = short_segments(spark, sf_dir).select(F.lit("g").alias("graph_id"), F.col("id").alias("u"), F.col("id").alias("v"), F.lit(0).alias("k"), F.array("a", "b").alias("curve"))
    return graph.near_graph(e, e.where("u % 7 = 0"), 15.0, 40.0).select(F.col("u").alias("id"))


@query(f"WITH {MULTI}, i AS (SELECT u AS nid FROM e UNION ALL SELECT v FROM e) SELECT nid, count(*) AS degree FROM i GROUP BY nid HAVING count(*) > 32")
def complicated_crossings(spark, sf_dir):
    return graph.crossings_over(multigraph(spark, sf_dir), 32).select("nid", "degree")


@query("SELECT u, v FROM ((SELECT DISTINCT o_custkey AS u, o_orderkey % 7 AS v FROM orders EXCEPT SELECT c_custkey, c_custkey % 7 FROM customer) UNION ALL (SELECT c_custkey, c_custkey % 7 FROM customer EXCEPT SELECT o_custkey, o_orderkey % 7 FROM orders))")
def symmetric_difference(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("u"), (F.col("o_orderkey") % 7).alias("v"))
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("u"), (F.col("c_custkey") % 7).alias("v"))
    return graph.symmetric_difference(o, c)


@query(f"WITH {MULTI} SELECT CASE WHEN threshold > 20 THEN 'above' ELSE 'below' END AS side, l_returnflag AS flag, count(*) AS n, round(sum(length), 4) AS length FROM e WHERE l_linestatus = 'O' GROUP BY ALL")
def coverage_split(spark, sf_dir):
    e = graph.filter_by_attributes(multigraph(spark, sf_dir), l_linestatus="O")
    above, below = graph.split_by_coverage(e, 20.0)
    both = above.withColumn("side", F.lit("above")).unionByName(below.withColumn("side", F.lit("below")))
    return both.groupBy("side", F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), r(F.sum("length"), 4).alias("length"))


@query(f"WITH {CHAIN}, i AS (SELECT graph_id, u AS nid, u, v FROM e UNION SELECT graph_id, v, u, v FROM e) SELECT graph_id, nid, u, v FROM i WHERE nid = 1")
def incident_edges(spark, sf_dir):
    e = chain_edges(spark, sf_dir).withColumn("k", F.lit(0))
    return graph.incident_edges(e, e.select("graph_id", F.lit(1).cast("int").alias("nid"))).select("graph_id", "nid", "u", "v")


@query(f"WITH {NODES}, {SHORT}, t AS (SELECT n.nid AS lid, s.id AS rid, n.y AS py, n.x AS px, s.*, CASE WHEN abs(byy-ay) < 1e-4 AND abs(bx-ax) < 1e-4 THEN 0 ELSE greatest(0, least(1, ((n.y-ay)*(byy-ay)+(n.x-ax)*(bx-ax))/((byy-ay)*(byy-ay)+(bx-ax)*(bx-ax)))) END AS t FROM n JOIN s ON s.id % 3 = 1 WHERE n.nid % 3 = 0), d AS (SELECT *, sqrt(pow(ay+t*(byy-ay)-py,2)+pow(ax+t*(bx-ax)-px,2)) AS d, row_number() OVER (PARTITION BY lid ORDER BY sqrt(pow(ay+t*(byy-ay)-py,2)+pow(ax+t*(bx-ax)-px,2))) AS k FROM t) SELECT lid, rid, round(d, 6) AS distance, round(ay+t*(byy-ay), 4) AS near_y, round(ax+t*(bx-ax), 4) AS near_x, round(t, 6) AS fraction FROM d WHERE k = 1")
def nearest_position(spark, sf_dir):
    """Points with an id divisible by 3 against the segments whose id leaves 1: the two sides of the query."""
    e = short_segments(spark, sf_dir).where("id % 3 = 1").select(F.lit("g").alias("graph_id"), F.col("id").alias("u"), F.col("id").alias("v"), F.lit(0).alias("k"), F.array("a", "b").alias("curve"))
    points = nodes(spark, sf_dir).where("nid % 3 = 0").select(F.col("nid").alias("lid"), "graph_id", "y", "x")
    n = graph.nearest_position(points, e, 60.0)
    return n.select("lid", F.col("u").alias("rid"), r(F.col("distance")).alias("distance"), r(F.col("near_y"), 4).alias("near_y"), r(F.col("near_x"), 4).alias("near_x"), r(F.col("fraction")).alias("fraction"))


@query()
def topo_match(spark, sf_dir):
    n = nodes(spark, sf_dir).select((F.floor(F.col("y") / 300) * 1000 + F.floor(F.col("x") / 300)).cast("long").alias("seed"), "y", "x")
    return metrics.topo_samples(n, n.withColumn("y", F.col("y") + 3.0), 5.0)


@query("SELECT CAST(i AS BIGINT) AS sample_id, 'C' AS category, 1.0::DOUBLE AS score FROM range(0, 200) AS r(i)")
def apls_sample(spark, sf_dir):
    """Paths between random places of a tree, in itself: every sample finds its way back, at the same length."""
    t = tree(spark, sf_dir).where("u >= 1 and v < 1000").select("graph_id", "u", "v", F.lit(0).alias("k"))
    at = lambda n: F.struct((n % 100 * 40.0).cast("double").alias("y"), (F.floor(n / 100) * 1000.0).cast("double").alias("x"))
    e = t.withColumn("curve", F.array(at(F.col("u")), at(F.col("v"))))
    ring = spark.range(1, 5).select(F.lit("g").alias("graph_id"), F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(0).alias("k")).withColumn("curve", F.array(at(F.col("u")), at(F.col("v"))))
    rows = metrics.apls_samples(e.unionByName(ring), e.unionByName(ring), 200, 7)
    return rows.select("sample_id", "category", r(F.col("score"), 4).alias("score"))


@query(f"WITH {SHORT} SELECT id, round(least(5, len), 6) AS before, CASE WHEN len > 5 THEN round(len - 5, 6) END AS after FROM (SELECT id, sqrt(pow(byy-ay,2)+pow(bx-ax,2)) AS len FROM s)")
def cut_line(spark, sf_dir):
    parts = C.cut_line(F.array("a", "b"), F.lit(5.0))
    return short_segments(spark, sf_dir).select("id", parts.alias("p")).select("id", r(C.length(F.get("p", F.lit(0)))).alias("before"), F.when(F.size("p") > 1, r(C.length(F.get("p", F.lit(1))))).alias("after"))


@query(f"""WITH {SHORT}, p AS (SELECT s.*, sqrt(pow(byy-ay,2)+pow(bx-ax,2)) AS len FROM s),
i AS (SELECT id, i, ay * (1 - i/len) + byy * (i/len) AS y, ax * (1 - i/len) + bx * (i/len) AS x, len FROM p, range(0, 1000) AS q(i) WHERE i < floor(len)),
d AS (SELECT id, i, sqrt(pow(y-10,2)+pow(x,2)) + sqrt(pow(y+10,2)+pow(x,2)) AS sum FROM i)
SELECT p.id, round(coalesce(min(d.sum), any_value(sqrt(pow(ay-10,2)+pow(ax,2)) + sqrt(pow(ay+10,2)+pow(ax,2)))), 6) AS sum FROM p LEFT JOIN d ON p.id = d.id GROUP BY p.id""")
def closest_between(spark, sf_dir):
    c, d = C.point(F.lit(10.0), F.lit(0.0)), C.point(F.lit(-10.0), F.lit(0.0))
    p = short_segments(spark, sf_dir).select("id", C.closest_between(F.col("a"), F.col("b"), c, d).alias("p"))
    return p.select("id", r(C.distance(F.col("p"), c) + C.distance(F.col("p"), d)).alias("sum"))


def _pixels(lat: str, lon: str) -> tuple[str, str]:
    y = MERC_Y.replace("lat", lat)
    return f"CAST(floor({y} * 16777216) AS BIGINT)", f"CAST(floor((pi() + radians({lon})) / (2*pi()) * 16777216) AS BIGINT)"


@query(f"""WITH {PLACES}, k AS (SELECT c_custkey, {_pixels('(lat+0.05)', '(lon-0.05)')[0]} AS y0, {_pixels('(lat+0.05)', '(lon-0.05)')[1]} AS x0, {_pixels('(lat-0.05)', '(lon+0.05)')[0]} AS y1, {_pixels('(lat-0.05)', '(lon+0.05)')[1]} AS x1 FROM c),
o AS (SELECT *, (y1 - y0 + 200) % 88 AS h, (x1 - x0 + 200) % 88 AS w FROM k)
SELECT c_custkey, y0 - 100 + h // 2 + h % 2 AS top, x0 - 100 + w // 2 + w % 2 AS left_, y1 + 100 - h // 2 AS bottom, x1 + 100 - w // 2 AS right_ FROM o""")
def image_bounds(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    b = places(spark, sf_dir).select("c_custkey", G.image_bounds(lat + 0.05, lon - 0.05, lat - 0.05, lon + 0.05, 16).alias("b"))
    return b.select("c_custkey", "b.top", F.col("b.left").alias("left_"), "b.bottom", F.col("b.right").alias("right_"))


@query(f"""WITH {CHAIN}, g AS (SELECT graph_id, count(*) AS m, sum(length) / 1000 AS km FROM e GROUP BY graph_id)
SELECT graph_id, CAST(t AS INTEGER) AS threshold, item, round(CASE item WHEN 'nodes' THEN m + 1 WHEN 'edges' THEN m ELSE km END, 6) AS value
FROM g, (VALUES (1), (10), (20)) AS x(t), (VALUES ('nodes'), ('edges'), ('length_km')) AS y(item)""")
def basics_by_threshold(spark, sf_dir):
    e = chain_edges(spark, sf_dir)
    n = structure.incidence(e).select("graph_id", "nid").distinct()
    table = sweeps.long_form(sweeps.basics(n, e), ["graph_id"], ["nodes", "edges", "length_km"])
    return sweeps.constant_series(table, [1, 10, 20]).select("graph_id", "threshold", "item", r(F.col("value")).alias("value"))


@query(f"""WITH {MULTI}, g AS (SELECT l_returnflag AS flag, count(*) FILTER ({RENDER} = 'injected') AS i, count(*) AS n, coalesce(sum(length) FILTER ({RENDER} = 'injected'), 0) AS ik, sum(length) AS k FROM e GROUP BY flag)
SELECT flag, i AS injected_edges, n AS total_edges, round(i / n, 6) AS edge_ratio, round(ik / k, 6) AS length_ratio FROM g""")
def injection_ratios(spark, sf_dir):
    injected = F.col("render") == "injected"
    g = rendered(spark, sf_dir).groupBy(F.col("l_returnflag").alias("flag")).agg(F.count_if(injected).alias("injected_edges"), F.count("*").alias("total_edges"), F.sum(F.when(injected, F.col("length"))).alias("injected_km"), F.sum("length").alias("total_km"))
    return sweeps.injection_ratios(g).select("flag", "injected_edges", "total_edges", r(F.col("edge_ratio")).alias("edge_ratio"), r(F.col("length_ratio")).alias("length_ratio"))


@query(f"""WITH {CHAIN}, g AS (SELECT graph_id, count(*) AS m FROM e GROUP BY graph_id)
SELECT graph_id, CAST(t AS INTEGER) AS threshold, false AS inverse, CASE t WHEN 2 THEN m ELSE 0 END AS injected, CAST(0 AS BIGINT) AS deleted, CAST(0 AS BIGINT) AS reconnected FROM g, (VALUES (2), (20)) AS x(t)""")
def sweep_actions(spark, sf_dir):
    """A chain of each graph and the same one 4.5 beside it: at 2 all of the patch is new, at 20 nothing is."""
    chain = chain_edges(spark, sf_dir).select("graph_id", "u", "v")
    at = lambda c, y: F.struct(F.lit(y).alias("y"), (F.col(c) * 100.0).alias("x"))

    def graph_at(y: float) -> tuple[DataFrame, DataFrame]:
        e = chain.select("graph_id", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.lit(0).alias("k"), F.array(at("u", y), at("v", y)).alias("curve"))
        n = structure.incidence(e).select("graph_id", "nid").distinct().select("graph_id", "nid", F.lit(y).alias("y"), (F.col("nid") * 100.0).alias("x"))
        return n, e

    swept = sweeps.fuse_at(graph_at(0.0), graph_at(4.5), [2, 20], [False])
    return sweeps.threshold_actions(swept)
