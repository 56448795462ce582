import numpy as np
from pyspark.sql import functions as F

from roadloom.functions import curve as C
from roadloom.functions import geodesy as G
from roadloom.operators import coverage, fusion, graph, metrics, spatial, structure
from roadloom.sources import traces

CURVE = "array<struct<y:double,x:double>>"


def line(spark, *pts):
    return spark.createDataFrame([([{"y": float(y), "x": float(x)} for y, x in pts],)], f"c {CURVE}")


def test_curve_pieces(spark):
    df = line(spark, *[(0, i) for i in range(11)])
    for n, size in ((10, 1), (5, 2), (2, 5), (3, 10 / 3)):
        got = df.select(F.transform(C.cut_pieces(F.col("c"), n), C.length).alias("l")).first()["l"]
        assert len(got) == n and np.allclose(got, size)
    assert df.select(F.size(C.cut_max_distance(F.col("c"), 10.0)).alias("n")).first()["n"] == 1
    assert df.select(F.size(C.cut_max_distance(F.col("c"), 0.5)).alias("n")).first()["n"] == 20


def test_nearest_and_degenerate_segment(spark):
    far = line(spark, (0, 0), (0, 1)).select(C.nearest_on_curve(F.col("c"), C.point(F.lit(0.0), F.lit(-1.0))).alias("n")).first()["n"]
    assert far["distance"] == 1 and far["fraction"] == 0
    flat = line(spark, (0, 0), (0, 0)).select(C.nearest_on_curve(F.col("c"), C.point(F.lit(3.0), F.lit(4.0))).alias("n")).first()["n"]
    assert flat["distance"] == 5 and flat["fraction"] == 0


def test_linestring_round_trip(spark):
    df = line(spark, (1, 2), (3, 4.5))
    assert df.select((C.from_linestring(C.to_linestring(F.col("c"))) == F.col("c")).alias("same")).first()["same"]


def test_utm_round_trip_and_pixel(spark):
    df = spark.createDataFrame([(52.5, 13.4), (41.8, -87.6)], "lat double, lon double")
    n, e = G.utm_from_latlon(F.col("lat"), F.col("lon"))
    lat, lon = G.latlon_from_utm(n, e, G.utm_zone(F.col("lon")))
    for r in df.select("lat", "lon", lat.alias("a"), lon.alias("b")).collect():
        assert abs(r.lat - r.a) < 1e-6 and abs(r.lon - r.b) < 1e-6


def test_coverage_thresholds():
    nodes = {k: np.array([0.0, 50.0 * k]) for k in range(4)}
    edges = [(0, 1), (1, 2), (2, 3)]
    at = lambda y: np.array([[y, 0.0], [y, 70.0], [y, 150.0]])
    assert coverage.smallest_reach(at(0.0), nodes, edges, 50) == (1.0, [0, 1, 2, 3])
    assert coverage.smallest_reach(at(4.2), nodes, edges, 50)[0] == 5
    assert coverage.smallest_reach(at(100.0), nodes, edges, 50) == (float("inf"), [])


def test_duplicates_chain_to_the_smallest(spark):
    n = spark.createDataFrame([("g", 3, 0.0, 0.0), ("g", 1, 0.0, 0.0008), ("g", 2, 0.0, 0.0016), ("g", 9, 5.0, 5.0)], "graph_id string, nid long, y double, x double")
    got = {r.nid: r.canonical for r in structure.duplicated_nodes(n, 0.001).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_pure_cycle_stays_and_chain_contracts(spark):
    e = spark.createDataFrame([("g", 1, 2, 1.0), ("g", 2, 3, 2.0), ("h", 1, 2, 1.0), ("h", 2, 3, 1.0), ("h", 1, 3, 1.0)], "graph_id string, u long, v long, length double")
    assert sorted(tuple(r) for r in structure.chains(e).collect()) == [("g", 1, 3, 2, 3.0), ("h", 1, 2, 1, 1.0), ("h", 1, 3, 1, 1.0), ("h", 2, 3, 1, 1.0)]


def test_scores(spark):
    s = spark.createDataFrame([(10.0, 10.0), (10.0, 15.0), (10.0, 40.0), (0.0, 1.0)], "a double, b double")
    assert [r.s for r in s.select(metrics.sample_score(F.col("a"), F.col("b")).alias("s")).collect()] == [1, 0.5, 0, None]
    t = metrics.topo(spark.createDataFrame([("x", 3, 1, 2), ("y", 0, 0, 7)], "k string, tp int, fp int, fn int"), "k").orderBy("k").collect()
    assert (t[0]["precision"], t[0]["recall"]) == (0.75, 0.6) and abs(t[0]["f1"] - 2 / 3) < 1e-9 and t[1]["f1"] == 0


def test_path_on_one_edge(spark):
    paths = metrics.shortest_paths(spark.createDataFrame([("g", 1, 2, 10.0)], "graph_id string, u long, v long, length double"))
    s = spark.createDataFrame([(0, "g", 1, 2, 3.0, 10.0, 1, 2, 8.0, 10.0, True)], "sample_id long, graph_id string, u1 long, v1 long, d1 double, len1 double, u2 long, v2 long, d2 double, len2 double, same boolean")
    assert metrics.path_between(s, paths).first()["path"] == 5


def test_fusion_without_injection_is_the_base(spark):
    nodes = spark.createDataFrame([("g", 1, 0.0, 0.0), ("g", 2, 0.0, 100.0)], "graph_id string, nid long, y double, x double")
    edges = spark.createDataFrame([("g", 1, 2, 0, [{"y": 0.0, "x": 0.0}, {"y": 0.0, "x": 100.0}], 1.0)], f"graph_id string, u long, v long, k int, curve {CURVE}, threshold double")
    more = nodes.withColumn("nid", F.col("nid") + 10)
    out = fusion.fuse(nodes, edges.drop("threshold"), more, edges.withColumn("u", F.col("u") + 10).withColumn("v", F.col("v") + 10), 20.0)
    assert [(r.u, r.v, r.render) for r in out["c"][1].collect()] == [(1, 2, "original")]


def test_release_round_trip(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "t1.txt").write_text("13.4 52.5 1\n\nbad line\n13.5 52.6 2\n")
    traces.build_release("0.1.0-alpha.1", {"a": str(tmp_path / "a")}, str(tmp_path / "r.tar.gz"))
    assert traces.list_release(str(tmp_path / "r.tar.gz"))["cities"] == {"a": 1}
    root = traces.extract_release(str(tmp_path / "r.tar.gz"), str(tmp_path / "out"))
    assert traces.load_release(root)["version"]["prerelease"] == "alpha.1"
    assert traces.read_trips(spark, f"{root}/inputs/gps/a").count() == 2


SQUARE = [((0, 0), (0, 10)), ((0, 10), (10, 10)), ((10, 10), (10, 30)), ((0, 0), (-20, 0))]


def small_graph(spark, pieces=SQUARE, graph_id="g"):
    at = {p: k for k, p in enumerate(sorted({p for s in pieces for p in s}))}
    nodes = spark.createDataFrame([(graph_id, k, float(y), float(x)) for (y, x), k in at.items()], "graph_id string, nid long, y double, x double")
    pts = lambda s: [{"y": float(y), "x": float(x)} for y, x in s]
    rows = [(graph_id, at[a], at[b], 0, pts((a, b)), "street") for a, b in pieces]
    edges = spark.createDataFrame(rows, f"graph_id string, u long, v long, k int, curve {CURVE}, kind string")
    return nodes, structure.canonical(edges).withColumn("length", C.length(F.col("curve")))


def total(edges):
    return edges.agg(F.sum(C.length(F.col("curve")))).first()[0]


def test_contracting_and_cutting_keep_length(spark):
    nodes, edges = small_graph(spark)
    less, chain = graph.simplified(nodes, edges)
    row = chain.collect()
    assert len(row) == 1 and less.count() == 2 and np.isclose(row[0].length, 60) and row[0].kind == "street" and len(row[0].path) == 5
    assert len(row[0].curve) == 5
    more, parts = graph.vectorized(less, chain)
    assert parts.count() == 4 and more.count() == 5 and np.isclose(total(parts), 60)
    for most, n in ((50.0, 4), (5.0, 2 + 2 + 4 + 4), (7.0, 2 + 2 + 3 + 3)):
        more, parts = graph.bounded_edges(nodes, edges, most)
        assert parts.count() == n and more.count() == n + 1 and np.isclose(total(parts), 60)
        assert parts.where(F.col("length") > most + 1e-9).isEmpty() and parts.where("u > v").isEmpty()
        assert {r.violations for r in structure.violations(more, parts, utm=False).collect()} == {0}
    more, parts = graph.cut_at(nodes, edges, F.array(F.lit(0.5)))
    assert parts.count() == 8 and parts.select("cut_from").distinct().count() == 4


def test_cycles_stay(spark):
    nodes, edges = small_graph(spark, [((0, 0), (0, 10)), ((0, 10), (10, 10)), ((10, 10), (0, 0))])
    assert graph.simplified(nodes, edges)[1].count() == 3 == structure.chains(edges).count()


def test_relabelled_and_paths(spark):
    nodes, edges = small_graph(spark)
    new, moved = graph.relabelled(nodes, edges, 100)
    assert sorted(r.nid for r in new.collect()) == list(range(100, 105)) and {r.violations for r in structure.violations(new, moved, utm=False).collect()} == {0}
    curves = spark.createDataFrame([("g", k, [{"y": 0.0, "x": float(x)} for x in range(n)]) for k, n in ((1, 3), (2, 2))], f"graph_id string, path_id long, curve {CURVE}")
    n, e = graph.graph_of_paths(curves)
    assert n.count() == 5 and n.select("nid").distinct().count() == 5 and e.count() == 3 and np.isclose(total(e), 3, atol=1e-2)


def test_nearest_position(spark):
    _, edges = small_graph(spark)
    points = spark.createDataFrame([(1, "g", 2.0, 4.0), (2, "g", 11.0, 20.0)], "lid long, graph_id string, y double, x double")
    got = {r.lid: (round(r.distance, 6), round(r.near_y, 6), round(r.near_x, 6), round(r.fraction, 6)) for r in graph.nearest_position(points, edges, 5.0).collect()}
    assert got[1] == (2, 0, 4, 0.4) and got[2] == (1, 10, 20, 0.5)


def test_apls_of_a_graph_and_itself(spark):
    _, edges = small_graph(spark)
    rows = metrics.apls_samples(edges, edges, 20, 3).collect()
    assert len(rows) == 20 and all(r.category == "C" and np.isclose(r.score, 1) for r in rows)
    shifted = edges.withColumn("curve", F.transform("curve", lambda p: F.struct((p["y"] + 100.0).alias("y"), p["x"].alias("x"))))
    assert {r.category for r in metrics.apls_samples(edges, shifted, 10, 3).collect()} == {"A"}
    # without the edge in the middle some pairs have a path on one side only
    cut = edges.where(~((F.col("curve")[0]["y"] == 0) & (F.element_at("curve", -1)["y"] == 10)))
    assert {r.category for r in metrics.apls_samples(cut, cut, 40, 5).collect()} == {"C"}


def test_topo_of_a_graph_and_itself(spark):
    _, edges = small_graph(spark)
    rows = metrics.topo_sampling(edges, edges, 6, 1, radius=30.0).collect()
    assert len(rows) == 6 and all(r.fp == 0 and r.fn == 0 and r.tp > 3 for r in rows)
    seeds = edges.where("length = 20").limit(1).select(F.lit(1).alias("seed"), "graph_id", "u", "v", "k", F.lit(0.0).alias("offset"))
    assert metrics.marks_around(edges, seeds, 5.0, 10.0).count() in (3, 5)


def test_covered_injection_only(spark):
    """Of two patch edges far from the base only the one that a base edge follows on is injected; places are told by position."""
    bn, be = small_graph(spark, [((0, 0), (0, 100))])
    pn, pe = small_graph(spark, [((5, 0), (5, 50)), ((5, 50), (5, 100)), ((500, 0), (500, 100))])
    pe = pe.withColumn("u", F.col("u") + 1000).withColumn("v", F.col("v") + 1000).withColumn("threshold", F.lit(float("inf")))
    pn = pn.withColumn("nid", F.col("nid") + 1000)
    every = fusion.fuse(bn, be, pn, pe, 20.0)["a"][1].where("render = 'injected'").count()
    some = fusion.fuse(bn, be, pn, pe, 20.0, covered_injection_only=True)["a"][1].where("render = 'injected'").count()
    assert (every, some) == (3, 2)


def test_projection_round_trip(spark):
    nodes, edges = small_graph(spark, [((52.5, 13.4), (52.51, 13.41))])
    n, e = graph.to_latlon(*graph.to_utm(nodes, edges))
    back = {r.nid: (r.y, r.x) for r in n.collect()}
    assert all(np.allclose(back[r.nid], (r.y, r.x), atol=1e-6) for r in nodes.collect()) and e.columns[:3] == ["graph_id", "u", "v"]
    assert 1200 < graph.to_utm(nodes, edges)[1].first().length < 1400


def test_nearest_in_dense_places_meets_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    at = np.concatenate([rng.normal(0, 0.5, (1500, 2)), rng.normal(0, 300, (60, 2)), np.tile([[0.25, 0.5]], (1200, 1)), [[9000.0, 9000.0]]])
    ids = rng.permutation(len(at)) * 3
    left = spark.createDataFrame([(int(i), float(y), float(x)) for i, (y, x) in zip(ids, at)] + [(-1, float("nan"), 0.0), (-2, None, 1.0)], "lid long, ly double, lx double")
    right = left.toDF("rid", "ry", "rx")
    met, plain = [], spatial.box_join

    def counted(*args, **kw):
        out = plain(*args, **kw)
        met.append(out.count())
        return out

    monkeypatch.setattr(spatial, "box_join", counted)
    d = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1))
    np.fill_diagonal(d, np.inf)
    best = d.min(1)
    want = {int(i): (float(b), int(ids[row <= b + 1e-12].min())) for i, b, row in zip(ids, best, d)}
    for got in (spatial.nearest_point(left, right, 40.0), spatial.nearest_curve(left, right.select("rid", F.array(C.point(F.col("ry"), F.col("rx")), C.point(F.col("ry"), F.col("rx"))).alias("curve")), 40.0)):
        rows = {r["lid"]: (r["distance"], r["rid"]) for r in got.collect()}
        assert rows.keys() == want.keys()
        assert all(np.isclose(rows[i][0], want[i][0]) and rows[i][1] == want[i][1] for i in want)
        assert sum(met) < 60 * len(at)
        met.clear()
    alone = spatial.nearest_point(left.where("lid = 0"), right.where("rid = 0"), 1.0)
    assert alone.count() == 0


def test_nearest_among_long_segments(spark, monkeypatch):
    rng = np.random.default_rng(7)
    a = np.concatenate([rng.uniform(0, 1000, (1200, 2)), [[-4e5, 3e5]]])
    b = a + rng.normal(0, 600, a.shape)
    b[:300] = a[:300] + rng.choice([0.0, 250.0, 1e-6], (300, 2))  # upright, level, diagonal and without a length
    at = np.concatenate([a[:1000], [[7e5, -2e5], [500.0, 500.0]]])
    plans, plain = [], spatial.settled
    monkeypatch.setattr(spatial, "settled", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    left = spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(at)], "lid long, ly double, lx double")
    rows = [(i, [tuple(map(float, p)) for p in (p, q)]) for i, (p, q) in enumerate(zip(a, b))] + [(5000, [(0.0, None), (1.0, 1.0)]), (5001, [(float("nan"), 0.0), (1.0, 1.0)])]
    right = spark.createDataFrame(rows, "rid long, curve array<struct<y: double, x: double>>")
    got = {r.lid: (r.distance, r.rid) for r in spatial.nearest_curve(left, right, 40.0).collect()}
    d, e = b - a, at[:, None] - a[None]
    flat = (np.abs(d) < 1e-4).all(1)
    t = np.where(flat, 0, np.clip((e * d).sum(2) / np.where(flat, 1, (d * d).sum(1)), 0, 1))
    away = np.linalg.norm(a + t[..., None] * d - at[:, None], axis=2)
    away[np.arange(len(at)), np.arange(len(at))] = np.inf
    assert got.keys() == set(range(len(at)))
    assert all(np.isclose(got[i][0], away[i].min(), rtol=1e-9, atol=1e-9) and np.isclose(away[i, got[i][1]], away[i].min(), rtol=1e-9, atol=1e-9) for i in got)
    # what each pair is asked for is compiled: functions of arrays are interpreted, which took most of the time
    assert any("Join" in p for p in plans) and not any("Join" in p and "lambda" in p for p in plans)
    # a long slanted segment lies in the cells that it passes, each named once, not in all of its box
    one = right.where("rid = 0").selectExpr("0L as rid", "0D as ay", "0D as ax", "900D as by", "700D as bx")
    cells = [(r["_cy"], r["_cx"]) for r in spatial._drawn(one, 10.0, 1e-6).collect()]
    assert len(cells) == len(set(cells)) <= 180 and {(int(900 * f // 10), int(700 * f // 10)) for f in np.linspace(0, 1, 5001)} <= set(cells)
