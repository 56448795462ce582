import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from roadloom.functions import curve as C
from roadloom.functions import geodesy as G
from roadloom.plans import sweeps
from roadloom.scratch import settled
from roadloom.sources import archives, traces
from roadloom.sources.store import Store, fusion_variants

EDGE = "graph_id string, u long, v long, k int, curve array<struct<y:double,x:double>>, length double"


def chain(spark, y, first, count=3):
    """Nodes a hundred metres apart along a level, and the edges between them."""
    n = [("p", first + i, float(y), 100.0 * i + 500) for i in range(count)]
    e = [("p", first + i, first + i + 1, 0, [(float(y), 100.0 * i + 500), (float(y), 100.0 * i + 600)], 100.0) for i in range(count - 1)]
    return spark.createDataFrame(n, "graph_id string, nid long, y double, x double"), spark.createDataFrame(e, EDGE)


def test_layout(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.graph_path("berlin", "osm") == f"{tmp_path}/graphs/osm-berlin"
    assert s.graph_path("berlin", "C", 30, True) == f"{tmp_path}/graphs/C-berlin-30-inverse"
    assert s.result_path("samples", "berlin", "A2", 5, metric="topo", metric_threshold=5.5, prime=True) == f"{tmp_path}/results/samples_prime/A2-berlin-5-topo-5.5"
    for wrong in (lambda: s.graph_path("berlin", "C"), lambda: s.graph_path("berlin", "X"), lambda: s.result_path("metrics", "berlin", "osm", metric="x")):
        with pytest.raises(ValueError):
            wrong()
    assert fusion_variants() == ("A", "B", "C") and fusion_variants(True) == ("A2", "B2", "C2")


def test_reuse_and_extension(spark, tmp_path):
    s, made = Store(spark, str(tmp_path)), []

    def make():
        made.append(1)
        return spark.range(3)

    path = f"{tmp_path}/t"
    assert not s.exists(path)
    assert s.reused(path, make).count() == 3 and s.reused(path, make).count() == 3 and len(made) == 1
    assert s.reused(path, make, re_use=False).count() == 3 and len(made) == 2
    assert s.exists(path) and 0 <= s.age(path) < 600
    more = lambda n, had: spark.range(had, had + n)
    for count in (5, 5, 8):
        assert sorted(r["id"] for r in s.extended(f"{tmp_path}/e", count, more).collect()) == list(range(count))
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut/part-0.parquet").write_bytes(b"")
    assert not s.exists(f"{tmp_path}/cut")


def test_maps_are_fused_once_and_read_back(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.write_graph(*chain(spark, 500, 0), s.graph_path("p", "sat"))
    s.write_graph(*chain(spark, 504, 0, 5), s.graph_path("p", "gps"))
    sweeps.obtain_maps(s, ["p"], [20], [False])
    path = s.graph_path("p", "C", 20)
    before = s.age(f"{path}/edges")
    sweeps.obtain_maps(s, ["p"], [20], [False])
    assert s.age(f"{path}/edges") >= before
    counts = {r["render"]: r["n"] for r in s.fusion_maps(["p"], 20)["p"]["C"][1].groupBy("render").agg(F.count("*").alias("n")).collect()}
    assert counts["injected"] == 2
    nodes, edges = s.prepared("p", "C", 20)
    assert edges.where("render = 'deleted'").isEmpty() and s.has_graph(s.graph_path("p", "C", 20, prepared=True)) and nodes.count() > 0


def test_sweep_counts(spark):
    swept = sweeps.fuse_at(chain(spark, 500, 0), chain(spark, 504, 0, 5), [2, 20], [False])
    rows = {r["threshold"]: r for r in sweeps.threshold_actions(swept).collect()}
    assert rows[2]["injected"] == 4 and rows[20]["injected"] == 2
    info = sweeps.basics(*chain(spark, 500, 0))
    long = sweeps.constant_series(sweeps.long_form(info, ["graph_id"], ["nodes", "edges", "length_km"]), [1, 2])
    assert sorted((r["item"], r["threshold"], r["value"]) for r in long.collect()) == [("edges", 1, 2.0), ("edges", 2, 2.0), ("length_km", 1, 0.2), ("length_km", 2, 0.2), ("nodes", 1, 3.0), ("nodes", 2, 3.0)]


def test_sweep_broadcasts_nothing_and_keeps_graphs_apart(spark, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settled(df)

    for module in (sweeps, sweeps.fusion):
        monkeypatch.setattr(module, "settled", seen)
    many = lambda graphs: tuple(settled(d.drop("graph_id").crossJoin(spark.range(60).select(F.format_string("g%d", "id").alias("graph_id")))) for d in graphs)
    counts = sweeps.threshold_actions(sweeps.fuse_at(many(chain(spark, 500, 0)), many(chain(spark, 504, 0, 5)), [2], [False]))
    plans.append(counts._jdf.queryExecution().executedPlan().toString())
    assert [tuple(r) for r in counts.select("injected").groupBy("injected").count().collect()] == [(4, 60)]
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    assert joins and not any("BroadcastHashJoin" in line for line in joins)
    assert all("graph" in line or "_by" in line for line in joins)


def test_ratios_and_typst(spark):
    t = spark.createDataFrame([("b", 1, 4, 0.5, 2.0), ("a", 0, 0, 0.0, 0.0)], "place string, injected_edges long, total_edges long, injected_km double, total_km double")
    t = sweeps.injection_ratios(t)
    assert [(r["edge_ratio"], r["length_ratio"]) for r in t.orderBy("place").collect()] == [(0.0, 0.0), (0.25, 0.25)]
    said = sweeps.typst_table(t, {"place": ("Place", None), "edge_ratio": ("Share", 3)}, ["place"], "About", "table:x")
    assert "columns: 2" in said and said.index("[a], [0.000]") < said.index("[b], [0.250]") and said.endswith("<table:x>")


def test_archives(tmp_path):
    with tarfile.open(tmp_path / "t.tar", "w") as tar:
        info = tarfile.TarInfo("maps-1/readme")
        info.size = 2
        tar.addfile(info, io.BytesIO(b"ok"))
    root = archives.extract_tarball(str(tmp_path / "t.tar"), str(tmp_path / "out"), "maps-")
    assert root.endswith("maps-1")
    with pytest.raises(FileNotFoundError):
        archives.extract_tarball(str(tmp_path / "t.tar"), str(tmp_path / "out2"), "other-")
    with zipfile.ZipFile(tmp_path / "berlin.zip", "w") as z:
        z.writestr("trip_1.txt", "1 2 3\n")
    files, missing = archives.extract_traces(str(tmp_path), str(tmp_path / "traces"), {"berlin": "berlin.zip", "athens": "athens.zip"})
    assert files == {"berlin": 1} and missing == ["athens"]
    traces.build_release("1.0.0", {"berlin": str(tmp_path / "traces/berlin")}, str(tmp_path / "r.tar.gz"), "c", "b")
    told = archives.release_summary(traces.load_release(traces.extract_release(str(tmp_path / "r.tar.gz"), str(tmp_path / "x"))))
    assert "Release 1.0.0" in told and "berlin: 1 traces" in told and json.dumps(told)


def test_curve_helpers(spark):
    df = spark.range(50).select("id", C.random_curve(100, C.point(F.lit(-10.0), F.lit(-10.0)), C.point(F.lit(10.0), F.lit(10.0)), F.col("id")).alias("c"))
    stats = df.select("id", F.explode("c").alias("p")).agg(F.count("*").alias("n"), F.min("p.y").alias("lo"), F.max("p.x").alias("hi"), F.avg("p.y").alias("m"), F.count_distinct("p.x").alias("d")).first()
    assert stats["n"] == 5000 and stats["lo"] >= -10 and stats["hi"] <= 10 and abs(stats["m"]) < 0.5 and stats["d"] == 5000
    assert df.select(F.max(F.size("c"))).first()[0] == 100
    line = spark.range(1).select(F.array(C.point(F.lit(0.0), F.lit(0.0)), C.point(F.lit(0.0), F.lit(10.0))).alias("c"))
    for at, sizes in ((4.0, [4.0, 6.0]), (0.0, [10.0]), (10.0, [10.0]), (-1.0, [10.0])):
        assert line.select(F.transform(C.cut_line(F.col("c"), F.lit(at)), C.length).alias("l")).first()["l"] == pytest.approx(sizes)
    assert line.select(C.unzip(F.col("c"), "y", "x").alias("u")).first()["u"].asDict() == {"y": [0.0, 0.0], "x": [0.0, 10.0]}
    p = lambda y, x: C.point(F.lit(float(y)), F.lit(float(x)))
    near = line.select(C.closest_between(p(0, 0), p(0, 10), p(1, 6), p(-1, 6)).alias("p"), C.closest_between(p(3, 3), p(3, 3), p(1, 6), p(-1, 6)).alias("q")).first()
    assert (near["p"]["y"], near["p"]["x"]) == pytest.approx((0, 6)) and (near["q"]["y"], near["q"]["x"]) == (3, 3)


def test_image_geometry(spark):
    df = spark.createDataFrame([("a", 41.9, -87.7, 41.8, -87.6)], "place string, north double, west double, south double, east double")
    row = G.image_statistics(df).first()
    assert row["height"] % 88 == 0 and row["width"] % 88 == 0 and row["gsd"] <= 0.75
    assert row["area"] == pytest.approx(row["height"] * row["width"] * row["gsd"] ** 2, rel=0.02)
    box = df.select(G.image_bounds(F.col("north"), F.col("west"), F.col("south"), F.col("east"), 16).alias("b"), *[c.alias(n) for c, n in zip(G.pixel_from_latlon(F.col("north"), F.col("west"), 16), "yx", strict=True)]).first()
    assert box["y"] - 100 <= box["b"]["top"] <= box["y"] - 100 + 44 and box["x"] - 100 <= box["b"]["left"] <= box["x"] - 100 + 44
