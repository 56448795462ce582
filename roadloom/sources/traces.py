"""GPS traces, graph tables and release bundles."""

from __future__ import annotations

import json
import tarfile
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geodesy as G

LINE = r"\s+"


def fields(column: str = "value"):
    return F.split(F.trim(F.col(column)), LINE)


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    """``(trip_id, y, x, t)`` of every three-field line of the trace files under ``path``; a trip is a file, ordered by time."""
    lines = spark.read.option("pathGlobFilter", "*.txt").text(path).select("value", F.col("_metadata.file_name").alias("trip_id"))
    f = fields()
    return lines.where(F.size(f) == 3).select("trip_id", f[1].cast("double").alias("y"), f[0].cast("double").alias("x"), f[2].cast("double").alias("t"))


def to_geographic(trips: DataFrame, zone: int) -> DataFrame:
    """Traces from UTM to longitude and latitude: (trip_id, lon, lat, t)."""
    lat, lon = G.latlon_from_utm(F.col("y"), F.col("x"), zone)
    return trips.select("trip_id", lon.alias("lon"), lat.alias("lat"), "t")


def write_trips(trips: DataFrame, path: str) -> None:
    trips.select(F.format_string("%.7f %.7f %s", "lon", "lat", F.col("t").cast("string")).alias("value"), "trip_id").write.partitionBy("trip_id").text(path)


def trip_steps(points: DataFrame) -> DataFrame:
    """Adds ``step`` and ``dt`` from the point before to ``points(trip, y, x, t)``."""
    w = Window.partitionBy("trip").orderBy("t")
    dy, dx = F.col("y") - F.lag("y").over(w), F.col("x") - F.lag("x").over(w)
    return points.withColumn("step", F.sqrt(dy * dy + dx * dx)).withColumn("dt", F.col("t") - F.lag("t").over(w))


def trip_statistics(points: DataFrame) -> DataFrame:
    """Trips, samples, distance and means over all points; the mean interval is over intervals. 0 when there are none."""
    per = trip_steps(points).groupBy("trip").agg(F.count("*").alias("n"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("d"), F.coalesce(F.sum("dt"), F.lit(0.0)).alias("dt"), F.count("dt").alias("k"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return per.agg(
        F.count("*").alias("trips"), F.coalesce(F.sum("n"), F.lit(0)).alias("samples"), zero(F.sum("d")).alias("distance"),
        zero(F.avg("n")).alias("samples_per_trip"), zero(F.avg("d")).alias("distance_per_trip"), zero(F.try_divide(F.sum("dt"), F.sum("k"))).alias("mean_interval"),
    )


def read_graph_csv(spark: SparkSession, folder: str, graph_id: str = "") -> tuple[DataFrame, DataFrame, str]:
    """Nodes, edges and the coordinate system of ``vertices.csv`` (id and x, y or lat, lon) and ``edges.csv`` (u, v)."""
    v = spark.read.option("header", True).csv(f"{folder}/vertices.csv")
    planar = "x" in v.columns
    y, x = ("y", "x") if planar else ("lat", "lon")
    nodes = v.select(F.lit(graph_id).alias("graph_id"), F.col("id").cast("long").alias("nid"), F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"))
    e = spark.read.option("header", True).schema("u long, v long").csv(f"{folder}/edges.csv")
    edges = e.select(F.lit(graph_id).alias("graph_id"), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return nodes, edges, "utm" if planar else "latlon"


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").partitionBy("graph_id").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("graph_id").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str, graph_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    out = (spark.read.parquet(f"{path}/{t}").withColumn("graph_id", F.col("graph_id").cast("string")) for t in ("nodes", "edges"))
    return tuple(d.where(F.col("graph_id") == graph_id) if graph_id is not None else d for d in out)


def parse_version(text: str) -> dict:
    import re

    m = re.fullmatch(r"v*(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?", text.strip())
    if not m:
        raise ValueError(f"not a version: {text!r}")
    return {"major": int(m[1]), "minor": int(m[2]), "patch": int(m[3]), "prerelease": m[4]}


def build_release(version: str, traces: dict[str, str], output: str, commit: str = "", branch: str = "", readme: str | None = None) -> dict:
    """A tar of each city's trace files with version, metadata and readme; returns the metadata."""
    import io

    meta = {"version": version, "build_date": datetime.now(timezone.utc).isoformat(), "git_commit": commit, "git_branch": branch}
    root = f"release-{version}"
    with tarfile.open(output, "w:gz") as tar:
        for city, folder in traces.items():
            files = sorted(Path(folder).glob("*.txt"))
            if not files:
                raise FileNotFoundError(f"no traces in {folder}")
            for f in files:
                tar.add(f, f"{root}/inputs/gps/{city}/{f.name}")
        for name, body in (("metadata.json", json.dumps(meta)), ("VERSION", version), *((("README.md", Path(readme).read_text()),) if readme else ())):
            info = tarfile.TarInfo(f"{root}/{name}")
            info.size = len(body.encode())
            tar.addfile(info, io.BytesIO(body.encode()))
    return meta


def extract_release(path: str, folder: str) -> str:
    """Unpacks a release, members outside the folder refused; returns its root."""
    with tarfile.open(path) as tar:
        tar.extractall(folder, filter="data")
        return f"{folder}/{tar.getnames()[0].split('/')[0]}"


def list_release(path: str) -> dict:
    with tarfile.open(path) as tar:
        files = [m for m in tar.getmembers() if m.isfile()]
    cities: dict[str, int] = {}
    for m in files:
        parts = m.name.split("/")
        if len(parts) == 5 and parts[1:3] == ["inputs", "gps"]:
            cities[parts[3]] = cities.get(parts[3], 0) + 1
    return {"cities": cities, "total_bytes": sum(m.size for m in files), "version": files[0].name.split("/")[0].removeprefix("release-") if files else None}


def load_release(root: str) -> dict:
    if not Path(root).is_dir():
        raise FileNotFoundError(root)
    meta = json.loads(Path(root, "metadata.json").read_text())
    missing = {"version", "build_date", "git_commit", "git_branch"} - meta.keys()
    if missing:
        raise KeyError(f"metadata lacks {sorted(missing)}")
    gps = Path(root, "inputs/gps")
    cities = {d.name: sorted(map(str, d.glob("*.txt"))) for d in sorted(gps.iterdir()) if d.is_dir()} if gps.is_dir() else {}
    return {"metadata": meta, "version": parse_version(meta["version"]), "gps": cities}
