"""Where graphs and results lie, whether they are there, and using them again instead of making them anew."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curve as C
from ..operators import graph, structure
from . import traces

#: The variants of a place's graph, and the metrics.
BASE, FUSED, FUSED_COVERED, METRICS = ("osm", "sat", "gps"), ("A", "B", "C"), ("A2", "B2", "C2"), ("apls", "topo")


def fusion_variants(covered_injection_only: bool = False) -> tuple[str, ...]:
    return FUSED_COVERED if covered_injection_only else FUSED


class Store:
    """Graphs and results of places under one folder that driver and executors share; paths may have any scheme Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def folder(self, *parts: str) -> str:
        """The path of a folder, which is made if it is not there."""
        path = "/".join([self.root, *parts])
        system, place = self._at(path)
        system.mkdirs(place)
        return path

    def exists(self, path: str) -> bool:
        """Whether a file, folder or wholly written table is there; a table that was cut off while being written is not."""
        system, place = self._at(path)
        if not system.exists(place):
            return False
        names = [f.getPath().getName() for f in system.listStatus(place)] if system.getFileStatus(place).isDirectory() else []
        return "_SUCCESS" in names or not any(n.startswith(("part-", "_temporary")) for n in names)

    def age(self, path: str) -> float:
        """Seconds since a file or folder was last changed."""
        system, place = self._at(path)
        return time.time() - system.getFileStatus(place).getModificationTime() / 1000

    def delete(self, path: str) -> None:
        system, place = self._at(path)
        system.delete(place, True)

    def graph_path(self, place: str, variant: str, threshold: int | None = None, inverse: bool = False, prepared: bool = False) -> str:
        """The folder of one graph. Fused variants need a threshold, base variants have none."""
        if variant not in BASE + FUSED + FUSED_COVERED:
            raise ValueError(f"unknown variant: {variant!r}")
        if variant in BASE:
            parts = [variant, place]
        elif threshold is None:
            raise ValueError(f"variant {variant} needs a threshold")
        else:
            parts = [variant, place, str(threshold), *(["inverse"] if inverse else [])]
        return f"{self.root}/{'prepared' if prepared else 'graphs'}/{'-'.join(parts)}"

    def result_path(self, kind: str, place: str, variant: str, threshold: int | None = None, inverse: bool = False, metric: str | None = None, metric_threshold: float | None = None, metric_interval: float | None = None, prime: bool = False) -> str:
        """The folder of one result: ``kind`` is shortest_paths, metrics or samples."""
        if metric is not None and metric not in METRICS:
            raise ValueError(f"unknown metric: {metric!r}")
        name = self.graph_path(place, variant, threshold, inverse).rsplit("/", 1)[1]
        rest = [str(x) for x in (metric, metric_threshold, metric_interval) if x is not None]
        return f"{self.root}/results/{kind}{'_prime' if prime else ''}/{'-'.join([name, *rest])}"

    def reused(self, path: str, make: Callable[[], DataFrame], re_use: bool = True) -> DataFrame:
        """The table at ``path``, made and written first if it is not there whole or must not be used again."""
        if not (re_use and self.exists(path)):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def extended(self, path: str, count: int, make: Callable[[int, int], DataFrame]) -> DataFrame:
        """The samples at ``path``, topped up to ``count`` rows: ``make(n, had)`` gives ``n`` more where ``had`` are there."""
        had = self.spark.read.parquet(path).count() if self.exists(path) else 0
        if had < count:
            make(count - had, had).write.mode("append").parquet(path)
        return self.spark.read.parquet(path)

    def write_graph(self, nodes: DataFrame, edges: DataFrame, path: str) -> None:
        traces.write_graph(nodes, edges, path)

    def has_graph(self, path: str) -> bool:
        return all(self.exists(f"{path}/{t}") for t in ("nodes", "edges")) and self.exists(f"{path}/edges/_SUCCESS")

    def read_graph(self, place: str, variant: str, threshold: int | None = None, inverse: bool = False, prepared: bool = False) -> tuple[DataFrame, DataFrame]:
        return traces.read_graph(self.spark, self.graph_path(place, variant, threshold, inverse, prepared))

    def base_maps(self, places: list[str]) -> dict[str, dict[str, tuple[DataFrame, DataFrame]]]:
        return {p: {v: self.read_graph(p, v) for v in BASE} for p in places}

    def fusion_maps(self, places: list[str], threshold: int = 30, covered_injection_only: bool = False) -> dict[str, dict[str, tuple[DataFrame, DataFrame]]]:
        return {p: {v: self.read_graph(p, v, threshold) for v in fusion_variants(covered_injection_only)} for p in places}

    def all_maps(self, places: list[str], threshold: int = 30, covered_injection_only: bool = False) -> dict[str, dict[str, tuple[DataFrame, DataFrame]]]:
        base, fused = self.base_maps(places), self.fusion_maps(places, threshold, covered_injection_only)
        return {p: base[p] | fused[p] for p in places}

    def import_graph(self, place: str, variant: str, folder: str) -> tuple[DataFrame, DataFrame]:
        """A place's graph from ``vertices.csv`` and ``edges.csv`` in degrees: sanitised, checked, kept; broken invariants are an error."""
        nodes, edges, system = traces.read_graph_csv(self.spark, folder, place)
        if system != "latlon":
            raise ValueError(f"{folder} is not in degrees")
        nodes, edges = graph.sanitized(nodes, edges)
        self._checked(nodes, edges, f"{variant}-{place}")
        self.write_graph(nodes, edges, self.graph_path(place, variant))
        return self.read_graph(place, variant)

    def prepared(self, place: str, variant: str, threshold: int | None = None, inverse: bool = False, re_use: bool = True) -> tuple[DataFrame, DataFrame]:
        """A graph without what was deleted, checked, as the metrics take it."""
        path = self.graph_path(place, variant, threshold, inverse, prepared=True)
        if not (re_use and self.has_graph(path)):
            nodes, edges = self.read_graph(place, variant, threshold, inverse)
            nodes, edges = structure.remove_deleted(nodes, edges) if "render" in edges.columns else (nodes, edges)
            edges = edges.withColumn("length", C.length(F.col("curve")))
            self._checked(nodes, edges, path)
            self.write_graph(nodes, edges, path)
        return self.read_graph(place, variant, threshold, inverse, prepared=True)

    @staticmethod
    def _checked(nodes: DataFrame, edges: DataFrame, name: str) -> None:
        broken = {r["invariant"]: r["violations"] for r in structure.violations(nodes, edges).where(F.col("violations") > 0).collect()}
        if broken:
            raise ValueError(f"{name} breaks invariants: {broken}")
