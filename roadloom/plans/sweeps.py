"""Conflation at many thresholds and in both directions, and tables about the results."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import fusion, graph, structure
from ..scratch import settled
from ..sources.store import Store, fusion_variants


def shifted(nodes: DataFrame, edges: DataFrame, past: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph whose ids lie past the greatest of ``past``'s nodes of the same graph_id."""
    most = past.groupBy("graph_id").agg((F.max("nid") + 1).alias("_past"))
    own = nodes.groupBy("graph_id").agg(F.min("nid").alias("_least"))
    by = F.coalesce("_past", F.lit(0)) - F.col("_least")
    at = own.join(most.hint("merge"), "graph_id", "left").select("graph_id", by.alias("_by")).hint("merge")
    moved = edges.join(at, "graph_id").withColumns({"u": F.col("u") + F.col("_by"), "v": F.col("v") + F.col("_by")})
    return nodes.join(at, "graph_id").withColumn("nid", F.col("nid") + F.col("_by")).drop("_by"), moved.drop("_by")


def fuse_at(one: tuple[DataFrame, DataFrame], other: tuple[DataFrame, DataFrame], thresholds: Iterable[int], inverse: Iterable[bool] = (False, True), covered_injection_only: bool = False, most: int = 50) -> dict[tuple[int, bool], dict[str, tuple[DataFrame, DataFrame]]]:
    """The conflation at each threshold and direction, variants a, b and c of each; ``inverse`` swaps base and patch.

    All graphs (by graph_id) are in each job. How near the base follows a patch edge is found once a direction, for all thresholds.
    """
    out = {}
    wanted = sorted(set(thresholds))
    for swap in dict.fromkeys(inverse):
        base, patch = (other, one) if swap else (one, other)
        patch_nodes, patch_edges = map(settled, shifted(*patch, base[0]))
        near = settled(graph.with_coverage(patch_edges, base[1], max([most, *wanted])))
        for t in wanted:
            out[t, swap] = fusion.fuse(*base, patch_nodes, near, float(t), covered_injection_only)
    return out


def obtain_maps(store: Store, places: list[str], thresholds: Iterable[int] = (30,), inverse: Iterable[bool] = (False,), re_use: bool = True, covered_injection_only: bool = False, prune_base: float | None = None) -> None:
    """Conflates each place's ``sat`` (base) with ``gps`` (patch) and keeps the variants; what is there already stays if ``re_use``.

    ``prune_base`` leaves out base edges that no path of the patch follows within so many metres.
    """
    names = fusion_variants(covered_injection_only)
    for place in places:
        for swap in dict.fromkeys(inverse):
            paths = {t: [store.graph_path(place, v, t, swap) for v in names] for t in sorted(set(thresholds))}
            todo = [t for t, p in paths.items() if not (re_use and all(map(store.has_graph, p)))]
            if not todo:
                continue
            sat, gps = store.read_graph(place, "sat"), store.read_graph(place, "gps")
            if prune_base is not None:
                near = structure.prune(settled(graph.with_coverage(sat[1], gps[1], int(prune_base))), prune_base)
                used = structure.incidence(near).select("graph_id", "nid").distinct()
                sat = sat[0].join(used, ["graph_id", "nid"], "left_semi"), graph.without_coverage(near)
            for (t, _), variants in fuse_at(sat, gps, todo, [swap], covered_injection_only).items():
                for path, graphs in zip(paths[t], (variants["a"], variants["b"], variants["c"]), strict=True):
                    store.write_graph(*graphs, path)


def basics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph_id, nodes, edges, length_km)``; an edge without a length has that of its curve."""
    sums = edges.groupBy("graph_id").agg(F.count("*").alias("edges"), (F.sum("length") / 1000).alias("length_km"))
    counts = nodes.groupBy("graph_id").agg(F.count("*").alias("nodes"))
    return counts.join(sums, "graph_id", "full").select("graph_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("nodes", "edges")], F.coalesce("length_km", F.lit(0.0)).alias("length_km"))


def long_form(table: DataFrame, ids: list[str], items: list[str]) -> DataFrame:
    """One row for each item of each row: ``ids``, item, value."""
    return table.select(*ids, *[F.col(c).cast("double").alias(c) for c in items]).unpivot(ids, items, "item", "value")


def constant_series(table: DataFrame, thresholds: Iterable[int]) -> DataFrame:
    """Each row at every threshold: what does not change with it."""
    return table.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in sorted(set(thresholds))])))


def tagged(tables: dict[tuple[int, bool], DataFrame]) -> DataFrame:
    """Tables by threshold and direction as one, with the columns ``threshold`` and ``inverse``."""
    return reduce(DataFrame.unionByName, [d.withColumns({"threshold": F.lit(t), "inverse": F.lit(swap)}) for (t, swap), d in tables.items()])


def threshold_actions(swept: dict[tuple[int, bool], dict[str, tuple[DataFrame, DataFrame]]]) -> DataFrame:
    """``(graph_id, threshold, inverse, injected, deleted, reconnected)``; reconnections are variant c's connections less variant a's."""
    first = tagged({k: fusion.action_counts(v["a"][1], "graph_id").select("graph_id", F.col("connection").alias("before")) for k, v in swept.items()})
    last = tagged({k: fusion.action_counts(v["c"][1], "graph_id") for k, v in swept.items()})
    keys = ["graph_id", "threshold", "inverse"]
    return last.join(first.hint("merge"), keys).select(*keys, "injected", "deleted", (F.col("connection") - F.col("before")).alias("reconnected"))


def injection_ratios(table: DataFrame) -> DataFrame:
    """Adds the injected share of the edges and of the length to ``injected_edges, total_edges, injected_km, total_km``; 0 of nothing."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return table.withColumns({"edge_ratio": share("injected_edges", "total_edges"), "length_ratio": share("injected_km", "total_km")})


def typst_cell(value: Column, digits: int | None = None) -> Column:
    text = value.cast("string") if digits is None else F.format_string(f"%.{digits}f", value.cast("double"))
    return F.concat(F.lit("["), F.coalesce(text, F.lit("-")), F.lit("]"))


def typst_table(rows: DataFrame, columns: dict[str, tuple[str, int | None]], order: list[str], caption: str, label: str) -> str:
    """A report table (one row a place and scenario) as Typst markup; ``columns`` names a heading and digits for each column."""
    cells = rows.orderBy(*order).select(F.concat_ws(", ", *[typst_cell(F.col(c), digits) for c, (_, digits) in columns.items()]).alias("cells")).collect()
    head = ", ".join(f"[{heading}]" for heading, _ in columns.values())
    body = "\n".join(f"    {r['cells']}," for r in cells)
    return f"#figure(\n  table(\n    columns: {len(columns)},\n    table.header({head}),\n{body}\n  ),\n  caption: [{caption}],\n) <{label}>"
