"""Range and nearest-neighbour joins over grid cells."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import curve as C
from ..scratch import settled


def _cells(box: Column, size: float, pad: float) -> Column:
    """The grid cells that a padded box meets, as (cy, cx) structs."""
    axis = lambda low, high: F.sequence(F.floor((box[low] - pad) / size).cast("bigint"), F.floor((box[high] + pad) / size).cast("bigint"))
    return F.flatten(F.transform(axis("miny", "maxy"), lambda cy: F.transform(axis("minx", "maxx"), lambda cx: F.struct(cy.alias("cy"), cx.alias("cx")))))


def box_join(left: DataFrame, right: DataFrame, radius: float, size: float, left_box: str = "lbox", right_box: str = "rbox", by: tuple[str, str] | None = None) -> DataFrame:
    """Pairs whose boxes overlap once the left one is padded by ``radius`` (closed), each pair once.

    Both sides are dealt out to grid cells of ``size`` and meet in an equi-join; a pair that shares several cells is kept only in the
    one that holds the upper left corner of the boxes' intersection, so no de-duplicating shuffle follows. ``by`` names a left and a
    right column that must be equal too, such as their graphs'. Neither side is broadcast, as both grow with the input.
    """
    a = left.withColumn("_cell", F.explode(_cells(F.col(left_box), size, radius)))
    b = right.withColumn("_cell", F.explode(_cells(F.col(right_box), size, 0.0)))
    if by:
        met = a.withColumn("_by", F.col(by[0])).join(b.withColumn("_by", F.col(by[1])).hint("merge"), ["_cell", "_by"]).drop("_by")
    else:
        met = a.join(b.hint("merge"), "_cell")
    padded = C.pad_bounding_box(F.col(left_box), radius)
    corner_y = F.floor(F.greatest(padded["miny"], F.col(right_box)["miny"]) / size).cast("bigint")
    corner_x = F.floor(F.greatest(padded["minx"], F.col(right_box)["minx"]) / size).cast("bigint")
    return met.where(C.boxes_overlap(padded, F.col(right_box)) & (F.col("_cell")["cy"] == corner_y) & (F.col("_cell")["cx"] == corner_x)).drop("_cell")


def point_box(y: str, x: str) -> Column:
    return F.struct(F.col(y).alias("miny"), F.col(x).alias("minx"), F.col(y).alias("maxy"), F.col(x).alias("maxx"))


def radius_join(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of ``left(lid, ly, lx)`` and ``right(rid, ry, rx)`` within ``radius`` (closed), with their distance."""
    met = box_join(left.withColumn("lbox", point_box("ly", "lx")), right.withColumn("rbox", point_box("ry", "rx")), radius, radius)
    d = F.sqrt((F.col("ly") - F.col("ry")) * (F.col("ly") - F.col("ry")) + (F.col("lx") - F.col("rx")) * (F.col("lx") - F.col("rx")))
    return met.drop("lbox", "rbox").withColumn("distance", d).where(F.col("distance") <= radius)


def kd_ball(left: DataFrame, right: DataFrame, radius: float, k: int = 500) -> DataFrame:
    """At most the ``k`` nearest of the neighbours within ``radius``; ties by id. The limit is the operator's definition."""
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "rid"))), 1, k)
    return radius_join(left, right, radius).groupBy("lid").agg(best.alias("near")).select("lid", F.inline("near"))


def _extent(box: str) -> list[Column]:
    return [F.min(f"{box}.miny").alias("miny"), F.min(f"{box}.minx").alias("minx"), F.max(f"{box}.maxy").alias("maxy"), F.max(f"{box}.maxx").alias("maxx")]


#: The ends of a segment, for the rows that ``segment_join`` takes.
ENDS = ("ay", "ax", "by", "bx")


def _cell(at: Column, size: float) -> Column:
    return F.floor(at / size).cast("bigint")


def _boxed(rows: DataFrame, box: str, size: float, pad: float) -> DataFrame:
    """A row for each cell (_cy, _cx) that a padded box meets."""
    for axis in "yx":
        rows = rows.withColumn(f"_c{axis}", F.explode(F.sequence(_cell(F.col(box)[f"min{axis}"] - pad, size), _cell(F.col(box)[f"max{axis}"] + pad, size))))
    return rows


def _drawn(rows: DataFrame, size: float, slack: float) -> DataFrame:
    """A row for each cell (_cy, _cx) that a segment passes, or passes by within ``slack``: in each row of cells, or column if it is flat, a few."""
    steep = F.abs(F.col("by") - F.col("ay")) >= F.abs(F.col("bx") - F.col("ax"))
    ends = {e: F.when(steep, F.struct(F.col(f"{e}y").alias("m"), F.col(f"{e}x").alias("n"))).otherwise(F.struct(F.col(f"{e}x").alias("m"), F.col(f"{e}y").alias("n"))) for e in "ab"}
    on = rows.withColumn("_steep", steep).withColumn("_p", F.least(*ends.values())).withColumn("_q", F.greatest(*ends.values()))
    on = on.withColumn("_slope", F.coalesce(F.try_divide(F.col("_q.n") - F.col("_p.n"), F.col("_q.m") - F.col("_p.m")), F.lit(0.0)))
    on = on.withColumn("_i", F.explode(F.sequence(_cell(F.col("_p.m") - slack, size), _cell(F.col("_q.m") + slack, size))))
    at = lambda m: F.col("_p.n") + F.col("_slope") * (F.greatest(F.col("_p.m"), F.least(F.col("_q.m"), m)) - F.col("_p.m"))
    low, high = at(F.col("_i") * size), at((F.col("_i") + 1) * size)
    on = on.withColumn("_j", F.explode(F.sequence(_cell(F.least(low, high) - slack, size), _cell(F.greatest(low, high) + slack, size))))
    cells = {"_cy": F.when(F.col("_steep"), F.col("_i")).otherwise(F.col("_j")), "_cx": F.when(F.col("_steep"), F.col("_j")).otherwise(F.col("_i"))}
    return on.select(*rows.columns, *[c.alias(k) for k, c in cells.items()])


def segment_join(left: DataFrame, right: DataFrame, radius: float, size: float, slack: float) -> DataFrame:
    """Pairs of left boxes and right segments (``ENDS``) that share a grid cell once the boxes are padded by ``radius``: all that are within it.

    A pair comes once for each cell that it shares. A segment lies in the cells that it passes and not in all of its box, so long ones
    meet few boxes. ``slack`` covers the rounding of coordinates.
    """
    return _boxed(left, "lbox", size, radius + slack).join(_drawn(right, size, slack).hint("merge"), ["_cy", "_cx"]).drop("_cy", "_cx")


def _first_radius(left: DataFrame, right: DataFrame, radius: float, least: float, wanted: int, per_row: int) -> tuple[float, float]:
    """A first radius and grid size: the given radius, made larger where rows lie in far too many of its cells, or else smaller until rows
    in the same grid cells make about ``wanted`` pairs, as long as they don't lie in too many cells for that. Where segments then still
    meet more, the radius is a part of the size, for about ``per_row`` pairs a row within it."""
    drawn = set(ENDS) <= set(right.columns)
    spread = lambda box, size: F.sum((F.ceil((F.col(box)["maxy"] - F.col(box)["miny"]) / size) + 1) * (F.ceil((F.col(box)["maxx"] - F.col(box)["minx"]) / size) + 1))
    passed = lambda size: F.sum(2 * F.ceil(F.greatest(F.abs(F.col("by") - F.col("ay")), F.abs(F.col("bx") - F.col("ax"))) / size) + 1)
    counted = lambda rows, n: rows.groupBy("_cy", "_cx").agg(F.count("*").alias(n))
    cells = lambda size: left.agg(spread("lbox", size).alias("n")).first()["n"] + right.agg((passed(size) if drawn else spread("rbox", size)).alias("n")).first()["n"]
    radius, left_over = max(radius, 16 * least), left.count()
    while (many := cells(radius)) > 64 * wanted:
        radius *= 2 ** math.ceil(math.log2(many / wanted) / 4)
    while True:
        there = _drawn(right, radius, least) if drawn else _boxed(right, "rbox", radius, 0.0)
        met = counted(_boxed(left, "lbox", radius, 0.0), "l").join(counted(there, "r").hint("merge"), ["_cy", "_cx"]).agg(F.sum(F.col("l").cast("double") * F.col("r")).alias("n")).first()["n"] or 0
        if 9 * met <= wanted:
            return radius, radius
        part = min(1.0, per_row * left_over / met) if drawn else 1.0
        smaller = radius / 2 ** max(1, math.ceil(math.log2(9 * met / wanted) / 2))
        # a cell's row is shuffled and costs about as much as eight pairs, which are only compared
        if smaller < 16 * least or cells(smaller) > max(wanted, (1 + 2 * part) ** 2 * met / 8 if drawn else 0):
            return max(radius * part, 16 * least), radius
        radius = smaller


def nearest(left: DataFrame, right: DataFrame, distance: Column, radius: float, per_row: int = 16) -> DataFrame:
    """``(lid, rid, distance)``: the nearest right row of each left row by ``distance``, ties by smallest rid.

    ``left(lid, lbox, ...)`` and ``right(rid, rbox, ...)`` meet within a radius that grows for the rows still without a neighbour
    inside it; ``distance`` must be at least the distance of the boxes, or of the left box and the segment where right rows have
    ``ENDS``. Rows with lid = rid do not meet. Where rows are dense the first radius is smaller than the given one, for about
    ``per_row`` pairs a row; it grows the faster the fewer rows are left, and the last few rows meet all others. Rows alike but for their
    id are looked up once: left ones for the two nearest rids, one of which is not their own, right ones by their two smallest rids. Rows
    without a finite box have no neighbour.
    """
    finite = lambda box: reduce(Column.__and__, [F.abs(F.col(box)[c]) < math.inf for c in ("miny", "minx", "maxy", "maxx")])
    left, right = left.where(F.col("lid").isNotNull() & finite("lbox")), right.where(F.col("rid").isNotNull() & finite("rbox"))
    shape, other = ([c for c in rows.columns if c != key] for rows, key in ((left, "lid"), (right, "rid")))
    alike = Window.partitionBy(*other).orderBy("rid")
    right = settled(right.distinct().withColumn("_k", F.row_number().over(alike)).where("_k <= 2").drop("_k"))
    left = settled(left)
    leads = settled(left.groupBy(*shape).agg(F.min("lid").alias("_lead")))
    at_left = leads.agg(*_extent("lbox"), F.count("*").alias("n")).first()
    ids = right.agg(*_extent("rbox"), F.count("*").alias("n"), F.count_distinct("rid").alias("ids")).first()
    ends = [e for e in (at_left, ids) if e["n"]]
    if len(ends) < 2:
        return left.select("lid", F.lit(None).cast("long").alias("rid"), F.lit(None).cast("double").alias("distance")).limit(0)
    whole = math.hypot(*[max(e[f"max{c}"] for e in ends) - min(e[f"min{c}"] for e in ends) for c in "yx"])
    most = max([abs(e[c]) for e in ends for c in ("miny", "minx", "maxy", "maxx")])
    pairs = reduce(Column.__and__, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in shape])
    members = settled(left.alias("l").join(leads.alias("r").hint("merge"), pairs).select("l.lid", "_lead"))
    own = members.select("_lead", F.col("lid").alias("rid"))
    open_, left_over = leads, at_left["n"]
    wanted = per_row * (left_over + ids["n"])
    least = max(whole, most) * 2.0**-40
    drawn = set(ENDS) <= set(right.columns)
    radius, size = _first_radius(leads, right, radius, least, wanted, per_row)
    first = Window.partitionBy("_lead").orderBy("distance", "rid")
    out = None
    while True:
        few = left_over * ids["n"] <= wanted
        last = few or radius >= whole  # all boxes meet
        if few:
            met = right.crossJoin(F.broadcast(open_)) if left_over <= ids["n"] else open_.crossJoin(F.broadcast(right))
        else:
            met = segment_join(open_, right, radius, size, least) if drawn else box_join(open_, right, radius, radius)
        met = met.select("_lead", "rid", distance.alias("distance"))
        met = met.where(F.col("distance") < math.inf) if last else met.where(F.col("distance") <= radius)
        if few:  # of each half of the rids the least distance: the two nearest are no farther than the larger of both
            half = met.groupBy("_lead", F.pmod(F.xxhash64("rid"), F.lit(2)).alias("_half")).agg(F.min("distance").alias("d"))
            bound = half.groupBy("_lead").agg(F.when(F.count("*") > 1, F.max("d")).alias("_most"))
            met = met.join(bound, "_lead").where("_most is null or distance <= _most").drop("_most")
        if drawn and not few or ids["n"] > ids["ids"]:
            met = met.groupBy("_lead", "rid").agg(F.min("distance").alias("distance"))
        near = settled(met.withColumn("_k", F.row_number().over(first)).where("_k <= 2").drop("_k"))
        found = near.groupBy("_lead").agg(F.count("*").alias("n"), F.min("rid").alias("rid"))
        done = found.where("n > 1").select("_lead").unionAll(found.where("n = 1").join(own, ["_lead", "rid"], "left_anti").select("_lead"))
        near = near if last else near.join(done, "_lead", "left_semi")
        out = near if out is None else out.unionByName(near)
        if last:
            break
        open_ = settled(open_.join(done, "_lead", "left_anti"))
        before, left_over = left_over, open_.count()
        if not left_over:
            break
        radius *= 2 ** min(3, max(1, round(math.log2(before / left_over) / 2)))
        size = max(size, radius)
    best = out.join(members, "_lead").where("lid != rid").groupBy("lid").agg(F.min(F.struct("distance", "rid")).alias("m"))
    return best.select("lid", F.col("m.rid").alias("rid"), F.col("m.distance").alias("distance"))


def nearest_point(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Nearest other point: ``left(lid, ly, lx)``, ``right(rid, ry, rx)``."""
    dy, dx = F.col("ly") - F.col("ry"), F.col("lx") - F.col("rx")
    return nearest(left.withColumn("lbox", point_box("ly", "lx")), right.withColumn("rbox", point_box("ry", "rx")), F.sqrt(dy * dy + dx * dx), radius)


def nearest_curve(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Nearest curve of another id: ``left(lid, ly, lx)``, ``right(rid, curve)``."""
    known = right.where(F.forall("curve", lambda p: (F.abs(p["y"]) < math.inf) & (F.abs(p["x"]) < math.inf)))
    parts = known.select("rid", F.explode(C.segments(F.col("curve"))).alias("s")).select("rid", *[F.col(f"s.{e}.{axis}").alias(f"{e}{axis}") for e in "ab" for axis in "yx"])
    box = F.struct(*[f(F.col(f"a{axis}"), F.col(f"b{axis}")).alias(f"{name}{axis}") for name, f in (("min", F.least), ("max", F.greatest)) for axis in "yx"])
    d = C.distance_to_segment(*[F.col(c) for c in (*ENDS, "ly", "lx")])
    return nearest(left.withColumn("lbox", point_box("ly", "lx")), parts.withColumn("rbox", box), d, radius)


def crossings(edges: DataFrame, size: float) -> DataFrame:
    """Pairs (lid < rid) of straight edges ``(id, a, b)`` that cross strictly."""
    boxed = edges.select("id", "a", "b", C.bounding_box(F.array("a", "b")).alias("box"))
    left = boxed.select(F.col("id").alias("lid"), F.col("a").alias("la"), F.col("b").alias("lb"), F.col("box").alias("lbox"))
    right = boxed.select(F.col("id").alias("rid"), F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("box").alias("rbox"))
    met = box_join(left, right, 0.0, size).where("lid < rid")
    return met.where(C.crosses(F.col("la"), F.col("lb"), F.col("ra"), F.col("rb"))).select("lid", "rid")


def parallels(edges: DataFrame, pad: float, least: float = 0.985, shortest: float = 10.0) -> DataFrame:
    """Pairs (lid < rid) of edges at least ``shortest`` long, near one another, whose directions have an absolute cosine over ``least``."""
    long_ = edges.where(C.distance(F.col("a"), F.col("b")) >= shortest).withColumn("box", C.bounding_box(F.array("a", "b")))
    left = long_.select(F.col("id").alias("lid"), F.col("a").alias("la"), F.col("b").alias("lb"), F.col("box").alias("lbox"))
    right = long_.select(F.col("id").alias("rid"), F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("box").alias("rbox"))
    cos = F.abs(C.cosine(F.col("la"), F.col("lb"), F.col("ra"), F.col("rb")))
    return box_join(left, right, pad, max(pad, shortest)).where("lid < rid").withColumn("cosine", cos).where(F.col("cosine") > least).select("lid", "rid", "cosine")
