"""Polygon rings as plain array columns: ``array<array<struct<x,y>>>``, closed, shell first."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RING_TYPE = "array<struct<x:double,y:double>>"
RINGS_TYPE = f"array<{RING_TYPE}>"
PARTS_TYPE = f"array<{RINGS_TYPE}>"

# Metres per degree and the constant cosine of the quick registration formula.
M_PER_DEG = 111320.0
M_PER_DEG_UI = 111319.5
COS_REGISTRATION = 0.89
CANVAS_SQM_PER_PX = 0.24


def let(value: Column, fn) -> Column:
    """``fn(v)`` with ``value`` evaluated once. Inside a lambda an outer expression is worked out again for
    every element; a bound variable is not."""
    return F.transform(F.array(value), fn)[0]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rect_rings(x0, y0, x1, y1) -> Column:
    """Rings of an axis-parallel rectangle, counter-clockwise and closed."""
    x0, y0, x1, y1 = (F.col(c) if isinstance(c, str) else c for c in (x0, y0, x1, y1))
    return F.array(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0)))


def _tail(ring: Column, start: int) -> Column:
    return F.slice(ring, F.lit(start), F.greatest(F.size(ring) - 1, F.lit(0)))


def edges(ring: Column) -> Column:
    """Consecutive vertex pairs of a closed ring as ``struct<ax,ay,bx,by>``."""
    return F.zip_with(
        _tail(ring, 1), _tail(ring, 2),
        lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")),
    )


def all_edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, edges))


def all_points(rings: Column) -> Column:
    return F.flatten(rings)


def map_points(rings: Column, fn) -> Column:
    """Apply ``fn(x, y) -> (x, y)`` to every vertex."""
    def one(p):
        x, y = fn(p["x"], p["y"])
        return point(x, y)
    return F.transform(rings, lambda ring: F.transform(ring, one))


def map_ring(ring: Column, fn) -> Column:
    return map_points(F.array(ring), fn)[0]


def cross_sum(ring: Column) -> Column:
    """Twice the signed area of a closed ring, taken about its first vertex for precision."""
    def about(r):
        return let(r[0], lambda o: F.aggregate(
            edges(r), F.lit(0.0),
            lambda acc, e: acc + ((e["ax"] - o["x"]) * (e["by"] - o["y"]) - (e["bx"] - o["x"]) * (e["ay"] - o["y"]))))
    return let(ring, about)


def ring_area(ring: Column) -> Column:
    """Planar area of one ring, closed or not (an open ring is closed first)."""
    return F.abs(cross_sum(let(ring, close_ring))) / 2.0


def is_closed(ring: Column) -> Column:
    return F.element_at(ring, 1) == F.element_at(ring, -1)


def close_ring(ring: Column) -> Column:
    """Append the first vertex when the last one differs."""
    return F.when((F.size(ring) > 0) & ~is_closed(ring), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def planar_area(rings: Column) -> Column:
    """Shell minus holes in squared coordinate units."""
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return F.abs(cross_sum(rings[0])) / 2.0 - F.aggregate(
        holes, F.lit(0.0), lambda acc, r: acc + F.abs(cross_sum(r)) / 2.0
    )


def _ring_moments(ring: Column, ox: Column, oy: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(acc, e):
        ax, ay, bx, by = e["ax"] - ox, e["ay"] - oy, e["bx"] - ox, e["by"] - oy
        c = ax * by - bx * ay
        return F.struct((acc["a"] + c).alias("a"), (acc["mx"] + (ax + bx) * c).alias("mx"),
                        (acc["my"] + (ay + by) * c).alias("my"))

    return F.aggregate(edges(ring), zero, add)


def moments(rings: Column) -> Column:
    """``struct<a2,mx,my>`` over shell minus holes, about the first shell vertex."""
    zero = F.struct(F.lit(0.0).alias("a2"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(acc, e):
        s = F.signum(e["m"]["a"]) * F.when(e["i"] == 0, 1.0).otherwise(-1.0)
        return F.struct((acc["a2"] + s * e["m"]["a"]).alias("a2"), (acc["mx"] + s * e["m"]["mx"]).alias("mx"),
                        (acc["my"] + s * e["m"]["my"]).alias("my"))

    def about(rs):
        return let(rs[0][0], lambda o: F.aggregate(
            F.transform(rs, lambda r, i: F.struct(_ring_moments(r, o["x"], o["y"]).alias("m"), i.alias("i"))), zero, add))

    return let(rings, about)


def vertex_mean(ring: Column) -> Column:
    """Plain mean of the listed vertices, closing one included."""
    return let(ring, lambda r: point(
        F.aggregate(r, F.lit(0.0), lambda a, p: a + p["x"]) / F.size(r).cast("double"),
        F.aggregate(r, F.lit(0.0), lambda a, p: a + p["y"]) / F.size(r).cast("double")))


def area_centroid(rings: Column) -> Column:
    """``struct<area,x,y>`` in one pass over the edges: shell minus holes and the area-weighted
    centroid, or the vertex mean where the area is zero."""
    def read(rs):
        return let(moments(rs), lambda m: F.struct(
            (m["a2"] / 2.0).alias("area"),
            F.when(m["a2"] == 0, vertex_mean(rs[0])["x"]).otherwise(rs[0][0]["x"] + m["mx"] / (3.0 * m["a2"])).alias("x"),
            F.when(m["a2"] == 0, vertex_mean(rs[0])["y"]).otherwise(rs[0][0]["y"] + m["my"] / (3.0 * m["a2"])).alias("y")))
    return let(rings, read)


def centroid(rings: Column) -> Column:
    """Area-weighted centroid ``struct<x,y>``."""
    return let(area_centroid(rings), lambda c: point(c["x"], c["y"]))


def metric_area(area_deg: Column, lat: Column) -> Column:
    """Square metres of a small region of ``area_deg`` square degrees at latitude ``lat``."""
    return area_deg * M_PER_DEG * (M_PER_DEG * F.cos(F.radians(lat)))


def _drop_repeats(ring: Column) -> Column:
    return F.filter(ring, lambda p, i: (i == 0) | (p != F.element_at(ring, F.greatest(i, F.lit(1)))))


def area_sqm(rings: Column, mode: str = "centroid") -> Column:
    """Ground area. ``centroid`` is normative; ``registration`` uses a constant cosine;
    ``screen`` is the map-widget formula, planar at 0.24 m² per px² when not geographic."""
    if mode == "centroid":
        return let(area_centroid(rings), lambda ac: F.round(metric_area(ac["area"], ac["y"]), 2))
    if mode == "registration":
        return F.round(planar_area(rings) * M_PER_DEG * (M_PER_DEG * COS_REGISTRATION), 2)
    if mode != "screen":
        raise ValueError(f"unknown area mode {mode!r}")
    def opened(shell):
        return F.when((F.size(shell) > 3) & is_closed(shell), F.slice(shell, F.lit(1), F.size(shell) - 1)).otherwise(shell)

    def ground(r):
        geographic = F.forall(r, lambda p: (F.abs(p["y"]) <= 90) & (F.abs(p["x"]) <= 180))
        lat = F.aggregate(r, F.lit(0.0), lambda a, p: a + p["y"]) / F.size(r)
        scale = F.when(geographic, M_PER_DEG_UI * (M_PER_DEG_UI * F.cos(F.radians(lat)))).otherwise(CANVAS_SQM_PER_PX)
        return F.when(F.size(r) < 3, F.lit(0.0)).otherwise(F.round(ring_area(r) * scale, 2))

    return let(let(let(rings[0], _drop_repeats), opened), ground)


def area_px(ring: Column, sqm_per_px: float | None = None) -> Column:
    """Planar shoelace area of a pixel ring, optionally scaled to square metres."""
    a = let(ring, lambda r: F.when(F.size(r) < 3, F.lit(0.0)).otherwise(ring_area(r)))
    return a if sqm_per_px is None else a * sqm_per_px


def bbox(rings: Column) -> Column:
    def ends(pts):
        xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
        return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
                        F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))
    return let(all_points(rings), ends)


def with_bbox(df, rings: str = "rings"):
    """Materialise the bounding box so that joins and scans can filter on plain columns."""
    return df.withColumn("_b", bbox(F.col(rings))).select(
        "*", "_b.minx", "_b.miny", "_b.maxx", "_b.maxy").drop("_b")


def is_rectangle(rings: Column) -> Column:
    """True for a single axis-parallel rectangle, whose bounding box is the shape itself."""
    return let(rings, lambda rs: (F.size(rs) == 1) & (F.size(rs[0]) == 5) & F.forall(
        edges(rs[0]), lambda e: (e["ax"] == e["bx"]) != (e["ay"] == e["by"])))


def _orient(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _within(ax, ay, bx, by, cx, cy):
    return ((cx >= F.least(ax, bx)) & (cx <= F.greatest(ax, bx)) & (cy >= F.least(ay, by)) & (cy <= F.greatest(ay, by)))


def segments_meet(e: Column, f: Column) -> Column:
    """Closed segments share a point (touching counts)."""
    d1 = _orient(f["ax"], f["ay"], f["bx"], f["by"], e["ax"], e["ay"])
    d2 = _orient(f["ax"], f["ay"], f["bx"], f["by"], e["bx"], e["by"])
    d3 = _orient(e["ax"], e["ay"], e["bx"], e["by"], f["ax"], f["ay"])
    d4 = _orient(e["ax"], e["ay"], e["bx"], e["by"], f["bx"], f["by"])
    proper = (((d1 > 0) & (d2 < 0)) | ((d1 < 0) & (d2 > 0))) & (((d3 > 0) & (d4 < 0)) | ((d3 < 0) & (d4 > 0)))
    return (proper
            | ((d1 == 0) & _within(f["ax"], f["ay"], f["bx"], f["by"], e["ax"], e["ay"]))
            | ((d2 == 0) & _within(f["ax"], f["ay"], f["bx"], f["by"], e["bx"], e["by"]))
            | ((d3 == 0) & _within(e["ax"], e["ay"], e["bx"], e["by"], f["ax"], f["ay"]))
            | ((d4 == 0) & _within(e["ax"], e["ay"], e["bx"], e["by"], f["bx"], f["by"])))


def contains_point(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd point-in-polygon over shell and holes."""
    crossings = F.aggregate(
        all_edges(rings), F.lit(0),
        lambda n, e: n + F.when(
            ((e["ay"] > y) != (e["by"] > y))
            & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / F.when(e["by"] != e["ay"], e["by"] - e["ay"]) + e["ax"]), 1
        ).otherwise(0),
    )
    return crossings % 2 == 1


def polygons_intersect(a: Column, b: Column) -> Column:
    """Exact polygon predicate: some edges meet, or one holds a vertex of the other."""
    edges_meet = let(all_edges(b), lambda eb: F.exists(all_edges(a), lambda e: F.exists(eb, lambda f: segments_meet(e, f))))
    return (edges_meet
            | let(a[0][0], lambda p: contains_point(b, p["x"], p["y"]))
            | let(b[0][0], lambda p: contains_point(a, p["x"], p["y"])))


def point_segment_distance(px, py, e: Column) -> Column:
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    len2 = dx * dx + dy * dy
    t = F.when(len2 == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - e["ax"]) * dx + (py - e["ay"]) * dy) / F.when(len2 != 0, len2))))
    return F.sqrt(F.pow(px - (e["ax"] + t * dx), F.lit(2.0)) + F.pow(py - (e["ay"] + t * dy), F.lit(2.0)))


def _vertex_edge_distance(a: Column, b: Column) -> Column:
    return let(all_edges(b), lambda eb: F.array_min(F.transform(
        all_points(a), lambda p: F.array_min(F.transform(eb, lambda e: point_segment_distance(p["x"], p["y"], e))))))


def polygon_distance(a: Column, b: Column) -> Column:
    """Least distance of two polygons, 0 when they meet."""
    return F.when(polygons_intersect(a, b), F.lit(0.0)).otherwise(
        F.least(_vertex_edge_distance(a, b), _vertex_edge_distance(b, a)))


def is_simple(ring: Column) -> Column:
    """No two non-adjacent edges of a closed ring meet and no vertex repeats."""
    tagged = F.transform(edges(ring), lambda e, i: F.struct(e["ax"].alias("ax"), e["ay"].alias("ay"), e["bx"].alias("bx"),
                                                            e["by"].alias("by"), i.alias("i")))

    def sound(ts):
        clash = F.exists(ts, lambda e: F.exists(
            ts, lambda f: (f["i"] > e["i"] + 1) & ~((e["i"] == 0) & (f["i"] == F.size(ts) - 1)) & segments_meet(e, f)))
        repeats = F.exists(ts, lambda e: (e["ax"] == e["bx"]) & (e["ay"] == e["by"]))
        return ~clash & ~repeats

    return let(tagged, sound)


def flat_rings(rings: Column) -> Column:
    """Rings as ``array<array<double>>`` of x,y,x,y…, the cheap form to hand to Arrow."""
    return F.transform(rings, lambda r: F.flatten(F.transform(r, lambda p: F.array(p["x"], p["y"]))))


def unflat_rings(flat: Column) -> Column:
    return F.transform(flat, lambda r: F.transform(
        F.sequence(F.lit(0), (F.size(r) / 2 - 1).cast("int")),
        lambda i: F.struct(F.element_at(r, i * 2 + 1).alias("x"), F.element_at(r, i * 2 + 2).alias("y"))))


def geojson_coordinates(rings: Column) -> Column:
    """``array<array<array<double>>>`` as GeoJSON writes it."""
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))


def ring_extremities(ring: Column) -> Column:
    """0-based indices of the topmost, rightmost, lowest and leftmost vertex, repeats removed
    (screen axes: y grows downwards; the first of equals wins)."""
    def least(idx, key):
        return F.array_min(F.transform(idx, lambda s: F.struct(key(s).alias("k"), s["i"].alias("i"))))["i"]

    def corners(idx):
        return F.when(F.size(idx) < 4, F.array().cast("array<int>")).otherwise(F.array_distinct(F.array(
            least(idx, lambda s: s["y"]), least(idx, lambda s: -s["x"]), least(idx, lambda s: -s["y"]), least(idx, lambda s: s["x"]))))

    return let(F.transform(ring, lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), i.alias("i"))), corners)
