"""Polygon repair, difference, snapping and the whole-table clean-up.

Spark finds who meets whom (grid join), groups the distinct neighbour shapes of each target and splits
crowded targets into tiles; numpy inside the tasks only cuts one target against its neighbours."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rings as R
from ..session import cut_lineage, spread
from . import topology_small as S
from .spatial import box_pairs, distinct_shapes

# Fixed value: five centimetres in degrees.
TOLERANCE_DEG = 5.0e-7
# Neighbour shapes one task cuts at once; a target with more is split into tiles.
TILE_NEIGHBOURS = 256


# ---- one target in numpy -------------------------------------------------------------------------

def _edges(rings) -> np.ndarray:
    out = []
    for ring in rings:
        p = np.asarray(ring, dtype=float).reshape(-1, 2)
        e = np.hstack([p[:-1], p[1:]])
        out.append(e[(e[:, 0] != e[:, 2]) | (e[:, 1] != e[:, 3])])
    return np.vstack(out) if out else np.empty((0, 4))


def _split_edges(e: np.ndarray, q: float) -> np.ndarray:
    """All edges cut at their crossings, touches and collinear overlaps."""
    ax, ay = e[:, 0], e[:, 1]
    rx, ry = e[:, 2] - ax, e[:, 3] - ay
    length = np.hypot(rx, ry)
    tol = q / length
    wx, wy = ax[None, :] - ax[:, None], ay[None, :] - ay[:, None]
    d = rx[:, None] * ry[None, :] - ry[:, None] * rx[None, :]
    parallel = np.abs(d) <= 1e-12 * length[:, None] * length[None, :]
    safe = np.where(parallel, 1.0, d)
    t = (wx * ry[None, :] - wy * rx[None, :]) / safe
    u = (wx * ry[:, None] - wy * rx[:, None]) / safe
    ti, tj = tol[:, None], tol[None, :]
    hit = ~parallel & (t >= -ti) & (t <= 1 + ti) & (u >= -tj) & (u <= 1 + tj)
    idx, par = [np.nonzero(hit)[0]], [t[hit]]
    line = parallel & (np.abs(wx * ry[:, None] - wy * rx[:, None]) <= q * length[:, None])
    for ex, ey in ((wx, wy), (wx + rx[None, :], wy + ry[None, :])):
        s = (ex * rx[:, None] + ey * ry[:, None]) / (length ** 2)[:, None]
        on = line & (s >= -ti) & (s <= 1 + ti)
        idx.append(np.nonzero(on)[0])
        par.append(s[on])
    n = np.arange(len(e))
    i = np.concatenate([*idx, n, n])
    s = np.concatenate([*par, np.zeros(len(e)), np.ones(len(e))])
    s = np.where(s <= tol[i], 0.0, np.where(s >= 1 - tol[i], 1.0, s))
    order = np.lexsort((s, i))
    i, s = i[order], s[order]
    fresh = np.ones(len(i), dtype=bool)
    fresh[1:] = (i[1:] != i[:-1]) | (s[1:] - s[:-1] > tol[i[1:]])
    i, s = i[fresh], s[fresh]
    x = np.where(s == 1.0, e[i, 2], ax[i] + s * rx[i])
    y = np.where(s == 1.0, e[i, 3], ay[i] + s * ry[i])
    same = i[1:] == i[:-1]
    return np.column_stack([x[:-1], y[:-1], x[1:], y[1:]])[same]


def _inside(px, py, polys) -> np.ndarray:
    """Even-odd membership, one row per polygon."""
    out = np.zeros((len(polys), len(px)), dtype=bool)
    for k, e in enumerate(polys):
        up = (e[:, 1][:, None] > py[None, :]) != (e[:, 3][:, None] > py[None, :])
        dy = np.where(e[:, 3] == e[:, 1], 1.0, e[:, 3] - e[:, 1])
        x = (e[:, 2] - e[:, 0])[:, None] * (py[None, :] - e[:, 1][:, None]) / dy[:, None] + e[:, 0][:, None]
        out[k] = np.count_nonzero(up & (px[None, :] < x), axis=0) % 2 == 1
    return out


class _Nodes:
    """Points closer than ``q`` share one node, whose coordinates are those seen first."""

    def __init__(self, q):
        self.q, self.cells, self.xy = q, {}, []

    def get(self, x, y):
        cx, cy = S.cell(x, y, self.q)
        for gx in (cx, cx - 1, cx + 1):
            for gy in (cy, cy - 1, cy + 1):
                k = self.cells.get((gx, gy))
                if k is not None and abs(self.xy[k][0] - x) <= self.q and abs(self.xy[k][1] - y) <= self.q:
                    return k
        self.cells[(cx, cy)] = len(self.xy)
        self.xy.append((x, y))
        return len(self.xy) - 1


def _grain(e: np.ndarray) -> float:
    return max(1e-10, float(np.abs(e).max()) * 1e-12) if len(e) else 1e-10


def boundary(target, blockers, window=None) -> np.ndarray:
    """Boundary of ``target`` minus all ``blockers`` as directed segments, interior on the left.

    Every edge is cut where it meets another and each piece is judged by the points just left and right
    of it. ``window`` (x0, y0, x1, y1) limits the work to one tile: edges are also cut along the tile
    borders and only pieces inside are returned, so the tiles of a target add up to the whole."""
    if window is None and sum(len(r) for p in (target, *blockers) for r in p) <= 2 * S.FEW:
        polys = [[e for r in p for e in S.edges(S.points(r))] for p in (target, *blockers)]
        if not polys[0]:
            return np.empty((0, 4))
        return np.array(S.boundary(polys, S.grain([v for p in polys for e in p for v in e])), dtype=float).reshape(-1, 4)
    polys = [_edges(target)] + [_edges(b) for b in blockers]
    e = np.vstack(polys)
    if not len(polys[0]):
        return np.empty((0, 4))
    q = _grain(e)
    n_real = None
    if window is not None:
        x0, y0, x1, y1 = window
        lines = np.array([[x0, y0, x1, y0], [x1, y0, x1, y1], [x1, y1, x0, y1], [x0, y1, x0, y0]])
        lo, hi = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
        near = (hi[:, 0] >= x0 - q) & (lo[:, 0] <= x1 + q) & (hi[:, 1] >= y0 - q) & (lo[:, 1] <= y1 + q)
        e = np.vstack([e[near], lines])
        n_real = len(lines)
    seg = _split_edges(e, q)
    mx, my = (seg[:, 0] + seg[:, 2]) / 2, (seg[:, 1] + seg[:, 3]) / 2
    if n_real is not None:
        keep = (mx >= x0) & (mx < x1) & (my >= y0) & (my < y1)
        seg, mx, my = seg[keep], mx[keep], my[keep]
        if not len(seg):
            return seg
    dx, dy = seg[:, 2] - seg[:, 0], seg[:, 3] - seg[:, 1]
    length = np.hypot(dx, dy)
    off = 4 * q
    nx, ny = -dy / length * off, dx / length * off

    def solid(px, py):
        m = _inside(px, py, polys)
        return m[0] & ~m[1:].any(axis=0)

    left, right = solid(mx + nx, my + ny), solid(mx - nx, my - ny)
    out = np.vstack([seg[left & ~right], seg[right & ~left][:, [2, 3, 0, 1]]])
    return out


def stitch(seg: np.ndarray, corners=None) -> list[list[list[float]]]:
    """Directed boundary segments to polygons, each a list of flat rings, shell first, largest first.
    ``corners`` are vertices to keep even where they lie on a straight line."""
    if not len(seg):
        return []
    q = _grain(seg)
    nodes = _Nodes(q)
    kept = {nodes.get(x, y) for x, y in corners} if corners is not None else set()
    ends = {(nodes.get(a, b), nodes.get(c, d)) for a, b, c, d in seg.tolist()}
    ends = [(s, t) for s, t in ends if s != t]
    xy, places = nodes.xy, None
    leaving: dict[int, list[int]] = {}
    for t, h in sorted(ends):
        leaving.setdefault(t, []).append(h)
    rings = []
    for start in sorted(leaving):
        while leaving.get(start):
            ring, prev, cur = [start], start, leaving[start].pop(0)
            while cur != start:
                ring.append(cur)
                options = leaving.get(cur)
                if not options:
                    ring = None
                    break
                if len(options) == 1:
                    nxt = options.pop()
                else:
                    back = np.arctan2(xy[prev][1] - xy[cur][1], xy[prev][0] - xy[cur][0])
                    turn = [S.turn(back, xy[cur], xy[o]) for o in options]
                    nxt = options.pop(turn.index(min(turn)))
                prev, cur = cur, nxt
            if ring is not None and len(ring) >= 3:
                rings.append(ring)
    shells, holes = [], []
    for ring in rings:
        if len(ring) <= S.FEW:
            seen = S.outline(ring, xy, kept, q)
            if seen is not None and abs(seen[1]) > 2 * q * seen[2]:
                flat = [v for p in (*seen[0], seen[0][0]) for v in p]
                (shells if seen[1] > 0 else holes).append((abs(seen[1]), flat))
            continue
        places = np.array(xy) if places is None else places
        p = places[ring]
        a, b = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
        turn = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
        bend = np.abs(turn) > q * (np.hypot(a[:, 0], a[:, 1]) + np.hypot(b[:, 0], b[:, 1]))
        keep = bend | np.array([k in kept for k in ring])
        p = p[keep]
        if len(p) < 3:
            continue
        o = p - p[0]
        area = float(np.sum(o[:, 0] * np.roll(o[:, 1], -1) - np.roll(o[:, 0], -1) * o[:, 1])) / 2
        perimeter = float(np.hypot(*(np.roll(p, -1, axis=0) - p).T).sum())
        if abs(area) <= 2 * q * perimeter:
            continue
        flat = np.vstack([p, p[:1]]).ravel().tolist()
        (shells if area > 0 else holes).append((abs(area), flat))
    shells.sort(key=lambda s: (-s[0], s[1]))
    polys = [[flat] for _, flat in shells]
    for _, hole in holes:
        hx, hy = (hole[0] + hole[2]) / 2, (hole[1] + hole[3]) / 2
        for k in range(len(shells) - 1, -1, -1):
            if _inside(np.array([hx]), np.array([hy]), [_edges([shells[k][1]])])[0, 0]:
                polys[k].append(hole)
                break
    return polys


def _corners(rings):
    return [p for r in rings for p in S.points(r)]


def _bounds(rings):
    p = [v for r in rings for v in S.points(r)]
    x, y = [a for a, _ in p], [b for _, b in p]
    return min(x), min(y), max(x), max(y)


def repair(rings) -> list[list[list[float]]]:
    """Even-odd repair: repeats and spikes go, a bow-tie falls into its loops."""
    return stitch(boundary(rings, []), _corners(rings))


def subtract(target, blockers, keep_all=False):
    """Target minus blockers: a list of polygons (one unless ``keep_all``); the target itself when
    nothing would remain."""
    tx0, ty0, tx1, ty1 = _bounds(target)
    cut = []
    for b in blockers:
        bx0, by0, bx1, by1 = _bounds(b)
        if bx0 < tx1 and bx1 > tx0 and by0 < ty1 and by1 > ty0:
            cut.append(b)
    if not cut:
        return [target]
    parts = stitch(boundary(target, cut), _corners(target))
    if not parts:
        return [target]
    return parts if keep_all else parts[:1]


def snap(rings, refs, tol):
    """Vertices within ``tol`` of a reference vertex move onto the closest one; a reference vertex
    within ``tol`` of an edge is then put into that edge."""
    few = sorted(set(_corners(refs)))
    if not few:
        return rings
    ref, out = None, []
    for ring in rings:
        if len(ring) <= 2 * S.FEW and len(few) <= 8 * S.FEW:
            p = S.snap(S.points(ring), few, tol) if len(ring) > 2 else None
            if p is not None:
                out.append([v for q in p for v in q])
            continue
        ref = np.array(few) if ref is None else ref
        p = np.asarray(ring, dtype=float).reshape(-1, 2)[:-1].copy()
        d = np.hypot(p[:, None, 0] - ref[None, :, 0], p[:, None, 1] - ref[None, :, 1])
        k = d.argmin(axis=1)
        near = d[np.arange(len(p)), k] <= tol
        p[near] = ref[k[near]]
        used = {tuple(v) for v in p.tolist()}
        spare = [v for v in ref.tolist() if tuple(v) not in used]
        for vx, vy in spare:
            nxt = np.roll(p, -1, axis=0)
            r = nxt - p
            len2 = (r ** 2).sum(axis=1)
            len2[len2 == 0] = 1.0
            s = np.clip(((vx - p[:, 0]) * r[:, 0] + (vy - p[:, 1]) * r[:, 1]) / len2, 0, 1)
            dist = np.hypot(p[:, 0] + s * r[:, 0] - vx, p[:, 1] + s * r[:, 1] - vy)
            j = int(dist.argmin())
            if dist[j] <= tol and 0 < s[j] < 1:
                p = np.insert(p, j + 1, [vx, vy], axis=0)
        fresh = np.ones(len(p), dtype=bool)
        fresh[1:] = (p[1:] != p[:-1]).any(axis=1)
        p = p[fresh]
        if len(p) > 1 and (p[0] == p[-1]).all():
            p = p[:-1]
        if len(p) >= 3:
            out.append(np.vstack([p, p[:1]]).ravel().tolist())
    return out or rings


def _simple(ring) -> bool:
    if 8 < len(ring) <= 2 * S.FEW:
        p = S.points(ring)
        return len(set(p[:-1])) == len(p) - 1 and len(S.split_edges(S.edges(p), S.grain([v for a in p for v in a]))) == len(p) - 1
    p = np.asarray(ring, dtype=float).reshape(-1, 2)
    if len(p) <= 4:
        return len(np.unique(p[:-1], axis=0)) == 3
    return len(np.unique(p[:-1], axis=0)) == len(p) - 1 and len(_split_edges(_edges([ring]), _grain(p))) == len(p) - 1


# ---- Spark side ----------------------------------------------------------------------------------

_FLAT_PARTS = "array<array<array<double>>>"


def _as_lists(cell):
    return [np.asarray(r, dtype=float) for r in cell] if cell is not None else []


def make_valid(parcels: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Parts (key, part_no, rings, repaired). Sound rows stay in the JVM; only flagged ones reach Python."""
    sound = F.forall("rings", R.is_simple)
    good = parcels.filter(sound).select(key, F.lit(0).alias("part_no"), "rings", F.lit(False).alias("repaired"))
    key_type = dict(parcels.dtypes)[key]
    bad = parcels.filter(~sound).select(key, R.flat_rings(F.col("rings")).alias("flat"))

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "parts": [repair(_as_lists(c)) for c in pdf["flat"]]})

    fixed = spread(bad, key).mapInPandas(fix, f"{key} {key_type}, parts {_FLAT_PARTS}").select(
        key, F.posexplode("parts").alias("part_no", "flat"))
    return good.unionByName(fixed.select(key, "part_no", R.unflat_rings(F.col("flat")).alias("rings"), F.lit(True).alias("repaired")))


def _shape_pairs(parcels: DataFrame, priority: str | None, tol: float) -> tuple[DataFrame, DataFrame]:
    """Distinct shapes, and the pairs (shape, acting neighbour shape) between them.

    A neighbour acts when it is sound and, with a priority, when its owner's value is lower. The pairs are
    written once to the shared folder: counting, listing and tiling then read them instead of joining again."""
    shapes = distinct_shapes(parcels, priority or "parcel_id").withColumn("sound", F.forall("rings", R.is_simple))
    near = box_pairs(shapes, tol, ["rings", "first_priority", "sound"]).filter(F.col("b.sound"))
    if priority is not None:
        near = near.filter(F.col("b.first_priority") < F.col("a.first_priority"))
    pairs = near.select(F.col("a.shape_id").alias("shape_id"), F.col("b.shape_id").alias("n_id"), F.col("b.rings").alias("n_rings"),
                        *[F.col(f"b.{c}").alias(f"n_{c}") for c in ("minx", "miny", "maxx", "maxy")])
    return shapes, cut_lineage(pairs)


def clean_topology(parcels: DataFrame, tol: float = TOLERANCE_DEG, priority: str | None = None,
                   keep: str = "largest") -> DataFrame:
    """Every parcel repaired, cut free of its neighbours and snapped to those within ``tol``.

    Without ``priority`` each parcel is cleaned against all others as they are stored, which answers the
    per-parcel question for the whole table. With it the overlap of two parcels goes to the lower value,
    so one pass leaves no overlap behind. A parcel fully covered by others stays as it is, so of a group of
    copies only the first can change. ``keep``: ``largest`` part or ``all`` parts.
    Result: parcel_id, part_no, rings, area_sqm, n_blockers."""
    shapes, pairs = _shape_pairs(parcels, priority, tol)
    counts = pairs.groupBy("shape_id").agg(F.count("*").alias("n_blockers"))
    todo = shapes.join(counts, "shape_id", "left").na.fill(0, ["n_blockers"])
    free = F.lit(True) if priority is not None else F.col("members") == 1
    todo = todo.filter(free & ((F.col("n_blockers") > 0) | ~F.col("sound")))
    key_type = dict(parcels.dtypes)["parcel_id"]
    schema = f"shape_id {key_type}, n_blockers bigint, parts {_FLAT_PARTS}"
    keep_all = keep == "all"
    has_crowd = bool(counts.filter(F.col("n_blockers") > TILE_NEIGHBOURS).limit(1).collect())
    small = todo.filter(F.col("n_blockers") <= TILE_NEIGHBOURS) if has_crowd else todo
    use = pairs.join(small.select("shape_id"), "shape_id", "left_semi") if has_crowd else pairs
    lists = use.groupBy("shape_id").agg(F.collect_list(R.flat_rings(F.col("n_rings"))).alias("near"))
    rows = small.join(lists, "shape_id", "left").select("shape_id", "n_blockers", R.flat_rings(F.col("rings")).alias("flat"), "near")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for flat, near in zip(pdf["flat"], pdf["near"]):
                near = [_as_lists(n) for n in near] if near is not None else []
                done.append(_clean_one(_as_lists(flat), near, tol, keep_all))
            yield pd.DataFrame({"shape_id": pdf["shape_id"], "n_blockers": pdf["n_blockers"], "parts": done})

    # By a hash of the id: a plain repartition by it would be dropped behind the join, and its few partitions by size kept.
    cleaned = spread(rows, F.xxhash64("shape_id")).mapInPandas(cut, schema)
    if has_crowd:
        crowded = todo.filter(F.col("n_blockers") > TILE_NEIGHBOURS)
        cleaned = cleaned.unionByName(_clean_crowded(crowded, pairs, tol, keep_all, schema))
    out = parcels.select("parcel_id", "rings").join(cleaned, F.col("parcel_id") == F.col("shape_id"), "left")
    return (out.select("parcel_id", F.coalesce("n_blockers", F.lit(0)).alias("n_blockers"),
                       F.posexplode(F.coalesce("parts", F.array(R.flat_rings(F.col("rings"))))).alias("part_no", "flat"))
            .withColumn("rings", R.unflat_rings(F.col("flat"))).drop("flat")
            .withColumn("area_sqm", R.area_sqm(F.col("rings"))))


def _clean_one(flat, near, tol, keep_all):
    """Repair, cut and snap one polygon against its neighbours."""
    whole = flat if all(_simple(r) for r in flat) else (repair(flat) or [flat])[0]
    parts = [_finish(p, near, tol) for p in subtract(whole, near, keep_all)]
    return [[np.asarray(r, dtype=float) for r in p] for p in parts]


def _finish(rings, near, tol):
    snapped = snap(rings, [r for n in near for r in n], tol)
    if snapped is rings or all(_simple(r) for r in snapped):
        return snapped
    fixed = repair(snapped)
    return fixed[0] if fixed else rings


def _clean_crowded(crowded: DataFrame, pairs: DataFrame, tol: float, keep_all: bool, schema: str) -> DataFrame:
    """Targets with very many neighbours: one task per tile of the target, then one light task per
    target that only strings the boundary pieces together (as much data as the result row holds)."""
    side = F.ceil(F.sqrt(F.col("n_blockers") / float(TILE_NEIGHBOURS))).cast("int")
    crowded = crowded.select("shape_id", "n_blockers", "rings", "minx", "miny", "maxx", "maxy", side.alias("side"))
    w = (F.col("maxx") - F.col("minx")) / F.col("side")
    h = (F.col("maxy") - F.col("miny")) / F.col("side")
    # The last tile reaches past the edge so that pieces on the border fall inside.
    tiles = crowded.withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("side") - 1))).withColumn(
        "iy", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    tiles = tiles.select(
        "shape_id", "n_blockers", "ix", "iy", R.flat_rings(F.col("rings")).alias("flat"),
        F.array(F.when(F.col("ix") == 0, F.col("minx") - w).otherwise(F.col("minx") + F.col("ix") * w),
                F.when(F.col("iy") == 0, F.col("miny") - h).otherwise(F.col("miny") + F.col("iy") * h),
                F.when(F.col("ix") == F.col("side") - 1, F.col("maxx") + w).otherwise(F.col("minx") + (F.col("ix") + 1) * w),
                F.when(F.col("iy") == F.col("side") - 1, F.col("maxy") + h).otherwise(F.col("miny") + (F.col("iy") + 1) * h)).alias("win"))

    def index(v, low, step):
        return F.least(F.greatest(F.floor((v - low) / step), F.lit(0)), F.col("side") - 1).cast("int")

    near = pairs.join(crowded.select("shape_id", "minx", "miny", "maxx", "maxy", "side"), "shape_id")
    near = near.withColumn("ix", F.explode(F.sequence(index(F.col("n_minx") - tol, F.col("minx"), w), index(F.col("n_maxx") + tol, F.col("minx"), w))))
    near = near.withColumn("iy", F.explode(F.sequence(index(F.col("n_miny") - tol, F.col("miny"), h), index(F.col("n_maxy") + tol, F.col("miny"), h))))
    lists = near.groupBy("shape_id", "ix", "iy").agg(F.collect_list(R.flat_rings(F.col("n_rings"))).alias("near"))
    key_type = schema.split(",")[0].split()[1]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            segs, refs = [], []
            for flat, close, win in zip(pdf["flat"], pdf["near"], pdf["win"]):
                close = [_as_lists(n) for n in close] if close is not None else []
                seg = boundary(_as_lists(flat), close, tuple(win))
                segs.append(seg.ravel())
                refs.append(_refs_near(seg, close, tol))
            yield pd.DataFrame({"shape_id": pdf["shape_id"], "seg": segs, "refs": refs})

    cut = (tiles.join(lists, ["shape_id", "ix", "iy"], "left")
           .select("shape_id", "flat", "near", "win")
           .mapInPandas(pieces, f"shape_id {key_type}, seg array<double>, refs array<double>"))
    gathered = cut.groupBy("shape_id").agg(F.flatten(F.collect_list("seg")).alias("seg"), F.flatten(F.collect_list("refs")).alias("refs"))

    def string(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for flat, seg, refs in zip(pdf["flat"], pdf["seg"], pdf["refs"]):
                flat = _as_lists(flat)
                parts = stitch(np.asarray(seg, dtype=float).reshape(-1, 4), _corners(flat)) if seg is not None else []
                parts = parts or [flat]
                parts = parts if keep_all else parts[:1]
                near = [[np.asarray(refs, dtype=float)]] if refs is not None and len(refs) else []
                done.append([[np.asarray(r, dtype=float) for r in _finish(p, near, tol)] for p in parts])
            yield pd.DataFrame({"shape_id": pdf["shape_id"], "n_blockers": pdf["n_blockers"], "parts": done})

    return (crowded.join(gathered, "shape_id", "left")
            .select("shape_id", "n_blockers", R.flat_rings(F.col("rings")).alias("flat"), "seg", "refs").mapInPandas(string, schema))


def _refs_near(seg, near, tol):
    """Neighbour vertices within reach of the boundary pieces: all that snapping can use."""
    if not len(seg) or not near:
        return np.empty(0)
    ref = np.unique(np.array([p for n in near for p in _corners(n)]), axis=0)
    r = seg[:, 2:] - seg[:, :2]
    len2 = np.maximum((r ** 2).sum(axis=1), 1e-300)
    s = np.clip(((ref[:, None, 0] - seg[None, :, 0]) * r[None, :, 0] + (ref[:, None, 1] - seg[None, :, 1]) * r[None, :, 1]) / len2, 0, 1)
    d = np.hypot(seg[None, :, 0] + s * r[None, :, 0] - ref[:, None, 0], seg[None, :, 1] + s * r[None, :, 1] - ref[:, None, 1])
    return ref[d.min(axis=1) <= tol].ravel()


def difference(parcels: DataFrame, keep: str = "largest") -> DataFrame:
    """Each parcel minus the union of all parcels that meet it, without snapping."""
    return clean_topology(parcels, tol=0.0, keep=keep)


def snap_parcels(parcels: DataFrame, tol: float = TOLERANCE_DEG) -> DataFrame:
    """Each parcel snapped to the stored vertices of parcels within ``tol``, without cutting.

    Only neighbour vertices that lie within ``tol`` of the parcel's own edges are gathered, so a group
    is never larger than its outline can take up."""
    sound = F.forall("rings", R.is_simple)
    pairs = box_pairs(parcels.select(F.col("parcel_id").alias("shape_id"), "rings", "minx", "miny", "maxx", "maxy", sound.alias("sound")),
                      tol, ["rings", "sound"]).filter(F.col("b.sound"))
    acting = pairs.select(F.col("a.shape_id").alias("parcel_id"), F.col("a.rings").alias("rings"), F.col("b.rings").alias("n_rings"))

    def reach(p):
        return F.array_min(F.transform(R.all_edges(F.col("rings")), lambda e: R.point_segment_distance(p["x"], p["y"], e))) <= tol

    refs = acting.select("parcel_id", F.explode(F.filter(R.all_points(F.col("n_rings")), reach)).alias("v")).groupBy("parcel_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_set("v")), lambda v: F.array(v["x"], v["y"]))).alias("near"))
    rows = parcels.select("parcel_id", R.flat_rings(F.col("rings")).alias("flat")).join(refs, "parcel_id", "left")
    key_type = dict(parcels.dtypes)["parcel_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [[np.asarray(r, dtype=float) for r in snap(_as_lists(flat), [np.asarray(near, dtype=float)], tol)]
                    for flat, near in zip(pdf["flat"], pdf["near"])]
            yield pd.DataFrame({"parcel_id": pdf["parcel_id"], "flat": done})

    moved = rows.filter("near is not null").mapInPandas(run, f"parcel_id {key_type}, flat array<array<double>>")
    return moved.unionByName(rows.filter("near is null").select("parcel_id", "flat")).select(
        "parcel_id", R.unflat_rings(F.col("flat")).alias("rings"))
