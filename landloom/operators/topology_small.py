"""The steps of ``topology`` for shapes of a few edges, over plain floats: at this size numpy's calls cost more than the
work. Rules, order of operations and tolerances are those of the array forms in ``topology``, which treat the larger shapes."""
from __future__ import annotations

from math import atan2, floor, hypot, pi

import numpy as np

#: Edges up to which the plain forms are used.
FEW = 32


def points(ring) -> list[tuple[float, float]]:
    """The points of a flat ring."""
    flat = np.asarray(ring, dtype=float).ravel().tolist()
    return list(zip(flat[::2], flat[1::2]))


def edges(pts) -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for a, b in zip(pts, pts[1:]) if a != b]


def grain(values) -> float:
    return max(1e-10, max(map(abs, values)) * 1e-12)


def split_edges(es, q: float) -> list[tuple[float, float, float, float]]:
    """All edges cut at their crossings, touches and collinear overlaps."""
    n, far = len(es), 8 * q
    r = [(c - a, d - b) for a, b, c, d in es]
    length = [hypot(x, y) for x, y in r]
    box = [(min(a, c) - far, min(b, d) - far, max(a, c) + far, max(b, d) + far) for a, b, c, d in es]
    cuts: list[list[float]] = [[0.0, 1.0] for _ in es]
    for i in range(n):
        ax, ay, _, _ = es[i]
        (rx, ry), li, bi = r[i], length[i], box[i]
        for j in range(i + 1, n):
            bj = box[j]
            if bj[0] > bi[2] or bj[2] < bi[0] or bj[1] > bi[3] or bj[3] < bi[1]:
                continue
            (sx, sy), lj = r[j], length[j]
            wx, wy = es[j][0] - ax, es[j][1] - ay
            d = rx * sy - ry * sx
            ti, tj = q / li, q / lj
            if abs(d) > 1e-12 * li * lj:
                t, u = (wx * sy - wy * sx) / d, (wx * ry - wy * rx) / d
                if -ti <= t <= 1 + ti and -tj <= u <= 1 + tj:
                    cuts[i].append(t)
                    cuts[j].append(u)
                continue
            if abs(wx * ry - wy * rx) <= q * li:
                for ex, ey in ((wx, wy), (wx + sx, wy + sy)):
                    s = (ex * rx + ey * ry) / li ** 2
                    if -ti <= s <= 1 + ti:
                        cuts[i].append(s)
            if abs(wx * sy - wy * sx) <= q * lj:
                for ex, ey in ((-wx, -wy), (rx - wx, ry - wy)):
                    s = (ex * sx + ey * sy) / lj ** 2
                    if -tj <= s <= 1 + tj:
                        cuts[j].append(s)
    out = []
    for i in range(n):
        (ax, ay, bx, by), (rx, ry), tol = es[i], r[i], q / length[i]
        if len(cuts[i]) == 2 and tol < 1:
            out.append(es[i])
            continue
        s = sorted(0.0 if v <= tol else 1.0 if v >= 1 - tol else v for v in cuts[i])
        last = None
        for k, v in enumerate(s):
            if k and not v - s[k - 1] > tol:
                continue
            p = (bx, by) if v == 1.0 else (ax + v * rx, ay + v * ry)
            if last is not None:
                out.append((*last, *p))
            last = p
    return out


def inside(x: float, y: float, es) -> bool:
    """Even-odd membership."""
    odd = False
    for ax, ay, bx, by in es:
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def boundary(polys, q: float) -> list[tuple[float, float, float, float]]:
    """Boundary of the first of ``polys`` (lists of edges) minus the others, interior on the left."""
    def solid(x, y):
        return inside(x, y, polys[0]) and not any(inside(x, y, p) for p in polys[1:])

    ahead, turned, off = [], [], 4 * q
    for seg in split_edges([e for p in polys for e in p], q):
        x0, y0, x1, y1 = seg
        mx, my, dx, dy = (x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0
        length = hypot(dx, dy)
        nx, ny = -dy / length * off, dx / length * off
        left, right = solid(mx + nx, my + ny), solid(mx - nx, my - ny)
        if left and not right:
            ahead.append(seg)
        elif right and not left:
            turned.append((x1, y1, x0, y0))
    return ahead + turned


def outline(ring, xy, kept, q: float):
    """Corners, signed area and perimeter of a closed walk over nodes without the nodes on straight lines; None if fewer than three stay."""
    p = [xy[k] for k in ring]
    n, out = len(p), []
    for i in range(n):
        (px, py), (x, y), (nx, ny) = p[i - 1], p[i], p[(i + 1) % n]
        ax, ay, bx, by = x - px, y - py, nx - x, ny - y
        if ring[i] in kept or abs(ax * by - ay * bx) > q * (hypot(ax, ay) + hypot(bx, by)):
            out.append((x, y))
    if len(out) < 3:
        return None
    (ox, oy), area, around = out[0], 0.0, 0.0
    for (x, y), (u, v) in zip(out, out[1:] + out[:1]):
        area += (x - ox) * (v - oy) - (u - ox) * (y - oy)
        around += hypot(u - x, v - y)
    return out, area / 2, around


def turn(back: float, here, there) -> float:
    """Clockwise angle from the way back to the way there, a full turn for the way back itself."""
    return (back - atan2(there[1] - here[1], there[0] - here[0])) % (2 * pi) or 2 * pi


def cell(x: float, y: float, q: float) -> tuple[int, int]:
    return floor(x / q), floor(y / q)


def snap(pts, ref, tol: float):
    """A ring's points (closed) moved onto references (sorted, distinct) within ``tol``, those within ``tol`` of an edge put into it;
    None if fewer than three points stay."""
    p = pts[:-1]
    xs, ys = [a for a, _ in p], [b for _, b in p]
    x0, y0, x1, y1 = min(xs) - 2 * tol, min(ys) - 2 * tol, max(xs) + 2 * tol, max(ys) + 2 * tol
    # A reference farther off than this reaches neither a point nor an edge, moved points included.
    close = [v for v in ref if x0 <= v[0] <= x1 and y0 <= v[1] <= y1]
    if close:
        for i, (x, y) in enumerate(p):
            d, v = min((hypot(x - v[0], y - v[1]), v) for v in close)
            if d <= tol:
                p[i] = v
    used = set(p)
    for v in close:
        if v in used:
            continue
        best = None
        for j, (x, y) in enumerate(p):
            u, w = p[(j + 1) % len(p)]
            rx, ry = u - x, w - y
            len2 = rx * rx + ry * ry or 1.0
            s = min(1.0, max(0.0, ((v[0] - x) * rx + (v[1] - y) * ry) / len2))
            d = hypot(x + s * rx - v[0], y + s * ry - v[1])
            if best is None or d < best[0]:
                best = d, j, s
        if best[0] <= tol and 0 < best[2] < 1:
            p.insert(best[1] + 1, v)
    p = p[:1] + [b for a, b in zip(p, p[1:]) if a != b]
    if len(p) > 1 and p[0] == p[-1]:
        p = p[:-1]
    return p + p[:1] if len(p) >= 3 else None
