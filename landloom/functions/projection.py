"""Coordinate systems, pixel mappings and ring transforms."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rings import M_PER_DEG, close_ring, let, map_points, map_ring, point, vertex_mean

# Half the equator in Web Mercator metres; latitude clamp; rounding per system.
MERCATOR_HALF = 20037508.342789244
MERCATOR_LAT = 89.5
ROUND_3857, ROUND_4326 = 4, 8

# Provisional sheet centre and map default resolution.
DEFAULT_CENTRE = (26.7605, 80.9010)
GSD_M = 0.05


def mercator_xy(lon: Column, lat: Column):
    lat = F.greatest(F.lit(-MERCATOR_LAT), F.least(F.lit(MERCATOR_LAT), lat))
    return (lon * MERCATOR_HALF / 180.0,
            F.log(F.tan(F.lit(math.pi / 4.0) + F.radians(lat) / 2.0)) * MERCATOR_HALF / math.pi)


def wgs84_lonlat(x: Column, y: Column):
    return (x * 180.0 / MERCATOR_HALF,
            F.degrees(F.lit(2.0) * F.atan(F.exp(y * math.pi / MERCATOR_HALF)) - math.pi / 2.0))


def reproject(rings: Column, source: str, target: str) -> Column:
    """EPSG:4326 ↔ EPSG:3857; equal systems pass through, any other pair is only rounded."""
    if source == target:
        return rings
    digits = ROUND_3857 if target == "EPSG:3857" else ROUND_4326

    def move(x, y):
        if (source, target) == ("EPSG:4326", "EPSG:3857"):
            x, y = mercator_xy(x, y)
        elif (source, target) == ("EPSG:3857", "EPSG:4326"):
            x, y = wgs84_lonlat(x, y)
        return F.round(x, digits), F.round(y, digits)

    return map_points(rings, move)


def to_web_mercator(rings: Column) -> Column:
    return reproject(rings, "EPSG:4326", "EPSG:3857")


def to_wgs84(rings: Column) -> Column:
    return reproject(rings, "EPSG:3857", "EPSG:4326")


def geo_to_pixel(x, y, min_x, min_y, scale_x, scale_y, height):
    """Pixel position with the y axis flipped, for a scale in pixels per degree."""
    return (x - min_x) * scale_x, (height - 1) - (y - min_y) * scale_y


def pixel_to_geo(px, py, min_x, min_y, scale_x, scale_y, height):
    return px / scale_x + min_x, ((height - 1) - py) / scale_y + min_y


def bounds_to_pixel(x, y, min_x, max_x, min_y, max_y, width, height):
    """Pixel position inside explicit bounds, spread over (w-1, h-1); an empty span counts as 1e-6."""
    span_x = F.when(max_x == min_x, 1e-6).otherwise(max_x - min_x)
    span_y = F.when(max_y == min_y, 1e-6).otherwise(max_y - min_y)
    return (x - min_x) / span_x * (width - 1), (1.0 - (y - min_y) / span_y) * (height - 1)


def centre_pixel_to_geo(px, py, lat0, lon0, gsd, base: int = 1000):
    """Canvas pixel to (lat, lon) about a centre at ``gsd`` metres per pixel, rounded to 6."""
    lat = lat0 - (py - base / 2) * gsd / M_PER_DEG
    lon = lon0 + (px - base / 2) * gsd / (M_PER_DEG * F.cos(F.radians(lat0)))
    return F.round(lat, 6), F.round(lon, 6)


def centre_geo_to_pixel(lat, lon, lat0, lon0, gsd, base: int = 1000):
    dx = (lon - lon0) * (M_PER_DEG * F.cos(F.radians(lat0)))
    dy = (lat - lat0) * M_PER_DEG
    return F.round(base / 2 + dx / gsd), F.round(base / 2 - dy / gsd)


def project_point(h: Column, x: Column, y: Column):
    """Projective map by a row-major 3×3 array; no divide where the denominator is 0."""
    w = h[6] * x + h[7] * y + h[8]
    w = F.when(w == 0, 1.0).otherwise(w)
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def apply_homography(rings: Column, h: Column, digits: int = ROUND_4326) -> Column:
    def move(x, y):
        u, v = project_point(h, x, y)
        return F.round(u, digits), F.round(v, digits)
    return map_points(rings, move)


def apply_homography_geo(rings: Column, h: Column, src: Column, dst: Column) -> Column:
    """Degrees → source pixels → homography → target pixels → degrees, rounded to 8.
    ``src``/``dst`` are structs min_x, min_y, scale_x, scale_y, height."""
    def move(x, y):
        px, py = geo_to_pixel(x, y, src["min_x"], src["min_y"], src["scale_x"], src["scale_y"], src["height"])
        u, v = project_point(h, px, py)
        lon, lat = pixel_to_geo(u, v, dst["min_x"], dst["min_y"], dst["scale_x"], dst["scale_y"], dst["height"])
        return F.round(lon, ROUND_4326), F.round(lat, ROUND_4326)
    return map_points(rings, move)


def affine_point(m: Column, x: Column, y: Column):
    """``m`` is struct a,b,tx,c,d,ty."""
    return m["a"] * x + m["b"] * y + m["tx"], m["c"] * x + m["d"] * y + m["ty"]


def apply_affine(rings: Column, m: Column) -> Column:
    return map_points(rings, lambda x, y: affine_point(m, x, y))


def fix_axis_order(ring: Column) -> Column:
    """Swap (lat, lon) pairs to (lon, lat) and close the ring; null below three points.

    A pair is (lat, lon) if its second number is above 50 and the larger one: of the lands it is meant for,
    longitudes lie above 50 and above all latitudes, which may pass 50 themselves."""
    swapped = F.transform(ring, lambda p: F.when((p["y"] > 50) & (p["x"] < p["y"]), point(p["y"], p["x"])).otherwise(point(p["x"], p["y"])))
    return F.when(F.size(ring) >= 3, close_ring(swapped))


def translate_ring(ring: Column, dx: Column, dy: Column) -> Column:
    return map_ring(ring, lambda x, y: (x + dx, y + dy))


def scale_ring(ring: Column, scale: Column) -> Column:
    """Scale about the mean of the listed vertices, factor held in 0.15–6; closure is kept."""
    s = F.greatest(F.lit(0.15), F.least(F.lit(6.0), scale))
    return let(vertex_mean(ring), lambda c: map_ring(ring, lambda x, y: (c["x"] + (x - c["x"]) * s, c["y"] + (y - c["y"]) * s)))


def displacement_m(lat1, lon1, lat2, lon2):
    dy = (lat2 - lat1) * M_PER_DEG
    dx = (lon2 - lon1) * M_PER_DEG * F.cos(F.radians(lat1))
    return F.sqrt(dx * dx + dy * dy)


def sheet_bounds(nw_lat, nw_lon, se_lat, se_lon, centre_lat, centre_lon, width_px, height_px, gsd) -> Column:
    """Explicit corner box, else centre ± half size, else the provisional centre; rounded to 6."""
    boxed = nw_lat.isNotNull() & nw_lon.isNotNull() & se_lat.isNotNull() & se_lon.isNotNull()
    centred = centre_lat.isNotNull() & centre_lon.isNotNull()
    lat = F.when(boxed, (nw_lat + se_lat) / 2.0).when(centred, centre_lat).otherwise(DEFAULT_CENTRE[0])
    lon = F.when(boxed, (nw_lon + se_lon) / 2.0).when(centred, centre_lon).otherwise(DEFAULT_CENTRE[1])
    dlat = (height_px * gsd / 2.0) / M_PER_DEG
    dlon = (width_px * gsd / 2.0) / (M_PER_DEG * F.greatest(F.lit(0.001), F.cos(F.radians(lat))))
    return F.struct(
        F.round(lat, 6).alias("center_lat"), F.round(lon, 6).alias("center_lon"),
        F.round(F.when(boxed, nw_lat).otherwise(lat + dlat), 6).alias("north"),
        F.round(F.when(boxed, se_lat).otherwise(lat - dlat), 6).alias("south"),
        F.round(F.when(boxed, nw_lon).otherwise(lon - dlon), 6).alias("west"),
        F.round(F.when(boxed, se_lon).otherwise(lon + dlon), 6).alias("east"),
        F.when(boxed, "user_bbox").when(centred, "user_center").otherwise("default_provisional").alias("source"),
    )


def anchor_points(m: Column, width: Column, height: Column) -> Column:
    """Four labelled anchors at 15 % / 85 % of the sheet pushed through an affine, one decimal."""
    # Anchor labels and their relative corners.
    corners = [("NW Sector (Pillar 1)", 0.15, 0.15), ("NE Sector (Pillar 2)", 0.85, 0.15),
               ("SE Sector (Pillar 3)", 0.85, 0.85), ("SW Sector (Pillar 4)", 0.15, 0.85)]
    out = []
    for i, (label, fx, fy) in enumerate(corners, 1):
        x, y = affine_point(m, width * fx, height * fy)
        out.append(F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"),
                            F.round(x, 1).alias("x"), F.round(y, 1).alias("y")))
    return F.array(*out)
