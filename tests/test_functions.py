"""Recorded values and small invariants of the column functions."""
from __future__ import annotations

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from landloom.functions import codes, projection, rings, scores, status
from landloom.functions.text import classify_infrastructure
from landloom.sources import readers, writers


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("lat, lon, want", [
    (26.8467, 80.9462, "9Y3397AA2ZDCZ4"), (28.6139, 77.2090, "9322BBZAZZ7ZB5"), (26.76099767979002, 80.90151367979001, "9YYD56AA2Z9Y3A")])
def test_ulpin(spark, lat, lon, want):
    assert one(spark, codes.ulpin(F.lit(lat), F.lit(lon))) == want


def test_scores(spark):
    assert one(spark, scores.alignment_confidence(F.lit(150), F.lit(200), F.lit(5.0))) == 81.55
    assert one(spark, scores.alignment_confidence(F.lit(0), F.lit(0), F.lit(100.0))) == 0.0
    assert one(spark, scores.alignment_confidence(F.lit(0), F.lit(0), F.lit(None).cast("double"), F.lit(4))) == 96.0
    assert one(spark, scores.band(F.lit(85.0))) == "GREEN"
    assert one(spark, scores.to_bigha(F.lit(-1.0))) == "0.00"


def test_codes(spark):
    assert one(spark, codes.officer_id(F.lit("Tehsildar"), F.lit("9876543210"))) == "REV-TEH-3210"
    assert one(spark, codes.safe_name(F.lit("/a/b/my map(2).png"))) == "my_map_2_"
    assert one(spark, codes.khasra_from_id(F.lit("preview-107-x"))) == "107"
    assert one(spark, codes.parse_uuid(F.lit("no"))) is None
    assert one(spark, status.status_label(F.lit(None).cast("string"))) == "Draft"
    assert one(spark, status.status_label(F.lit("Other"))) == "Other"


def test_mercator_round_trip(spark):
    r = rings.rect_rings(F.lit(80.9462), F.lit(26.8467), F.lit(80.95), F.lit(26.85))
    m = one(spark, projection.to_web_mercator(r))
    assert round(m[0][0]["x"], 2) == 9010889.77 and round(m[0][0]["y"], 2) == 3104331.96
    back = one(spark, projection.to_wgs84(projection.to_web_mercator(r)))
    assert abs(back[0][2]["x"] - 80.95) < 1e-7 and abs(back[0][2]["y"] - 26.85) < 1e-7


def test_area_and_hole(spark):
    sq = rings.rect_rings(F.lit(80.9010), F.lit(26.7605), F.lit(80.9022), F.lit(26.7615))
    assert one(spark, rings.area_sqm(sq)) == 13277.82
    outer, inner = rings.rect_rings(F.lit(0), F.lit(0), F.lit(4), F.lit(4)), rings.rect_rings(F.lit(0), F.lit(0), F.lit(2), F.lit(2))
    both = F.array(outer[0], inner[0])
    assert one(spark, rings.planar_area(both)) == 12.0
    c = one(spark, rings.centroid(both))
    assert abs(c["x"] - 28 / 12) < 1e-12 and abs(c["y"] - 28 / 12) < 1e-12


def test_infrastructure_rules(spark):
    got = one(spark, classify_infrastructure(F.lit("A Broad RAIL line")))
    assert got["detected"] == ["Road / Transport Corridor", "Railway Track"] and got["risk"] == "HIGH"
    assert one(spark, classify_infrastructure(F.lit("settlement")))["risk"] == "LOW"
    assert one(spark, classify_infrastructure(F.lit("field")))["risk"] == "NONE"


def test_wkb(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)]
    body = struct.pack("<II", 1, 4) + b"".join(struct.pack("<2d", *p) for p in ring)
    plain = b"\x01" + struct.pack("<I", 3) + body
    srid = b"\x01" + struct.pack("<II", 3 | 0x20000000, 4326) + body
    big = b"\x00" + struct.pack(">III", 3, 1, 4) + b"".join(struct.pack(">2d", *p) for p in ring)
    multi = b"\x01" + struct.pack("<II", 6, 2) + plain + plain
    rows = [(1, plain), (2, srid), (3, big), (4, multi), (5, b"\x01junk"), (6, None)]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in rows], "id int, wkb binary")
    got = {r["id"]: r for r in readers.decode_wkb(df).collect()}
    for i in (1, 2, 3):
        assert [(p["x"], p["y"]) for p in got[i]["rings"][0]] == ring
    assert len(got[4]["parts"]) == 2
    assert got[5]["error"] and not got[6]["error"] and got[6]["parts"] == []


def png(path, w, h):
    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    raw = b"".join(b"\x00" + b"\x10\x80\x20" * w for _ in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_profile_rasters(spark, tmp_path):
    png(tmp_path / "a.png", 7, 5)
    (tmp_path / "b.png").write_bytes(b"not an image")
    got = {r["path"].split("/")[-1]: r for r in readers.profile_rasters(spark, str(tmp_path)).collect()}
    assert (got["a.png"]["width"], got["a.png"]["height"], got["a.png"]["channels"]) == (7, 5, 3)
    assert got["b.png"]["width"] is None


def test_profile_raster_headers(spark, tmp_path):
    png(tmp_path / "a.png", 70_000, 2)
    bmp = b"BM" + bytes(16) + struct.pack("<iiHH", 640, -480, 1, 32) + bytes(8)
    for name, data in {"b.bmp": bmp, "c.gif": b"GIF89a" + struct.pack("<HH", 300, 200), "d.ppm": b"P6 # 9 9\n# 8 8\n12\t34\n255\n\xff\x00", "e.pgm": b"P2\n1 2\n255\n0 0",
                       "f.png": (tmp_path / "a.png").read_bytes()[:20], "g.bmp": b"BM", "i.jpg": b"\xff\xd8\xff\xe0", "j.ppm": b"P3 0 5 255", "k.ppm": b" P3 4 5 255"}.items():
        (tmp_path / name).write_bytes(data)
    rows = readers.profile_raster_headers(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    got = {r["path"].split("/")[-1]: tuple(r)[1:] for r in rows}
    none = (None, None, None)
    assert got == {"a.png": (70_000, 2, 3), "b.bmp": (640, 480, 4), "c.gif": (300, 200, 3), "d.ppm": (12, 34, 3), "e.pgm": (1, 2, 1),
                   "f.png": none, "g.bmp": none, "i.jpg": none, "j.ppm": none, "k.ppm": none}
    # A scan skips empty files; rows that come without bytes some other way have no size.
    nothing = spark.createDataFrame([("x", None), ("y", b"")], "path string, content binary")
    assert {tuple(r) for r in readers.profile_raster_headers(nothing).collect()} == {("x", *none), ("y", *none)}


def test_geojson_files(spark, tmp_path):
    p = readers.generate_parcels(spark.range(10).withColumnRenamed("id", "i"), "sheet").withColumn("parcel_id", F.col("i"))
    p = p.withColumns({c: F.lit("x") for c in ("khasra_no", "owner_name", "village", "tehsil", "district", "alignment_status", "ulpin")})
    p = p.withColumns({c: F.lit(1.5) for c in ("area_sqm", "alignment_confidence", "centroid_lat", "centroid_lon")}).withColumn("khasra_no", F.col("i").cast("string"))
    writers.write_geojson(writers.parcel_features(p), str(tmp_path / "out"))
    back = readers.read_geojson(spark, str(tmp_path / "out"), lines=True)
    assert sorted(r["khasra_no"] for r in back.collect()) == sorted(str(i) for i in range(10))
    lines = "\n".join('{"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}}' for _ in range(3))
    (tmp_path / "unnamed.jsonl").write_text(lines.replace("\n", "\n\n", 1) + "\n")
    got = readers.read_geojson(spark, str(tmp_path / "unnamed.jsonl"), lines=True).orderBy("feature_no").collect()
    assert [(r["feature_no"], r["khasra_no"], len(r["rings"]), len(r["parts"])) for r in got] == [(0, "101", 1, 2), (1, "102", 1, 2), (2, "103", 1, 2)]
    (tmp_path / "empty.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    with pytest.raises(ValueError, match="no features"):
        readers.read_geojson(spark, str(tmp_path / "empty.geojson"))
    prof = readers.profile_layers(spark, str(tmp_path / "empty.geojson")).first()
    assert prof["parsed_successfully"] and prof["features_count"] == 0


def test_gcp_files(spark, tmp_path):
    (tmp_path / "g.json").write_text(
        '[{"id": "a", "name": "n", "source": {"lng": 80.9, "lat": 26.7}, "target": {"lng": 80.91, "lat": 26.71}, "error_m": 0.1},'
        ' {"legacy_coord": [26.7, 80.9], "drone_coord": [26.8, 80.8]}, {"source_lon": 1, "source_lat": 2, "target_lon": 3, "target_lat": 4},'
        ' [[1, 2], [3, 4]], {"source": "bad", "target": [1, 2]}]')
    got = [(r["sx"], r["sy"], r["tx"], r["ty"]) for r in readers.read_gcps(spark, str(tmp_path / "g.json")).orderBy("gcp_no").collect()]
    assert got == [(80.9, 26.7, 80.91, 26.71), (80.9, 26.7, 80.8, 26.8), (1.0, 2.0, 3.0, 4.0), (1.0, 2.0, 3.0, 4.0)]


@pytest.mark.parametrize("sqm, want", [(3983.616, "1.58"), (2529.28 / 8, "0.13"), (2529.28 * 1234.5, "1234.50")])
def test_bigha_halves_go_up(spark, sqm, want):
    assert one(spark, scores.to_bigha(F.lit(sqm))) == want


def test_axis_order_north_of_50(spark):
    pairs = lambda ps: F.array(*[rings.point(F.lit(x), F.lit(y)) for x, y in ps])
    north = [(80.9, 50.1), (80.9, 51.2), (81.0, 50.3)]
    for given in (north, [(y, x) for x, y in north]):
        got = one(spark, projection.fix_axis_order(pairs(given)))
        assert [(p["x"], p["y"]) for p in got] == [*north, north[0]]
