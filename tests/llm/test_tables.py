"""Archives, URL lists, vectors, the registered queries against their twins, and the pipeline."""
from __future__ import annotations

import datetime as dt
import hashlib
import io
import os
import struct
from fractions import Fraction

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import zstandard

from landloom.llm import ann, components, registry, url_filters, warc
from landloom.llm.common import open_dir
from landloom.session import settings

registry.load_all()
TABLES = ["documents", "embeddings", "pages", "labels", "benchmark"]


def canon(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(registry.ORACLES[name])
    at = [[x[0] for x in cur.description].index(c) for c in cols]
    assert sorted(x[0] for x in cur.description) == cols
    assert sorted(tuple(canon(v) for v in r) for r in df.select(*cols).collect()) == sorted(tuple(canon(r[i]) for i in at) for r in cur.fetchall())


# ---- archives ------------------------------------------------------------------------------------

def test_warc(spark, tmp_path):
    same = "<html>" + "x" * 200
    rows = [(3, "http://a/1", same, "e"), (1, "http://a/2", same, "e"), (1, "http://a/2", same, "e"), (9, None, same, "e"), (None, "http://n/", same, "e"), (4, "http://b/\r\nX: y", None, "e"), (5, "u", "", "e"),
            (6, "u", "short", "e"), (7, "u", "short", "e"), (8, "u", "ü" * 400_000, "e")] + [(100 + i, f"http://p/{i}", f"<html><body>page {i % 50} of many pages with the same head and foot</body></html>" * 3, "e") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    archives = warc.write_archives(pages, f"file://{tmp_path}/w")
    got = sorted(map(str, warc.read_archives(archives, payload=False).drop("url").collect()))
    first = {}
    for i, _, h, _ in rows:
        d = hashlib.sha256((h or "").encode()).hexdigest()
        if i is not None and len((h or "").encode()) >= 100:
            first[d] = min(first.get(d, i), i)
    want = []
    for i, _, h, _ in rows:
        d = hashlib.sha256((h or "").encode()).hexdigest()
        f = first.get(d)
        r = f if f is not None and (i is None or i > f) else None
        want.append(f"Row(page_id={i}, payload_bytes={len((h or '').encode())}, payload_digest={d!r}, record_type={'revisit' if r is not None else 'response'!r}, refers_to={r})".replace("record_type=revisit", "record_type='revisit'"))
    assert got == sorted(want)
    body = {r.page_id: bytes(r.payload) for r in warc.read_archives(archives).filter("record_type = 'response' and page_id is not null").collect()}
    assert body[8] == ("ü" * 400_000).encode() and body[4] == b""
    urls = {r.page_id: r.url for r in warc.read_archives(archives, payload=False).collect()}
    assert urls[9] is None and urls[4] == "http://b/%0D%0AX: y"
    assert warc.read_archives(warc.write_archives(pages.limit(0)), payload=False).count() == 0


def test_warc_frames_open_with_any_reader(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://p/{i}", f"<html><body>page {i} of many pages with the same head and foot</body></html>" * 4) for i in range(400)], "page_id long, url string, html string").coalesce(1)
    a = warc.write_archives(pages, f"{tmp_path}/w").collect()[0]
    raw = open(os.path.join(open_dir(a.folder)[1], a.file), "rb").read()
    magic, n = struct.unpack_from("<II", raw)
    assert magic == 0x184D2A5D
    made = zstandard.ZstdCompressionDict(raw[8:8 + n])
    reader = zstandard.ZstdDecompressor(dict_data=made).stream_reader(io.BytesIO(raw[8 + n:]), read_across_frames=True)
    assert reader.read().count(b"WARC/1.1\r\n") == 400
    plain = sum(len(zstandard.compress(r)) for r in warc.read_frames(io.BytesIO(raw)))
    assert len(raw) - 8 - n < plain / 2


# ---- lists ---------------------------------------------------------------------------------------

def test_url_lists(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    entries = spark.createDataFrame([("bad", "example.com", "add", t(5)), ("bad", "example.com", "add", t(5)), ("bad", "example.com", "remove", t(10)), ("bad", "Example.com", "add", t(20)), ("spam", "x.org/ads", "add", t(1)),
                                     ("tie", "tie.net", "add", t(3)), ("tie", "tie.net", "remove", t(3)), (None, "z.z", "add", t(1)), ("bad", None, "add", t(1)), ("bad", "q.q", None, t(1)), ("bad", "q.q", "add", None)],
                                    "list_name string, pattern string, action string, since timestamp")
    rows = [("http://www.EXAMPLE.com:80/a", t(4), ""), ("http://www.example.com/a", t(5), "bad"), ("http://example.com", t(9), "bad"), ("http://example.com", t(10), ""), ("https://u@a.b.example.com./?q", t(21), "bad"),
            ("http://notexample.com", t(6), ""), ("http://x.org/ads/1", t(2), "spam"), ("http://x.org/adsense", t(2), ""), ("http://y.x.org/ads", t(2), ""), ("http://tie.net", t(4), ""), (None, t(6), ""), ("http://example.com", None, ""), ("nonsense", t(6), ""), ("http://example.com", t(9), "bad")]
    caps = spark.createDataFrame([(u, at, w, "kept", None) for u, at, w in rows], "url string, fetched_at timestamp, want string, pattern string, blocked boolean")
    out = url_filters.apply_lists(caps, entries).collect()
    assert len(out) == len(rows) and all(r.matched_lists == r.want and r.blocked == (r.want != "") and r.pattern == "kept" for r in out)
    assert url_filters.apply_lists(caps, entries.limit(0)).filter("blocked").count() == 0 and url_filters.apply_lists(caps.limit(0), entries).count() == 0


def test_url_lists_with_capitals(spark):
    entries = spark.createDataFrame([("bad", "Site.com/News", "add", 1), ("old", "example.com", "add", 1), ("old", "Example.com", "remove", 5)], "list_name string, pattern string, action string, since long")
    rows = [("http://SITE.com/News/1", 2, "bad"), ("http://site.com/news/1", 2, ""), ("http://example.com/A", 4, "old"), ("http://example.com/A", 6, "")]
    out = url_filters.apply_lists(spark.createDataFrame(rows, "url string, fetched_at long, want string"), entries).collect()
    assert len(out) == 4 and all(r.matched_lists == r.want for r in out)


# ---- vectors -------------------------------------------------------------------------------------

def test_nearest(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=16) * 10.0 ** rng.integers(-3, 4)]) for i in range(400)] + [(400 + i, rows_ := [1.0] * 16) for i in range(60)]
    rows += [(500, None), (600, []), (700, [0.0] * 16), (701, [float("nan")] + [1.0] * 15), (702, [None] + [1.0] * 15), (703, [float("inf")] * 16), (800, [1.0, 2.0]), (801, [1.0, 3.0]), (None, [1.0] * 16), (5, rows_)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    want = []
    for q, x in ok:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(x.tolist(), y.tolist(), strict=True)))), i) for i, y in ok if i != q and len(x) == len(y))[:10]
            want += [(q, k + 1, i, d) for k, (d, i) in enumerate(near)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df, block=32, query_block=2).collect())
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], rtol=1e-12)
    assert ann.nearest(df.limit(0)).count() == 0


def test_nearest_broadcasts_no_blocks(spark):
    """Blocks are wide binaries that size estimates take for short ones: neither side is gathered in the driver."""
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 11), 1.0]) for i in range(400)], "vec_id long, embedding array<double>")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "100m", "spark.sql.adaptive.autoBroadcastJoinThreshold": "100m"}):
        got = ann.nearest(df, block=32)
        assert len(got.collect()) == 40
        plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


# ---- components and the pipeline -----------------------------------------------------------------

def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (None, 3), (3, None)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_pipeline(spark, odd, none):
    docs = odd
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near duplicates", "personal data", "mixing", "token ids"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, "")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name != "token ids":
            assert docs.columns == odd.columns
        if name in ("quality rules", "near duplicates"):
            assert docs.count() < before.count()
    assert docs.count() and "ids" in docs.columns and "text" not in docs.columns


@pytest.mark.parametrize("vectors", [
    [[1000.0 * (1 + k * 1e-9)] * 64 for k in range(400)], [[1e6 + k * 1e-9] * 64 for k in range(300)], [[1e6 * (1 + k * 1e-9)] * 33 for k in range(300)],
    [[(-1) ** k * 1e200, k * 1e198] for k in range(200)], [[k * 1e-200, 1e-201, 0.0] for k in range(1, 120)], [[1.7e308 * (-1) ** k, -2.5e307 * (k % 7)] for k in range(40)],
    [[1e200 * (k % 2), k * 1e-180, 1.0] for k in range(150)]], ids=["steps", "large", "larger", "huge", "tiny", "overflow", "mixed"])
def test_bounds_hold_whatever_the_size(vectors):
    """The tile's nearest are those of exact arithmetic, ties to the smaller id."""
    v = np.array(vectors)
    ids = np.arange(len(v))
    q = ids[:: max(1, len(v) // 9)]
    a, b, d = ann.tile_best(q, v[q], ids, v, 10)
    for i in q:
        exact = [sum((Fraction(x) - Fraction(y)) ** 2 for x, y in zip(v[i].tolist(), w, strict=True)) for w in v.tolist()]
        want = sorted(exact[j] for j in ids if j != i)[:10]
        got = [exact[j] for j in b[a == i]]
        # Distances that agree in double precision may change places.
        assert len(got) == 10 and all(abs(x - y) <= y * Fraction(1, 10**11) for x, y in zip(sorted(got), want, strict=True))
        with np.errstate(over="ignore"):
            assert all(np.isinf(x) or x <= y * (1 + 1e-9) for x, y in zip(d[a == i], d[a == i][1:], strict=False))


def test_distances_keep_every_bit():
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(50, 40)), rng.normal(size=(50, 40))
    plain = [np.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))) for a, b in zip(q, c, strict=True)]
    assert ann.distances(q, c).tolist() == plain
    assert ann.distances(np.ldexp(q, 700), np.ldexp(c, 700)).tolist() == np.ldexp(plain, 700).tolist()
    assert ann.distances(np.array([[1e200, 0.0]]), np.array([[0.0, 0.0]])).tolist() == [1e200]
