"""Source divergence, toxicity and product codes against brute force, odd rows included."""
from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from landloom.llm import divergence, toxicity, vector_codes


def audited(rows, least, top):
    """All rows of the audit from (lang, source, text), worked out directly."""
    docs = [(a or "", b or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        holds = Counter(t for d in mine for t in d[2])
        terms = [t for t, n in holds.items() if n >= least]
        count = defaultdict(Counter)
        for _, s, c in mine:
            count[s].update({t: c[t] for t in terms if t in c})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(terms)) for t in terms}
        whole = share(sum(count.values(), Counter()))
        p = {s: share(count[s]) for s in {d[1] for d in mine}}
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pair = sorted((-sum(far(p[s][t], p[o][t]) for t in terms), o.encode()) for o in p if o != s)
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pair)]
            term = sorted((-far(p[s][t], whole[t]), t.encode()) for t in terms if count[s][t] and p[s][t] > whole[t])
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(term[:top])]
    return sorted(out)


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_divergence(odd, odd_rows, block):
    got = sorted(tuple(r) for r in divergence.audit(odd, least_docs=3, top=4, block=block).collect())
    assert got == audited([(r[2], r[3], r[1]) for r in odd_rows], 3, 4)
    assert {r[2] for r in got} == {"pair", "term"}


def test_divergence_of_nothing(none, odd, odd_rows):
    assert divergence.audit(none).collect() == []
    got = divergence.audit(odd, least_docs=1000).collect()  # no language keeps a term
    assert sorted(tuple(r) for r in got) == audited([(r[2], r[3], r[1]) for r in odd_rows], 1000, 10)
    assert {r["value"] for r in got} == {0}


def test_divergence_scatters_large_counts():
    n, m = np.array([0, 7, 2 * 10**14], np.int64), np.array([3, 10, 2 * 10**14 + 4], np.int64)
    assert divergence.shares(n, m).tolist() == [1 + 10**9 * (int(a) + 2) // int(b) for a, b in zip(n, m, strict=True)]


def test_divergence_takes_crowded_terms_in_steps(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(divergence, "STEP", 3)
    monkeypatch.setattr(divergence, "HELD", 5)
    batch = odd.selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source", "coalesce(text, '') text").toArrow().combine_chunks().to_batches(max_chunksize=9)
    parts = [p.to_pylist() for p in divergence._counted(batch)]
    assert len(parts) > 1
    got = Counter()
    for r in itertools.chain(*parts):
        got[r["lang"], r["source"], r["term"].decode()] += r["n"]
    want = Counter()
    for r in odd_rows:
        want.update((r[2] or "", r[3] or "", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or ""))
    assert got == want


VECTORS = "vec_id long, embedding array<double>, label int, error string, code int"


def coded(rows):
    """Codes from (vec_id, vector, label) with Python's own integers."""
    kept = [(i, [int(np.floor(4096 * np.float64(x))) if abs(x) < 1e300 else 4096 * int(x) for x in v], lab) for i, v, lab in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [x if x is not None else 0 for x in r[1] or []])) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // 8) * 8
    kept = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in kept]
    part = lambda v, p: v[p * width // 8:(p + 1) * width // 8]
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]
    near = lambda x, c: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(c))
    for _ in range(6):
        moved = []
        for p, c in enumerate(books):
            at = [near(part(v, p), c)[1] for _, v, _ in kept]
            mine = [[part(v, p) for (_, v, _), a in zip(kept, at, strict=True) if a == k] for k in range(len(c))]
            moved.append([[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c[k] for k, g in enumerate(mine)])
        books = moved
    rows = []
    for i, v, lab in kept:
        found = [near(part(v, p), c) for p, c in enumerate(books)]
        rows.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    by_label = Counter()
    for r in rows:
        by_label[r[1]] += r[3]
    sha = hashlib.sha256(",".join(str(x) for c in books for e in c for x in e).encode()).hexdigest()
    fits = lambda x: x if x < 2**63 else None
    return sorted(((i, code, fits(e), fits(by_label[lab]), sha) for i, lab, code, e in rows), key=str)


def vectors(seed, n, dim, spread=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, spread) for _ in range(dim)], rng.choice([1, 2, None])) for i in range(n)]
    return rows + [(3, rows[7][1], 1), (3, rows[7][1], 1), (n, None, 1), (n + 1, [1.0, None] + [0.0] * (dim - 2), 1), (n + 2, [float("nan")] * dim, 2), (n + 3, [float("inf")] * dim, 2), (n + 4, [0.0] * dim, None), (None, [0.5] * dim, 1)]


@pytest.mark.parametrize("rows", [
    vectors(1, 60, 16), vectors(2, 40, 8, 1e-4), vectors(3, 9, 24), vectors(4, 30, 16, 1e30), vectors(5, 30, 8, 2.0**40),
    [*vectors(6, 20, 11), (100, [], 1), (101, [1e306, -1e306], 1), (102, [0.25], None)]], ids=["plain", "tiny", "few", "huge", "wide", "ragged"])
def test_product_codes(spark, rows):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], VECTORS).repartition(3)
    got = sorted((tuple(r) for r in vector_codes.compress(df).collect()), key=str)
    assert got == coded(rows)


def test_product_codes_of_nothing(spark):
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).collect() == []
    one = vector_codes.compress(spark.createDataFrame([(5, [1.5] * 8)], "vec_id long, embedding array<float>")).collect()
    assert [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in one] == [(5, "00" * 8, 0, 0)]


@pytest.mark.parametrize("size", [1, 2**10, 2**24, 2**26, 2**31, 2**61, 2**200])
def test_limb_products_are_exact(size):
    rng = random.Random(size)
    draw = lambda n, d: [[rng.randint(-size, size) for _ in range(d)] for _ in range(n)]
    kind = np.int64 if size < 2**62 else object
    for d in (1, 3, 8, 100):
        a, b = draw(9, d), draw(5, d)
        got = vector_codes.products(np.array(a, dtype=kind), np.array(b, dtype=kind))
        assert got.tolist() == [[sum(x * y for x, y in zip(r, s, strict=True)) for s in b] for r in a]


def test_ties_take_the_lower_entry():
    at, d = vector_codes.nearest(np.array([[0, 0], [5, 5]]), np.array([[1, 0], [0, 1], [-1, 0], [5, 5], [5, 5]]))
    assert (at.tolist(), d.tolist()) == ([0, 3], [1, 0])


def spoken(rng, n, bad):
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    for _ in range(max(1, n // 25) if bad else 0):
        words[rng.randrange(n)] = rng.choice(["wretched", "Vermin", "scumbag"])
    return " ".join(words)


@pytest.fixture(scope="module")
def labelled(spark, odd_rows):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(1000, 1600):
        bad = i % 6 == 0
        rows.append((i, spoken(rng, rng.randint(10, 300), bad)))
        if i % 5:
            labels.append((i, int(bad)))
    rows += [(r[0], r[1]) for r in odd_rows if r[0] is None or r[0] < 1000]
    labels += [(1, 0), (12, 0), (12, 0), (5, 0), (4, None), (None, 1), (777_777, 1), (14, 7)]
    docs = spark.createDataFrame([(*r, "x", 0.5, True) for r in rows], "doc_id long, text string, toxic string, score double, feature boolean").repartition(4)
    return rows, docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark, labelled):
    rows, docs, labels = labelled
    got = toxicity.classify(docs, labels).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] >= 1000]
    bad, good = [r for r in held if r["doc_id"] % 6 == 0], [r for r in held if r["doc_id"] % 6]
    assert sum(r["predicted"] for r in bad) >= 0.9 * len(bad)
    assert sum(r["predicted"] for r in good) <= 0.02 * len(good)
    # The same text gets the same score wherever it stands, and labels of held-out rows play no part.
    again = toxicity.classify(docs.repartition(2, "text"), spark.createDataFrame([(r[0], 1) for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1], "doc_id long, toxic int").union(labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1 or doc_id is null")))
    one = {r["doc_id"]: r["score"] for r in got}
    assert all(abs(one[r["doc_id"]] - r["score"]) < 1e-3 for r in again.collect() if r["doc_id"] is not None and r["doc_id"] >= 1000)


def test_toxicity_without_both_labels(spark, labelled, none):
    _, docs, labels = labelled
    got = toxicity.classify(docs, labels.filter("toxic = 1"))
    n = labels.filter("toxic = 1 and doc_id between 1000 and 2000 and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").count()
    assert {round(r["score"], 9) for r in got.collect()} == {round((n + 1) / (n + 2), 9)}
    assert {r["score"] for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.classify(none, labels).collect() == []


def test_features_of_a_text(monkeypatch):
    f = toxicity.Features()
    grams = lambda t: {t[i:i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)}
    assert len(f.of(None)) == len(f.of("ab")) == 0
    assert sorted(f.of("Ab\tcd")) == sorted(f.of("aB CD"))
    text = " ".join("".join(random.Random(i).choice("abcdeé😀") for _ in range(5)) for i in range(60))
    whole = sorted(f.of(text))
    assert abs(len(whole) - len(grams(text))) <= 2  # numbers of features collide rarely
    monkeypatch.setattr(toxicity, "STEP", 17)
    assert sorted(f.of(text)) == whole
