"""Exact nearest neighbours as a block matrix join over int8 products.

Vectors are packed into blocks of rows: the original floats plus an int8 code and a scale per row. Query blocks
meet candidate blocks in an equi-join on tile numbers; in a tile one integer-valued matrix product of the codes
gives all distances at once, each with a bound of its quantisation error. What the bounds cannot rule out is
computed again from the floats, in double precision, and each tile hands on its best k per query, which a
bounded heap per query merges. The bounds allow for the rounding of their own arithmetic, so recall is 1.

Components of any finite size are fine; a distance beyond the largest double is infinite.

Null vectors, vectors of zeros and vectors with null, NaN or infinite components take no part. Vectors are
compared with vectors of their own length. Rows that repeat a vec_id are candidates of their own, save that a
query never finds rows of its own id; of a query id that repeats with different vectors the one smallest by
components asks. Fewer than k candidates give fewer rows. Other columns are not looked at."""
from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_parts

#: Rows of a block; a tile holds a query block against a candidate block.
BLOCK = 2048
QUERY_BLOCK = 512
#: Heap entries a task holds before it hands them on.
HELD = 400_000


def usable(vectors: DataFrame) -> DataFrame:
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.filter(~bad & F.exists("v", lambda x: x != 0))


def _pack(block: int):
    def pack(batches):
        for df in batches:
            for dim, part in df.groupby(df["v"].map(len)):
                for i in range(0, len(part), block):
                    cut = part.iloc[i:i + block]
                    m = np.array(cut["v"].tolist(), dtype=np.float64)
                    yield pd.DataFrame({"dim": [dim], "ids": [cut["vec_id"].to_numpy(np.int64).tobytes()], "m": [m.tobytes()]})
    return pack


def quantise(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scale per row, and per row the length of what rounding left out."""
    top = np.abs(m).max(axis=1)
    scale = np.where(top > 0, top / 127.0, 1.0)
    codes = np.rint(m / scale[:, None])
    left = np.sqrt(((m - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes.astype(np.int8), scale, left


#: What is smaller than this share of a tile's largest component counts as zero in the bounds.
_SPECK = 1e-150
#: Binary exponents beyond this are taken out before squares are summed.
_FAR = 400
#: Pairs whose distance is worked out at a time.
_PAIRS = 1 << 16


def _exponent(m: np.ndarray) -> np.ndarray:
    e = np.frexp(np.abs(m).max(axis=1))[1]
    return np.where(np.abs(e) > _FAR, e, 0)[:, None]


def distances(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row pair, summed in order of the components. Very large and very small ones are
    scaled by powers of two, which changes no bit of the others."""
    first = _exponent(np.maximum(np.abs(q), np.abs(c)))
    diff = np.ldexp(q, -first) - np.ldexp(c, -first)
    second = _exponent(diff)
    diff = np.ldexp(diff, -second)
    d = np.zeros(len(q))
    for j in range(q.shape[1]):
        d += diff[:, j] ** 2
    with np.errstate(over="ignore"):
        return np.ldexp(np.ldexp(np.sqrt(d), second[:, 0]), first[:, 0])


def bounds(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all distances of a tile, in units of a power of two above its components."""
    e = -np.frexp(max(np.abs(q).max(), np.abs(c).max()))[1]
    q, c = np.ldexp(q, e), np.ldexp(c, e)
    q, c = np.where(np.abs(q) < _SPECK, 0.0, q), np.where(np.abs(c) < _SPECK, 0.0, c)
    qc, qs, ql = quantise(q)
    cc, cs, cl = quantise(c)
    # float32 products of int8 codes are exact up to a length of 1040; longer ones go in double.
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    dot = (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64) * (qs[:, None] * cs[None, :])
    square = ((qc * qs[:, None]) ** 2).sum(1)[:, None] + ((cc * cs[:, None]) ** 2).sum(1)[None, :]
    near = np.sqrt(np.maximum(square - 2 * dot, 0))
    # The difference of squares is off by at most some roundings of its operands, and its root by the root of that.
    dim = q.shape[1]
    rounding = np.sqrt(16 * (dim + 8) * np.finfo(np.float64).eps * square)
    slack = (ql[:, None] + cl[None, :]) * (1 + 1e-9) + rounding + 4 * dim * _SPECK
    return near - slack, near + slack


def tile_best(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int):
    """(query id, candidate id, distance) of every query's k nearest candidates of this tile."""
    low, high = bounds(q, c)
    own = qid[:, None] == cid[None, :]
    high[own] = np.inf
    kk = min(k, high.shape[1])
    limit = np.partition(high, kk - 1, axis=1)[:, kk - 1]
    qi, ci = np.nonzero((low <= limit[:, None]) & ~own)
    d = np.concatenate([distances(q[qi[i:i + _PAIRS]], c[ci[i:i + _PAIRS]]) for i in range(0, max(len(qi), 1), _PAIRS)])
    order = np.lexsort((cid[ci], d, qi))
    qi, ci, d = qi[order], ci[order], d[order]
    place = np.arange(len(qi)) - np.searchsorted(qi, qi)
    keep = place < k
    return qid[qi[keep]], cid[ci[keep]], d[keep]


def _rows(best: dict[int, list]) -> pd.DataFrame:
    flat = [(q, i, d) for q, rows in best.items() for d, i in rows]
    return pd.DataFrame(flat, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row whose id ``every`` divides."""
    spark = vectors.sparkSession
    v = usable(vectors)
    parts = n_parts(spark)
    packed = "dim int, ids binary, m binary"
    cands = v.mapInPandas(_pack(block), packed)
    # Query blocks go to every candidate tile row; tiles are numbered by the hash of the block's content.
    queries = v.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).repartition(max(1, parts // 8), "vec_id").mapInPandas(_pack(query_block), packed)
    cands = cands.withColumn("tile", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("tile"), F.col("dim"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
    # Merged: a block is thousands of times the size that is estimated for it, and copies of the queries are no table to broadcast.
    met = cands.join(queries.hint("merge"), ["tile", "dim"])

    def score(batches):
        best: dict[int, list] = {}
        held = 0
        for df in batches:
            for r in df.itertuples(index=False):
                qid, cid = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
                q, c = np.frombuffer(r.q_m, np.float64).reshape(len(qid), -1), np.frombuffer(r.m, np.float64).reshape(len(cid), -1)
                a, b, d = tile_best(qid, q, cid, c, k)
                cut = np.flatnonzero(np.diff(a)) + 1
                for ids, near, far in zip(np.split(a, cut), np.split(b, cut), np.split(d, cut), strict=True):
                    if len(ids):
                        new = list(zip(far.tolist(), near.tolist(), strict=True))
                        old = best.get(int(ids[0]), [])
                        held += len(new) - len(old)
                        best[int(ids[0])] = heapq.nsmallest(k, old + new)
                        held += len(best[int(ids[0])]) - len(new)
                if held > HELD:  # a full table of heaps goes on to the merge, so memory stays bounded
                    yield _rows(best)
                    best, held = {}, 0
        yield _rows(best)

    found = met.select("ids", "m", "q_ids", "q_m").mapInPandas(score, "query_id long, vec_id long, score double")
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
