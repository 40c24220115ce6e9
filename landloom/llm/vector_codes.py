"""Product codes of vectors from integer k-means, with distances by limb-split exact matrix products.

Components become integers ``floor(4096 * x)`` and vectors are cut into ``PARTS`` equal parts. A part's codebook
starts as that part of the first ``ENTRIES`` vectors by id; each round assigns every part to its nearest entry
and moves the entries to the floor of their parts' means. Distances come from one matrix product a part: integers
are broken into limbs so short that the float64 products of limbs and their sums stay below 2^53, where they are
exact whatever order BLAS adds them in; the products are put together again in int64 (in unbounded integers
where that could overflow), and the first smallest distance wins.

Every round is one pass over the vectors without a shuffle of them: a task hands on one sum a codebook cell and
limb, which Spark adds up. Only the codebooks, ``ENTRIES`` vectors long, come to the driver.

Vectors that are null or hold null or non-finite components are dropped; zero vectors stay. A vector shorter than the longest
one, rounded up to a multiple of ``PARTS``, is read as ended by zeros, an empty one too. Rows that repeat a
vec_id count each; the first ones are taken by vec_id (nulls last), then by components. With fewer than
``ENTRIES`` vectors the codebooks are that short. An error too large for a long is null. No rows give no rows;
columns besides ``vec_id``, ``embedding`` and ``label`` are not looked at, and without ``label`` all are null."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import cut_lineage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components that are turned into integers at a time.
CELLS = 1 << 19
#: Bits of the limbs in which sums are handed on: 2^23 of them still add up exactly in float64.
SUM_BITS = 30
#: Ways the rows of one label are dealt when they meet their label's sum.
SALTS = 32


def integers(v: np.ndarray) -> np.ndarray:
    """``floor(SCALE * v)``: int64, or Python integers if one of them is too large for it."""
    with np.errstate(over="ignore"):
        f = np.floor(v * SCALE)
    if not f.size or np.abs(f).max() < 2.0 ** 62:
        return f.astype(np.int64)
    out = np.empty(f.size, dtype=object)
    # Scaling by a power of two is exact unless it overflows, and then the component is an integer already.
    out[:] = [int(a) if np.isfinite(a) else int(b) * SCALE for a, b in zip(f.ravel().tolist(), v.ravel().tolist(), strict=True)]
    return out.reshape(f.shape)


def _largest(a: np.ndarray) -> int:
    return max(abs(int(a.max())), abs(int(a.min()))) if a.size else 0


def limbs(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 arrays whose sum, each times 2^bits more than the one before, is ``a``; the last one is signed."""
    n = _largest(a).bit_length() // bits + 1
    low = (1 << bits) - 1
    return [((a >> (bits * i)) & low if i < n - 1 else a >> (bits * i)).astype(np.float64) for i in range(n)]


def products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact ``x @ c.T`` of integer matrices, in int64 if no sum of four such products can overflow."""
    terms = max(x.shape[1], 1)
    bits = (53 - (terms - 1).bit_length()) // 2
    fits = 4 * terms * max(_largest(x), _largest(c)) ** 2 < 1 << 63
    kind = np.int64 if fits else object
    out = np.zeros((len(x), len(c)), dtype=kind)
    right = limbs(c, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            part = (a @ b.T).astype(np.int64)
            out += part.astype(kind) * (1 << bits * (i + j)) if not fits else part << (bits * (i + j))
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lowest of equals, and its squared distance."""
    dot = products(x, c)
    square = lambda a: (a.astype(dot.dtype) ** 2).sum(axis=1)
    d = square(x)[:, None] - 2 * dot + square(c)[None, :]
    at = np.argmin(d, axis=1)
    return at, d[np.arange(len(x)), at]


def _matrices(batch, width: int):
    """(first row, integer matrix) of runs of rows, padded to ``width``."""
    col = batch.column(batch.schema.get_field_index("v"))
    step = max(1, CELLS // max(width, 1))
    for i in range(0, len(col), step):
        part = col.slice(i, step)
        n = part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        m = np.zeros((len(part), width))
        m[np.repeat(np.arange(len(part)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = part.flatten().to_numpy(zero_copy_only=False)
        yield i, integers(m)


def _pieces(m: np.ndarray, books: list[np.ndarray]):
    size = m.shape[1] // PARTS
    return [(p, m[:, p * size:(p + 1) * size], c) for p, c in enumerate(books)]


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label and v (doubles) of the vectors that take part."""
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    v = vectors.select("vec_id", label, F.col("embedding").cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    return v.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))


def _moved(v: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after one round."""
    schema = "part int, entry int, place int, limb int, total long"

    def sums(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        count = np.zeros((PARTS, ENTRIES), dtype=np.int64)
        for batch in batches:
            for _, m in _matrices(batch, width):
                for p, x, c in _pieces(m, books):
                    at, _ = nearest(x, c)
                    count[p] += np.bincount(at, minlength=ENTRIES)
                    chosen = (at == np.arange(len(c))[:, None]).astype(np.float64)
                    for k, limb in enumerate(limbs(x, SUM_BITS)):
                        part = (chosen @ limb).astype(np.int64)
                        total[p, k] = part + total[p, k] if (p, k) in total else part
        for (p, k), s in total.items():
            e, at = np.divmod(np.arange(s.size), max(s.shape[1], 1))
            yield pa.RecordBatch.from_pydict({"part": np.full(s.size, p, np.int32), "entry": e.astype(np.int32), "place": at.astype(np.int32), "limb": np.full(s.size, k, np.int32), "total": s.ravel()})
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({"part": p.astype(np.int32), "entry": e.astype(np.int32), "place": np.full(len(p), -1, np.int32), "limb": np.zeros(len(p), np.int32), "total": count[p, e]})

    rows = v.select("v").mapInArrow(sums, schema).groupBy("part", "entry", "place", "limb").agg(F.sum("total").alias("total")).collect()  # cells of the codebooks
    whole: dict[tuple[int, int, int], int] = {}
    for r in rows:
        key = r["part"], r["entry"], r["place"]
        whole[key] = whole.get(key, 0) + (r["total"] << (SUM_BITS * r["limb"]))
    out = []
    for p, c in enumerate(books):
        new = c.astype(object)
        for e in range(len(c)):
            if n := whole.get((p, e, -1), 0):
                new[e] = [whole[p, e, i] // n for i in range(c.shape[1])]
        out.append(_narrow(new))
    return out


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) if _largest(a) < 1 << 62 else a


def train(v: DataFrame, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """The codebooks of vectors from ``kept``, and the width vectors are padded to."""
    longest = v.agg(F.max(F.size("v"))).first()[0]
    width = -(-(longest or 0) // PARTS) * PARTS
    first = v.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    m = np.zeros((len(first), width))
    for i, r in enumerate(first):
        m[i, :len(r["v"])] = r["v"]
    m = integers(m)
    size = width // PARTS
    books = [_narrow(m[:, p * size:(p + 1) * size]) for p in range(PARTS)]
    for _ in range(rounds if len(m) else 0):
        books = _moved(v, books, width)
    return books, width


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for c in books for x in c.ravel().tolist()).encode()).hexdigest()


def assign(v: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """``v`` without the vectors, with ``code`` (two hex digits a part) and ``error``."""
    rest = [f for f in v.schema.fields if f.name not in ("v", "code", "error")]
    schema = StructType([*rest, StructField("code", StringType()), StructField("error", LongType())])
    hexes = np.array([f"{i:02x}" for i in range(ENTRIES)])

    def run(batches):
        for batch in batches:
            for i, m in _matrices(batch, width):
                codes, error = np.zeros(len(m), dtype="U0"), np.zeros(len(m), dtype=object)
                for _, x, c in _pieces(m, books):
                    at, d = nearest(x, c)
                    codes = np.char.add(codes, hexes[at])
                    error += d.astype(object)
                part = batch.slice(i, len(m))
                cols = [part.column(part.schema.get_field_index(f.name)) for f in rest]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(codes.tolist(), pa.string()), pa.array([e if e < 1 << 63 else None for e in error.tolist()], pa.int64())], names=[f.name for f in schema.fields])

    return v.select(*[F.col(f"`{f.name}`") for f in rest], "v").mapInArrow(run, schema)


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels) and the codebooks' digest."""
    v = kept(vectors)
    books, width = train(v)
    coded = cut_lineage(assign(v, books, width).withColumn("k", F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label").cast("string")))))
    exact = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = coded.groupBy("k").agg(F.when(F.count("error") == F.count(F.lit(1)), exact).alias("e")).select("k", F.col("e").try_cast("long").alias("label_error"))
    # One label may hold a third of all rows, so its rows meet their sum in many tasks.
    by_label = by_label.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)).cast("int"))
    return salted.join(by_label, ["k", "salt"]).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
