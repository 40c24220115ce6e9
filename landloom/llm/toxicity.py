"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the different runs of ``ORDERS`` characters in it, in lower case and with all white space alike, hashed
to ``2^BITS`` numbers. Over all training rows Spark counts, for each feature, the toxic and the other rows that hold it; the
logarithm of the two smoothed shares' ratio scales the feature, and each text's scaled features are brought to length 1.
A logistic regression with an L2 penalty is fitted on them by L-BFGS: every gradient is a Spark job over the sample, the driver
holds the weights alone. The score is the probability of label 1.

The ratios cover all training rows. The regression is fitted on a bounded sample, about ``SAMPLE`` rows of either label chosen by a
hash of their id, weighted back to the shares of the labels. Training rows are labelled ones with ``crc32(doc_id as text) mod
3`` other than 1; of an id with several labels the highest holds, and its rows count each. Texts are read whole.

A null text is an empty one; it has no features and gets the score of the intercept. Labels other than 0 and 1 are none.
A row without an id is scored and not held out. Without training rows of both labels every score is
``(toxic + 1) / (rows + 2)``. Rows that repeat are scored alike. An empty table gives an empty result; columns besides ``doc_id`` and
``text`` are not looked at."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import pack_planes, unpack_planes

ORDERS, BITS = (3, 4, 5), 18
#: Rows of each label, at most about, that the regression is fitted on, and the tasks they are dealt to.
SAMPLE, SAMPLE_PARTS = 4000, 8
PENALTY, ROUNDS, MEMORY = 0.01, 25, 8
THRESHOLD = 0.7
#: Characters of a text that are hashed at a time.
STEP = 1 << 20

_SPREAD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _hashed(chars: np.ndarray) -> Iterator[np.ndarray]:
    """Features of each order, one a place."""
    h = chars
    for n in range(2, max(ORDERS) + 1):
        if len(chars) < n:
            return
        h = h[:len(chars) - n + 1] * _SPREAD + chars[n - 1:]
        if n in ORDERS:
            yield (((h ^ (h >> np.uint64(29))) * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


class Features:
    """Finds the different features of texts; ``last`` remembers who wrote a feature last, so nothing is sorted."""

    def __init__(self):
        self.last = np.zeros(1 << BITS, dtype=np.int32)

    def _once(self, f: np.ndarray) -> np.ndarray:
        at = np.arange(len(f), dtype=np.int32)
        self.last[f] = at
        return f[self.last[f] == at]

    def of(self, text: str | None) -> np.ndarray:
        chars = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        chars = np.where((chars <= 32) | (chars == 0x85) | (chars == 0xA0), np.uint64(32), chars)
        overlap = max(ORDERS) - 1
        found = []
        for i in range(0, max(len(chars) - overlap, 1), STEP):
            parts = list(_hashed(chars[i:i + STEP + overlap]))
            if parts:
                found.append(self._once(np.concatenate(parts)))
        return self._once(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.zeros(0, np.int64)


@dataclass
class Model:
    """Scaled weights of the features, the squares of their scales, and the intercept."""
    weights: np.ndarray
    squares: np.ndarray
    intercept: float

    def score(self, f: np.ndarray) -> float:
        z = self.intercept
        if len(f):
            z += self.weights[f].sum() / np.sqrt(max(self.squares[f].sum(), 1e-12))
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _training(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, toxic) of the training rows, and the labels they take."""
    mine = lambda t: t.filter(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 1))
    known = mine(labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))).filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Labels have no size bound, so they are not broadcast; texts are not sorted either.
    return mine(docs.select("doc_id", "text")).join(known.hint("shuffle_hash"), "doc_id"), known


def _gathered(batches):
    """The task's rows a feature and label, and the features of the rows in the sample."""
    f = Features()
    counts = np.zeros((2, 1 << BITS), dtype=np.int64)
    rows = np.zeros(2, dtype=np.int64)
    names = ["feature", "clean", "toxic", "y", "held"]
    for batch in batches:
        text, toxic, taken = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "toxic", "taken"))
        y, held = [], []
        for i in range(len(text)):
            t = toxic[i].as_py()
            b = f.of(text[i].as_py())
            counts[t, b] += 1
            rows[t] += 1
            if taken[i].as_py():
                y.append(t)
                held.append(pack_planes(np.sort(b).astype(np.int32)) if len(b) else b"")
        none = lambda kind: pa.nulls(len(y), kind)
        yield pa.RecordBatch.from_arrays([none(pa.int32()), none(pa.int64()), none(pa.int64()), pa.array(y, pa.int32()), pa.array(held, pa.binary())], names=names)
    at = np.flatnonzero(counts.any(axis=0))
    # Feature -1 carries the number of rows.
    arrays = [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(counts[0, at], rows[0])), pa.array(np.append(counts[1, at], rows[1])), pa.nulls(len(at) + 1, pa.int32()), pa.nulls(len(at) + 1, pa.binary())]
    yield pa.RecordBatch.from_arrays(arrays, names=names)


def _gradient(weights: np.ndarray, intercept: float, scales: np.ndarray, share: tuple[float, float]):
    """Loss and gradient of a task's rows: the intercept's part, then the features' as bytes."""
    def run(batches):
        scaled, squares = weights * scales, scales ** 2
        loss, base = 0.0, 0.0
        out = np.zeros(1 << BITS)
        for batch in batches:
            for y, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = unpack_planes(held, np.int32) if held else np.zeros(0, np.int32)
                size = 1 / float(np.sqrt(max(squares[f].sum(), 1e-12))) if len(f) else 0.0
                z = float(intercept + scaled[f].sum() * size)
                loss += share[y] * (np.logaddexp(0, z) - y * z)
                d = share[y] * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y)
                base += d
                out[f] += d * size
        yield pa.RecordBatch.from_pydict({"loss": [float(loss)], "base": [float(base)], "grad": [(out * scales).astype(np.float32).tobytes()]})
    return run


def _minimised(f, x: np.ndarray, rounds: int, memory: int) -> np.ndarray:
    """L-BFGS with step halving."""
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    value, g = f(x)
    for _ in range(rounds):
        q, factors = g.copy(), []
        for s, d in reversed(moves):
            factors.append((s @ q) / (d @ s))
            q -= factors[-1] * d
        q *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(np.linalg.norm(g), 1e-12)
        for (s, d), a in zip(moves, reversed(factors), strict=True):
            q += s * (a - (d @ q) / (d @ s))
        step = 1.0
        while True:
            new_x = x - step * q
            new_value, new_g = f(new_x)
            if new_value <= value - 1e-4 * step * (g @ q) or step < 1e-4:
                break
            step /= 2
        if new_value > value:
            break
        s, d = new_x - x, new_g - g
        if s @ d > 1e-12:
            moves = [*moves, (s, d)][-memory:]
        done = value - new_value <= 1e-4 * max(abs(value), 1e-9)
        x, value, g = new_x, new_value, new_g
        if done:
            break
    return x


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    train, known = _training(docs, labels)
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    taken = place < F.when(F.col("toxic") == 1, F.lit(int((1 << 20) * min(1.0, sample / max(n.get(1, 0), 1))))).otherwise(F.lit(int((1 << 20) * min(1.0, sample / max(n.get(0, 0), 1)))))
    raw = cut_lineage(train.select("text", "toxic", taken.alias("taken")).mapInArrow(_gathered, "feature int, clean long, toxic long, y int, held binary"))
    counts = raw.filter("feature is not null").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()  # 2^BITS rows at most
    at, by_label = counts.column("feature").to_numpy(), [counts.column(c).to_numpy() for c in ("clean", "toxic")]
    rows = [int(c[at == -1].sum()) for c in by_label]
    flat = lambda z: Model(np.zeros(1 << BITS), np.zeros(1 << BITS), z)
    if not all(rows):
        return flat(float(np.log((rows[1] + 1) / (rows[0] + 1))))
    scales = np.zeros(1 << BITS)
    real = at >= 0
    scales[at[real]] = np.log((by_label[1][real] + 1) / (rows[1] + 2)) - np.log((by_label[0][real] + 1) / (rows[0] + 2))
    held = cut_lineage(raw.filter("y is not null").select("y", "held").repartition(SAMPLE_PARTS, F.xxhash64("held")))
    drawn = {r["y"]: r["count"] for r in held.groupBy("y").count().collect()}
    if len(drawn) < 2:
        return flat(float(np.log((rows[1] + 1) / (rows[0] + 1))))
    share = tuple(rows[y] / sum(rows) * sum(drawn.values()) / drawn[y] for y in (0, 1))

    def loss(x: np.ndarray):
        w, b = x[:-1], float(x[-1])
        parts = held.mapInArrow(_gradient(w.astype(np.float32), b, scales.astype(np.float32), share), "loss double, base double, grad binary").collect()
        grad = sum(np.frombuffer(p["grad"], np.float32).astype(np.float64) for p in parts) + PENALTY * w
        return sum(p["loss"] for p in parts) + PENALTY * (w @ w) / 2, np.append(grad, sum(p["base"] for p in parts))

    x = _minimised(loss, np.append(np.zeros(1 << BITS), np.log(rows[1] / rows[0])), rounds, MEMORY)
    return Model((x[:-1] * scales).astype(np.float32), (scales ** 2).astype(np.float32), float(x[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    def run(batches):
        f = Features()
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            scores = [model.score(f.of(text[i].as_py())) for i in range(len(text))]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, by a model of ``labels``."""
    held_out = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    return score(docs, fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
