"""Helpers shared by the operators of this subpackage: table access, row keys, words and hashes as arrays."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are turned into arrays at a time; one longer text is taken alone.
PIECE = 2 << 20

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Texts reach Python workers in Arrow batches of this size, not of 10 000 rows, which buffers on both sides would hold.
    A limit that the session was given stands."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower() in ("67108864b", "67108864", "64mb", "64m"):  # Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def row_key(doc_id: Column, text: Column) -> Column:
    """Two rows with equal id and text are the same row; an id that comes with two texts is two rows."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")), text.isNull())


def pieces(batch, column: str = "text", limit: int = PIECE):
    """Yield (first row, last row + 1, bytes, offsets) of runs of rows with about ``limit`` bytes; nulls are empty."""
    arr = batch.column(column)
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    n = len(arr)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64 if wide else np.int32)[arr.offset:arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j modulo 2**64 for j < n."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, PIECE + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            _powers[name] = np.cumprod(step, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums whose differences, scaled by ``powers``, hash any substring."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    up, _ = powers(len(data))
    np.cumsum((_LOWER if lower else _TABLE)[data] * up, out=out[1:])
    return out


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and per text the index of its first word (one entry more than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~_IS_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[off] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = ~word[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = before[1:]
    starts = np.flatnonzero(word & (before | cut[:-1]))
    after[:-1] = ~word[1:]
    ends = np.flatnonzero(word & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, p: np.ndarray | None = None) -> np.ndarray:
    """``p``: the prefix hash of the data, if it is there already."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p = prefix_hash(data, lower) if p is None else p
    _, down = powers(len(data) + 1)
    return mix((p[ends] - p[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k-1 entries run over the end and are cut off."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = mix(out + h[j:n + j] * np.uint64(2 * j + 3))
    return out


def pack_planes(a: np.ndarray) -> bytes:
    """An integer array by byte planes, compressed: planes that hold little cost little."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_planes(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def open_dir(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder named by Spark, inside tasks."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri[5:] if not uri.startswith("file://") else uri[7:]
    return pafs.FileSystem.from_uri(uri)
