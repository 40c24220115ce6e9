"""Removal of byte strings that start at two places, by sorting the suffixes of a covering sample.

A suffix array by difference covers rests on one property: two equal strings hold sampled positions at equal
distances from their starts, so sampled suffixes are ranked first and the others follow from a few leading bytes and the rank of the next sample.
Here the sample is taken by content: for every start, the smallest hash of a ``GRAM``-byte string in the ``SPAN``
starts from it on. Equal strings of ``SPAN + GRAM`` bytes and more choose the same place in them. That keeps 3 % of all
positions, where residues modulo 3 keep two thirds of them, whose names alone would exceed the input several
times over (see README).

1. Sampled contexts are named by the ``length - SPAN + 1`` bytes from the sample on, sorted, and compared with their
   neighbours; what is alone cannot lie in a repeat.
2. All starts that choose one sample form a run. A run is named by all bytes its strings cover; equal names settle a
   run at once, which is what happens inside long repeats.
3. The remaining starts, at the edges of repeats, get the name of their own ``length`` bytes and are sorted once more,
   with one run of each name that the others may match; equal neighbours are repeats.

Names are 64-bit hashes; in 1 a shorter one is enough, as it only preselects. Strings never reach over a text's
end, the same text counts as another place, and overlaps count. A null or empty text has no bytes. Rows that
repeat id and text are places of their own, so both lose everything of ``length`` bytes and more. A row without an id is
known by its text. An empty table gives an empty result; columns besides ``doc_id`` and ``text`` are not looked at."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import mix, n_parts, pack_planes, pieces, powers, prefix_hash, row_key, unpack_planes

GRAM, SPAN = 16, 64
#: Buckets of names for each shuffle partition.
BUCKETS = 4
#: Runs a task gathers before it hands them on.
HELD = 400_000
_SETTLED, _ASKS, _OFFERS = 0, 1, 2


def _ident(docs: DataFrame) -> tuple[Column, Column]:
    """Two numbers that tell rows apart: a 64-bit hash of id and text, and 16 more bits of the text."""
    return row_key(F.col("doc_id"), F.col("text")), F.xxhash64(F.lit(7), F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0xFFFF)).cast("int")


def runs_of(data: np.ndarray, off: np.ndarray, length: int):
    """First start, number of starts, sample, short name and full name of every run of a piece."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    p = prefix_hash(data)
    _, down = powers(n + 1)
    gram = mix((p[GRAM:] - p[:-GRAM]) * down[:n - GRAM + 1])
    bits = np.uint64(max(22, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    # The place goes into the low bits, so that the rightmost of equal hashes wins in every window.
    least = (gram & ~low) | (low - np.arange(len(gram), dtype=np.uint64))
    wide = 1
    while wide < SPAN:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    start = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(off[:-1], off[1:], strict=True) if b - a >= length] or [none])
    if not len(start):
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = (low - (least[start] & low)).astype(np.int64)
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)))
    first = np.flatnonzero(new)
    s, m = start[first], np.diff(np.append(first, len(start)))
    a, end = at[first], s + m - 1 + length
    short = mix((p[a + length - SPAN + 1] - p[a]) * down[a])
    full = mix(mix((p[end] - p[s]) * down[s]) + (a - s).astype(np.uint64) * np.uint64(256) + m.astype(np.uint64))
    return s, m, short, full


_BLOB = "bucket int, short binary, full binary, id binary, tag binary, s binary, m binary, twice binary, own binary"
_RUN = "id long, tag int, s long, m int, kind int"


def _spill(parts: list, buckets: int):
    """Runs by bucket of their short name, sorted by it.

    Runs that share their full name in here are settled at once: one of them goes on with a mark, the others
    only ride along (``own``, spread over the buckets), so a text with very many copies reaches its bucket once a spill."""
    short, full, ids, tag, s, m = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((full, short))
    short, full, ids, tag, s, m = short[order], full[order], ids[order], tag[order], s[order], m[order]
    new = np.concatenate(([True], (full[1:] != full[:-1]) | (short[1:] != short[:-1])))
    twice = (np.diff(np.append(np.flatnonzero(new), len(new))) > 1).astype(np.uint8)
    own = np.stack([ids[~new], tag[~new].astype(np.int64), s[~new], m[~new]], 1).astype(np.int64)
    short, full, ids, tag, s, m = short[new], full[new], ids[new], tag[new], s[new], m[new]
    # Buckets are ranges of the name; 40 bits of it are kept, as differences.
    short = short >> np.uint64(24)
    edge = np.searchsorted(short, _edges(buckets))
    share = np.linspace(0, len(own), buckets + 1).astype(int)
    for b in range(buckets):
        i, j = edge[b], edge[b + 1]
        yield {"bucket": b, "short": pack_planes(np.diff(short[i:j], prepend=np.uint64(0))), "full": full[i:j].tobytes(), "id": pack_planes(ids[i:j]), "tag": pack_planes(tag[i:j]),
               "s": pack_planes(s[i:j]), "m": pack_planes(m[i:j].astype(np.uint8)), "twice": pack_planes(twice[i:j]), "own": pack_planes(own[share[b]:share[b + 1]].T.reshape(-1))}


def _edges(buckets: int) -> np.ndarray:
    return np.array([(k << 40) // buckets for k in range(buckets + 1)], np.uint64)


def _gathered(blobs: list[bytes], kind) -> np.ndarray:
    return np.concatenate([unpack_planes(x, kind) for x in blobs])


def settle(key, df):
    """Compare the runs of a bucket with their neighbours by name."""
    short = np.concatenate([np.cumsum(unpack_planes(x, np.uint64), dtype=np.uint64) for x in df["short"]])
    full = np.frombuffer(b"".join(df["full"]), np.uint64)
    own = np.concatenate([unpack_planes(x, np.int64).reshape(4, -1).T for x in df["own"]])
    out = [pd.DataFrame({"id": own[:, 0], "tag": own[:, 1].astype(np.int32), "s": own[:, 2], "m": own[:, 3].astype(np.int32), "kind": np.int32(_SETTLED)})]
    if not len(short):
        return out[0]
    order = np.lexsort((full, short))
    short, full = short[order], full[order]
    new_s = np.concatenate(([True], short[1:] != short[:-1]))
    new_f = new_s | np.concatenate(([True], full[1:] != full[:-1]))
    group, name = np.cumsum(new_s) - 1, np.cumsum(new_f) - 1
    times = np.bincount(name, weights=1 + _gathered(df["twice"], np.uint8)[order].astype(np.int64))[name]
    names = np.bincount(group[new_f])[group]
    settled = times > 1
    open_groups = np.zeros(group[-1] + 1, bool)
    open_groups[group[~settled]] = True
    asks = ~settled & (names > 1)
    offers = settled & new_f & (names > 1) & open_groups[group]
    ids, tag, s, m = (_gathered(df[c], k)[order] for c, k in (("id", np.int64), ("tag", np.int32), ("s", np.int64), ("m", np.uint8)))
    for kind, mine in ((_SETTLED, settled), (_ASKS, asks), (_OFFERS, offers)):
        out.append(pd.DataFrame({"id": ids[mine], "tag": tag[mine], "s": s[mine], "m": m[mine].astype(np.int32), "kind": np.int32(kind)}))
    return pd.concat(out)


def _per_text(runs: DataFrame) -> DataFrame:
    """(id, tag, runs): the runs of one text in one row; their number is bounded by the text's length."""
    return runs.groupBy("id", "tag").agg(F.collect_list(F.struct("s", "m", "kind")).alias("runs"))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of a list column by row (nulls are empty) and its (s, m, kind) rows."""
    n = np.array([0 if x is None else x for x in pc.list_value_length(column).to_pylist()], np.int64)
    flat = column.flatten()
    cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in flat.flatten()] if len(flat) else [np.zeros(0, np.int64)] * 3
    return np.concatenate(([0], np.cumsum(n))), np.stack(cols, 1)


def find_runs(docs: DataFrame, length: int) -> DataFrame:
    """Runs in repeats (settled), runs that may hold some (asks), and runs those may match (offers)."""
    buckets = n_parts(docs.sparkSession) * BUCKETS
    ident, tag = _ident(docs)

    def scan(batches):
        held, size = [], 0
        for b in batches:
            ids, tags = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, j, data, off in pieces(b):
                s, m, short, full = runs_of(data, off, length)
                if len(s):
                    doc = np.searchsorted(off, s, side="right") - 1
                    held.append((short, full, ids[i:j][doc].astype(np.int64), tags[i:j][doc].astype(np.int32), s - off[doc], m))
                    size += len(s)
                if size > HELD:
                    yield pa.RecordBatch.from_pylist(list(_spill(held, buckets)), schema=blob)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(list(_spill(held, buckets)), schema=blob)

    blob = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("short", "full", "id", "tag", "s", "m", "twice", "own")])
    return docs.select(ident.alias("id"), tag.alias("tag"), "text").mapInArrow(scan, _BLOB).groupBy("bucket").applyInPandas(settle, _RUN)


def _edge_names(length: int, buckets: int):
    """Names of the starts of runs that ask or offer, by bucket."""
    blob = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("name", "id", "tag", "s")])

    def scan(batches):
        held, size = [], 0

        def spill():
            name, ids, tag, s = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(name)
            name, ids, tag, s = name[order], ids[order], tag[order], s[order]
            edge = np.searchsorted(name >> np.uint64(24), _edges(buckets))
            rows = [{"bucket": b, "name": pack_planes(np.diff(name[i:j], prepend=np.uint64(0))), "id": pack_planes(ids[i:j]), "tag": pack_planes(tag[i:j]), "s": pack_planes(s[i:j])}
                    for b, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if i < j]
            return pa.RecordBatch.from_pylist(rows, schema=blob)

        for b in batches:
            off, flat = _lists(b.column(3))
            for r in range(b.num_rows):
                runs = flat[off[r]:off[r + 1]]
                runs = runs[runs[:, 2] != _SETTLED]
                if not len(runs):
                    continue
                data = np.frombuffer(b.column(2)[r].as_py().encode("utf-8"), np.uint8)
                p = prefix_hash(data)
                _, down = powers(len(data) + 1)
                n = runs[:, 1]
                at = np.repeat(runs[:, 0] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                name = mix((p[at + length] - p[at]) * down[at])
                # Starts of runs that only offer are sent with a mark: they need no answer.
                offer = np.repeat(runs[:, 2] == _OFFERS, n)
                held.append((name, np.full(len(at), b.column(0)[r].as_py(), np.int64), np.full(len(at), b.column(1)[r].as_py(), np.int32), np.where(offer, -1 - at, at)))
                size += len(at)
                if size > HELD:
                    yield spill()
                    held, size = [], 0
        if held:
            yield spill()

    return scan


def _equal_names(key, df):
    name = np.concatenate([np.cumsum(unpack_planes(x, np.uint64), dtype=np.uint64) for x in df["name"]])
    ids, tag, s = (_gathered(df[c], k) for c, k in (("id", np.int64), ("tag", np.int32), ("s", np.int64)))
    order = np.argsort(name, kind="stable")
    name, ids, tag, s = name[order], ids[order], tag[order], s[order]
    same = name[1:] == name[:-1]
    twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
    mine = twice & (s >= 0)
    ids, tag, s = ids[mine], tag[mine], s[mine]
    # Consecutive starts of a text become one run again.
    order = np.lexsort((s, tag, ids))
    ids, tag, s = ids[order], tag[order], s[order]
    if not len(s):
        return pd.DataFrame({"id": ids, "tag": tag, "s": s, "m": s.astype(np.int32), "kind": s.astype(np.int32)})
    new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (tag[1:] != tag[:-1]) | (s[1:] != s[:-1] + 1)))
    at = np.flatnonzero(new)
    return pd.DataFrame({"id": ids[at], "tag": tag[at], "s": s[at], "m": np.diff(np.append(at, len(s))).astype(np.int32), "kind": np.int32(_SETTLED)})


def covered(n: int, runs: np.ndarray, length: int) -> np.ndarray:
    """Which of n bytes the strings of the runs cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1] - 1 + length, -1)
    return np.cumsum(edge[:-1]) > 0


def dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, the bytes kept, and the removed runs as (start, end) in bytes."""
    if length <= SPAN + GRAM:
        raise ValueError(f"strings must be longer than {SPAN + GRAM} bytes")
    parts = n_parts(docs.sparkSession)
    runs = cut_lineage(_per_text(find_runs(docs, length)))
    ident, tag = _ident(docs)
    d = docs.select(F.col("doc_id"), ident.alias("id"), tag.alias("tag"), F.coalesce("text", F.lit("")).alias("text"))
    # Texts meet their runs once; the result is written, and all that follows reads it.
    met = cut_lineage(d.join(runs, ["id", "tag"], "left"))
    buckets = parts * BUCKETS
    asked = met.filter("runs is not null").select("id", "tag", "text", "runs").mapInArrow(_edge_names(length, buckets), "bucket int, name binary, id binary, tag binary, s binary")
    more = cut_lineage(_per_text(asked.groupBy("bucket").applyInPandas(_equal_names, _RUN)).withColumnRenamed("runs", "more"))
    # Only texts that asked wait for answers; the others are cut as they are.
    waits = F.coalesce(F.exists("runs", lambda x: x["kind"] == _ASKS), F.lit(False))
    touched = met.filter(waits).join(more, ["id", "tag"], "left").select("doc_id", "text", "runs", "more")
    clean = met.filter(~waits).select("doc_id", "text", "runs", F.lit(None).cast(met.schema["runs"].dataType).alias("more"))
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("removed", pa.list_(pa.list_(pa.int64())))])

    def cut(batches):
        for b in batches:
            rows, size = [], 0
            lists = [_lists(b.column(i)) for i in (2, 3)]
            for r in range(b.num_rows):
                raw = b.column(1)[r].as_py().encode("utf-8")
                found = np.concatenate([flat[off[r]:off[r + 1]] for off, flat in lists])
                found = found[found[:, 2] == _SETTLED]
                if len(found):
                    gone = covered(len(raw), found, length)
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                    kept, spans = np.frombuffer(raw, np.uint8)[~gone].tobytes(), edge.reshape(-1, 2)
                else:
                    kept, spans = raw, np.zeros((0, 2), np.int64)
                rows.append({"doc_id": b.column(0)[r].as_py(), "n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(spans), "kept": kept, "removed": spans.tolist()})
                size += len(raw)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=out)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    return touched.union(clean).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<array<long>>")
