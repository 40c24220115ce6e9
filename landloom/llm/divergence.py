"""Divergence of sources: how far apart the word shares of every two sources of a language lie.

The index is term-major: one row a language and kept term with its postings, a source and a count each. It is cut
into blocks of terms; within a block every group (language and source) in turn accumulates a row: its
terms are scattered through the postings into a dense accumulator over the peers, so pairs of postings are
never rows. Terms that a group or a peer lacks have a share above zero too. So an accumulator starts as if no term were
shared: the group's terms against each peer's share of absent terms, the peers' terms against the group's, and
the terms neither has; shares that repeat are worked out once, by histograms of counts. Scattering then
corrects the terms both have. Blocks hand on one dense row a group, and Spark adds them up.

A term is a run of letters and non-ASCII characters, A-Z in lower case; a language keeps the terms in at least ``LEAST_DOCS`` of its
rows. All numbers are integers: a share is ``1 + floor(10^9 (count + 2) / (N + 2 V))``, a divergence of two shares
``floor((p - q)^2 / (p + q))``. Sums are exact for up to 2 * 10^14 occurrences.

Null text, language and source are empty ones. Every group that occurs has its rows, without terms as well; a language
of one source has no pairs. Repeated rows count each. An empty table gives an empty result; columns besides
``text``, ``lang`` and ``source`` are not looked at."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import n_parts, pieces

LEAST_DOCS, TOP = 10, 10
#: Postings of a block, counted terms a task holds, and postings or values worked on at a time.
BLOCK, HELD, STEP = 1 << 20, 1 << 18, 1 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _terms(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Terms of a run of texts, and the text of each."""
    letter = np.zeros(len(data) + 2, dtype=bool)
    letter[1:-1] = _LETTER[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[off] = True
    starts = np.flatnonzero(letter[1:] & (~letter[:-1] | cut))
    ends = np.flatnonzero(letter[:-1] & (~letter[1:] | cut))
    at = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=at[1:])
    kept = _LOWER[data[letter[1:-1]]]
    kind, wide = (pa.binary(), np.int32) if len(kept) < 1 << 31 else (pa.large_binary(), np.int64)
    terms = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(at.astype(wide)), pa.py_buffer(kept)])
    return terms, np.searchsorted(off, starts, side="right") - 1


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(batches):
    """Occurrences and texts per group and term, added up as far as ``HELD`` allows."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        lang, source = (batch.column(batch.schema.get_field_index(c)).dictionary_encode() for c in ("lang", "source"))
        group = lang.indices.to_numpy().astype(np.int64) * max(len(source.dictionary), 1) + source.indices.to_numpy()
        for i, j, data, off in pieces(batch):
            terms, doc = _terms(data, off)
            if not len(terms):
                continue
            coded = terms.dictionary_encode()
            width = len(coded.dictionary)
            pair, n = np.unique(doc * width + coded.indices.to_numpy(), return_counts=True)
            key = group[i:j][pair // width] * width + pair % width
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = _runs(key)
            g, t = np.divmod(key[first], width)
            a, b = np.divmod(g, max(len(source.dictionary), 1))
            held.append(pa.Table.from_arrays([lang.dictionary.take(pa.array(a)), source.dictionary.take(pa.array(b)), coded.dictionary.take(pa.array(t)).cast(pa.binary()),
                                              pa.array(np.add.reduceat(n, first)), pa.array(np.diff(np.append(first, len(key))))], schema=_COUNTED))
            size += len(first)
            if size > HELD:
                all_in = _summed(held)
                held, size = [all_in], all_in.num_rows
                if size > HELD // 2:
                    yield from all_in.to_batches(max_chunksize=1 << 16)
                    held, size = [], 0
    if held:
        yield from _summed(held).to_batches(max_chunksize=1 << 16)


def _summed(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return t.rename_columns([c.removesuffix("_sum") for c in t.column_names]).select(_COUNTED.names).combine_chunks()


def term_index(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, total and postings (source, n) of the terms a language keeps."""
    counted = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    groups = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # One posting a source at most, so a row is as long as a language has sources.
    index = groups.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("postings"))
    return index.filter(F.col("docs") >= least_docs).select("lang", F.col("term").cast("string").alias("term"), "total", "postings")


def _group_table(docs: DataFrame, index: DataFrame) -> DataFrame:
    """lang, source, g (number of the source in its language), m and lang_m (what shares are divided by, 0 without terms)."""
    own = index.select("lang", F.explode("postings").alias("p")).groupBy("lang", F.col("p.source").alias("source")).agg(F.sum("p.n").alias("n"))
    whole = index.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    g = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(whole, "lang", "left")
    g = g.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return g.select("lang", "source", "g", (zero("n") + 2 * zero("v")).cast("long").alias("m"), (zero("lang_n") + 2 * zero("v")).cast("long").alias("lang_m"))


def shares(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``1 + floor(10^9 (n + 2) / m)``, divided in two steps so that nothing overflows."""
    q, r = np.divmod((n + 2) * 31250, m)
    return 1 + q * 32000 + r * 32000 // m


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _rows_of(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every row, one after the other."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


class Block:
    """Terms of one language with all of their postings, and all groups of the language."""

    def __init__(self, sources: pa.Array, m: np.ndarray, lang_m: int, terms: pa.Array, postings: pa.Array):
        self.sources, self.terms, self.n_terms = sources, terms, len(terms)
        lengths = pc.list_value_length(postings).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = postings.flatten()
        n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.peer = pc.index_in(flat.field("source"), value_set=sources).to_numpy(zero_copy_only=False).astype(np.int64)
        self.term = np.repeat(np.arange(self.n_terms), lengths)
        self.p = shares(n, m[self.peer])
        self.p0 = shares(np.zeros(len(m), np.int64), m)
        total = np.zeros(self.n_terms, np.int64)
        np.add.at(total, self.term, n)
        self.lang_p = shares(total, np.int64(lang_m))
        # Group-major order, and equal shares of a group once with their number.
        self.by_group = np.lexsort((self.p, self.peer))
        self.held = np.bincount(self.peer, minlength=len(m))
        self.begin = np.cumsum(self.held) - self.held
        peer, p = self.peer[self.by_group], self.p[self.by_group]
        first = np.flatnonzero(np.concatenate([[True], (peer[1:] != peer[:-1]) | (p[1:] != p[:-1])])) if len(p) else np.zeros(0, np.int64)
        self.h_peer, self.h_p, self.h_n = peer[first], p[first], np.diff(np.append(first, len(p)))
        self.h_begin = np.searchsorted(self.h_peer, np.arange(len(m) + 1))
        self.zero, self.zero_of = np.unique(self.p0, return_inverse=True)
        self._cached: tuple[int, np.ndarray] | None = None

    def _peers_against(self, share: int) -> np.ndarray:
        """Per peer, its terms against one share."""
        if self._cached is None or self._cached[0] != share:
            out = np.zeros(len(self.p0), np.int64)
            np.add.at(out, self.h_peer, apart(self.h_p, np.int64(share)) * self.h_n)
            self._cached = share, out
        return self._cached[1]

    def row(self, g: int) -> np.ndarray:
        """The block's divergence of group ``g`` from every peer."""
        share = self.p0[g]
        own = slice(self.h_begin[g], self.h_begin[g + 1])
        against = np.zeros(len(self.zero), np.int64)
        step = max(1, STEP // max(len(self.zero), 1))
        for i in range(own.start, own.stop, step):
            part = slice(i, min(i + step, own.stop))
            against += (apart(self.h_p[part, None], self.zero[None, :]) * self.h_n[part, None]).sum(axis=0)
        acc = against[self.zero_of] + self._peers_against(int(share)) + (self.n_terms - self.held[g] - self.held) * apart(share, self.p0)
        mine = self.by_group[self.begin[g]:self.begin[g] + self.held[g]]
        size = np.cumsum(self.lengths[self.term[mine]])
        i = 0
        while i < len(mine):
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + STEP)))
            t = self.term[mine[i:j]]
            at = _rows_of(self.lengths[t], self.starts[t])
            p, q, peer = np.repeat(self.p[mine[i:j]], self.lengths[t]), self.p[at], self.peer[at]
            zero = self.p0[peer]
            np.add.at(acc, peer, apart(p, q) - apart(p, zero) - apart(share, q) + apart(share, zero))
            i = j
        return acc

    def top_terms(self, g: int, k: int) -> list[tuple[bytes, int]]:
        """The group's ``k`` terms furthest above their share in the language."""
        mine = self.by_group[self.begin[g]:self.begin[g] + self.held[g]]
        p, q = self.p[mine], self.lang_p[self.term[mine]]
        mine, value = mine[p > q], apart(p, q)[p > q]
        if len(value) > k:
            far = value >= np.partition(value, len(value) - k)[len(value) - k]
            mine, value = mine[far], value[far]
        names = [x.as_py().encode() for x in self.terms.take(pa.array(self.term[mine]))]
        return sorted(zip(names, value.tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:k]


_OUT = pa.schema([("lang", pa.string()), ("g", pa.int32()), ("item", pa.string()), ("value", pa.int64()), ("dense", pa.list_(pa.int64()))])


def _block_rows(lang: str, table: pa.Table, top: int):
    """A dense row per group over its peers, and the groups' top terms of the block."""
    table = table.combine_chunks()
    is_group = pc.is_null(table.column("term"))
    groups, body = table.filter(is_group).sort_by("g"), table.filter(pc.invert(is_group))
    sources, m = groups.column("source").combine_chunks(), groups.column("m").to_numpy().astype(np.int64)
    n = len(m)
    block = Block(sources, m, groups.column("lang_m")[0].as_py(), body.column("term").combine_chunks(), body.column("postings").combine_chunks()) if body.num_rows else None
    # Groups with equal shares of absent terms follow one another, as what their peers add is the same.
    order = np.argsort(m, kind="stable")
    step = max(1, STEP // max(n, 1))
    for i in range(0, n, step):
        ids = order[i:i + step]
        dense = [block.row(int(g)) if block else np.zeros(n, np.int64) for g in ids]
        best = [(int(g), *x) for g in ids for x in block.top_terms(int(g), top)] if block else []
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * n, pa.int32()), pa.array(np.concatenate(dense)))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids)), pa.array(ids, pa.int32()), pa.nulls(len(ids), pa.string()), pa.nulls(len(ids), pa.int64()), flat], schema=_OUT)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(best), pa.string()), pa.array([b[0] for b in best], pa.int32()), pa.array([b[1].decode() for b in best], pa.string()),
                                          pa.array([b[2] for b in best], pa.int64()), pa.nulls(len(best), pa.list_(pa.int64()))], schema=_OUT)


def _accumulated(top: int):
    def run(batches):
        key, held = None, []
        for batch in batches:
            lang, block = batch.column(batch.schema.get_field_index("lang")).to_pylist(), batch.column(batch.schema.get_field_index("block")).to_pylist()
            i = 0
            while i < len(lang):
                j = i
                while j < len(lang) and (lang[j], block[j]) == (lang[i], block[i]):
                    j += 1
                if key is not None and key != (lang[i], block[i]):
                    yield from _block_rows(key[0], pa.Table.from_batches(held), top)
                    held = []
                key = lang[i], block[i]
                held.append(batch.slice(i, j - i))
                i = j
        if held:
            yield from _block_rows(key[0], pa.Table.from_batches(held), top)
    return run


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    d = docs.select(text("lang"), text("source"), text("text"))
    index = cut_lineage(term_index(d, least_docs))
    groups = cut_lineage(_group_table(d, index))
    postings = index.agg(F.sum(F.size("postings"))).first()[0] or 0
    blocks = max(1, math.ceil(postings / block))
    parts = max(n_parts(docs.sparkSession), blocks)
    # Small tables still use all tasks.
    blocks = max(blocks, min(parts, math.ceil(16 * postings / block)))
    none = lambda kind: F.lit(None).cast(kind)
    # Every block meets all groups of its language: as many rows as one dense accumulator has entries.
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), none("string").alias("term"), none(index.schema["postings"].dataType).alias("postings"), "source", "g", "m", "lang_m")
    body = index.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"), "term", "postings", none("string").alias("source"), none("int").alias("g"), none("long").alias("m"), none("long").alias("lang_m"))
    met = heads.union(body).repartition(parts, "lang", "block").sortWithinPartitions("lang", "block")
    found = cut_lineage(met.mapInArrow(_accumulated(top), "lang string, g int, item string, value long, dense array<long>"))
    names = groups.select("lang", "g", "source")
    pair = found.filter("dense is not null").select("lang", "g", F.posexplode("dense").alias("h", "v")).groupBy("lang", "g", "h").agg(F.sum("v").alias("value")).filter("g <> h")
    pair = pair.join(names.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"]).select("lang", "g", F.lit("pair").alias("part"), "item", "value")
    term = found.filter("dense is null").select("lang", "g", F.lit("term").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "g", "part").orderBy(F.desc("value"), "item")
    ranked = pair.withColumn("rank", F.row_number().over(order)).unionByName(term.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    return ranked.join(names, ["lang", "g"]).select("lang", "source", "part", "item", "value", "rank")
