"""Exact Jaccard join of documents on word n-grams by token groups.

1. Grouping similar documents. A document's set of n-gram hashes is cut into K ranges of the hash space. Sets that
   are similar enough differ in at most H elements, H from the sizes, so they agree on at least K - H ranges. K is
   chosen so that more ranges agree than the set leaves empty, hence a range that agrees has content. Sets of
   one size class and the next share the cut. The few sets with more empty ranges than planned are cut once more
   with another hash, and again until that holds, so no pair is lost. Documents that agree on a range are
   candidates; their connected components hold every pair that can link.
2. Token-group matrix. In a component equal sets are folded to one, and the sets are dealt into groups by their
   smallest hash. A group stores the union of its tokens and, for each token, its sets.
3. A query set is bounded against a group by its overlap with the union. Only groups whose bound reaches the least
   overlap that the query needs are opened, and the overlaps with all of its sets are counted.
4. Links that span the components, and the number of links, leave the tiles; components of the links give classes.

Sizes are compared in integers: ``den * intersection >= num * union``. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z
lowered; a text shorter than n words is one n-gram of what it has; null texts and texts without words have an empty set and
link with nothing. Rows that repeat an id are one document, whose sets may be several; rows with a null id keep
a null component and link nothing. Copies count as links of each other. An empty table gives an empty result;
columns besides ``doc_id`` and ``text`` are not looked at. Sets are compared by 64-bit hashes of their n-grams."""
from __future__ import annotations

import functools
import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, run_dir, settings
from .common import mix, n_parts, open_dir, pack_planes, pieces, row_key, shingle_hashes, unpack_planes, word_hashes, words
from .components import connected

#: Tokens of a group, so that a group and its union (8 bytes a token, a few times over) fit in a task.
GROUP = 1 << 20
#: Buckets of range hashes for each shuffle partition.
BUCKETS = 8
#: Spark makes a Bloom filter of a join's smaller side whatever the size of the other side's files.
_FILTERED = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
             "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "4g"}
#: Spark's limits on the items and bits of such a filter; beyond them it lets more through.
_MOST_ITEMS, _MOST_BITS = 4_000_000, 1 << 26


def document_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of every text."""
    starts, ends, first = words(data, off)
    h = word_hashes(data, starts, ends, lower=True)
    grams = shingle_hashes(h, n)
    out = []
    for i in range(len(off) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= n:
            out.append(np.unique(grams[a:b - n + 1]))
        elif b > a:
            out.append(shingle_hashes(h[a:b], int(b - a)) + np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@functools.cache
def size_classes(num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last size of each class: sizes that can link lie in one class or in two neighbouring ones."""
    low, high, at = [], [], 1
    while at < 1 << 40:
        low.append(at)
        high.append(max(at, at * den // num))
        at = high[-1] + 1
    return np.array(low), np.array(high)


@functools.cache
def cut_plan(size_class: int, num: int, den: int) -> tuple[int, int]:
    """(ranges, empty ranges allowed) for sets of a class and the one below it."""
    low, high = size_classes(num, den)
    top, least = int(high[size_class]), int(low[max(0, size_class - 1)])
    differ = 2 * top * (den - num) // (den + num)
    best = None
    for spare in range(0, differ + 8):
        k = differ + 1 + spare
        mean = k * math.exp(-least / k) if k > 1 else 0.0
        if mean > 50:  # many empty ranges are close to normal, and their exact sum would be long
            if spare >= mean + 3 * math.sqrt(mean) or spare == differ + 7:
                best = 0.0, k, spare
                break
            continue
        tail, term = 1.0, math.exp(-mean)
        for i in range(spare + 1):
            tail -= term
            term *= mean / (i + 1)
        if best is None or tail < best[0]:
            best = tail, k, spare
        if tail < 0.01:
            break
    return best[1], best[2]


def range_hashes(u: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of the non-empty ranges of a set, tagged by class, cut and range."""
    if not len(u):
        return u
    c = int(np.searchsorted(size_classes(num, den)[0], len(u), side="right")) - 1
    out = []
    for tag in (c, c + 1):
        k, spare = cut_plan(tag, num, den)
        v, turn = u, 0
        while True:
            at = (v >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)
            edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            sums = np.add.reduceat(mix(v + np.uint64(turn)), edge)
            out.append(mix(sums + mix(at[edge] * np.uint64(1 << 20) + np.uint64((tag << 8) + min(turn, 255)))))
            if k - len(edge) <= spare:
                break
            turn += 1
            v = np.sort(mix(u + np.uint64(turn)))
    return np.concatenate(out)


def _flat(batch, n: int):
    """(row, set) of every row of a batch."""
    for i, j, data, off in pieces(batch):
        for k, u in enumerate(document_sets(data, off, n)):
            yield i + k, u


def set_keys(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit name of the set and its smallest hash."""
    def run(batches):
        for b in batches:
            size = np.zeros(b.num_rows, np.int64)
            k1, k2, low = (np.zeros(b.num_rows, np.uint64) for _ in range(3))
            for r, u in _flat(b, n):
                if len(u):
                    size[r], k1[r], k2[r], low[r] = len(u), mix(u).sum(dtype=np.uint64), mix(u + np.uint64(0x5851F42D)).sum(dtype=np.uint64), u[0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), *[pa.array(k.view(np.int64)) for k in (k1, k2, low)]], names=["doc_id", "n_shingles", "k1", "k2", "low"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, low long")


def _runs(h: np.ndarray, ids: np.ndarray):
    """Sorted (hash, id) once each, with the smallest id of each hash's run at every entry."""
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    first = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    return h, ids, first, new


def candidate_edges(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b): documents that agree on a range, as stars around the smallest id of each range hash.

    A task first folds its own rows to one id a hash, so a hash that very many documents share
    reaches the shuffle once a task."""
    spark = docs.sparkSession
    buckets = n_parts(spark) * BUCKETS

    def spread(batches):
        hs, ids, held = [], [], 0
        for b in batches:
            doc = b.column(0).to_numpy(zero_copy_only=False)
            for r, u in _flat(b, n):
                # 48 bits will do: a chance agreement only adds a candidate.
                s = range_hashes(u, num, den) >> np.uint64(16)
                hs.append(s)
                ids.append(np.full(len(s), doc[r], np.int64))
                held += len(s)
                if held > 2_000_000:
                    yield from _emit(hs, ids)
                    hs, ids, held = [], [], 0
        if held:
            yield from _emit(hs, ids)

    def _emit(hs, ids):
        h, i, first, new = _runs(np.concatenate(hs), np.concatenate(ids))
        own = np.unique(np.stack([first[~new], i[~new]], 1), axis=0) if (~new).any() else np.zeros((0, 2), np.int64)
        own = own[own[:, 0] != own[:, 1]]
        h, i = h[new], i[new]
        # Buckets are ranges of the sorted hashes, which are stored as differences.
        cut = np.searchsorted(h, np.array([(k << 48) // buckets for k in range(buckets + 1)], np.uint64))
        ecut = np.linspace(0, len(own), buckets + 1).astype(int)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(buckets), pa.int32()),
            pa.array([pack_planes(np.diff(h[cut[k]:cut[k + 1]], prepend=np.uint64(0))) for k in range(buckets)], pa.binary()),
            pa.array([pack_planes(i[cut[k]:cut[k + 1]]) for k in range(buckets)], pa.binary()),
            pa.array([pack_planes(own[ecut[k]:ecut[k + 1]].reshape(-1)) for k in range(buckets)], pa.binary())], names=["bucket", "h", "i", "e"])

    def gather(key, df):
        h = np.concatenate([np.cumsum(unpack_planes(x, np.uint64), dtype=np.uint64) for x in df["h"]])
        own = np.concatenate([unpack_planes(x, np.int64) for x in df["e"]]).reshape(-1, 2)
        if len(h):
            _, i, first, new = _runs(h, np.concatenate([unpack_planes(x, np.int64) for x in df["i"]]))
            own = np.concatenate([own, np.stack([first[~new], i[~new]], 1)])
        own = np.unique(own[own[:, 0] != own[:, 1]], axis=0)
        return pd.DataFrame({"a": own[:, 0], "b": own[:, 1]})

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = rows.mapInArrow(spread, "bucket int, h binary, i binary, e binary")
    return packed.groupBy("bucket").applyInPandas(gather, "a long, b long").distinct()


def _pack(key, df, folder: str):
    """A group as one row. Those of large components, which meet other groups, go to a file each in the shared folder
    (tokens, then nodes, times and sizes), and the row names it."""
    df = df.sort_values(["node", "tokens"]).drop_duplicates(["node", "tokens"])
    tokens = df["tokens"].tolist()
    sizes = np.array([len(x) // 8 for x in tokens], np.int64)
    columns = [df["node"].to_numpy(np.int64).tobytes(), df["times"].to_numpy(np.int64).tobytes(), sizes.tobytes()]
    row = {"component": [key[0]], "grp": [key[1]], "band": [None], "file": [None], "nodes": columns[:1], "times": columns[1:2], "sizes": columns[2:], "tokens": [None]}
    if pd.isna(df["band"].iloc[0]):
        return pd.DataFrame(row | {"tokens": [b"".join(tokens)]})
    fs, path = open_dir(folder)
    name = uuid.uuid4().hex
    with fs.open_output_stream(f"{path}/{name}.part", compression=None) as out:
        for x in [*tokens, *columns]:
            out.write(x)
    fs.move(f"{path}/{name}.part", f"{path}/{name}")
    return pd.DataFrame(row | {"band": [int(df["band"].iloc[0])], "file": [f"{name}/{len(sizes)}"], "nodes": [None], "times": [None], "sizes": [None]})


#: A link within a small component, or a group's file.
_SETTLED = "a long, b long, links long, component long, grp long, band long, file string"


def _settle(key, df, folder: str, num: int, den: int) -> pd.DataFrame:
    """A group of a small component as the links within it, so that its tokens go no further; another one as its file."""
    row = _pack(key, df, folder).iloc[0]
    if row["file"] is not None:
        return _numbers(pd.DataFrame({"a": [None], "b": [None], "links": [None], "component": [row["component"]], "grp": [row["grp"]], "band": [row["band"]], "file": [row["file"]]}))
    g = _Group(row["nodes"], row["times"], row["sizes"], row["tokens"])
    found = _link_rows(tile_links(g, g, True, num, den))
    return _numbers(found.assign(component=None, grp=None, band=None, file=None))


def _numbers(df: pd.DataFrame) -> pd.DataFrame:
    return df.astype({c: "Int64" if kind == "long" else object for c, kind in (x.split() for x in _SETTLED.split(", "))})


def _load(folder: str, file: str) -> _Group:
    fs, path = open_dir(folder)
    name, n = file.split("/")
    with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
        data = f.read()
    at = len(data) - 24 * int(n)
    return _Group(*(data[at + 8 * int(n) * i:at + 8 * int(n) * (i + 1)] for i in range(3)), memoryview(data)[:at])


class _Group:
    def __init__(self, nodes, times, sizes, tokens):
        self.nodes, self.times, self.sizes = (np.frombuffer(x, np.int64) for x in (nodes, times, sizes))
        flat = np.frombuffer(tokens, np.uint64)
        self.sets = np.split(flat, np.cumsum(self.sizes)[:-1])
        self.flat, self.union = flat, None

    def _index(self) -> None:
        # Only the group that is looked up needs it.
        order = np.argsort(self.flat, kind="stable")
        flat = self.flat[order]
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)[order]
        new = np.concatenate(([True], flat[1:] != flat[:-1]))
        self.union = flat[new]
        self.start = np.append(np.flatnonzero(new), len(flat))

    def overlaps(self, q: np.ndarray, needed: int) -> np.ndarray | None:
        """Overlap with each set of the group; None if the union rules the group out."""
        if self.union is None:
            self._index()
        at = np.searchsorted(self.union, q)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == q]
        if len(at) < needed:
            return None
        a, b = self.start[at], self.start[at + 1]
        n = b - a
        where = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.owner[where], minlength=len(self.sizes))


def tile_links(a: _Group, b: _Group, same: bool, num: int, den: int):
    """Spanning links and weighted link counts of the sets of two groups."""
    root = list(range(len(a.nodes) + (0 if same else len(b.nodes))))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links, count_a, count_b = [], np.zeros(len(a.nodes), np.int64), np.zeros(len(b.nodes), np.int64)
    for i, q in enumerate(a.sets):
        got = b.overlaps(q, -(-num * len(q) // den))
        if got is None:
            continue
        hit = den * got >= num * (len(q) + b.sizes - got)
        if same:
            hit[i] = False
        count_a[i] = b.times[hit].sum()
        count_b[hit] += a.times[i]
        for j in np.flatnonzero(hit).tolist():
            x, y = find(i), find(j if same else len(a.nodes) + j)
            if x != y:
                root[y] = x
                links.append((int(a.nodes[i]), int(b.nodes[j])))
    rows = [(x, y, 0) for x, y in links] + [(int(n), None, int(c)) for n, c in zip(a.nodes, count_a, strict=True) if c]
    return rows if same else rows + [(int(n), None, int(c)) for n, c in zip(b.nodes, count_b, strict=True) if c]


def links(docs: DataFrame, keys: DataFrame, coarse: DataFrame, n: int, num: int, den: int, group: int = GROUP) -> DataFrame:
    """(a, b, links): spanning links (b set) and parts of the link counts (b null) inside the coarse components.

    Folding and dealing need the slim keys only. One text of each different set is then fetched, once."""
    folded = keys.join(coarse.withColumnRenamed("node", "doc_id"), "doc_id").groupBy("component", "k1", "k2", "low", "n_shingles").agg(F.min("doc_id").alias("node"), F.count_distinct("doc_id").alias("times"))
    folded = cut_lineage(folded)
    # A component that is one set (and its copies) has nothing to compare.
    per = folded.groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("t")).filter("c > 1").select("component", (F.col("t") > group).alias("large"))
    # Large components are cut into bands of size; sizes that can link lie in one band or in two neighbouring ones.
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(math.log(den / num) * (1 + 1e-9))).cast("long")
    folded = folded.join(per, "component").withColumn("band", F.when(F.col("large"), band).otherwise(0))
    of = folded.groupBy("component", "band").agg(F.ceil(F.sum("n_shingles") / group).alias("of"))
    parts = folded.groupBy("component", "band", "low").agg(F.ceil(F.sum("n_shingles") / group).alias("split"))
    # Similar sets tend to share their smallest hash; a large band is dealt by it, a large deal by the id too.
    dealt = folded.join(of, ["component", "band"]).join(parts, ["component", "band", "low"]).withColumn("grp", F.xxhash64("band", F.pmod(F.xxhash64("low"), "of"), F.pmod(F.xxhash64("node"), "split")))
    dealt = dealt.select("component", "grp", F.when(F.col("large"), F.col("band")).alias("band"), "times", "k1", "k2", F.col("node").alias("doc_id"))
    arrow = pa.schema([(c, pa.int64()) for c in ("component", "grp", "band", "times", "node")] + [("tokens", pa.binary())])

    def tokens(batches):
        for b in batches:
            text = pa.RecordBatch.from_arrays([b.column(5)], names=["text"])
            k1, k2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (6, 7))
            rows, out, size = [], [], 0

            def batch(rows, out, b=b):
                at = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([b.column(i).take(at) for i in range(5)] + [pa.array(out, pa.binary())], schema=arrow)

            for r, u in _flat(text, n):
                # An id may come with several texts; the one that the key names is meant.
                if int(mix(u).sum(dtype=np.uint64).view(np.int64)) == k1[r] and int(mix(u + np.uint64(0x5851F42D)).sum(dtype=np.uint64).view(np.int64)) == k2[r]:
                    rows.append(r)
                    out.append(u.tobytes())
                    size += u.nbytes
                if size > 8 << 20:
                    yield batch(rows, out)
                    rows, out, size = [], [], 0
            yield batch(rows, out)

    # Only texts of the dealt ids are wanted; a filter that Spark makes of the ids keeps most others out of the shuffle.
    dealt = cut_lineage(dealt)
    items = max(10_000, dealt.count())
    filtered = _FILTERED | {"spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": str(min(items, _MOST_ITEMS)), "spark.sql.optimizer.runtime.bloomFilter.numBits": str(min(10 * items, _MOST_BITS))}
    dealt = dealt.filter("times > 0")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(dealt, "doc_id")
    sets = texts.select("component", "grp", "band", "times", "doc_id", "text", "k1", "k2").mapInArrow(tokens, "component long, grp long, band long, times long, node long, tokens binary")
    folder = run_dir(docs.sparkSession, "groups")
    fs, path = open_dir(folder)
    fs.create_dir(path)
    with settings(docs.sparkSession, filtered):
        packed = cut_lineage(sets.groupBy("component", "grp").applyInPandas(lambda key, df: _settle(key, df, folder, num, den), _SETTLED))

    def cross(batches):
        # Pairs come sorted, so that the left group is read once for its run of partners.
        held = None, None
        for df in batches:
            for r in df.itertuples(index=False):
                if held[0] != r.file:
                    held = r.file, _load(folder, r.file)
                yield _link_rows(tile_links(held[1], held[1] if r.file == r.file2 else _load(folder, r.file2), r.file == r.file2, num, den))

    schema = "a long, b long, links long"
    alone = packed.filter("file is null").select("a", "b", "links")
    # A group meets itself and the others of its band and the next by numbers and names alone; its tokens are read from its file.
    many = packed.filter("file is not null").select("component", "grp", "band", "file")
    above = many.select("component", F.col("grp").alias("grp2"), F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), F.col("band").alias("band2"), F.col("file").alias("file2"))
    pairs = many.join(above, ["component", "band"]).filter((F.col("band2") > F.col("band")) | (F.col("grp") <= F.col("grp2"))).select("file", "file2")
    tiles = pairs.repartition(n_parts(docs.sparkSession), "file", "file2").sortWithinPartitions("file", "file2")
    return alone.union(tiles.mapInPandas(cross, schema))


def _link_rows(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["a", "b", "links"]).astype({"a": "Int64", "b": "Int64", "links": "Int64"})


def classes(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row."""
    keys = cut_lineage(set_keys(docs, n))
    coarse = cut_lineage(connected(candidate_edges(docs, n, num, den)))
    found = cut_lineage(links(docs, keys, coarse, n, num, den, group))
    nodes = keys.filter("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("node"), F.count_distinct("doc_id").alias("times"))
    tied = connected(found.filter("b is not null").select("a", "b").union(_same_id(keys)))
    counts = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    out = keys.join(nodes, ["n_shingles", "k1", "k2"], "left").join(tied, "node", "left").join(counts, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    n_links = F.when(F.col("doc_id").isNull() | F.col("node").isNull(), 0).otherwise(F.col("times") - 1 + F.coalesce("others", F.lit(0)))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), n_links.cast("long").alias("n_links"))


def _same_id(keys: DataFrame) -> DataFrame:
    """An id that comes with several sets ties the nodes of those sets."""
    many = keys.filter("doc_id is not null").groupBy("doc_id").agg(F.count_distinct("k1", "k2").alias("c")).filter("c > 1").select("doc_id")
    node = keys.filter("n_shingles > 0").groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("node"))
    rows = keys.join(many, "doc_id").join(node, ["n_shingles", "k1", "k2"])
    return rows.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each class: the one whose id names it. Rows without an id stay.

    Of rows that repeat the kept id one stays, the first by a hash of its text. The choice is made on ids and hashes;
    the texts are shuffled once, and those of repeated ids only if there are any."""
    kept = classes(docs, n, num, den).filter("doc_id = component_id").select("doc_id").distinct()
    rk = row_key(F.col("doc_id"), F.col("text"))
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), rk.alias("rk"))
    chosen = cut_lineage(rows.join(kept, "doc_id").groupBy("doc_id").agg(F.min("rk").alias("__rk"), F.count(F.lit(1)).alias("c")))
    one, many = chosen.filter("c = 1").select(F.col("doc_id").alias("__id")), cut_lineage(chosen.filter("c > 1").select("__rk"))
    pick = [F.col(f"`{c}`") for c in docs.columns]
    once = docs.join(one, F.col("doc_id") == F.col("__id"), "left_semi")
    out = once.select(*pick).union(docs.filter("doc_id is null").select(*pick))
    if many.isEmpty():
        return out
    again = docs.withColumn("__k", rk).join(many, F.col("__k") == F.col("__rk")).dropDuplicates(["__k"])
    return out.union(again.select(*pick))
