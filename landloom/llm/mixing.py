"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target number of words. Its documents, in order of size, expect target / size copies each;
the running sum of the expected copies plus one offset per source is followed, and a document is emitted once
for each whole number it crosses. Ordering by size makes the words taken differ from the target by about the
largest document at most.

A null text has size 0; a null source is a source of its own, last in order. Repeated rows are documents of
their own. An empty table gives an empty result. A source without words has target 0. Columns besides
``doc_id``, ``text`` and ``source`` are not looked at and come through ``mix`` unchanged."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WORD, row_key

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more than so many times over.
MAX_COPIES = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(source_key, source_size, target) from (source_key, size); one row per source from here on.

    Sources whose fair share lies above ``most`` times their size stop there. In order of size per weight they
    are the first ones, so one pass of running sums finds where the stopping ends, and with it the level that
    all others share."""
    per = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    first = Window.orderBy("source_key")
    place = (F.row_number().over(first) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int") + 1)
    per = per.withColumn("w", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "source_key")
    past = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    per = (per.withColumn("total", F.sum("source_size").over(whole).cast("double"))
           .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(past), F.lit(0.0))) / F.sum("w").over(rest))
           .withColumn("full", F.col("cap") < F.col("w") * F.col("level")))
    per = (per.withColumn("used", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole))
           .withColumn("open", F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0.0)).over(whole)))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * ((F.col("total") - F.col("used")) / F.col("open")))
    return per.select("source_key", "source_size", F.coalesce(F.least(target, "cap"), F.lit(0.0)).alias("target"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id"), F.col("source"),
        # Code point order with nulls last: a leading 0 or 1.
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")).alias("source_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("tag"),
        row_key(F.col("doc_id"), F.col("text")).alias("rk"))


def copies(docs: DataFrame, weights=WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(doc_id, source, rk, size, source_size, target, n): how often each row is taken.

    The place of a row within its source is the rows of smaller sizes, plus the rows of its size in earlier
    blocks of the id's hash, plus its place in its block: no window ever holds more than one block."""
    # Counting words is the dear part; the slim table of sizes is read three times.
    rows = cut_lineage(_keyed(docs).withColumn("block", F.substring("tag", 1, 2)))
    per_block = rows.groupBy("source_key", "size", "block").agg(F.count(F.lit(1)).alias("c"))
    in_size = Window.partitionBy("source_key", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.withColumn("before_block", F.coalesce(F.sum("c").over(in_size), F.lit(0)))
    per_size = per_block.groupBy("source_key", "size").agg(F.sum("c").alias("c"))
    in_source = Window.partitionBy("source_key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    per_size = per_size.withColumn("before_size", F.coalesce(F.sum("c").over(in_source), F.lit(0)))
    sources = source_targets(per_size.select("source_key", (F.col("size") * F.col("c")).alias("size")), weights, most)
    bases = (per_block.drop("c").join(per_size.drop("c"), ["source_key", "size"]).join(sources, "source_key")
             .select("source_key", "size", "block", (F.col("before_size") + F.col("before_block")).alias("base"), "source_size", "target"))
    in_block = Window.partitionBy("source_key", "size", "block").orderBy("tag", "rk")
    at = F.col("base") + F.row_number().over(in_block) - 1
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = F.conv(F.substring(F.md5("source_key"), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    out = rows.join(bases, ["source_key", "size", "block"]).withColumn("at", at).withColumn("share", share).withColumn("start", start)
    part = F.col("share") - F.floor("share")
    n = F.floor("share") + F.floor(part * (F.col("at") + 1) + F.col("start")) - F.floor(part * F.col("at") + F.col("start"))
    return out.select("doc_id", "source", "rk", "size", "source_size", "target", n.cast("long").alias("n"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """The mixture: every row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    taken = (copies(docs, weights, most).groupBy("rk").agg(F.sum("n").alias("__n"), F.count(F.lit(1)).alias("__rows"))
             .filter("__n > 0").withColumnRenamed("rk", "__rk"))
    # Equal rows share what they take; the remainder goes with the first of them.
    keyed = docs.withColumn("__rk", row_key(F.col("doc_id"), F.col("text")))
    if not docs.columns or "doc_id" not in docs.columns:
        raise ValueError("documents need a doc_id")
    once = taken.filter("__rows = 1").select("__rk", "__n")
    more = taken.filter("__rows > 1")
    single = keyed.join(once, "__rk")
    nth = F.row_number().over(Window.partitionBy("__rk").orderBy("__rk"))
    multi = (keyed.join(more, "__rk").withColumn("__i", nth)
             .withColumn("__n", F.floor(F.col("__n") / F.col("__rows")) + F.when(F.col("__i") <= F.col("__n") % F.col("__rows"), 1).otherwise(0))
             .drop("__rows", "__i"))
    both = single.unionByName(multi).filter("__n > 0")
    return both.withColumn("__e", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
