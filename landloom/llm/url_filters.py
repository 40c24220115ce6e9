"""URL filters with dated lists: entries become validity intervals, captures are judged as of their fetch time.

A list entry says that from a moment on a pattern is on a list (action ``add``) or off it (``remove``). Per list
and pattern the entries become intervals that end where the next entry begins; a capture matches if one of its
keys has an ``add`` interval holding its fetch time (start included, end excluded). Keys of a URL are its host,
every parent domain of two labels and more, and the host with each leading part of the path, so a pattern is a
domain (with its subdomains) or a host with a path prefix; the case of hosts does not count, that of paths does. Of entries of one list and pattern at the same moment
``remove`` wins; repeated entries count once.

A null url, a url without host, a null fetch time: no match. Null patterns, dates or actions are no entries.
Rows of captures stay as they are, repeated ones included; the columns added are ``matched_lists`` and
``blocked``. Empty lists block nothing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or trailing dot; empty if there is none."""
    h = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.rtrim(F.lower(h), F.lit("."))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def url_keys(url: Column) -> Column:
    """The patterns that would match a URL: as many as its host has labels and its path has parts."""
    labels = F.split(host_of(url), r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    prefixes = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: i > 0), lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(host_of(url) != "", F.array_distinct(F.concat(domains, prefixes)))


def validity(entries: DataFrame) -> DataFrame:
    """(list_name, pattern, valid_from, valid_to) from (list_name, pattern, action, since); an open end is null."""
    e = entries.filter("list_name is not null and pattern is not null and since is not null and action in ('add', 'remove')")
    # Hosts have no case, paths do.
    host = F.substring_index("pattern", "/", 1)
    e = e.withColumn("pattern", F.concat(F.lower(host), F.substring(F.col("pattern"), F.length(host) + 1, F.length("pattern"))))
    e = e.groupBy("list_name", "pattern", "since").agg(F.max("action").alias("action"))  # 'remove' sorts last
    w = Window.partitionBy("list_name", "pattern").orderBy("since")
    return (e.withColumn("valid_to", F.lead("since").over(w)).filter("action = 'add'")
            .select("list_name", "pattern", F.col("since").alias("valid_from"), "valid_to"))


def apply_lists(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """``captures`` with ``matched_lists`` (sorted names) and ``blocked``.

    Captures are first reduced to distinct (url, fetch time), so a page fetched by thousands of rows is judged
    once; a popular host is a join key with few intervals, whose capture side Spark can split."""
    seen = captures.select(F.col(url).alias("__u"), F.col(fetched).alias("__t")).filter("__u is not null and __t is not null").distinct()
    keyed = seen.withColumn("pattern", F.explode(url_keys(F.col("__u"))))
    hit = keyed.join(validity(entries), "pattern").filter((F.col("valid_from") <= F.col("__t")) & (F.col("valid_to").isNull() | (F.col("__t") < F.col("valid_to"))))
    per = hit.groupBy("__u", "__t").agg(F.array_join(F.array_sort(F.collect_set("list_name")), ",").alias("__l"))
    names = [F.col(f"c.`{c}`") for c in captures.columns if c not in ("matched_lists", "blocked")]
    joined = captures.alias("c").join(per.alias("h"), (F.col(f"c.{url}") == F.col("h.__u")) & (F.col(f"c.{fetched}") == F.col("h.__t")), "left")
    return joined.select(*names, F.coalesce("__l", F.lit("")).alias("matched_lists"), F.col("__l").isNotNull().alias("blocked"))
