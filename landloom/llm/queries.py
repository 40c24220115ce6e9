"""One query per operator, over whole tables."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import ann, bpe, divergence, jaccard, mixing, passages, pii, quality, suffix_dedup, toxicity, url_filters, vector_codes, warc
from .common import table
from .registry import query

#: Path of the vocabulary file, on every node.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT"


@query("op1_warc_dictionary", """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN p.page_id > f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN p.page_id > f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100""")
def op1(spark, d):
    archives = warc.write_archives(table(spark, d, "pages"))
    return warc.read_archives(archives, payload=False).drop("url")


@query("op7_mix_sources", f"""
WITH d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, {_SIZE} AS size, md5(coalesce(doc_id::VARCHAR, '')) AS tag FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS w, 3e0 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, sum(source_size) OVER ()::DOUBLE AS total FROM w),
o AS (SELECT *, sum(CASE WHEN cap < w * level THEN cap ELSE 0e0 END) OVER () AS used, sum(CASE WHEN cap < w * level THEN 0e0 ELSE w END) OVER () AS open FROM l),
t AS (SELECT k, source_size, CASE WHEN cap < w * level THEN cap ELSE least(w * ((total - used) / open), cap) END AS target FROM o),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0e0 END AS share, row_number() OVER (PARTITION BY d.k ORDER BY d.size, d.tag) - 1 AS pos,
 ('0x' || substr(md5(d.k), 1, 8))::BIGINT::DOUBLE / 4294967296e0 AS start FROM d JOIN t ON d.k = t.k)
SELECT doc_id, source, size, source_size, target, size * (floor(share) + floor((share - floor(share)) * (pos + 1) + start) - floor((share - floor(share)) * pos + start))::BIGINT AS taken FROM r""")
def op7(spark, d):
    c = mixing.copies(table(spark, d, "documents"))
    return c.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("n")).alias("taken"))


# Dated entries on the hosts of the pages: every third host by its hash goes on a list, some come off it and
# return, some only by a path. A capture's time follows from its id.
_EPOCH = 1704067200
_DAY = 86400


def _entries(pages):
    host = url_filters.host_of(F.col("url"))
    h = pages.select(host.alias("host"), F.regexp_extract(url_filters.path_of(F.col("url")), "^/([^/]+)", 1).alias("part")).filter("host <> ''").distinct()
    h = h.withColumn("n", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long")).filter("n % 3 = 0")
    name = F.when(F.col("n") % 2 == 0, "adult").otherwise("malware")
    by_path = (F.col("n") % 5 == 0) & (F.col("part") != "")
    pattern = F.when(by_path, F.concat("host", F.lit("/"), "part")).when(F.col("n") % 7 == 0, F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)).otherwise(F.col("host"))
    at = lambda days: F.lit(_EPOCH) + F.lit(_DAY) * days
    first = F.col("n") % 200
    dated = F.array(F.struct(at(first).alias("since"), F.lit("add").alias("action")),
                    F.struct(at(first + 60).alias("since"), F.lit("remove").alias("action")),
                    F.struct(F.when(F.col("n") % 4 == 0, at(first + 150)).alias("since"), F.lit("add").alias("action")))
    return h.select(name.alias("list_name"), pattern.alias("pattern"), F.inline(dated)).filter("since is not null and pattern <> ''")


@query("op8_url_temporal_lists", r"""
WITH p AS (SELECT page_id, url, 1704067200 + 86400 * (page_id % 365) AS t, rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '.') AS host, regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
h AS (SELECT DISTINCT host, regexp_extract(path, '^/([^/]+)', 1) AS part, ('0x' || substr(md5(host), 1, 6))::BIGINT AS n FROM p WHERE host <> ''),
b AS (SELECT CASE WHEN n % 2 = 0 THEN 'adult' ELSE 'malware' END AS list_name, n % 200 AS first, n, CASE WHEN n % 5 = 0 AND part <> '' THEN host || '/' || part WHEN n % 7 = 0 THEN regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) ELSE host END AS pattern FROM h WHERE n % 3 = 0),
e AS (SELECT list_name, pattern, 1704067200 + 86400 * first AS since, 'add' AS action FROM b UNION ALL SELECT list_name, pattern, 1704067200 + 86400 * (first + 60), 'remove' FROM b UNION ALL SELECT list_name, pattern, 1704067200 + 86400 * (first + 150), 'add' FROM b WHERE n % 4 = 0),
g AS (SELECT list_name, pattern, since, max(action) AS action FROM e WHERE pattern <> '' GROUP BY ALL),
v AS (SELECT list_name, lower(pattern) AS pattern, since AS valid_from, lead(since) OVER (PARTITION BY list_name, pattern ORDER BY since) AS valid_to, action FROM g),
k AS (SELECT DISTINCT page_id, t, host, unnest(list_concat(list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda i: array_to_string(list_slice(string_split(host, '.'), i, 99), '.')), list_transform(range(1, len(list_filter(string_split(path, '/'), lambda x: x <> '')) + 1), lambda i: host || '/' || array_to_string(list_slice(list_filter(string_split(path, '/'), lambda x: x <> ''), 1, i), '/')))) AS pattern FROM p WHERE host <> ''),
m AS (SELECT k.page_id, k.t, array_to_string(list_sort(list(DISTINCT v.list_name)), ',') AS l FROM k JOIN v ON k.pattern = v.pattern AND v.action = 'add' AND v.valid_from <= k.t AND (v.valid_to IS NULL OR k.t < v.valid_to) GROUP BY 1, 2)
SELECT p.page_id, p.t::BIGINT AS fetched_at, coalesce(m.l, '') AS matched_lists, m.l IS NOT NULL AS blocked FROM p LEFT JOIN m ON p.page_id = m.page_id""")
def op8(spark, d):
    pages = table(spark, d, "pages")
    captures = pages.select("page_id", "url", (F.lit(_EPOCH) + F.lit(_DAY) * (F.col("page_id") % 365)).cast("long").alias("fetched_at"))
    return url_filters.apply_lists(captures, _entries(pages)).select("page_id", "fetched_at", "matched_lists", "blocked")


@query("op10_block_nearest", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda x, y: x + y)) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op10(spark, d):
    return ann.nearest(table(spark, d, "embeddings"))


@query("op2_ngram_jaccard_join", """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
t AS (SELECT doc_id, unnest(g) AS t FROM s),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
c AS (SELECT * FROM (WITH RECURSIVE r(d, m) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.y, r.m FROM r JOIN e ON r.d = e.x WHERE r.m < e.y) SELECT d, min(m) AS component_id FROM r GROUP BY d))
SELECT n.doc_id, n.n AS n_shingles, c.component_id, (SELECT count(*) FROM e WHERE e.x = n.doc_id)::BIGINT AS n_links FROM n JOIN c ON c.d = n.doc_id""")
def op2(spark, d):
    return jaccard.classes(table(spark, d, "documents"), n=4, num=85, den=100)


@query("op4_bpe_prefix_dp")
def op4(spark, d):
    return bpe.digests(table(spark, d, "documents"), TOKENIZER)


@query("op3_ngram_perplexity")
def op3(spark, d):
    return quality.judge(table(spark, d, "documents")).drop("rk")


@query("op5_pii_boosting")
def op5(spark, d):
    return pii.report(table(spark, d, "documents"))


@query("op6_suffix_dedup")
def op6(spark, d):
    r = suffix_dedup.dedup(table(spark, d, "documents"), length=200)
    return r.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_compact_windows")
def op9(spark, d):
    return passages.repeats(table(spark, d, "documents"), least_words=50, similarity=0.8)


@query("op11_source_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*)::BIGINT AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::BIGINT AS total FROM c GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS n FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
f AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT f.lang, f.source, f.term, f.n, 1 + (1000000000 * (f.n + 2)) // (sum(f.n) OVER (PARTITION BY f.lang, f.source)::BIGINT + 2 * v.v) AS p, 1 + (1000000000 * (f.total + 2)) // (v.n + 2 * v.v) AS q FROM f JOIN v ON f.lang = v.lang),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
s AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM s WHERE part = 'pair' OR rank <= 10""")
def op11(spark, d):
    return divergence.audit(table(spark, d, "documents"))


@query("op12_char_ngram_toxicity")
def op12(spark, d):
    return toxicity.classify(table(spark, d, "documents"), table(spark, d, "labels"))


def _rounds() -> str:
    """Six rounds of assigning and moving, and the last assignment, spelt out."""
    near = "SELECT p.vec_id, p.r, p.label, p.part, min({{'d': list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': c.entry}}) AS near, any_value(p.x) AS x FROM p JOIN c{0} c ON p.part = c.part GROUP BY 1, 2, 3, 4"
    steps = []
    for i in range(vector_codes.ROUNDS):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(i)})")
        steps.append(f"s{i} AS (SELECT part, near.e AS entry, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS y FROM a{i})")
        steps.append(f"m{i} AS (SELECT part, entry, list(m ORDER BY i) AS x FROM (SELECT part, entry, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (SELECT part, entry, i, sum(y)::BIGINT AS s, count(*) AS n FROM s{i} GROUP BY ALL)) GROUP BY ALL)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.part = c.part AND m.entry = c.entry)")
    return ",\n".join([*steps, f"b AS ({near.format(vector_codes.ROUNDS)})"])


@query("op13_product_codes", f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, r, label, u.part, x[u.part * (len(x) // 8) + 1:(u.part + 1) * (len(x) // 8)] AS x FROM k, (SELECT unnest(range(0, 8)) AS part) u),
c0 AS (SELECT part, r - 1 AS entry, x FROM p WHERE r <= 16),
{_rounds()},
w AS (SELECT vec_id, r, label, string_agg(printf('%02x', near.e::INTEGER), '' ORDER BY part) AS code, sum(near.d)::BIGINT AS error FROM b GROUP BY ALL),
h AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS y FROM c{vector_codes.ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h.codebooks_sha256 FROM w, h""")
def op13(spark, d):
    return vector_codes.compress(table(spark, d, "embeddings"))
