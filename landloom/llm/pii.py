"""Personal data by candidate gradient boosting, in DataFrame operations only.

Generators, one pattern a kind, propose spans freely and may overlap: the four base kinds and looser forms of
mail addresses, phone numbers, identity numbers and credentials. A base span that passes its check is always
personal data. Boosted trees score every other candidate by its format (lengths, shares of digits and letters, separators)
and its context (the characters and key words around it). They learn from weak labels: a candidate is positive
if the check of its kind holds (Luhn, octets, digit counts, IBAN remainder, a mixed alphabet), which the
features do not see. One half of a bounded sample of candidates fits the trees, all of the other half
sets, per kind, the lowest threshold at which the labels' precision reaches ``PRECISION``; a kind without such a
threshold adds nothing.

Positions are code points. A null or empty text has no spans. Rows that repeat id and text share their spans; a
repeated id with another text has its own. An empty table gives an empty result; other columns stay as they are
in ``redact``. Patterns take each run of letters once, so a very long text costs time in proportion."""
from __future__ import annotations

import functools

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import row_key

#: Candidates the trees are fitted on, at most about; and trees, depth.
SAMPLE_ROWS = 20_000
TREES, DEPTH = 8, 3
#: Share of right labels that a kind's threshold must reach on candidates kept from fitting, and how many it must rest on.
PRECISION, LEAST = 0.98, 50

#: The base kinds in order, written so that no text is scanned twice from the same run: what precedes a start
#: cannot belong to the run, unless the last match ended there.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Looser forms; each becomes a span only if its score reaches the kind's threshold.
LOOSE = {
    "email_like": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]{1,63}+ ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,24}+",
    "phone_like": r"(?<![0-9+.(-])(?:\([0-9]{2,4}\) ?|[0-9]{3,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "credential": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|(?i:password|passwd|secret|token|api_?key) ?[=:] ?\"?[A-Za-z0-9_/+-]{8,128}+)",
}
KINDS = [*BASE, *LOOSE]


@functools.cache
def _cue_words() -> list[str]:
    return ["mail", "phone", "tel", "call", "fax", "card", "visa", "ip", "host", "server", "iban", "account", "password", "token", "key", "ssn"]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """Whether the digits pass; every second one from the right counts double."""
    n = F.length(d)
    at = lambda i: F.substring(d, (n - i + 1).cast("int"), F.lit(1)).cast("int")
    part = lambda i: F.when(i % 2 == 1, at(i)).otherwise(at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + part(i)) % 10 == 0


def _octets(c: Column) -> Column:
    plain = F.transform(F.split(c, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
    return F.forall(plain, lambda x: (F.length(x) <= 3) & (x.cast("int") <= 255))


def _iban(c: Column) -> Column:
    """Whether the number leaves 1 on division by 97, letters counting from 10."""
    s = F.upper(F.replace(c, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    values = F.transform(F.split(turned, ""), lambda x: F.when(x.rlike("[A-Z]"), F.ascii(x) - 55).otherwise(F.coalesce(x.try_cast("int"), F.lit(0))))
    return F.aggregate(values, F.lit(0), lambda a, v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97)) == 1


def candidates(docs: DataFrame) -> DataFrame:
    """rk, kind, start, end, match, before, after: every generator's spans.

    A text is split by each pattern it has at all; the running lengths of what lies between and of the matches
    give the places. Only the matches and a little of their surroundings are shuffled, not the texts."""
    d = docs.select(F.coalesce("text", F.lit("")).alias("text"), row_key(F.col("doc_id"), F.col("text")).alias("rk"))
    per_kind = [F.when(F.col("text").rlike(rx), F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(rx), F.lit(0)).alias("m"), F.split("text", rx, -1).alias("p"))) for k, rx in (BASE | LOOSE).items()]
    found = d.select("rk", F.explode(F.filter(F.array(*per_kind), lambda x: x.isNotNull())).alias("f")).select("rk", "f.kind", "f.m", "f.p")
    cut = F.transform("m", lambda m, i: F.struct(m.alias("match"), F.length(F.element_at("p", i + 1)).alias("gap"), F.substring(F.element_at("p", i + 1), -24, 24).alias("before"), F.substring(F.element_at("p", i + 2), 1, 12).alias("after")))
    rows = found.select("rk", "kind", F.posexplode(cut).alias("pos", "x")).select("rk", "kind", "pos", "x.*")
    # Equal rows of the table propose the same spans, once.
    rows = rows.repartition("rk").dropDuplicates(["rk", "kind", "pos"])
    w = Window.partitionBy("rk", "kind").orderBy("pos")
    end = F.sum(F.col("gap") + F.length("match")).over(w)
    return rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("match")).drop("gap", "pos")


def _checked(c: DataFrame) -> DataFrame:
    """Candidates with ``ok``: whether the check of the kind holds."""
    m, d = F.col("match"), _digits(F.col("match"))
    n = F.length(d)
    mixed = F.regexp_replace(m, r"^(?i:password|passwd|secret|token|api_?key) ?[=:] ?\"?", "")
    ok = (F.when(F.col("kind") == "email", True)
          .when(F.col("kind") == "ip", _octets(m))
          .when(F.col("kind") == "card", F.when(n.between(12, 19), _luhn(d)).otherwise(False))
          .when(F.col("kind") == "phone", n.between(9, 15))
          .when(F.col("kind") == "email_like", ~m.contains("@"))
          .when(F.col("kind") == "phone_like", n.between(9, 12))
          .when(F.col("kind") == "iban", _iban(m))
          .otherwise(mixed.rlike("[0-9]") & mixed.rlike("[A-Za-z]")))
    return c.withColumn("ok", ok)


def _featured(c: DataFrame) -> tuple[DataFrame, list[str]]:
    m, b, a = F.col("match"), F.col("before"), F.col("after")
    n = F.length(m)
    share = lambda rx: F.length(F.regexp_replace(m, rx, "")) / n
    f = {"f_len": n, "f_digits": share("[^0-9]"), "f_letters": share("[^A-Za-z]"), "f_upper": share("[^A-Z]"), "f_space": share("[^ ]"), "f_dash": share("[^-]"), "f_dot": share(r"[^.]"), "f_paren": share(r"[^()]"),
         "f_groups": F.size(F.split(m, r"[ .()-]+")), "f_first_digit": m.rlike("^[0-9]"), "f_plus": m.rlike(r"^\+"), "f_at": m.contains("@"),
         "f_glued_before": b.rlike(r"[A-Za-z0-9._=\"+-]$"), "f_glued_after": a.rlike(r"^[A-Za-z0-9_@=-]"), "f_line_start": (b == "") | b.endswith("\n")}
    f |= {f"f_cue_{w}": F.lower(b).contains(w) for w in _cue_words()}
    f |= {f"f_is_{k}": F.col("kind") == k for k in KINDS}
    return c.withColumns({k: v.cast("double") for k, v in f.items()}), list(f)


def _scored(c: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Candidates with ``score``, and the kinds' thresholds. Without both labels nothing is learnt and none are given."""
    n, good = c.agg(F.count(F.lit(1)), F.sum(F.col("ok").cast("int"))).first()
    if not n or not good or good == n:
        return c.withColumn("score", F.lit(0.0)), {}
    f, names = _featured(c)
    f = VectorAssembler(inputCols=names, outputCol="v").transform(f).withColumn("label", F.col("ok").cast("double"))
    place = F.pmod(F.xxhash64("match", "before", "after", "kind"), F.lit(1 << 20))
    fit, rest = f.filter(place % 2 == 0), f.filter(place % 2 == 1)
    sample = fit.filter(place < F.lit(int((1 << 20) * min(1.0, 2 * SAMPLE_ROWS / n)))).select("v", "label")
    if sample.select("label").distinct().count() < 2:
        return c.withColumn("score", F.lit(0.0)), {}
    model = GBTClassifier(featuresCol="v", maxIter=TREES, maxDepth=DEPTH, maxBins=16, seed=7).fit(sample)
    scored = lambda x: model.transform(x).withColumn("score", F.round(vector_to_array("probability")[1], 2))
    at = scored(rest).groupBy("kind", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).collect()  # 101 scores a kind at most
    limits: dict[str, float] = {}
    for kind in KINDS:
        seen = right = 0
        for r in sorted((r for r in at if r["kind"] == kind), key=lambda r: -r["score"]):
            seen, right = seen + r["n"], right + r["good"]
            if seen >= LEAST and right >= PRECISION * seen:
                limits[kind] = r["score"]
    return scored(f).select(*c.columns, "score"), limits


def spans(docs: DataFrame) -> DataFrame:
    """rk, kind, start, end, base: all spans, base ones and those the trees add."""
    c = cut_lineage(_checked(candidates(docs)))
    scored, limits = _scored(c)
    limit = F.coalesce(F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")], F.lit(2.0)) if limits else F.lit(2.0)
    base = F.col("kind").isin(*BASE) & F.col("ok")
    return scored.filter(base | (F.col("score") >= limit)).select("rk", "kind", "start", "end", base.alias("base"))


def _named(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, their digest and all spans."""
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    s = spans(docs).groupBy("rk").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in BASE],
        F.array_sort(F.collect_list(F.struct("start", order.alias("o"), "end", "kind", "base"))).alias("s"))  # one document's spans
    d = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("rk")).join(s, "rk", "left")
    none = F.coalesce("s", F.array().cast("array<struct<start:bigint,o:bigint,end:bigint,kind:string,base:boolean>>"))
    return d.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
                    F.sha2(_named(F.filter(none, lambda x: x["base"])), 256).alias("base_sha256"), _named(none).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every run of spans replaced by its first kind in angle brackets; ``n_chars``, if there, follows."""
    w = Window.partitionBy("rk").orderBy("start", "end", "kind")
    seen = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans(docs).withColumn("new", (seen.isNull() | (F.col("start") >= seen)).cast("int")).withColumn("run", F.sum("new").over(w))
    runs = runs.groupBy("rk", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "end", "kind"))["kind"].alias("kind"))
    per = runs.groupBy("rk").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("__s")).withColumnRenamed("rk", "__rk")
    d = docs.withColumn("__rk", row_key(F.col("doc_id"), F.col("text"))).join(per, "__rk", "left")
    last = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at("__s", i)["end"]).cast("int")
    parts = F.transform("__s", lambda x, i: F.concat(F.substring(F.col("text"), last(i) + 1, x["start"].cast("int") - last(i)), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
    rest = F.substring(F.col("text"), F.element_at("__s", -1)["end"].cast("int") + 1, F.length("text"))
    out = d.withColumn("text", F.when(F.col("__s").isNull(), F.col("text")).otherwise(F.concat(F.array_join(parts, ""), rest)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__s").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
