"""Keyword rules over response text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category, keywords and whether the category alone means high risk.
INFRASTRUCTURE_RULES = [
    ("Road / Transport Corridor", ["road", "highway", "transport"], True),
    ("Waterbody / Canal", ["water", "canal", "river", "reservoir"], True),
    ("Railway Track", ["rail"], False),
    ("Public Built-up Zone", ["built", "settlement"], False),
]


def classify_infrastructure(text: Column, rules=None) -> Column:
    """``struct<detected, has_overlap, risk>``: plain substring rules over the lower-cased text.
    Rules are a parameter: (category, keywords, high risk) triples in output order."""
    rules = rules or INFRASTRUCTURE_RULES
    low = F.lower(text)

    def any_of(words):
        hit = None
        for w in words:
            hit = low.contains(w) if hit is None else hit | low.contains(w)
        return F.coalesce(hit, F.lit(False))

    found = F.array_compact(F.array(*[F.when(any_of(words), F.lit(name)) for name, words, _ in rules]))
    grave = F.array(*[F.lit(name) for name, _, high in rules if high])
    return F.transform(F.array(found), lambda f: F.struct(
        f.alias("detected"), (F.size(f) > 0).alias("has_overlap"),
        F.when(F.arrays_overlap(f, grave), "HIGH").when(F.size(f) > 0, "LOW").otherwise("NONE").alias("risk")))[0]
