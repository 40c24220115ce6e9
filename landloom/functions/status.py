"""Status codes, labels, badges and display colours."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five life-cycle codes in order.
LIFE_CYCLE = ["DRAFT", "ALIGNED_DRAFT", "TOPOLOGY_CLEANED", "ULPIN_ASSIGNED", "PUBLISHED"]

# Earlier lower-case codes and their successors.
LEGACY_STATUS = {
    "raw": "DRAFT",
    "aligned": "ALIGNED_DRAFT",
    "cleaned": "TOPOLOGY_CLEANED",
    "ulpin_assigned": "ULPIN_ASSIGNED",
}

# Display label of each upper-cased status.
STATUS_LABEL = {
    "DRAFT": "Draft",
    "RAW": "Draft",
    "ALIGNED_DRAFT": "Aligned Candidate",
    "ALIGNED": "Aligned Candidate",
    "TOPOLOGY_CLEANED": "Topology Cleaned",
    "CLEANED": "Topology Cleaned",
    "ULPIN_ASSIGNED": "Bhu-Aadhaar Assigned",
    "PUBLISHED": "Legally Published",
}

# What each confidence band is written out as.
BAND_STATUS = {"GREEN": "VERIFIED_CLEAR", "AMBER": "OCCLUDED", "RED": "GOVT_ILLEGAL"}
BAND_COLOUR = {"RED": "#EF4444", "AMBER": "#F59E0B", "GREEN": "#10B981"}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    expr = None
    for k, v in table.items():
        expr = F.when(key == k, v) if expr is None else expr.when(key == k, v)
    return expr


def normalize_status(status: Column) -> Column:
    return F.coalesce(_lookup(status, LEGACY_STATUS), status)


def status_label(status: Column) -> Column:
    return F.when(status.isNull() | (status == ""), "Draft").otherwise(
        F.coalesce(_lookup(F.upper(status), STATUS_LABEL), status))


def status_badge(alignment_status: Column, colour: Column, band: Column, situation: Column) -> Column:
    """Badge text; a null column never matches."""
    def yes(c):
        return F.coalesce(c, F.lit(False))

    red = yes(colour == "red") | yes(band == "RED") | yes(situation.contains("GOVT"))
    amber = yes(colour.isin("amber", "orange")) | yes(band == "AMBER") | yes(situation.contains("OCCLUDED"))
    return (F.when(yes(alignment_status == "PENDING_APPROVAL"), "Submitted")
            .when(red, "GOVT_ILLEGAL").when(amber, "OCCLUDED").otherwise("VERIFIED_CLEAR"))


def aligned_status(band: Column) -> Column:
    return F.when(band == "GREEN", BAND_STATUS["GREEN"]).when(band == "AMBER", BAND_STATUS["AMBER"]).otherwise(BAND_STATUS["RED"])


def band_colour(band: Column) -> Column:
    return F.when(band == "RED", BAND_COLOUR["RED"]).when(band == "AMBER", BAND_COLOUR["AMBER"]).otherwise(BAND_COLOUR["GREEN"])
