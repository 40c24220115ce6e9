"""Location codes, officer ids, signatures, name and id clean-up."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code alphabet and its two look-alike substitutions.
BASE14 = "0123456789ABCD"
CODE_FROM, CODE_TO = "10", "YZ"
CODE_DIGITS = 7
CODE_CEILING = 0.999999999

# Default codes and names used when a text leaves nothing behind.
DEFAULT_BASE_NAME = "cadastre_alignment"


def encode_base14(value: Column, digits: int = CODE_DIGITS) -> Column:
    """Base-14 expansion of a value in [0, 1), most significant digit first."""
    start = F.struct(value.cast("double").alias("v"), F.lit("").alias("s"))

    def step(acc, _):
        scaled = acc["v"] * 14.0
        digit = F.least(F.floor(scaled).cast("int"), F.lit(13))
        return F.struct((scaled - digit).alias("v"),
                        F.concat(acc["s"], F.substring(F.lit(BASE14), digit + 1, F.lit(1))).alias("s"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(digits)), start, step, lambda acc: acc["s"])


def ulpin(lat: Column, lon: Column) -> Column:
    """14-character location code of a point in degrees."""
    def unit(v, half):
        return F.greatest(F.lit(0.0), F.least((v + half) / (2.0 * half), F.lit(CODE_CEILING)))

    return F.translate(F.concat(encode_base14(unit(lat, 90.0)), encode_base14(unit(lon, 180.0))), CODE_FROM, CODE_TO)


def officer_id(designation: Column, phone: Column) -> Column:
    return F.concat(F.lit("REV-"), F.upper(F.substring(designation, 1, 3)), F.lit("-"), F.right(phone, F.lit(4)))


def state_signature(parcel_id: Column, code: Column, officer: Column, stamp: Column, new_state: Column) -> Column:
    """SHA-256 hex over the colon-joined fields; a missing field counts as empty text."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (parcel_id, code, officer, stamp, new_state)]
    return F.sha2(F.concat_ws(":", *parts), 256)


def safe_name(path: Column) -> Column:
    """Base name without extension; anything but letters, digits, ``_`` and ``-`` becomes ``_``."""
    base = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)\z", 1), r"(?<=.)\.[^.]*\z", "")
    clean = F.regexp_replace(base, r"[^A-Za-z0-9_\-]", "_")
    return F.when(clean == "", F.lit(DEFAULT_BASE_NAME)).otherwise(clean)


UUID_RE = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\z"


def parse_uuid(raw: Column) -> Column:
    """Canonical lower-case UUID text, or null when the text is no UUID."""
    hexes = F.lower(F.regexp_replace(raw, "-", ""))
    parts = [F.substring(hexes, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(raw.rlike(UUID_RE), F.concat_ws("-", *parts))


def khasra_from_id(raw: Column) -> Column:
    """Plot number inside a composite id such as ``par-107-x`` or ``preview-107``."""
    bare = F.replace(F.replace(raw, F.lit("par-"), F.lit("")), F.lit("preview-"), F.lit(""))
    return F.split_part(bare, F.lit("-"), F.lit(1))
