"""Identifiers, dates, JSON and other small scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier patterns and severity names.
CHIP_ID = "^(AF|BS)_[A-Za-z0-9_-]+$"
SAFE_ID = "^[A-Za-z0-9._-]+$"
SEVERITY = {1: "low", 2: "medium", 3: "high"}


def task_of(chip_id: Column) -> Column:
    return F.lower(F.substring(chip_id, 1, 2))


def year_of(text: Column) -> Column:
    """Leading four digits, NULL when the text does not start with a year."""
    return F.nullif(F.regexp_extract(text, r"^(\d{4})", 1), F.lit(""))


def epsg_code(text: Column) -> Column:
    """``EPSG:32637`` or ``32637.0`` to an integer; NULL when not integral."""
    number = F.regexp_replace(F.upper(F.trim(text)), "^EPSG:", "").try_cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e9)
    return F.when(whole, number.cast("int"))


def utc_timestamp(text: Column) -> Column:
    """ISO-8601 text with a zone (``Z`` included) to an instant."""
    return F.try_to_timestamp(text)


def iso_from_millis(millis: Column) -> Column:
    """Epoch milliseconds to ISO text ending in ``Z`` (fraction only if any)."""
    at = F.to_utc_timestamp(F.timestamp_millis(millis), F.current_timezone())
    base = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.pmod(millis, F.lit(1000))
    tail = F.when(fraction == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(fraction.cast("string"), 3, "0"), F.lit("000")))
    return F.concat(base, tail, F.lit("Z"))


def safe_id(value: Column, longest: int = 128) -> Column:
    return value.rlike(SAFE_ID) & (F.length(value) <= longest)


def safe_chip_id(value: Column) -> Column:
    """Non-empty, at most 256 characters and free of path separators."""
    return (F.length(value) > 0) & (F.length(value) <= 256) & ~value.rlike(r"[/\\]")


def severity_name(cls: Column) -> Column:
    out = F.when(cls == 1, SEVERITY[1])
    return out.when(cls == 2, SEVERITY[2]).when(cls == 3, SEVERITY[3])


def canonical_json(fields: Column) -> Column:
    """Compact JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))


def canonical_sha256(fields: Column) -> Column:
    return F.sha2(canonical_json(fields), 256)


def without_private(fields: Column) -> Column:
    """Drop keys that start with an underscore."""
    return F.map_filter(fields, lambda k, _v: ~k.startswith("_"))


def clean_url(url: Column) -> tuple[Column, Column]:
    """URL without credentials, query and fragment, and whether any was there."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(url, r"^[^:]+://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, "^.*@", ""))
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    ok = scheme.isin("http", "https") & (host != "")
    redacted = authority.contains("@") | url.rlike(r"\?[^#]") | url.rlike("#.")
    return F.when(ok, F.concat(scheme, F.lit("://"), host, path)), F.when(ok, redacted)


# Words that mark training material.
SPLIT_WORDS = ("train", "training", "val", "validation")


def training_text(value: Column) -> Column:
    """One of the text's words names a training or validation split."""
    words = F.split(F.lower(value), "[^a-z0-9_]+")
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in SPLIT_WORDS]))


def days_to_period(start_day: Column, end_day: Column) -> tuple[Column, Column]:
    """Inclusive calendar days to a half-open period."""
    return F.to_timestamp_ntz(start_day.cast("string")), F.to_timestamp_ntz(F.date_add(end_day.cast("date"), 1).cast("string"))


def period_to_days(start: Column, end: Column) -> tuple[Column, Column]:
    """Half-open period back to inclusive days (one millisecond before the end)."""
    return start.cast("date"), (end - F.expr("INTERVAL 0.001 SECOND")).cast("date")


def _safe_pairs(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: p["id"].rlike(SAFE_ID) & p["href"].isNotNull() & ~p["href"].rlike(r"^/|(^|/)\.\.(/|$)"))


def artifact_pairs(fields: Column) -> Column:
    """``map<string,string>`` of artifacts to safe ``(id, href)`` pairs."""
    return _safe_pairs(F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("id"), e["value"].alias("href"))))


def artifact_entries(doc: Column) -> Column:
    """Safe ``(id, href)`` pairs of a JSON object of texts, lists and objects.

    A list gives ``key_0, key_1, ...``, an object ``key_name``; members that are
    not texts are left out.  Anything but an object gives no pairs.
    """

    def text(v: Column) -> Column:
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    def pair(name: Column, v: Column) -> Column:
        return F.struct(name.alias("id"), text(v).alias("href"))

    def members(e: Column) -> Column:
        key, value, kind = e["key"], e["value"], F.schema_of_variant(e["value"])
        items = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v, i: pair(F.concat_ws("_", key, i), v))
        fields = F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda f: pair(F.concat_ws("_", key, f["key"]), f["value"]))
        return F.when(kind.startswith("ARRAY"), items).when(kind.startswith("OBJECT"), fields).otherwise(F.array(pair(key, value)))

    fields = F.try_variant_get(F.try_parse_json(doc), "$", "map<string,variant>")
    return _safe_pairs(F.coalesce(F.flatten(F.transform(F.map_entries(fields), members)), F.array().cast("array<struct<id:string,href:string>>")))
