"""Text rules as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_fact_text(c: Column) -> Column:
    """Lower case, runs of other than letters and digits to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def normalize_title_key(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")


def title_tokens(c: Column) -> Column:
    """Distinct words of at least three of a-z, 0-9; other signs are deleted first."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""), r"\s+"), lambda w: F.length(w) >= 3))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def clip(c: Column, limit: int) -> Column:
    """Trimmed, cut to the limit, trimmed again at its end."""
    return F.rtrim(F.substring(F.trim(c), 1, limit))


def valid_tags(c: Column, most: int = 6, longest: int = 40) -> Column:
    """Trimmed lower-case tags of 1 to ``longest`` characters, the first ``most``."""
    return F.slice(F.filter(F.transform(c, lambda t: F.lower(F.trim(t))), lambda t: F.length(t).between(1, longest)), 1, most)


def normalize_source_ref(c: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r"[^A-Za-z0-9._\- ]", "")), 1, 255)


def normalize_source_hash(c: Column) -> Column:
    """64 hex digits in lower case, or null."""
    return F.when(F.trim(c).rlike("^[0-9a-fA-F]{64}$"), F.lower(F.trim(c)))


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def trust_tier(verified_by: Column) -> Column:
    """By the verifier: a person, a machine or nobody."""
    return F.when(verified_by.startswith("human:"), "human-reviewed").when(verified_by.isNotNull(), "machine-confirmed").otherwise("unverified")


def valid_date(c: Column) -> Column:
    """A YYYY-MM-DD that is in the calendar, as a date; else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))))


def parse_valid_from(c: Column) -> Column:
    """A number of milliseconds or an ISO time, as milliseconds from 0 on; else null."""
    ms = F.coalesce(F.expr(f"try_cast({_name(c)} AS BIGINT)"), F.unix_millis(F.try_to_timestamp(c)))
    return F.when(ms >= 0, ms)


def _name(c: Column) -> str:
    return c._jc.toString() if hasattr(c, "_jc") else str(c)


def clamp_priority(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(10), F.round(c))).cast("long")


def presenter_score(now: int, confidence: Column, accesses: Column, updated: Column) -> Column:
    """Confidence + 0.3 ln(1 + accesses) + 0.5 exp(-age in days / 30)."""
    weight = F.when(confidence == "certain", 1.0).when(confidence == "inferred", 0.6).when(confidence == "tentative", 0.3).otherwise(0.3)
    return weight + F.log(1 + accesses) * 0.3 + F.exp(-(F.lit(float(now)) - updated) / 86_400_000.0 / 30.0) * 0.5


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    dot = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.slice(v, 1, n), F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when((norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(dot / (norm(a) * norm(b)))
