"""Row rules as Columns: liveness, confidence, exclusions, cooldowns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order of confidence; anything else ranks -1.
CONFIDENCE = {"tentative": 0, "inferred": 1, "certain": 2}


def not_deleted() -> Column:
    return F.col("deleted_at").isNull()


def live(t: int, as_of: bool = False) -> Column:
    """Valid at t: the interval [valid_from, valid_to) holds it. ``as_of`` starts unset intervals at created_at."""
    start = F.coalesce("valid_from", "created_at") <= t if as_of else F.col("valid_from").isNull() | (F.col("valid_from") <= t)
    return start & (F.col("valid_to").isNull() | (F.col("valid_to") > t))


def is_draft() -> Column:
    return F.coalesce(F.col("lifecycle_status") == "draft", F.lit(False))


def confidence_rank(c: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, rank in CONFIDENCE.items():
        out = out.when(c == name, F.lit(rank))
    return out.otherwise(F.lit(-1))


def source_type_allowed(excluded: Iterable[str]) -> Column:
    """An empty list excludes nothing."""
    excluded = list(excluded)
    return ~F.col("source_type").isin(excluded) if excluded else F.lit(True)


def optional_equal(column: str, value) -> Column:
    return F.lit(True) if value is None else F.col(column) == value


def pointer_event(pointer: Column) -> Column:
    """The event id in a source pointer; malformed JSON gives null."""
    return F.get_json_object(pointer, "$.event_id")


def recheck_due(checked: str, now: int, cooldown: int) -> Column:
    return F.col(checked).isNull() | (F.col(checked) <= now - cooldown)


def orphan(now: int, after: int) -> Column:
    return (F.col("access_count") == 0) & (F.col("created_at") <= now - after) & (F.col("source_type") != "immutable_document")


def stale_inferred(now: int, after: int) -> Column:
    return (F.col("confidence") == "inferred") & (F.coalesce("last_accessed_at", "created_at") <= now - after)


def is_stale(now: int) -> Column:
    return F.coalesce(F.lit(now) >= F.col("stale_after"), F.lit(False))


def dimension_mismatch(vector: Column, dimension: int) -> Column:
    return vector.isNotNull() & (F.size(vector) != dimension)
