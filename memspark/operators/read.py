"""Read options, the read bundle, and what a budget leaves of walks and passages."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import chunking as C
from memspark.functions import predicates as P
from memspark.functions import text as T
from memspark.operators import relational as R
from memspark.operators import search as S

MOST_IDS = 100


class InvalidReadOptions(ValueError):
    pass


def entity_ids(ids: str | list[str]) -> list[str]:
    """Distinct ids in the order given."""
    return list(dict.fromkeys([ids] if isinstance(ids, str) else ids))


def excluded_ids(ids: list[str] | None) -> list[str]:
    """At most MOST_IDS distinct ids, none empty or with a NUL."""
    own = entity_ids(ids or [])
    if len(own) > MOST_IDS or any(not isinstance(x, str) or not x or "\x00" in x for x in own):
        raise InvalidReadOptions("exclude")
    return own


def tier_weights(ids: list[str], weights: dict[str, float] | None) -> dict[str, float] | None:
    """A weight of 0 or more for each id; 1 where there is none or no finite one."""
    if weights is None:
        return None
    value = lambda w: 1.0 if w is None or not math.isfinite(w) else max(0.0, float(w))
    return {i: value(weights.get(i)) for i in ids}


def passage_terms(query: str) -> list[str]:
    """Distinct searchable terms of a query; there must be one."""
    terms = S.query_tokens(query) if isinstance(query, str) else []
    if not terms:
        raise InvalidReadOptions("sources.query")
    return terms


def ranked(candidates: DataFrame, allowed: DataFrame, limit: int, fallback: DataFrame | None = None) -> DataFrame:
    """What an exchangeable ranker returns (id, score), made safe: allowed ids once, by their best finite score, at most ``limit``;
    the ``fallback`` ranking where nothing is left."""
    fit = candidates.filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf")))
    fit = fit.groupBy("id").agg(F.max("score").alias("score")).join(allowed.select("id"), "id", "left_semi").orderBy(F.col("score").desc(), "id").limit(limit)
    if fallback is None:
        return fit
    none = fit.agg((F.count(F.lit(1)) == 0).alias("none"))
    return fit.unionByName(fallback.select("id", "score").join(F.broadcast(none.filter("none")), how="left_semi").limit(limit))


def hydrated(facts: DataFrame, now: int) -> DataFrame:
    """Facts with trust_tier and is_stale."""
    return facts.withColumns({"trust_tier": T.trust_tier(F.col("verified_by")), "is_stale": P.is_stale(now)})


def bundle(facts: DataFrame, tasks: DataFrame, events: DataFrame, scores: DataFrame, now: int, most_facts: int = 10, most_tasks: int = 10, most_events: int = 10) -> dict[str, DataFrame]:
    """What a read returns of every entity: its best facts by ``scores`` (id, score) with trust and staleness, open tasks, latest events in
    order of time, and the counts of each."""
    own = hydrated(facts, now).join(scores, "id")
    best = R.newest(own, most_facts, S.ranking())
    open_tasks = R.newest(R.live_scan(tasks).filter(F.col("status").isin("pending", "in_progress")), most_tasks, [F.col("priority").desc(), F.col("created_at").desc(), F.col("id")])
    latest = latest_ascending(events, most_events)
    counted = lambda df, kind: df.groupBy("entity_id").agg(F.count(F.lit(1)).alias(kind))
    counts = counted(best, "facts").join(counted(open_tasks, "tasks"), "entity_id", "full").join(counted(latest, "events"), "entity_id", "full").na.fill(0)
    return {"facts": best, "tasks": open_tasks, "events": latest, "metadata": counts}


def latest_ascending(events: DataFrame, most: int) -> DataFrame:
    """The latest ``most`` events of each entity; ``place`` counts them from the oldest."""
    from pyspark.sql import Window

    cut = R.newest(events, most, [F.col("created_at").desc(), F.col("id").desc()]).drop("rn")
    return cut.withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy("created_at", "id")))


def packed_walk(rows: DataFrame, budget: int) -> DataFrame:
    """Of each anchor's nodes (anchor, place, id, cost), place 0 the anchor, which always stays: in order, whatever still fits the
    budget. A walk is cut to its node cap before, so a group is small."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        kept, used = [], 0
        for x in f.sort_values("place").itertuples():
            cost = min(x.cost, budget) if x.place == 0 else x.cost
            if x.place == 0 or used + cost <= budget:
                kept.append((x.anchor, x.id, len(kept)))
                used += cost
        return pd.DataFrame(kept, columns=["anchor", "id", "kept"])

    return rows.select("anchor", "place", "id", "cost").groupBy("anchor").applyInPandas(run, "anchor string, id string, kept long")


def passage_windows(hits: DataFrame, terms: list[str], budget: int, window: Callable[[str, list[str], int], str] = C.window_passage) -> DataFrame:
    """(entity_id, id, text): windows of an entity's best passages (entity_id, id, rn, text) in order of rank, together within the
    budget. Hits are cut to a few an entity before."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out, left = [], budget
        for x in f.sort_values("rn").itertuples():
            if left <= 0:
                break
            if text := window(x.text, terms, left):
                out.append((x.entity_id, x.id, text))
                left -= len(text)
        return pd.DataFrame(out, columns=["entity_id", "id", "text"])

    return hits.select("entity_id", "id", "rn", "text").groupBy("entity_id").applyInPandas(run, "entity_id string, id string, text string")


def tags_text(c: Column) -> Column:
    """A JSON array of tags joined by spaces; any other text as it is."""
    return F.coalesce(F.array_join(F.from_json(c, "array<string>"), " "), c)


def embed_text(title: Column, body: Column, tags: Column, limit: int = 6000, ceiling: int = 16_000) -> Column:
    """What is embedded of a fact: title, body and tags, clipped."""
    return T.clip(F.concat_ws(" ", title, body, tags), max(0, min(limit, ceiling)))


def finite_vector(text: Column) -> Column:
    """A JSON array of numbers as floats; null if it is none or a number is not finite."""
    v = F.from_json(text, "array<double>").cast("array<float>")
    return F.when(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), v)
