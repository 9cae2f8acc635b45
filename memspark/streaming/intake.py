"""Event intake as Structured Streaming: strictly increasing stamps, late events re-stamped, ordered change feed.

Late events are never dropped: the cursor here is how far processing has come, not an event-time
watermark, so ``withWatermark`` is not used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUT = "id string, entity_id string, created_at long, stamp long"


def advance(last: int, stamps: list[int]) -> list[int]:
    """max(own, previous + 1) from the last stamp given out on."""
    out = []
    for s in stamps:
        last = max(s, last + 1)
        out.append(last)
    return out


def clocked(events: DataFrame) -> DataFrame:
    """A stream (id, entity_id, created_at) with stamps that increase strictly within each entity, across batches."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1
        rows = pd.concat(list(frames)).sort_values(["created_at", "id"])
        stamps = advance(last, rows["created_at"].tolist())
        if stamps:
            state.update((stamps[-1],))
        yield rows.assign(stamp=stamps)[["id", "entity_id", "created_at", "stamp"]]

    return events.select("id", "entity_id", "created_at").groupBy("entity_id").applyInPandasWithState(run, OUT, "last long", "append", "NoTimeout")


def due_triggers(events: DataFrame, every: int) -> DataFrame:
    """A row (entity_id, events) each time an entity has gathered ``every`` events more."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((n % every,))
        if n >= every:
            yield pd.DataFrame({"entity_id": [key[0]], "events": [n]})

    return events.select("entity_id", "id").groupBy("entity_id").applyInPandasWithState(run, "entity_id string, events long", "n long", "append", "NoTimeout")


def consume_feed(feed: DataFrame, apply: Callable[[dict], None], skip_failed: bool = False) -> int:
    """Applies pending changes (seq, ...) in order and returns the last sequence number done.

    One ordered consumer, as the feed's order is total; it reads a page at a time from the
    iterator and halts at the first failure unless told to skip.
    """
    done = -1
    for row in feed.orderBy("seq").toLocalIterator():
        try:
            apply(row.asDict())
        except Exception:
            if not skip_failed:
                break
        done = row["seq"]
    return done


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over all that is there into Parquet, then ends."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def clock_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream through ``clocked``, run to its end."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        import tempfile

        root = tempfile.mkdtemp(prefix="memspark-stream-")
    here = f"{root}/clock-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    events = raw.select(F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"))
    run_available(clocked(events), f"{here}/out", f"{here}/state")
    return spark.read.schema(OUT).parquet(f"{here}/out")
