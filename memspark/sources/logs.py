"""Event logs and memory dumps as rows of lines: no entity's file is gathered into one row, a writer sorts by the order columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How ids of lines without one begin, and what an id may consist of.
PREFIX = "evt_okf1_"
ID = r"^[A-Za-z0-9._-]+$"
#: The notes behind tasks of a dump.
NOTES = {"done": " (done)", "abandoned": " (abandoned)", "in_progress": " (in progress)"}
KEY = ["entity_id", "date", "event_type", "summary"]


def derived_event_id(tag: str, occurrence: Column) -> Column:
    """PREFIX and 32 hex digits of SHA-256 over the fields, each with its length in bytes before it and a comma behind; ``tag`` names the scheme."""
    fields = [F.lit(tag), *map(F.col, KEY), occurrence.cast("string")]
    return F.concat(F.lit(PREFIX), F.substring(F.sha2(F.concat(*[p for f in fields for p in (F.octet_length(f).cast("string"), F.lit(":"), f, F.lit(","))]), 256), 1, 32))


def with_event_ids(lines: DataFrame, tag: str) -> DataFrame:
    """Lines (entity_id, pos, date, event_type, summary, event_id) with an id each: the n-th line without one of a key takes
    the key's n-th occurrence whose id no line of the entity states. Null fields count as empty."""
    rows = lines.withColumns({c: F.coalesce(c, F.lit("")) for c in KEY})
    bare = rows.filter("event_id IS NULL").withColumn("n", F.row_number().over(Window.partitionBy(*KEY).orderBy("pos")))
    # ids that the entity states can hold as many occurrences of a key as it has lines with such ids
    stated = rows.filter(F.col("event_id").startswith(PREFIX)).select("entity_id", "event_id").distinct()
    held = rows.filter(F.col("event_id").startswith(PREFIX)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("held"))
    counts = bare.groupBy(*KEY).agg(F.count(F.lit(1)).alias("lines")).join(held, KEY, "left")
    last = F.col("lines") * 2 + F.coalesce("held", F.lit(0)) - 1
    ids = counts.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("event_id", derived_event_id(tag, F.col("k")))
    free = ids.join(stated, ["entity_id", "event_id"], "left_anti").withColumn("n", F.row_number().over(Window.partitionBy(*KEY).orderBy("k")))
    found = bare.drop("event_id").join(free.select(*KEY, "n", "event_id"), [*KEY, "n"], "left").select(*lines.columns)
    return rows.filter("event_id IS NOT NULL").select(*lines.columns).unionByName(found)


def log_lines(entries: DataFrame) -> DataFrame:
    """(entity_id, date, part, at, id, line) of entries (entity_id, date, at, id, text): the days as headings, the newest first, each
    entry a bullet with its id in a comment. Sort by entity, date descending, part, at, id. Line breaks in texts become spaces."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " ")
    noted = F.when(F.col("id").rlike(ID), F.concat(text, F.lit(" <!-- id: "), F.col("id"), F.lit(" -->"))).otherwise(text)
    bullets = entries.select("entity_id", "date", F.lit(2).alias("part"), "at", "id", F.concat(F.lit("- "), noted).alias("line"))
    days = entries.select("entity_id", "date").distinct()
    oldest = days.groupBy("entity_id").agg(F.min("date").alias("oldest"))
    frame = days.join(oldest, "entity_id").select("entity_id", "date", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit("## "), F.col("date")).alias("line")), F.struct(F.lit(1).alias("part"), F.lit("").alias("line")),
        F.struct(F.when(F.col("date") != F.col("oldest"), 3).alias("part"), F.lit("").alias("line")))).alias("l")).filter("l.part IS NOT NULL")
    none = frame.select("entity_id", "date", "l.part", F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("id"), "l.line")
    return bullets.withColumn("at", F.col("at").cast("long")).unionByName(none)


def parsed_log(lines: DataFrame, order: list[Column]) -> DataFrame:
    """(entity_id, date, text, event_id) of the bullets of log lines (entity_id, line, order columns); lines before a heading or of another form are skipped."""
    date = F.regexp_extract("line", r"^##\s+(\d{4}-\d{2}-\d{2})\s*$", 1)
    seen = F.last(F.when(date != "", date), ignorenulls=True).over(Window.partitionBy("entity_id").orderBy(*order))
    text = F.regexp_extract("line", r"^-\s+(\S.*)?$", 1)
    rows = lines.withColumn("date", seen).filter(F.col("line").rlike(r"^-\s+(\S.*)?$") & F.col("date").isNotNull()).withColumn("text", text)
    cut = F.rtrim(F.col("text"))
    # the last comment, if it ends the line and holds nothing but an id
    noted = r"^(.*)<!--\s*id:\s*(\S+)\s*-->$"
    found = F.regexp_extract(cut, noted, 2)
    return rows.select("entity_id", "date", F.when(found != "", F.rtrim(F.regexp_extract(cut, noted, 1))).otherwise(F.col("text")).alias("text"), F.when(found.rlike(ID), found).alias("event_id"))


def citations(body: Column) -> Column:
    """The addresses in the list under a heading "Citations" (level 1 or 2) up to the next heading; code between fences counts as neither."""
    none = F.struct(F.lit("").alias("fence"), F.lit(False).alias("on"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, line: Column) -> Column:
        mark = F.regexp_extract(line, r"(?U)^\s*(```+|~~~+)", 1)
        fence, plain = mark != "", (mark == "") & (s["fence"] == "")
        closes = (F.substring(mark, 1, 1) == F.substring(s["fence"], 1, 1)) & (F.length(mark) >= F.length(s["fence"])) & line.rlike(r"(?U)^\s*(```+|~~~+)\s*$")
        url = F.regexp_extract(line, r"(?U)^\s*-\s+(https?://\S+)\s*$", 1)
        starts = plain & ~s["on"] & line.rlike(r"(?iU)^\s*#{1,2}\s*citations\s*$")
        ends = plain & s["on"] & line.rlike(r"(?U)^\s*#{1,2}\s+")
        moved = F.struct(
            F.when(~fence, s["fence"]).when(s["fence"] == "", mark).when(closes, F.lit("")).otherwise(s["fence"]).alias("fence"),
            (s["on"] | starts).alias("on"), (s["done"] | ends).alias("done"),
            F.when(plain & s["on"] & ~ends & (url != ""), F.concat(s["found"], F.array(url))).otherwise(s["found"]).alias("found"),
        )
        return F.when(s["done"], s).otherwise(moved)

    return F.aggregate(F.split(F.coalesce(body, F.lit("")), r"\r?\n"), none, step, lambda s: s["found"])


def iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def dump_lines(facts: DataFrame, tasks: DataFrame, events: DataFrame, now: int) -> DataFrame:
    """(entity_id, part, at, id, line) of a Markdown dump: its heading (0), facts (1), tasks (2) and events (3), a line for each row and
    "_(none)_" for a section without any. Sort by entity, part, at (a section's heading has null), id. Lines are joined by a line break."""
    part = lambda df, n, line: df.select("entity_id", F.lit(n).alias("part"), F.col("created_at").alias("at"), "id", line.alias("line"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    fact = F.concat(
        F.lit("### "), text("title"), F.lit("\n**Tags:** "), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", "), F.lit("\n**Confidence:** "), text("confidence"),
        F.lit("\n**Source:** "), F.coalesce("source_ref", "source_type", F.lit("")), F.lit("\n\n"), text("body"), F.lit("\n\n---\n"))
    note = F.lit("")
    for status, words in NOTES.items():
        note = F.when(F.col("status") == status, words).otherwise(note)
    task = F.concat(F.lit("- ["), F.when(F.col("status") == "done", "x").otherwise(" "), F.lit("] "), text("description"), note, F.lit("\n"))
    event = F.concat(F.lit("- ["), iso(F.col("created_at")), F.lit("] ("), text("event_type"), F.lit(") "), text("summary"), F.lit("\n"))
    rows = part(facts, 1, fact).unionByName(part(tasks, 2, task)).unionByName(part(events, 3, event))
    # which sections an entity has, in one pass
    has = rows.groupBy("entity_id").agg(*[F.max((F.col("part") == n).cast("int")).alias(f"has_{n}") for n in (1, 2, 3)])
    empty = lambda n: F.when(F.col(f"has_{n}") == 0, "\n_(none)_\n").otherwise("")
    heads = F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit("# Memory Dump: "), F.col("entity_id"), F.lit("\nGenerated: "), iso(F.lit(now)), F.lit("\n")).alias("line")),
        F.struct(F.lit(1).alias("part"), F.concat(F.lit("## Facts\n"), empty(1)).alias("line")),
        F.struct(F.lit(2).alias("part"), F.concat(F.lit("## Tasks\n"), empty(2)).alias("line")),
        F.struct(F.lit(3).alias("part"), F.concat(F.lit("\n## Recent Events\n"), empty(3)).alias("line")))
    frame = has.select("entity_id", F.explode(heads).alias("h")).select("entity_id", "h.part", F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("id"), "h.line")
    return rows.unionByName(frame)
