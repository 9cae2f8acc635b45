"""Mixing sources to target weights by a low-discrepancy schedule.

Slot t of the schedule is the point frac(t / golden ratio); the cumulative shares of the
sources map it to a source, and its rank among the slots of that source names the block of
the source that it takes. A source's documents, shuffled by hash, are cut into blocks of
equally many words; when all are taken, a second pass begins, and targets stop at two
passes. Everything is built from DataFrame functions.
"""

from __future__ import annotations

from decimal import Decimal, getcontext

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.llm.common import SPACES, WORD, Scratch, placed, salt_of, spread_of

#: The weights of the sources in their order, repeating; the mix's size against the input's; the most passes over a source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
BLOCK = 1024
CELLS = 4096
RUN = 65_536


def word_count(text: Column) -> Column:
    """Runs of other than white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, scratch: Scratch, share: float = SHARE, passes: int = PASSES, weights: tuple = WEIGHTS) -> DataFrame:
    """s (0, 1, ... by code point, null last), source, source_size, target for every source of (source, size).

    target is min(passes * source_size, weight * level), with the one level at which the
    targets share ``share`` times all sizes. The level comes from rounds, each an aggregate
    over the sources: those above their stop are fixed there, what they leave is shared by
    weight, until none is above.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))  # one row for each source
    ranked = totals.withColumn("s", (F.row_number().over(order) - 1).cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("s", F.lit(len(weights))) + 1)
    rows = scratch.write(ranked.select("s", "source", "source_size", weight.alias("weight"), (F.col("source_size") * float(passes)).alias("stop")), "sources")
    whole = rows.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        over = F.col("stop") < F.lit(level) * F.col("weight")
        fixed, free = rows.agg(F.sum(F.when(over, F.col("stop")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not free:
            break
        now = (share * whole - fixed) / free
        if now <= level:
            break
        level = now
    return rows.select("s", "source", "source_size", F.least(F.col("stop"), F.lit(level) * F.col("weight")).alias("target"))


def golden(t: Column) -> Column:
    """frac(t / golden ratio), exact to 1e-9 for any t below 2^40."""
    getcontext().prec = 60
    step = (Decimal(5).sqrt() - 1) / 2
    low, high = float(step), float(step * (1 << 20) % 1)
    at = F.shiftright(t, 20).cast("double") * high + t.bitwiseAND(F.lit((1 << 20) - 1)).cast("double") * low
    return at - F.floor(at)


def schedule(targets: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """(slot, s, block): the slots of the mix in order; a source with target x has ceil(x / block) of them.

    Points beyond a source's quota are left out, and ranks that the points did not reach (a
    few for a source) follow after the last point, so that the quota holds exactly.
    """
    spark = targets.sparkSession
    upto = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row for each source
    want = targets.select("s", F.round("target").cast("long").alias("words")).filter("words > 0")
    want = scratch.write(want.withColumn("high", F.sum("words").over(upto)).withColumn("quota", F.ceil(F.col("words") / F.lit(block))), "quotas")
    whole, slots = want.agg(F.max("high"), F.sum("quota")).first()
    if not whole:
        return spark.createDataFrame([], "slot long, s int, block long")
    low = F.col("high") - F.col("words")
    first, last = F.floor(low * CELLS / F.lit(whole)), F.least(F.floor(F.col("high") * CELLS / F.lit(whole)), F.lit(CELLS - 1))
    cells = want.select("s", "quota", low.cast("double").alias("from"), F.col("high").cast("double").alias("to"), F.explode(F.sequence(first, last)).alias("cell"))
    points = spark.range(slots).select(F.col("id").alias("slot"), golden(F.col("id") + 1).alias("u"))
    points = points.select("slot", (F.col("u") * float(whole)).alias("x"), F.least(F.floor(F.col("u") * CELLS), F.lit(CELLS - 1)).alias("cell"))
    hits = points.join(cells, "cell").filter("x >= from AND x < to").select("slot", "s", "quota", F.shiftright("slot", 16).cast("int").alias("run"))
    hits = scratch.write(hits, "hits")
    ranked = placed(hits, ["s"], "run", [F.col("slot")], F.lit(1), "block").filter("block < quota").select("slot", "s", "block")
    reached = hits.groupBy("s").agg(F.count(F.lit(1)).alias("reached"))
    short = want.join(reached, "s", "left").withColumn("reached", F.coalesce("reached", F.lit(0))).filter("reached < quota")
    tail = short.select("s", F.explode(F.sequence("reached", F.col("quota") - 1)).alias("block")).select((F.lit(slots) + F.col("block")).alias("slot"), "s", "block")
    return ranked.unionByName(tail)


def shuffled_streams(sized: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds s, source_size, target and ``start``: the words before the document in its source's shuffled order."""
    keyed = sized.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    keyed = scratch.write(keyed, "keyed")
    most = keyed.groupBy("s").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    keyed = keyed.withColumn("salt", salt_of(spread_of(most), F.col("doc_id"), F.col("size")))
    order = [F.xxhash64(F.lit(1), F.col("doc_id"), F.col("size")), F.col("doc_id"), F.col("size")]
    return placed(keyed, ["s"], "salt", order, F.col("size"), "start")


def mix(docs: DataFrame, block: int = BLOCK, share: float = SHARE, passes: int = PASSES, weights: tuple = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", payload: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """The mix as (documents, pieces).

    documents: doc_id, size, source, s, source_size, target, start, and ``payload`` columns, for
    every row. pieces: slot, s, block, pass_no, doc_id, size, start, from_word, words: which
    words of which document each slot takes; slots in order are the training order.
    Null text counts as empty, a null source is a source of its own and the last. Rows with
    equal ids are rows of their own. Texts without words are taken zero times. An empty table
    gives no rows. The order depends on ids and sizes alone, so that reruns agree.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *payload)
    sized = scratch.write(sized, "sized")
    targets = scratch.write(source_targets(sized, scratch, share, passes, weights), "targets")
    slots = schedule(targets, block, scratch)
    placed_docs = scratch.write(shuffled_streams(sized, targets, scratch), "placed")
    scratch.drop("keyed")
    begin = F.col("start") + F.col("pass_no") * F.col("source_size")
    end = F.least(begin + F.col("size"), F.round("target").cast("long"))
    runs = placed_docs.filter("size > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    runs = runs.withColumns({"begin": begin, "end": end}).filter("begin < end")
    blocks = runs.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / F.lit(block)), F.floor((F.col("end") - 1) / F.lit(block)))))
    low, high = F.greatest(F.col("begin"), F.col("block") * block), F.least(F.col("end"), (F.col("block") + 1) * block)
    cut = blocks.select("s", "block", "pass_no", "doc_id", "size", "start", (low - F.col("begin")).alias("from_word"), (high - low).alias("words"))
    return placed_docs, slots.join(cut, ["s", "block"])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, pieces = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    # start names a row with words within its source, also where ids repeat
    taken = pieces.groupBy("s", "start", "doc_id", "size").agg(F.sum("words").alias("taken"))
    keys = ["s", "start", "size"]
    joined = documents.join(taken.select(*keys, "taken", F.col("doc_id").alias("__id")), keys, "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for each document and pass that the mix takes, whole but for the last of a source.

    Keeps the columns of the input. A document of which the mix takes only the first words
    (at most one for each source and pass) is cut to them, joined by single spaces, and its
    n_chars, where there is such a column, follows.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    documents, pieces = mix(docs)
    taken = pieces.groupBy("s", "start", "pass_no").agg(F.sum("words").alias("words"))
    # rows with one id and size are alike in the schedule: each is named by its number among them
    like = Window.partitionBy("doc_id", "size").orderBy("s", "start")
    named = documents.filter("size > 0").select("doc_id", "size", "s", "start", F.row_number().over(like).alias("n"))
    plan = scratch.write(named.join(taken, ["s", "start"]).select(F.col("doc_id").alias("id"), "size", "n", "words"), "plan").alias("p")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("id"), word_count(F.col("row.text")).alias("size")).filter("size > 0")
    own = Window.partitionBy("id", "size").orderBy(F.col("row.source").isNull(), F.col("row.source"), F.col("row.text"))
    rows = rows.withColumn("n", F.row_number().over(own)).alias("r")
    same = F.col("r.id").eqNullSafe(F.col("p.id")) & (F.col("r.size") == F.col("p.size")) & (F.col("r.n") == F.col("p.n"))
    joined = rows.join(plan, same).select("row", (F.col("p.words") < F.col("r.size")).alias("part"), "words")
    spaced = F.btrim(F.translate(F.col("row.text"), SPACES, " " * len(SPACES)), F.lit(" "))
    text = F.when(F.col("part"), F.array_join(F.slice(F.split(spaced, " +"), F.lit(1), F.col("words").cast("int")), " ")).otherwise(F.col("row.text"))
    out = joined.withColumn("text", text)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
