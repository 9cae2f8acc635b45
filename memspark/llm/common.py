"""What the operators of this subpackage share: scratch tables, row positions, word rules."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words, as code points, and the pattern of a word.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: The least number of salts of a group, and the rows that may share one before there are more.
SPREAD = 64
WINDOW_ROWS = 1 << 20
#: Size of a bit field that keeps rows without a partner from a shuffle.
FIELD_BITS = 1 << 26
#: Spark's setting by which a query removes its shuffle files at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share; only where none is set (as in tests), one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        root = tempfile.mkdtemp(prefix="memspark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


@contextlib.contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a block of code; what they were before comes back."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Written tables that cut lineage: a lost executor costs a reread, never the result.

    ``write`` stores a DataFrame as Parquet below the shared folder and returns it reread;
    ``drop`` deletes a table as soon as nothing needs it any more. Tables behind a returned
    (lazy) DataFrame stay for the life of the shared folder. The shuffle files of a write go with
    it: the table stands for them from then on.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, **options) -> DataFrame:
        with held(self.spark, {SHUFFLE_CLEANUP: "true"}):
            df.write.mode("overwrite").option("compression", "zstd").options(**options).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        where.getFileSystem(conf).delete(where, True)


def give_back() -> None:
    """Returns freed memory to the system: a Python worker outlives its task, and other workers share the executor with it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives memory back at its end."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return tidied


class BitField:
    """Whether a long may be among ``members`` (x), by a field of FIELD_BITS bits, whatever their number. No member is
    missed; who is let through by chance is for a later join to drop."""

    def __init__(self, members: DataFrame):
        word = F.shiftright(F.col("x").bitwiseAND(F.lit(FIELD_BITS - 1)), 6).alias("w")
        found = members.select(word, F.expr("shiftleft(1L, cast(x & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most FIELD_BITS / 64 rows
        field = np.zeros(FIELD_BITS >> 6, np.uint64)
        field[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
        self.field = members.sparkSession.sparkContext.broadcast(field)

    def has(self, column: pa.Array) -> pa.Array:
        x = column.to_numpy(zero_copy_only=False).view(np.uint64)
        hit = self.field.value[(x & np.uint64(FIELD_BITS - 1)) >> np.uint64(6)] >> (x & np.uint64(63)) & np.uint64(1)
        return pa.array(hit.astype(bool))


def in_field(x: Column, members: DataFrame) -> Column:
    field = BitField(members)

    @F.arrow_udf("boolean")
    def asked(column: pa.Array) -> pa.Array:
        return field.has(column)

    return asked(x)


def rows_with(docs: DataFrame, keep: DataFrame, tag: Column) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose (doc_id, tag) is in ``keep`` (id, tag); of rows that repeat
    both, one. ``tag``, never null, is an expression over ``row``. Texts are exchanged once: the join and the choice share their keys."""
    null, known = F.col("id").isNull().alias("null"), F.coalesce("id", F.lit(0)).alias("known")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("id"), tag.alias("tag")).select("row", "tag", null, known)
    keys = ["tag", "known", "null"]
    kept = rows.join(keep.select("tag", null, known).hint("merge"), keys, "left_semi")
    kept = kept.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("tag"))).filter("n = 1")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def spread_of(rows: int) -> int:
    """Salts for a group of so many rows: about WINDOW_ROWS rows share one, so a window stays as large as it is when the input grows."""
    return max(SPREAD, -(-rows // WINDOW_ROWS))


def salt_of(spread: int, *cols: Column) -> Column:
    """0 to spread-1, by content alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(spread)).cast("int")


def placed(df: DataFrame, group: list[str], salt: str, order: list[Column], size: Column, to: str) -> DataFrame:
    """Adds ``to``: the running total of ``size`` before the row, within its group.

    The order within a group is (salt, order). Each (group, salt) is one window, so that no
    task holds a group, and the totals of the salts are added up apart. ``df`` is read
    twice: it should be a written table. Columns in ``group`` and ``salt`` hold no nulls.
    """
    keys = [*group, salt]
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = Window.partitionBy(*group).orderBy(salt).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = df.groupBy(*keys).agg(F.sum(size).alias("__n"))
    totals = totals.select(*keys, (F.sum("__n").over(base) - F.col("__n")).alias("__base"))
    inner = df.withColumn("__size", size).withColumn("__run", F.sum("__size").over(run) - F.col("__size"))
    return inner.join(totals, keys).withColumn(to, (F.col("__run") + F.col("__base")).cast("long")).drop("__size", "__run", "__base")
