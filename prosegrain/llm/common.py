"""What the training-data operators share: tables, the shared folder, bounded Arrow batches, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosegrain.functions.ship import ship

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; where that is unset (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="prosegrain-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later stages neither recompute it nor need the executors that made it."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def located(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(uri)


def put(uri: str, data: list[bytes]) -> None:
    """Write under another name and rename, so that no reader and no second attempt sees half a file."""
    store, path = located(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}.part") as out:
        for x in data:
            out.write(x)
    store.move(part, path)


def taken(uri: str) -> bytes:
    """What put() wrote."""
    store, path = located(uri)
    with store.open_input_stream(path) as f:
        return f.read()


def discard(*tables: DataFrame) -> None:
    """Remove tables that cut() wrote and nothing reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            assert re.search(r"-[0-9a-f]{32}$", path), path
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with, for each new column of sums, the sum of the column it names over the rows before in the given order.

    Rows are dealt out by ranges of the order and summed range by range; only a row for each range meets the others'.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = dealt.groupBy("_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    own = own.select("_range", *(F.sum(f"_{n}").over(before).alias(f"_{n}") for n in sums))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(own), "_range")
    zero = F.lit(0)
    return out.select(*df.columns, *((F.coalesce(F.sum(c).over(within), zero) + F.coalesce(f"_{n}", zero)).alias(n) for n, c in sums.items()))


class Maybe:
    """A filter of 64-bit marks in a table of bounded size, which every task gets: it lets all of them pass and few others. With very many marks
    it lets more others pass, and still all of them, so what follows is exact at every size."""

    #: Bits for each mark, and bits at most: a million rows of two numbers.
    BITS, MOST = 16, 1 << 26

    def __init__(self, marks: DataFrame):
        self.bits = min(self.MOST, max(1 << 10, 1 << (self.BITS * max(1, marks.count()) - 1).bit_length()))
        self.words = marks.select(self.place(F.col("mark")).alias("place")).groupBy(F.shiftright("place", 6).alias("its_word")).agg(F.bit_or(self.bit(F.col("place"))).alias("its_bits"))

    def place(self, mark: Column) -> Column:
        return F.pmod(mark, F.lit(self.bits))

    @staticmethod
    def bit(place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))

    def flag(self, df: DataFrame, mark: str) -> DataFrame:
        """df with maybe: false means that the mark is none of them."""
        place = self.place(F.col(mark))
        both = df.join(F.broadcast(self.words), F.shiftright(place, 6) == F.col("its_word"), "left")
        return both.withColumn("maybe", F.coalesce(F.col("its_bits").bitwiseAND(self.bit(place)) != 0, F.lit(False))).drop("its_word", "its_bits")


def bound_batches(spark: SparkSession, rows: int = 2000, mb: int = 16) -> None:
    """Arrow batches of so many rows and MB at most, so that a run of long texts cannot fill a worker. What every operator
    with Python on the executors calls first, so it ships the package too."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", mb << 20)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in column(batch, "text")]


def rows_of(batch: pa.RecordBatch, keep: list[str], **more: pa.Array) -> pa.RecordBatch:
    """The named columns of batch and then the new ones."""
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k)) for k in keep] + list(more.values()), names=[*keep, *more])


#: Rows and MB of a batch in the stages of the pipeline, whose workers live on from stage to stage beside a full heap.
SMALL = {"rows": 500, "mb": 4}
Batches = Iterator[pa.RecordBatch]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): a row (node, root) for each node, root being the smallest node reachable.

    Large-star and small-star steps in turn, each an aggregate and an equi-join, so that a node with very many
    neighbours is pre-aggregated and its join can be split. Every round is written to the shared folder. Null ends
    and loops are dropped; no edges give no rows.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct(), "edges")
    for _ in range(rounds):
        # stars: no node is both a leaf and a root, and no leaf has two roots
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))
        if ends.groupBy("node").agg(F.sum("leaf").alias("leaves"), F.max("root").alias("roots")).where("leaves > 1 or leaves > 0 and roots > 0").isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e1 = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = e1.groupBy("a").agg(F.min("b").alias("m"))
        e2 = e1.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        old, e = e, cut(e2.where("a <> b").distinct(), "edges")
        discard(old)
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    roots = e.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
