"""Documents from folders, files, tables, one text, or a diff, as rows of file, kind and raw."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosegrain.functions.ship import ship


def kind_of(file: Column) -> Column:
    end = F.lower(F.substring_index(file, ".", -1))
    return F.when(end.isin("html", "htm"), "html").when(end == "md", "md").otherwise("txt")


def named(uri: Column) -> Column:
    """The name that a person knows: no percent signs for what a URI cannot hold, and no scheme for local files."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:/*", "/")


def _whole(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    read = spark.read.options(ignoreMissingFiles="true", **options).text(paths, wholetext=True)
    return read.select(named(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("raw")).select("file", kind_of(F.col("file")).alias("kind"), "raw")


def from_folder(spark: SparkSession, path: str, ignored: list[str] | None = None) -> DataFrame:
    """Markdown files of a folder and those below it, without hidden ones and those under an ignored name. A folder may be of any file system;
    names that begin with an underscore are Spark's own and are left out. from_files(markdown_files(...)) has neither limit."""
    found = _whole(spark, [path], recursiveFileLookup="true", pathGlobFilter="*.md")
    below = F.regexp_replace("file", "^[a-z0-9]+:/*", "/")
    for name in ignored or []:
        found = found.where(~below.contains(f"/{name.strip('/')}/"))
    return found


def from_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Local files of any kind and name, under the names given; executors read them, so they must be where executors can. Missing ones are left
    out, and bytes that are no UTF-8 are replaced."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, Path(f).read_text(encoding="utf-8", errors="replace")) for f in batch.column(0).to_pylist() if Path(f).is_file()]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string())], names=["path", "raw"])

    base = os.getcwd()
    names = spark.createDataFrame([(os.path.join(base, p), p) for p in paths], "path string, file string")
    files = names.repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism)), "path").select("path").mapInArrow(read, "path string, raw string")
    return files.join(names, "path").select("file", kind_of(F.col("file")).alias("kind"), "raw")


def from_table(table: DataFrame, file: str, raw: str, kind: str = "txt") -> DataFrame:
    return table.select(F.col(file).cast("string").alias("file"), F.lit(kind).alias("kind"), F.coalesce(F.col(raw), F.lit("")).alias("raw"))


def from_text(spark: SparkSession, raw: str, kind: str = "md") -> DataFrame:
    return spark.createDataFrame([("-", kind, raw)], "file string, kind string, raw string")


def added_lines(diffs: DataFrame) -> DataFrame:
    """file, line, text of the lines that unified diffs without context (id, text) add.

    A diff is one row; its lines are numbered in the row and its windows are by diff, so diffs are independent.
    """
    rows = diffs.select("id", F.posexplode(F.split("text", r"\r?\n", -1)).alias("n", "row"))
    order = Window.partitionBy("id").orderBy("n")
    seen = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head, hunk = F.regexp_extract("row", r"^\+\+\+ b/(.*)$", 1), F.regexp_extract("row", r"^@@ [^+]*\+([0-9]+)", 1)
    rows = rows.withColumn("file", F.last(F.when(F.col("row").startswith("+++ b/"), head), ignorenulls=True).over(seen))
    rows = rows.withColumn("hunk", F.sum(F.when(hunk != "", 1).otherwise(0)).over(seen)).withColumn("start", F.last(F.when(hunk != "", hunk.cast("int")), ignorenulls=True).over(seen))
    added = rows.where(F.col("row").startswith("+") & ~F.col("row").startswith("+++") & F.col("file").isNotNull() & F.col("start").isNotNull())
    place = F.row_number().over(Window.partitionBy("id", "hunk").orderBy("n")) - 1
    return added.select("file", (F.col("start") + place).alias("line"), F.substring("row", 2, 1 << 30).alias("text"))
