"""Labels that the two classifiers learn from, and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrain.llm.common import cut


def held_out(doc_id, folds: int, fold: int):
    """Whether a document's labels must not be learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def known_labels(labels: DataFrame, label: str, folds: int, fold: int) -> DataFrame:
    """doc_id and label (0 or 1) of the documents outside the held out fold. Labels that are null or of documents without id are left out."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    return known.where(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.max("label").alias("label"))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int) -> DataFrame:
    """label (0 or 1) and text of at most `rows` labelled documents outside the held out fold, those with the smallest hashes of doc_id.

    Labels that are null or of documents without id are left out. Only the ids of the sample are broadcast.
    """
    known = known_labels(labels, label, folds, fold)
    chosen = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labelled")
    return cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text"), "labelled-texts")
