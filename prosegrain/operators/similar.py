"""Cosines of a document's units by their pairs of letters.

Nearly all units of a document share some pair of letters, so a join on pairs meets every two units many times over. Here
units meet once, by products of count matrices: those of one document within its row, without a shuffle, and those of a
document of more than TILE units in runs of that many, two at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrain.functions.ship import ship
from prosegrain.functions.text import fenced

#: Units of a tile, and columns of a product: what a task holds at once.
TILE, COLUMNS = 1024, 1024
#: Pairs that are handed on together; a batch for each document would cost more than its pairs.
PAIRS = 1 << 16


def letter_pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Text, number of the pair of letters and count, for each text and pair; and how many different pairs there are."""
    code = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    inner = of[1:] == of[:-1]
    kinds, pair = np.unique((code[:-1] << 32 | code[1:])[inner], return_inverse=True)
    both, n = np.unique(of[1:][inner] * max(1, len(kinds)) + pair, return_counts=True)
    return both // max(1, len(kinds)), both % max(1, len(kinds)), n, len(kinds)


def products(texts: list[str], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dot products of the left texts with the right ones (places in texts), and each text's own; whole numbers."""
    text, pair, n, kinds = letter_pairs(texts)
    own = np.bincount(text, weights=n.astype(float) ** 2, minlength=len(texts))
    dots = np.zeros((len(left), len(right)))
    order = np.argsort(pair, kind="stable")
    text, pair, n = text[order], pair[order], n[order]
    for k in range(0, kinds, COLUMNS):
        a, b = np.searchsorted(pair, [k, k + COLUMNS])
        part = np.zeros((len(texts), min(COLUMNS, kinds - k)))
        part[text[a:b], pair[a:b] - k] = n[a:b]
        dots += part[left] @ part[right].T
    return dots, own


def near(dots: np.ndarray, a: np.ndarray, b: np.ndarray, least: Fraction) -> np.ndarray:
    """Whether the cosine is `least` or more; by whole numbers of any size where it is all but that."""
    want = least**2
    left, right = dots**2 * want.denominator, a[:, None] * b[None, :] * want.numerator
    out = (left >= right) & (right > 0)
    for i, j in zip(*np.nonzero((np.abs(left - right) <= 1e-9 * right) & (right > 0))):
        out[i, j] = int(dots[i, j]) ** 2 * want.denominator >= int(a[i]) * int(b[j]) * want.numerator
    return out


def close_pairs(units: DataFrame, least: Fraction, tile: int = TILE) -> DataFrame:
    """file, a, b (a < b), cosine of the pairs of a file's units (file, id, t; t different) whose cosine is `least` or more."""
    ship(units.sparkSession)
    size = units.groupBy("file").agg(F.count("*").alias("n")).where("n > 1").select(F.col("file").alias("of"), F.ceil(F.col("n") / tile).alias("tiles"))
    dealt = units.join(size, F.col("file") == F.col("of")).drop("of").withColumn("own", F.pmod(F.xxhash64("t"), "tiles"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.select("file", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "t")

    def run(group: pa.Table) -> pa.Table:
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        own, ids, texts = np.asarray(group.column("own")), np.asarray(group.column("id")).astype(np.int64), group.column("t").to_pylist()
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        dots, norm = products(texts, left, right)
        ok = near(dots, norm[left], norm[right], least)
        if lo == hi:
            ok &= ids[left][:, None] < ids[right][None, :]
        i, j = np.nonzero(ok)
        p, q = left[i], right[j]
        cosine = dots[i, j] / np.sqrt(norm[p] * norm[q])
        return pa.table({"file": pa.array([group.column("file")[0].as_py()] * len(p), pa.string()), "a": np.minimum(ids[p], ids[q]), "b": np.maximum(ids[p], ids[q]), "cosine": cosine})

    return dealt.groupBy("file", "lo", "hi").applyInArrow(run, "file string, a bigint, b bigint, cosine double")


def unit_pairs(docs: DataFrame, least: Fraction, tile: int = TILE, large: DataFrame | None = None) -> DataFrame:
    """file, seq, line, cosine, other of the pairs of units of docs (file, us: seq, line, t, in order), at the later one's place.

    A document of up to `tile` units is looked at in its row. The units of a longer one are cut into runs of that many, and every two
    runs are a row of their own, dealt out to all tasks. large: those of docs that can have more units than that, if the caller knows;
    else all of docs are made a second time to look for them.
    """
    ship(docs.sparkSession)
    names = ["file", "seq", "line", "cosine", "other"]

    def pairs_of(one: list[dict], two: list[dict] | None) -> tuple[np.ndarray, ...]:
        own: dict[str, int] = {}
        a = np.array([own.setdefault(u["t"], len(own)) for u in one])
        b = a if two is None else np.array([own.setdefault(u["t"], len(own)) for u in two])
        left, right = np.unique(a), np.unique(b)
        dots, norm = products(list(own), left, right)
        ok = near(dots, norm[left], norm[right], least)
        p, q = np.searchsorted(left, a), np.searchsorted(right, b)
        i, j = np.nonzero(np.triu(ok[p][:, q], 1) if two is None else ok[p][:, q])
        cosine = np.where(a[i] == b[j], 1.0, dots[p[i], q[j]] / np.sqrt(norm[a[i]] * norm[b[j]]))
        later = one if two is None else two
        return np.array([u["seq"] for u in later])[j], np.array([u["line"] for u in later])[j], cosine, np.array([u["line"] for u in one])[i]

    def table(files: pa.Array, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        k, seq, line, cosine, other = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays([files.take(pa.array(k)).cast(pa.string()), pa.array(seq, pa.int32()), pa.array(line, pa.int32()), pa.array(cosine), pa.array(other, pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, ones, twos = (batch.column(k) for k in range(3))
            found, held = [], 0
            for k in range(batch.num_rows):
                seq, *rest = pairs_of(ones[k].as_py(), twos[k].as_py())
                if len(seq):
                    found.append((np.full(len(seq), k), seq, *rest))
                    held += len(seq)
                if found and (held >= PAIRS or k + 1 == batch.num_rows):
                    yield table(files, found)
                    found, held = [], 0

    runs = F.ceil(F.size("us") / tile).cast("int")
    us, many = (x.withColumn("us", fenced(F.col("us"))) for x in (docs, docs if large is None else large))
    short = us.where((F.size("us") > 1) & (F.size("us") <= tile)).select("file", "us", F.lit(None).cast(docs.schema["us"].dataType).alias("more"))
    long = many.where(F.size("us") > tile).select("file", "us", runs.alias("runs"), F.explode(F.sequence(F.lit(0), runs - 1)).alias("lo"))
    long = long.select("file", "us", "lo", F.explode(F.sequence("lo", F.col("runs") - 1)).alias("hi"))
    cut = lambda k: F.slice("us", k * tile + 1, F.lit(tile))
    long = long.select("file", cut(F.col("lo")).alias("us"), F.when(F.col("hi") > F.col("lo"), cut(F.col("hi"))).alias("more"), "lo", "hi").repartition("file", "lo", "hi").drop("lo", "hi")
    schema = "file string, seq int, line int, cosine double, other int"
    return short.mapInArrow(run, schema).unionByName(long.mapInArrow(run, schema))
