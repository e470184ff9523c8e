"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose five word positions and ignore those between, so that a hash survives a substitution at an ignored
position. Hashes of the benchmark and of the documents are joined, and around each hit the texts are compared word by word:
a document overlaps an item if some 13 aligned words agree in 10 or more. The three masks together hit every such
window, wherever its three substitutions lie (tests try all). An item of fewer than 13 words is compared whole, and all its
words but one, or but two of 11 or 12, must agree, which the masks hit as well; one of fewer than 8 words is too short for
them and for any substitution: it is hashed whole, by a mask for each length, and all its words must follow each other.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegrain.llm.common import SMALL, WORD, Batches, bound_batches, column, fresh_path, put, taken

MASKS = ((0, 1, 2, 4, 5), (0, 1, 6, 8, 9), (0, 1, 3, 4, 5))
WINDOW, AGREE, SHORTEST = 13, 10, 8
#: Words of a block of the benchmark, about. A block's index takes about 100 bytes a word; documents are read once for each block.
BLOCK_WORDS = 250_000
#: Hits compared at once, and words of documents.
HITS, WORDS_AT_ONCE = 1 << 14, 1 << 17
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)
APART = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def least(n: int) -> int:
    """Words that must agree with an item of n words."""
    return AGREE if n >= WINDOW else n if n < SHORTEST else n - (2 if n > 10 else 1)


def words(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation parts them."""
    return (text or "").lower().encode().translate(APART).split()


class Index:
    """A block of the benchmark: word numbers, items one after the other with gaps, and for each mask the sorted hashes."""

    def __init__(self, items: list[tuple[object, list[bytes]]]):
        self.ids = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        gap, flat, item = [-1] * WINDOW, [-1] * WINDOW, [-1] * WINDOW
        for k, (_, ws) in enumerate(items):
            flat += [self.number.setdefault(w, len(self.number) + 1) for w in ws] + gap
            item += [k] * len(ws) + gap
        self.flat, self.item = np.array(flat, dtype=np.int32), np.array(item, dtype=np.int32)
        length = np.array([len(ws) for _, ws in items] or [0])
        self.need = np.array([least(n) for n in length.tolist()])
        self.tables = []
        short = [tuple(range(n)) for n in range(1, SHORTEST) if (length == n).any()]
        for mask in (*MASKS, *short):
            span = mask[-1] + 1
            at = np.flatnonzero(np.all([self.flat[o : len(self.flat) - span + 1 + o] > 0 for o in mask], axis=0))
            at = at[self.item[at] == self.item[at + mask[-1]]]
            # short items have a mask of their length, and no other
            own = length[self.item[at]]
            at = at[own == span if mask in short else own >= SHORTEST]
            h = self.hashes(self.flat, mask)[at]
            order = np.argsort(h, kind="stable")
            heads = np.zeros(1 << 20, dtype=bool)
            heads[(h >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((mask, h[order], at[order], heads))

    @staticmethod
    def hashes(flat: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
        n, x = len(flat) - mask[-1], flat.astype(np.uint64)
        return reduce(np.add, (x[o : o + n] * f for o, f in zip(mask, FACTORS)))

    def pairs(self, flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in flat and in the benchmark with equal hashes, some at a time."""
        for mask, h, at, heads in self.tables:
            mine = self.hashes(flat, mask)
            here = np.flatnonzero(heads[(mine >> np.uint64(44)).astype(np.int64)])
            first = np.searchsorted(h, mine[here], side="left")
            n = np.searchsorted(h, mine[here], side="right") - first
            here, first, n = here[n > 0], first[n > 0], n[n > 0]
            ends = np.cumsum(n)
            for start in range(0, int(ends[-1]) if len(ends) else 0, HITS):
                k = np.arange(start, min(start + HITS, int(ends[-1])))
                which = np.searchsorted(ends, k, side="right")
                yield here[which], at[first[which] + k - (ends - n)[which]]

    def overlaps(self, docs: list[str | None]) -> tuple[np.ndarray, ...]:
        """Document, item, most words that agree in a window, and place of the first such word, for each pair that overlaps."""
        found, part, size = [np.zeros((4, 0), dtype=np.int64)], [], 0
        get = self.number.get
        for k, x in enumerate(docs):
            ws = words(x)
            part.append(np.fromiter((get(w, 0) for w in ws), np.int32, len(ws)))
            size += len(ws)
            if size >= WORDS_AT_ONCE or k == len(docs) - 1:
                doc, *more = self.overlaps_of(part)
                found.append(np.array([doc + k + 1 - len(part), *more]))
                part, size = [], 0
        return tuple(np.concatenate(found, axis=1))

    def overlaps_of(self, docs: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """The same for word numbers; 0 stands for words that no item has."""
        gap = np.zeros(WINDOW, np.int32)
        one = np.concatenate([gap, *(x for d in docs for x in (d, gap))])
        begin = WINDOW + np.cumsum([0, *(len(d) + WINDOW for d in docs)])[:-1]
        found = [np.zeros((4, 0), dtype=np.int64)]
        around = np.arange(1 - WINDOW, WINDOW)
        for p, q in self.pairs(one):
            agree = one[p[:, None] + around] == self.flat[q[:, None] + around]
            sums = np.cumsum(np.pad(agree, ((0, 0), (1, 0))), axis=1, dtype=np.uint8)
            best = (sums[:, WINDOW:] - sums[:, :-WINDOW]).max(axis=1).astype(np.int64)
            ok = best >= self.need[self.item[q]]
            p, q, best = p[ok], q[ok], best[ok]
            doc = np.searchsorted(begin, p, side="right") - 1
            found.append(np.array([doc, self.item[q], best, p - begin[doc]]))
        doc, item, best, at = np.concatenate(found, axis=1)
        order = np.lexsort((at, -best, item, doc))
        doc, item, best, at = doc[order], item[order], best[order], at[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))[: len(doc)]
        return doc[new], item[new], best[new], at[new]


def blocks(benchmark: DataFrame) -> list[str]:
    """Files in the shared folder, each with the index of a block of the benchmark (item_id, text); executors make them, the driver gets their names."""
    spark = benchmark.sparkSession
    own = benchmark.select("item_id", "text")
    size = own.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    folder = fresh_path(spark, "benchmark-index")

    def pack(batches: Batches) -> Batches:
        held, n, names = [], 0, []

        def flush() -> None:
            names.append(f"{folder}/{uuid.uuid4().hex}")
            put(names[-1], [pickle.dumps(Index(held))])

        for batch in batches:
            for item, text in zip(column(batch, "item_id"), column(batch, "text")):
                ws = words(text)
                if not ws:
                    continue
                if held and n + len(ws) > 2 * BLOCK_WORDS:
                    flush()
                    held, n = [], 0
                held.append((item, ws))
                n += len(ws)
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["name"])

    made = own.repartition(max(1, -(-size // BLOCK_WORDS))).mapInArrow(pack, "name string")
    return sorted(r["name"] for r in made.collect())  # a row for each block


@lru_cache(maxsize=1)
def index_of(name: str) -> Index:
    """One at a time in each Python worker."""
    return pickle.loads(taken(name))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each pair of a row of docs (doc_id, text) and one of the benchmark (item_id, text) that overlap: doc_id, item_id,
    agree (equal words in the best window of 13) and word (place of the first hit in that window's alignment).

    Whole texts, however long, are searched in one narrow pass for each block of the benchmark, without a shuffle; a worker holds one
    block. Null and empty texts overlap nothing, and neither do items without words; null ids are kept; repeated rows give
    repeated pairs; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark, rows=1000)
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema, out = f"doc_id {kinds[0]}, item_id {kinds[1]}, agree bigint, word bigint", []
    for name in blocks(benchmark):

        def run(batches: Batches, name=name) -> Batches:
            index = index_of(name)
            for batch in batches:
                doc, item, best, at = index.overlaps(column(batch, "text"))
                ids = pa.array([index.ids[k] for k in item.tolist()], pa.int64()) if kinds[1] == "bigint" else pa.array([index.ids[k] for k in item.tolist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), ids, pa.array(best), pa.array(at)], names=["doc_id", "item_id", "agree", "word"])

        out.append(docs.select("doc_id", "text").mapInArrow(run, schema))
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], schema)


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that overlap an item, in docs' columns. Cases as in contaminated()."""
    spark = docs.sparkSession
    bound_batches(spark, **SMALL)
    for name in blocks(benchmark):

        def run(batches: Batches, name=name) -> Batches:
            index = index_of(name)
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[index.overlaps(column(batch, "text"))[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
