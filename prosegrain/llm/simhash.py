"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt by radius + 1 blocks of their bits: two within the radius agree in one block at least, so only
fingerprints that share a block meet. There they are sorted by population count and compared tile by tile with numpy
exclusive-or and bit counts; what lies beyond the radius by population count alone is skipped. A block that very many
fingerprints share is dealt out as pairs of tiles, each a task's group of its own. Nothing within the radius is missed, and a
group yields a spanning forest of its links, never all pairs; distributed connected components join the forests.

one_of_each() of the pipeline needs a similarity of sets, which majority bits only estimate. Sets that are similar agree in whole parts, so
only such sets meet. Its fingerprints are parity bits, which differ in no more places than the sets in elements: the same
exclusive-or and bit counts then miss nothing, and what they let through is compared set by set.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosegrain.llm.common import SMALL, Batches, Maybe, bound_batches, column, components, cut, discard, rows_of

SEED = 42
#: Elements of a comparison in memory at once, and pairs of 512-bit fingerprints.
CELLS, STEP = 1 << 19, 1 << 16
#: Rows of a tile; groups of more rows are dealt out as pairs of tiles.
TILE = 1 << 14
#: Orders in which the texts of a group meet their neighbours before all other pairs are looked at.
ORDERS = tuple(range(1, 7))
#: Groups in which a text meets its neighbours; near copies of one text have hundreds of groups in common.
MEETINGS = 8


def shingles(text: str | None, words: int) -> Iterable[bytes]:
    """Space-joined runs of so many words, A-Z in lower case, repeats included; of fewer words, the whole sequence."""
    ws = (text or "").encode().lower().split()
    if len(ws) <= words:
        return [b" ".join(ws)] if ws else []
    return map(b" ".join, zip(*(ws[i:] for i in range(words))))


def fingerprint(text: str | None, words: int) -> int:
    """64 bits as a signed number. A bit is 1 if set in over half the shingles' hashes; no words give zero."""
    h = np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles(text, words)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, f0. docs: doc_id, text."""
    bound_batches(docs.sparkSession)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield rows_of(batch, ["doc_id"], f0=pa.array([fingerprint(x, words) for x in column(batch, "text")], pa.int64()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, f0 bigint")


def counts(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


class Forest:
    """Smallest linked place of each of n places, kept by pointer jumping."""

    def __init__(self, n: int):
        self.low = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        low = self.low
        while len(i):
            a, b = low[i], low[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
            while (low[low] != low).any():
                low[:] = low[low]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(self.low != np.arange(len(self.low)))
        return own, self.low[own]


def links(f0: np.ndarray, radius: int, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of fingerprints, of the links within radius: tiles sorted by population count, each compared with itself and
    the tiles after it whose counts are within the radius."""
    pop = counts(f0).astype(np.int64)
    order = np.argsort(pop, kind="stable")
    f, pop = f0[order], pop[order]
    forest = Forest(len(f))
    for k in range(0, len(f), step):
        last = int(np.searchsorted(pop, pop[min(k + step, len(f)) - 1] + radius, side="right"))
        for m in range(k, last, CELLS // step):
            i, j = np.nonzero(counts(f[k : k + step, None] ^ f[None, m : min(last, m + CELLS // step)]) <= radius)
            ok = i + k < j + m
            forest.link(i[ok] + k, j[ok] + m)
    own, low = forest.edges()
    return f[own], f[low]


def tiled(rows: DataFrame, keys: list[str], by: str, at: str, reach: int, tile: int) -> DataFrame:
    """rows with lo and hi, which part the groups of equal keys. Both are 0 in a group of `tile` rows at most. The rows of a larger group lie in
    tiles, by the column `at` and a hash of the column `by`; lo and hi are a pair of tiles whose `at` differ by `reach` at most,
    and a row comes once for each pair that its tile is in. So two rows of a group whose `at` are that near meet somewhere."""
    hot = cut(rows.groupBy(*keys).count().where(F.col("count") > tile).drop("count"), "hot")
    if hot.isEmpty():
        return rows.withColumn("lo", F.lit(0).cast("long")).withColumn("hi", F.lit(0).cast("long"))
    cold = rows.join(hot, keys, "left_anti").withColumn("lo", F.lit(0).cast("long")).withColumn("hi", F.lit(0).cast("long"))
    warm = rows.join(hot, keys, "left_semi")
    chunks = warm.groupBy(*keys, at).agg(F.ceil(F.count("*") / tile).alias("chunks"))
    chunks = cut(chunks.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(at, "chunks"))).alias("held")), "chunks")  # a few numbers for each hot group
    spread = warm.join(chunks, keys).withColumn("own", F.col(at).cast("long") * (1 << 32) + F.pmod(F.xxhash64(by), F.element_at("held", F.col(at))))
    others = F.expr(f"flatten(transform(sequence({at} - {reach}, {at} + {reach}), p -> transform(sequence(0L, coalesce(element_at(held, p), 0L)), c -> if(c < coalesce(element_at(held, p), 0L), cast(p as bigint) * {1 << 32} + c, null))))")
    spread = spread.withColumn("other", F.explode(F.array_compact(others)))
    spread = spread.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    return cold.unionByName(spread.select(cold.columns))


def grouped(batches: Batches, keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Columns of whole groups, some groups at a time, with the groups' starts and ends. Rows come sorted by the first `keys` columns; only the
    group that a batch ends in is held for the next."""
    held: list[list[np.ndarray]] = []

    def parted(cols: list[np.ndarray]) -> np.ndarray:
        new = np.zeros(len(cols[0]), dtype=bool)
        new[:1] = True
        for x in cols[:keys]:
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(x) for x in batch.columns]
        starts = parted(cols)
        if held and any(x[-1] != y[0] for x, y in zip(held[-1][:keys], cols[:keys])):
            whole = [np.concatenate(x) for x in zip(*held)]
            yield whole, np.array([0]), np.array([len(whole[0])])
            held = []
        if len(starts) > 1:
            first, last = [x[: starts[-1]] for x in cols], [x[starts[-1] :] for x in cols]
            whole = [np.concatenate(x) for x in zip(*held, first)]
            begin = parted(whole)
            yield whole, begin, np.append(begin[1:], len(whole[0]))
            held = [last]
        else:
            held.append(cols)
    if held:
        whole = [np.concatenate(x) for x in zip(*held)]
        yield whole, np.array([0]), np.array([len(whole[0])])


def block_edges(nodes: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Forests (a, b) of the links within radius of different fingerprints (f0), group by group of equal blocks of bits."""
    k = radius + 1
    ends = [64 * i // k for i in range(k + 1)]
    keys = F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(F.shiftleft("f0", 64 - hi), 64 - hi + lo).alias("bits")) for i, (lo, hi) in enumerate(zip(ends, ends[1:]))))
    dealt = nodes.select("f0", F.bit_count("f0").alias("pop"), F.explode(keys).alias("key")).select("f0", "pop", "key.*")
    dealt = tiled(dealt, ["block", "bits"], "f0", "pop", radius, tile)
    by = ["block", "bits", "lo", "hi"]
    dealt = dealt.repartition(*by).sortWithinPartitions(*by).select(*by, "f0")

    def run(batches: Batches) -> Batches:
        for cols, starts, stops in grouped(batches, 4):
            pairs = [links(cols[4][s:e], radius) for s, e in zip(starts.tolist(), stops.tolist()) if e - s > 1]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*pairs)], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, fingerprint (16 hexadecimal digits), component_id.

    64 bits over shingles of `words` words, of whole texts however long; a link is `radius` differing bits or fewer (3 at most are
    sensible); component_id is the smallest doc_id reachable. Null and empty texts have fingerprint zero, which links like any
    other. A row without doc_id takes part in links; component_id is null only if nothing reachable has an id. Repeated rows
    are rows of their own; an empty table gives an empty result; other columns of docs are not read.
    """
    prints = cut(fingerprints(docs, words), "fingerprints")
    nodes = cut(prints.groupBy("f0").agg(F.min("doc_id").alias("rep")), "nodes")
    edges = cut(block_edges(nodes, radius), "links")
    grown = cut(nodes.join(components(edges), F.col("f0") == F.col("node"), "left").select("f0", "rep", F.coalesce("root", "f0").alias("root")), "rooted")
    ids = grown.groupBy("root").agg(F.min("rep").alias("component_id"))
    its = grown.join(ids, "root").select(F.col("f0").alias("its"), "component_id")
    out = prints.join(its, F.col("f0") == F.col("its"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def distinct_shingles(text: str | None, words: int) -> np.ndarray:
    """Hashes of the different shingles, sorted."""
    return np.unique(np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles(text, words)], dtype="<u8"))


def set_key(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def parities(h: np.ndarray, bits: int = 512) -> bytes:
    """So many bits, a power of two: whether an odd number of hashes begins with each nine bits (of 512). Those of two sets differ in no more bits than the sets in elements."""
    return np.packbits(np.bincount((h >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1).tobytes()


def wide_parities(h: np.ndarray) -> bytes:
    """Parities of two bits or more for each hash, as 512 tell long sets apart no more."""
    return parities(h, 1 << max(9, (2 * len(h) - 1).bit_length()))


def needed(n: np.ndarray, share: Fraction) -> np.ndarray:
    """The least whole number that is share * n or more."""
    return -(-share.numerator * n // share.denominator)


def set_node(h: np.ndarray, salt: int) -> int:
    """A signed number of the set, which only a clash of 64 bits gives to another one as well."""
    return int(np.array(xxhash.xxh3_64_intdigest(h.tobytes(), salt), dtype="<u8").view("<i8"))


def shingle_sets(docs: DataFrame, words: int, salt: int) -> DataFrame:
    """doc_id, mark (hash of the text), node and key (of the set of shingles), d (its size), bits and wide (parities)."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            got = [distinct_shingles(x, words) for x in column(batch, "text")]
            keys, sizes = pa.array(map(set_key, got), pa.binary()), pa.array(map(len, got), pa.int64())
            yield rows_of(batch, ["doc_id", "mark"], node=pa.array([set_node(h, salt) for h in got], pa.int64()), key=keys, d=sizes, bits=pa.array(map(parities, got), pa.binary()), wide=pa.array(map(wide_parities, got), pa.binary()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(run, f"doc_id {kind}, mark bigint, node bigint, key binary, d bigint, bits binary, wide binary")


class Parts:
    """Keys of sets, of which two sets of similarity `least` or more have one in common, whatever they are.

    Classes of sizes grow by 1 / least, so the sets of such a pair are of one class or of two that follow each other. A set meets its own and
    the next class in one round, the class before in another. In a round, hashes are dealt by their first bits to more parts than elements
    that only one of two sets can have, so the sets agree in some parts. A set has keys for its largest parts, one more than elements that it
    and any partner can differ by: of the one whose parts reach less far down, one part agrees with the other set, which then has it as well, as
    all go by the same order of parts. With SPARE parts more, the largest ones hold two hashes or more but for small sets, so
    texts that share one shingle by chance do not meet. A set with too few parts that are not empty adds its first hashes, of which two
    such sets share one.
    """

    #: Parts beyond those that may differ, as a share of these.
    SPARE = Fraction(1, 4)

    def __init__(self, least: Fraction):
        self.least, self.begins = least, [1]

    def size_class(self, d: int) -> int:
        while self.begins[-1] <= d:
            self.begins.append(self.begins[-1] * self.least.denominator // self.least.numerator + 1)
        return bisect_right(self.begins, d) - 1

    def most_apart(self, d: int, other: int) -> int:
        """Elements that sets of d and of `other` elements at most, of similarity `least`, do not share, at most."""
        p, q = self.least.numerator, self.least.denominator
        return (d + min(other, d * q // p)) * (q - p) // (q + p)

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Keys of a set of sorted hashes."""
        d = len(h)
        if not d:
            return np.zeros(0, dtype="<i8")
        c = self.size_class(d)
        self.size_class(self.begins[c + 1])
        mixed, out = scrambled(h, 1), []
        for t in (c, c + 1):
            if not t:  # no set is smaller
                continue
            # the smaller set of a round is of class t - 1, the larger one of it or of class t
            apart = self.most_apart(d, self.begins[t] - 1 if t == c else self.begins[t + 1] - 1)
            if not apart:  # such sets are equal
                continue
            most = self.most_apart(self.begins[t] - 1, self.begins[t + 1] - 1)
            n = most + 1 + int(most * self.SPARE)
            part = (h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
            starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            size = np.diff(np.append(starts, d))
            keys = scrambled(np.add.reduceat(mixed, starts) + part[starts] * np.uint64(0xD6E8FEB86659FD93), 2 * t)
            out.append(keys[np.lexsort((keys, -size))[: apart + 1]])
            if len(starts) <= apart:
                out.append(scrambled(mixed[: d - int(needed(d, self.least)) + 1], 2 * t + 1))
        return np.concatenate([np.zeros(0, "<u8"), *out]).view("<i8")


def met(docs: DataFrame, words: int, least: Fraction, salt: int) -> DataFrame:
    """h, node, d: groups h of nodes that have a key of Parts in common, two nodes or more. Keys with the same nodes are one group."""

    def deal(batches: Batches) -> Batches:
        parts, seen = Parts(least), set()
        for batch in batches:
            keys, nodes, sizes = [], [], []
            for text in column(batch, "text"):
                h = distinct_shingles(text, words)
                if (node := set_node(h, salt)) not in seen:
                    seen.add(node)
                    keys.append(parts.keys(h))
                    nodes.append(node)
                    sizes.append(len(h))
            each = np.array([len(x) for x in keys], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, "<i8"), *keys])), *(pa.array(np.repeat(np.array(x, dtype="<i8"), each)) for x in (nodes, sizes))], names=["h", "node", "d"])

    dealt = docs.select("text").mapInArrow(deal, "h bigint, node bigint, d bigint").repartition("h").sortWithinPartitions("h", "node")

    def run(batches: Batches) -> Batches:
        for (h, node, d), _, _ in grouped(batches, 1):
            # copies of one text in several tasks
            once = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1]))
            h, node, d = h[once], node[once], d[once]
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            n = np.diff(np.append(starts, len(h)))
            same = np.repeat(np.add.reduceat(scrambled(node, 3), starts).view("<i8"), n)
            more = np.repeat(n > 1, n)
            yield pa.RecordBatch.from_arrays([pa.array(x[more]) for x in (same, node, d)], names=["h", "node", "d"])

    return dealt.mapInArrow(run, "h bigint, node bigint, d bigint").distinct()


def sized(d: np.ndarray, i: np.ndarray, j: np.ndarray, least: Fraction) -> np.ndarray:
    """Whether the sizes of rows i and j are near enough for a similarity of `least`."""
    return least.denominator * np.minimum(d[i], d[j]) >= least.numerator * np.maximum(d[i], d[j])


def scrambled(x: np.ndarray, seed: int) -> np.ndarray:
    """A fixed order of node numbers for each seed."""
    y = (x.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def as_pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Different pairs, the smaller node first."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return pa.RecordBatch.from_arrays([pa.array(low[new]), pa.array(high[new])], names=["a", "b"])


def near_bits(p: np.ndarray, q: np.ndarray, n: np.ndarray, least: Fraction) -> np.ndarray:
    """Whether parities differ in no more bits than sets of similarity `least` and sizes of sum n in elements."""
    apart = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64)
    return (least.denominator - least.numerator) * n >= (least.denominator + least.numerator) * apart


def once(found: Iterable[tuple[np.ndarray, np.ndarray]], most: int = 1 << 18) -> Batches:
    """as_pairs() of a task's pairs, each pair once as long as no more than about `most` are held: near copies meet in very many groups."""
    held, n = [], 0
    for a, b in found:
        held.append((a, b))
        n += len(a)
        if n >= most:
            batch = as_pairs(*map(np.concatenate, zip(*held)))
            held, n = [tuple(map(np.asarray, batch.columns))], batch.num_rows
            if 2 * n > most:
                yield batch
                held, n = [], 0
    if n:
        yield as_pairs(*map(np.concatenate, zip(*held)))


def neighbours(shared: DataFrame, least: Fraction, nodes: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b): each node of a group with the next in a few orders that are the same for all groups, so that near copies of one
    text are joined by about as many pairs as they are. A node does so in MEETINGS groups, the first in an order that is the same for all
    nodes, so there are no more than a number of pairs for each node, however large and many its groups are; others() looks at all that stays apart.
    nodes: node, bits; with it, pairs whose parities differ too much are left out."""
    first = Window.partitionBy("node").orderBy(F.xxhash64("h"), "h")
    few = shared.withColumn("at", F.row_number().over(first)).where(F.col("at") <= MEETINGS)
    few = few.join(nodes.select("node", "bits"), "node") if nodes else few.withColumn("bits", F.lit(bytes(64)))
    dealt = few.repartition("h").sortWithinPartitions("h").select("h", "node", "d", "bits")

    def found(batches: Batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for (h, node, d, bits), _, _ in grouped(batches, 1):
            bits = np.frombuffer(b"".join(bits.tolist()), dtype="<u8").reshape(-1, 8)
            for seed in ORDERS:
                order = np.lexsort((scrambled(node, seed), h))
                i, j = order[:-1], order[1:]
                ok = (h[i] == h[j]) & sized(d, i, j, least)
                i, j = i[ok], j[ok]
                ok = near_bits(bits[i], bits[j], d[i] + d[j], least)
                yield node[i[ok]], node[j[ok]]

    return dealt.mapInArrow(lambda batches: once(found(batches)), "a bigint, b bigint").distinct()


def others(shared: DataFrame, roots: DataFrame, nodes: DataFrame, least: Fraction, tile: int = TILE) -> DataFrame:
    """Pairs (a, b) of a group's nodes that no link joins yet and whose fingerprints are near enough. roots: node, root; nodes: node, bits."""
    labelled = shared.join(roots, "node", "left").select("h", "node", "d", F.coalesce("root", "node").alias("root"), F.lit(0).alias("one"))
    apart = labelled.groupBy("h").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("h")
    labelled = cut(labelled.join(apart, "h", "left_semi").join(nodes.select("node", "bits"), "node"), "apart")
    by = ["h", "lo", "hi"]
    dealt = tiled(labelled, ["h"], "node", "one", 0, tile).repartition(*by).sortWithinPartitions(*by, "root").select(*by, "root", "node", "d", "bits")

    def found(batches: Batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for cols, starts, stops in grouped(batches, 3):
            root, node, d, bits = cols[3:]
            bits = np.frombuffer(b"".join(bits.tolist()), dtype="<u8").reshape(-1, 8)
            stop = np.repeat(stops, stops - starts)
            new = np.ones(len(root), dtype=bool)
            new[1:] = root[1:] != root[:-1]
            new[starts] = True
            heads = np.flatnonzero(new)
            # a row meets those of its group that belong to a later root
            first = np.append(heads[1:], len(root))[np.cumsum(new) - 1]
            n = stop - first
            ends = np.cumsum(n)
            for k0 in range(0, int(ends[-1]) if len(ends) else 0, STEP):
                k = np.arange(k0, min(k0 + STEP, int(ends[-1])))
                i = np.searchsorted(ends, k, side="right")
                j = first[i] + k - (ends - n)[i]
                ok = sized(d, i, j, least)
                i, j = i[ok], j[ok]
                ok = near_bits(bits[i], bits[j], d[i] + d[j], least)
                yield node[i[ok]], node[j[ok]]

    return dealt.mapInArrow(lambda batches: once(found(batches)), "a bigint, b bigint").distinct()


def near_wide(x: bytes, y: bytes, n: int, least: Fraction) -> bool:
    """near_bits() of wide parities; neighbouring bits of the longer ones are joined until both have one length."""
    p, q = (np.frombuffer(z, np.uint8) for z in (x, y))
    if len(p) < len(q):
        p, q = q, p
    while len(p) > len(q):
        each = np.unpackbits(p)
        p = np.packbits(each[::2] ^ each[1::2])
    return (least.denominator - least.numerator) * n >= (least.denominator + least.numerator) * int(np.bitwise_count(p ^ q).sum(dtype=np.int64))


def possible(nodes: DataFrame, pairs: DataFrame, least: Fraction) -> DataFrame:
    """pairs (a, b) without those whose wide parities differ in more bits than sets of similarity `least` in elements. nodes: node, d, wide."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield batch.filter(pa.array([near_wide(*x, least) for x in zip(*(batch.column(k).to_pylist() for k in (3, 4, 2)))], pa.bool_())).select(["a", "b"])

    a, b = (nodes.select(F.col("node").alias(x), F.col("d").alias(f"d_{x}"), F.col("wide").alias(f"wide_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", (F.col("d_a") + F.col("d_b")).alias("n"), "wide_a", "wide_b").mapInArrow(run, "a bigint, b bigint")


def similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, least: Fraction, salt: int) -> DataFrame:
    """Those of pairs (a, b) whose sets of shingles have a similarity of `least` or more, as a written table. nodes: node, mark."""
    bound_batches(docs.sparkSession, **SMALL)
    want = cut(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "mark"), "wanted")

    def run(batches: Batches) -> Batches:
        seen = set()
        for batch in batches:
            got = {}
            for text in column(batch, "text"):
                h = distinct_shingles(text, words)
                if (node := set_node(h, salt)) not in seen:
                    seen.add(node)
                    got[node] = h.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(got.keys(), pa.int64()), pa.array(got.values(), pa.binary())], names=["node", "h"])

    # texts stay where they are; only the sets of those that pass the filter are shuffled
    asked = Maybe(want.select("mark")).flag(docs.select("text", F.xxhash64("text").alias("mark")), "mark").where("maybe").select("text")
    sets = cut(asked.mapInArrow(run, "node bigint, h binary").join(want.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("h_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("h").alias("h_b")), "b")

    def verify(batches: Batches) -> Batches:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(z.as_buffer(), "<u8") for z in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(least.denominator * both >= least.numerator * (len(p) + len(q) - both))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    out = cut(both.select("a", "b", "h_a", "h_b").mapInArrow(verify, "a bigint, b bigint"), "links")
    discard(want, sets)
    return out


def linked(docs: DataFrame, nodes: DataFrame, words: int, least: Fraction, salt: int) -> DataFrame:
    """node, root of the nodes that links of similarity `least` or more join; nothing is missed. nodes: node, mark, d, bits, wide."""
    spark = docs.sparkSession

    def verified(pairs: DataFrame) -> DataFrame:
        bound_batches(spark, rows=20_000, mb=4)
        near = cut(possible(nodes, pairs, least), "possible")
        out = similar(docs, nodes, near, words, least, salt)
        discard(pairs, near)
        return out

    bound_batches(spark, rows=50_000, mb=4)
    shared = cut(met(docs, words, least, salt), "shared")
    edges = verified(cut(neighbours(shared, least, nodes), "neighbours"))
    roots = cut(components(edges), "roots")
    bound_batches(spark, rows=20_000, mb=4)
    more = verified(cut(others(shared, roots, nodes, least), "others"))
    discard(shared)
    # the second links join what the first ones left: components of roots, through which the nodes go
    ends = more
    for x in "ab":
        ends = ends.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left").withColumn(f"root_{x}", F.coalesce(f"root_{x}", x))
    joined = cut(components(ends.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))), "joined").select(F.col("node").alias("its"), F.col("root").alias("top"))
    old = roots.join(joined, F.col("root") == F.col("its"), "left").select("node", F.coalesce("top", "root").alias("root"))
    return old.unionByName(joined.join(roots, F.col("its") == F.col("node"), "left_anti").select(F.col("its").alias("node"), F.col("top").alias("root")))


def one_of_each(docs: DataFrame, words: int = 5, ratio: float = 0.8) -> DataFrame:
    """docs without near-duplicates: of each group the row with the smallest doc_id stays, in docs' columns.

    A link is a Jaccard similarity of `ratio` or more of the sets of shingles of whole texts, however long, computed from the sets
    themselves; a group is what links reach. Candidates come from parts of the sets that agree, which miss no pair; near copies of one
    text meet a few others of their group each, and all other pairs are looked at only between texts that these links leave apart.
    Of rows that agree in doc_id and text one stays; a row without doc_id stays if nothing in its group has one. Null and empty
    texts are near-duplicates of each other; an empty table gives an empty result; other columns may have any names.
    """
    bound_batches(docs.sparkSession, **SMALL)
    least = Fraction(str(ratio))
    for salt in range(9):
        sets = cut(shingle_sets(docs, words, salt), "shingle-sets")
        # one node for each different set; should two sets ever have one number, others are tried
        nodes = cut(sets.groupBy("node").agg(F.min("mark").alias("mark"), F.first("d").alias("d"), F.first("bits").alias("bits"), F.first("wide").alias("wide"), F.min("key").alias("key"), F.max("key").alias("most")), "nodes")
        if nodes.where("key <> most").isEmpty():
            break
        discard(sets, nodes)
    else:
        raise RuntimeError("sets of shingles clash under all salts")
    found = cut(sets.groupBy("doc_id", "mark", "node").count(), "rows")
    discard(sets)
    roots = linked(docs, nodes, words, least, salt)
    grouped_ = cut(found.join(roots, "node", "left").select("doc_id", "mark", "count", F.coalesce("root", "node").alias("group")), "groups")
    discard(nodes)
    first = grouped_.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("stays"), F.sum("count").alias("rows"))
    first = cut(first.where("rows > 1").select("group", F.col("stays.doc_id").alias("its_id"), F.col("stays.mark").alias("its_mark")), "first")
    stays = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("mark") == F.col("its_mark"))
    # what goes, and what stays but comes more than once
    listed = cut(grouped_.join(first, "group").select("doc_id", F.col("mark").alias("its_mark"), stays.alias("stays"), "count").where("not stays or count > 1").withColumnRenamed("doc_id", "its_id"), "listed")
    # the row travels as one struct, so that no name of its columns can clash; only rows that may be listed are shuffled
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"))
    packed = Maybe(listed.select(F.col("its_mark").alias("mark"))).flag(packed, "mark")
    asked = packed.where("maybe").join(listed, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("mark") == F.col("its_mark")), "left")
    again = asked.where("stays").dropDuplicates(["id", "mark"]).select("row.*")
    return packed.where("not maybe").select("row.*").unionByName(asked.where("stays is null").select("row.*")).unionByName(again)
