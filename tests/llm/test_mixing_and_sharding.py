import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from prosegrain.llm import mixing
from prosegrain.llm.common import cut
from prosegrain.llm.mixing import mix, mix_plan
from prosegrain.llm.sharding import minimax_cuts, shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_filling(sizes, share=1.5, most=2.0):
    """Targets by repeated sharing of the excess."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(target.values())
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / w for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def test_mix_meets_its_targets(spark, sf_more):
    docs = spark.read.parquet(f"{sf_more}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()] + [(-1, None, None), (-2, "a b c", None), (-3, "", "empty"), (None, "x y", "web"), (-4, "p q r", "tie"), (-4, "p q r", "tie")]
    frame = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, source string, size string, rank int")
    got = mix_plan(frame).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    want = water_filling(size)
    source = {(i, len(WORD.findall(t or ""))): s for i, t, s in rows}
    taken, largest = Counter(), Counter()
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == size[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert r["taken"] % max(1, r["size"]) == 0 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in size)
    again = mix_plan(frame.repartition(5, "text")).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    whole = mix(frame)
    assert whole.columns == frame.columns
    copies = Counter(map(tuple, whole.collect()))
    plan = {(r["doc_id"], r["size"]): r["taken"] for r in got}
    twice = Counter((i, t, s) for i, t, s in rows)
    for (i, t, s, *_), n in copies.items():
        words = len(WORD.findall(t or ""))
        assert n * words == plan[i, words] * twice[i, t, s]
    assert sum(len(WORD.findall(k[1] or "")) * n for k, n in copies.items()) == sum(taken.values())
    assert mix_plan(frame.limit(0)).collect() == mix(frame.limit(0)).collect() == []


def test_documents_are_included_with_their_own_probabilities(spark):
    """Over many seeds, the copies of documents of each size come to the expected ones, which fall with the size, and each source has its size."""
    rng = np.random.default_rng(5)
    sizes = [4] * 60 + [20] * 60 + [90] * 60 + [400] * 30
    rows = [(k, " ".join(["w"] * n), "ab"[k % 2]) for k, n in enumerate(rng.permutation(sizes).tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size, of = {k: len(t.split()) for k, t, _ in rows}, {k: s for k, _, s in rows}
    total = Counter()
    for k, s in of.items():
        total[s] += size[k]
    want = water_filling(total)
    sized = cut(docs.select(F.col("doc_id").alias("id"), mixing.key_of().alias("mark"), "source", mixing.size_of(F.col("text")).alias("size")), "test-sizes")
    classes = cut(sized.groupBy("source", mixing.class_of(F.col("size")).alias("class")).agg(F.sum("size").alias("words")), "test-classes")
    plan = {(r["its_source"], r["its_class"]): r for r in mixing.expected(classes, 1.5, 2.0).collect()}
    ratio = {k: r["certain"] + r["p"] for k, r in plan.items()}
    for s in "ab":
        words = {c: sum(n for k, n in size.items() if of[k] == s and n.bit_length() - 1 == c) for c in (2, 4, 6, 8)}
        assert abs(sum(ratio[s, c] * n for c, n in words.items()) - want[s]) < 1e-6 * want[s]
        falls = [ratio[s, c] for c in (2, 4, 6, 8)]
        assert falls == sorted(falls, reverse=True) and max(falls) <= 2
        assert all(abs(a * mixing.EVEN**2 - b) < 1e-9 for a, b in zip(falls, falls[1:]) if a < 2)
    assert len({round(r["p"], 6) for r in plan.values() if r["p"] > 0}) >= 4
    seeds, got = 24, Counter()
    for seed in range(seeds):
        taken = Counter()
        for r in mix_plan(docs, seed=seed).collect():
            taken[of[r["doc_id"]]] += r["taken"]
            got[of[r["doc_id"]], size[r["doc_id"]].bit_length() - 1] += r["taken"] // r["size"]
        assert all(abs(taken[s] - want[s]) <= 400 for s in "ab")
    for (s, c), n in got.items():
        docs_of = sum(of[k] == s and x.bit_length() - 1 == c for k, x in size.items())
        deviation = math.sqrt(max(1e-9, plan[s, c]["p"] * (1 - plan[s, c]["p"]) / (seeds * docs_of)))
        assert abs(n / seeds / docs_of - ratio[s, c]) <= 5 * deviation + 0.02, (s, c)


def least_capacity(sizes, shards):
    n, best = len(sizes), None
    for cuts in itertools.combinations_with_replacement(range(n + 1), shards - 1):
        ends = [0, *cuts, n]
        most = max(sum(sizes[a:b]) for a, b in zip(ends, ends[1:]))
        best = most if best is None else min(best, most)
    return best


def test_cuts_are_minimax():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sizes = rng.integers(0, 12, rng.integers(1, 9))
        k = int(rng.integers(1, 5))
        ends = [0, *minimax_cuts(sizes, k), len(sizes)]
        assert len(ends) == k + 1 and ends == sorted(ends)
        assert max(int(sizes[a:b].sum()) for a, b in zip(ends, ends[1:])) == least_capacity(sizes.tolist(), k)


def test_shards(spark, sf_more):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_more}/documents.parquet").collect()]
    rows += [(-1, None), (-2, ""), (None, "no id"), (-7, "again"), (-7, "again")] + [(100_000 + k, "the same text") for k in range(300)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, shard int, slot int")
    got = shards(docs).collect()
    sizes, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    text = {i: t for i, t in rows}
    for r in got:
        t = text[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t.encode()) + 16, zlib.crc32(t.encode()), "bytes", None)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[t].add(r["shard"])
    assert len(got) == len(rows) and set(sizes) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    largest = max(Counter(t for i, t in rows for t in [t or ""]).items(), key=lambda x: x[1] * (len(x[0].encode()) + 16))
    assert max(sizes.values()) <= sum(sizes.values()) / 40 + largest[1] * (len(largest[0].encode()) + 16)
    assert shards(docs.limit(0)).collect() == []
    assert sorted(map(repr, shards(docs.repartition(3)).collect())) == sorted(map(repr, got))
