import itertools

import numpy as np

from prosegrain.llm import decontamination as d


def brute(docs, items):
    """Pairs with a window of 13 aligned words of which 10 agree, or all but one (two from 11 on, none below 8) of a shorter item's."""
    out = set()
    for i, t in docs:
        a = d.words(t)
        for k, s in items:
            b = d.words(s)
            if not b:
                continue
            need = 10 if len(b) >= 13 else len(b) - 2 if len(b) > 10 else len(b) - 1 if len(b) > 7 else len(b)
            for shift in range(-len(b), len(a) + 1):
                eq = np.array([0 <= j + shift < len(a) and a[j + shift] == w for j, w in enumerate(b)] + [False] * d.WINDOW, dtype=int)
                if np.convolve(eq, np.ones(d.WINDOW, int)).max() >= need:
                    out.add((i, k))
                    break
    return out


def test_masks_hit_every_window():
    assert [d.least(n) for n in (1, 7, 8, 10, 11, 12, 13, 90)] == [1, 7, 7, 9, 9, 10, 10, 10]
    for n in range(d.SHORTEST, d.WINDOW + 1):
        for gone in itertools.combinations(range(n), n - d.least(n)):
            assert any(all(at + o not in gone for o in mask) for mask in d.MASKS for at in range(n - mask[-1])), gone


def test_pairs_match_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"v{k}" for k in range(400)])
    items = [(k, " ".join(vocabulary[rng.integers(0, 400, n)])) for k, n in enumerate([30, 60, 13, 12, 9, 8, 7, 3, 90, 25])] + [(20, None), (21, ""), (22, "Same, words: here.")]
    docs = []
    for i in range(60):
        ws = list(vocabulary[rng.integers(0, 400, 80)])
        if i % 3:
            passage = items[i % 10][1].split()
            passage = passage[: max(8, len(passage) // (1 + i % 2))]
            for at in rng.choice(len(passage), min(i % 6, len(passage)), replace=False):
                passage[at] = "swapped"
            ws[20:20] = [w.upper() + "," if i % 4 == 0 else w for w in passage]
        docs.append((i, " ".join(ws)))
    docs += [(100, None), (101, ""), (102, "x"), (None, items[0][1]), (0, docs[0][1]), (103, "and " + items[7][1].upper() + "; so on"), (104, items[6][1]), (105, items[6][1].rsplit(" ", 1)[0]), (106, "x y " * 200_000 + items[0][1]), (107, "Unbroken" * 200_000)]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, agree int")
    bench = spark.createDataFrame([(k, t, 5) for k, t in items], "item_id long, text string, doc_id int")
    got = d.contaminated(frame, bench).collect()
    want = brute(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and want
    kept = d.without_benchmark(frame, bench)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((i for i, _ in docs if i not in {x for x, _ in want}), key=repr)
    blocks, d.BLOCK_WORDS = d.BLOCK_WORDS, 60  # several blocks give the same pairs
    try:
        assert {(r["doc_id"], r["item_id"]) for r in d.contaminated(frame, bench).collect()} == want
    finally:
        d.BLOCK_WORDS = blocks
    assert d.contaminated(frame.limit(0), bench).collect() == d.contaminated(frame, bench.limit(0)).collect() == []


def test_planted_items_are_found(spark, sf_more):
    docs, bench = (spark.read.parquet(f"{sf_more}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = [(r["doc_id"], " ".join(r["text"].lower().split())) for r in docs.where("text is not null").collect()]
    items = [(r["item_id"], " ".join(r["text"].lower().split()).rstrip(".")) for r in bench.collect()]
    planted = {(i, k) for k, s in items for i, t in texts if s in t}
    got = {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, bench).collect()}
    assert planted and planted <= got
