import re
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from prosegrain.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    ws = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    """Smallest id reachable from each fingerprint; None counts as no id."""
    f = np.array(sorted({p for _, p in prints}), dtype=np.uint64)
    root = list(range(len(f)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[k] ^ f[k + 1 :]) <= 2) + k + 1:
            a, b = find(k), find(int(j))
            root[max(a, b)] = min(a, b)
    group = {int(p): find(k) for k, p in enumerate(f)}
    low = {}
    for i, p in prints:
        if i is not None:
            low[group[p]] = min(i, low.get(group[p], i))
    return {p: low.get(g) for p, g in group.items()}


def test_components_match_brute_force(spark, sf_more):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_more}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-1, None), (-2, ""), (-3, " \n"), (-4, "One two"), (-5, "one TWO"), (-6, "É é \u00a0x"), (-7, "a b " * 5000), (-7, "a b " * 5000), (None, rows[3][1]), (None, "no id at all"), (-8, "unbroken" * 200_000)]
    got = {(r[0], r[1], r[2]) for r in simhash.simhash_components(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, f0 int, component_id int")).collect()}
    prints = {(i, fingerprint(t)) for i, t in rows}
    root = components(prints)
    assert got == {(i, f"{p:016x}", root[p]) for i, p in prints}


def test_null_ids_ties_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (9, "a b c d"), (None, "only here now"), (3, "a b c d"), (3, "a b c d")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.simhash_components(docs).collect()), key=repr)
    assert got == sorted([(None, 3), (9, 3), (None, None), (3, 3), (3, 3)], key=repr)
    assert simhash.simhash_components(docs.limit(0)).collect() == []
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def reachable(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize(("radius", "tile"), [(1, 1 << 14), (3, 1 << 14), (2, 16), (3, 40)])
def test_blocks_find_all_links(spark, radius, tile):
    """Against all pairs; with small tiles, groups of one block are dealt out as pairs of tiles."""
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63, 300, dtype=np.int64)
    base[:150] = (base[:150] & ~0xFFFFFFFF) | 12345  # one hot block
    f = np.unique(np.concatenate([base, *(base ^ (1 << rng.integers(0, 60, 300)).astype(np.int64) for _ in range(3))]))
    i, j = np.nonzero(np.triu(np.bitwise_count(f.view(np.uint64)[:, None] ^ f.view(np.uint64)[None]) <= radius, 1))
    want = reachable(zip(f[i].tolist(), f[j].tolist()))
    got = simhash.block_edges(spark.createDataFrame([(int(x),) for x in f], "f0 long"), radius, tile).collect()
    assert want and reachable((r["a"], r["b"]) for r in got) == want
    assert len(got) < (10 if tile > 100 else 2000) * len(f)


def test_all_pairs_of_a_frequent_shingle_are_looked_at_once_apart(spark):
    """Rows of one shingle meet unless a root joins them, with and without tiles."""
    shared = spark.createDataFrame([(7, k, 100, 0) for k in range(90)] + [(8, k, 100, 0) for k in range(5)], "h long, node long, d long, pos long")
    roots = spark.createDataFrame([(k, 0) for k in range(60)], "node long, root long")
    nodes = spark.createDataFrame([(k, bytes(64)) for k in range(90)], "node long, bits binary")
    want = {(a, b) for a in range(90) for b in range(max(a + 1, 60), 90)}
    for tile in (1 << 14, 20):
        got = [tuple(r) for r in simhash.others(shared, roots, nodes, Fraction(4, 5), tile).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    few = simhash.neighbours(shared, Fraction(4, 5)).collect()
    assert len(set(reachable(map(tuple, few)).values())) == 1 and len(few) <= len(simhash.ORDERS) * 95


def near(words, k, rng):
    out = list(words)
    for i in rng.choice(len(out), k, replace=False):
        out[i] = f"new{rng.integers(1 << 30)}"
    return " ".join(out)


def test_one_of_each_group_stays(spark):
    """Copies and texts of similarity 0.8 or more go, texts of their own stay, and columns come back as they were."""
    rng = np.random.default_rng(7)
    vocabulary = [f"w{k}" for k in range(3000)]
    bases = [[vocabulary[i] for i in rng.integers(0, 3000, n)] for n in (60, 200, 400, 1000, 3000)]
    rows, n = [], 0
    for g, ws in enumerate(bases):
        for text in [" ".join(ws)] * 3 + [near(ws, max(1, len(ws) // 60), rng) for _ in range(4)]:
            rows.append((n, text, g))
            n += 1
    rows += [(1000 + k, " ".join(vocabulary[i] for i in rng.integers(0, 3000, 150)), 50 + k) for k in range(200)]
    rows += [(2000, None, 900), (2001, "", 900), (0, rows[0][1], 0), (None, "alone without an id of its own here", 901)]
    docs = spark.createDataFrame([(i, t, g, "m", 1) for i, t, g in rows], "doc_id long, text string, its_id int, _mark string, mark int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    groups = [r["its_id"] for r in got]
    assert sorted(groups) == sorted(set(groups)) == sorted({g for _, _, g in rows})
    assert {r["doc_id"] for r in got if r["its_id"] < 5} == {0, 7, 14, 21, 28}


def test_one_of_each_at_the_edges(spark):
    docs = spark.createDataFrame([(None, None), (None, None), (None, "x y z"), (5, "x y z"), (6, None), (5, "x y z")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.one_of_each(docs).collect())) == [(5, "x y z"), (6, None)]
    one = docs.where("doc_id is null and text is null")
    assert list(map(tuple, simhash.one_of_each(one).collect())) == [(None, None)]
    names = spark.createDataFrame([(1, "a b", 1, 2, 3), (2, "a b", 1, 2, 3)], "doc_id long, text string, row int, maybe int, its_id int")
    assert list(map(tuple, simhash.one_of_each(names).collect())) == [(1, "a b", 1, 2, 3)]


def planted(n, tail, tag):
    """Two texts of n different words of which the last `tail` differ, and the similarity of their sets of five-word shingles."""
    words = [f"{tag}w{k}" for k in range(n)]
    return " ".join(words), " ".join(words[: n - tail] + [f"{tag}new{k}" for k in range(tail)]), (n - 4 - tail) / (n - 4 + tail)


def test_pairs_link_by_their_real_similarity(spark):
    """Pairs planted at 0.70, 0.75, next below 0.80, 0.80 and 0.82: the second text of a pair goes from 0.80 on, else both stay."""
    rows, goes = [], set()
    for n in (94, 184, 409, 904):
        for share in (0.70, 0.75, 0.80, 0.82):
            tail = max(t for t in range(n) if (n - 4 - t) / (n - 4 + t) >= share)
            for k in range(6):
                for more in (0, 1) if share == 0.80 else (0,):
                    a, b, real = planted(n, tail + more, f"n{n}s{share}k{k}m{more}")
                    assert real == 0.8 or share != 0.80 or more
                    rows += [(len(rows), a), (len(rows) + 1, b)]
                    goes |= {len(rows) - 1} if real >= 0.8 else set()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == set(range(len(rows))) - goes


def test_one_of_each_matches_brute_force(spark, sf_more):
    docs = spark.read.parquet(f"{sf_more}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sets = [set(map(bytes, simhash.shingles(r["text"], 5))) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for k, x in enumerate(sets):
        for h in x:
            holders.setdefault(h, []).append(k)
    for a, b in {(a, b) for ks in holders.values() for a in ks for b in ks if a < b}:
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    want = {}
    for k, r in enumerate(rows):
        want[find(k)] = min(want.get(find(k), r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == sorted(want.values())


@pytest.mark.parametrize("ratio", ["0.5", "0.8", "0.95"])
def test_similar_sets_have_a_key_in_common(ratio):
    """Pairs at the ratio or barely above, of all sizes, also where most parts are empty."""
    rng, least = np.random.default_rng(11), Fraction(ratio)
    parts, pairs = simhash.Parts(least), 0
    for n in [*range(1, 40), *rng.integers(40, 2500, 60).tolist()] * 4:
        a = np.unique(rng.integers(0, 2**64 if n % 3 else 2**40, n, dtype=np.uint64))  # every third has all hashes in one part
        gone = int(rng.integers(0, int(n * (1 - least)) + 1))
        more = int((n - gone) / least - n)
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**64 if n % 3 else 2**40, more, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if Fraction(both, len(a) + len(b) - both) >= least and not np.array_equal(a, b):
            pairs += 1
            assert np.intersect1d(parts.keys(a), parts.keys(b)).size
    assert pairs > 100 and not parts.keys(np.zeros(0, "<u8")).size


def test_long_texts_with_a_passage_in_common_are_not_compared(spark, monkeypatch):
    """Nothing but near-duplicates is shuffled as whole sets: of long unrelated texts that share a passage by twos, none is."""
    rng, rows = np.random.default_rng(5), {}
    texts = [[f"w{x}" for x in rng.integers(0, 10**6, 1500)] for _ in range(60)]
    for k in range(0, 59):
        texts[k][100 : 130], texts[k + 1][200 : 230] = ([f"p{k}x{j}" for j in range(30)],) * 2
    whole = simhash.cut

    def cut(df, name):
        out = whole(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "cut", cut)
    docs = spark.createDataFrame([(k, " ".join(ws)) for k, ws in enumerate([*texts, texts[0][:-20]])], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == set(range(60))
    assert rows["sets"] == 2


def test_one_group_for_keys_with_the_same_nodes(spark):
    """A near-duplicate that agrees in very many parts with one text meets it in few groups, and copies count once."""
    words = [f"w{k}" for k in range(1200)]
    docs = spark.createDataFrame([(k, " ".join(words[:-k] if k % 3 else words)) for k in range(12)], "doc_id long, text string").repartition(6)
    got = simhash.met(docs, 5, Fraction(4, 5), 0).collect()
    assert len(got) == len({(r["h"], r["node"]) for r in got}) and len({r["node"] for r in got}) == 9 and len(got) < 100


def test_sets_that_share_a_shingle_by_chance_have_no_key_in_common():
    rng, parts = np.random.default_rng(6), simhash.Parts(Fraction(4, 5))
    for _ in range(400):
        a, b = (np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64)) for _ in range(2))
        assert not np.intersect1d(parts.keys(a), parts.keys(np.unique(np.append(b[1:], a[rng.integers(len(a))])))).size


def test_candidates_of_loose_copies_do_not_grow_with_their_pairs(spark, monkeypatch):
    """Copies of one text that are too far apart for links agree in very many parts, and are hardly ever candidates."""
    rng, rows = np.random.default_rng(9), {}
    words = [f"w{k}" for k in range(800)]
    whole = simhash.cut

    def cut(df, name):
        out = whole(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "cut", cut)
    docs = spark.createDataFrame([(k, near(words, 45, rng)) for k in range(60)] + [(60, " ".join(words)), (61, " ".join(words[:-9]))], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == set(range(61))
    assert rows["shared"] > 1000 and rows["neighbours"] <= 62 and rows["others"] <= 62


def test_neighbours_are_bounded_by_the_nodes_however_many_groups_they_share(spark):
    rng = np.random.default_rng(8)
    shared = [(h, k, 100) for h in range(300) for k in range(100) if rng.random() < 0.6]
    pairs = simhash.neighbours(spark.createDataFrame(shared, "h long, node long, d long"), Fraction(4, 5)).collect()
    assert len(set(reachable(map(tuple, pairs)).values())) == 1 and len(pairs) < 20 * 100


def test_a_task_gives_each_pair_once():
    rng = np.random.default_rng(3)
    found = [tuple(rng.integers(0, 30, (2, 50))) for _ in range(100)]
    want = {(min(a, b), max(a, b)) for x, y in found for a, b in zip(x.tolist(), y.tolist())}
    for most in (10, 2000, 1 << 18):
        got = [(a, b) for batch in simhash.once(iter(found), most) for a, b in zip(*(c.to_pylist() for c in batch.columns))]
        assert set(got) == want and (most == 10 or len(got) == len(want))
    assert list(simhash.once(iter([]))) == []
