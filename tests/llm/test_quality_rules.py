import re
from collections import Counter

from prosegrain.llm.quality_rules import fit, posterior, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    ws = WORD.findall(text or "")
    runs = Counter(zip(ws, ws[1:], ws[2:]))
    marked = {j for i in range(len(ws) - 2) if runs[tuple(ws[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(marked)


def test_measures_match_brute_force(spark, sf_more):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_more}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-1, None), (-2, ""), (-3, "a b c a b c a b"), (-4, "x\nx\n \n \nx y\nx y\r\nx y"), (None, "null id"), (-5, "a b " * 30_000), (-5, "a b " * 30_000), (-6, "\u00a0 \u3000 \x0b\x0c 𠮷"), (-8, "A!B [x] ^-]\\ #*$%&|<> !!"), (-9, "unbroken" * 200_000), (-10, " ".join(f"w{k * k % 7919}" for k in range(150_000)))]
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, n_words int, kept string")
    got = quality_rules(docs).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted(((r["doc_id"], *(r[n] for n in names)) for r in got), key=repr) == sorted(((i, *base(t)) for i, t in rows), key=repr)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"]) and r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)


def test_repeats_are_found_whatever_the_heads_of_hashes(spark):
    """With heads of two bits alone, different windows with equal heads lie between equal ones."""
    import random

    from pyspark.sql import functions as F

    from prosegrain.llm import quality_rules as rules

    rng = random.Random(2)
    rows = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(60))) for _ in range(300)]
    docs = spark.createDataFrame([(t,) for t in rows], "t string").select("t", F.when(F.col("t") == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split("t", " "), lambda w: F.xxhash64(w))).alias("wh"))
    few = rules.REPEATS.replace(rules.HEAD, str(-(1 << 62)) + "L")
    assert few != rules.REPEATS
    for sql in (rules.REPEATS, few):
        assert {(r[0], r[1]) for r in docs.select("t", F.expr(sql)).collect()} == {(t, base(t)[4]) for t in rows}


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_kept_follows_the_labels(spark, sf_more):
    docs, labels = (spark.read.parquet(f"{sf_more}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules(docs).drop("quality").join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n.get((1, True), 0) >= 0.9 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.95 * (n.get((0, False), 0) + n.get((0, True), 0)), n


def test_expectation_maximisation_finds_the_good_rules():
    import random

    rng, rows = random.Random(1), Counter()
    for _ in range(5000):
        good = rng.random() < 0.7
        rows[tuple(None if rng.random() < 0.2 else int(good if rng.random() < a else not good) for a in (0.95, 0.9, 0.85, 0.6))] += 1
    share, says = fit(list(rows.items()))
    assert abs(share - 0.7) < 0.06
    assert says[0][0][1] > says[2][0][1] > says[3][0][1]
    assert posterior(share, says, (1, 1, 1, 1)) > 0.95 > 0.1 > posterior(share, says, (0, 0, 0, 0))
