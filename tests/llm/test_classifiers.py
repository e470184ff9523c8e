import zlib

import pytest

from prosegrain.llm.quality_classifier import Ranking, quality_classifier
from prosegrain.llm.toxicity import Matcher, apart, toxicity, without_toxic


def auc(rows):
    good, bad = ([s for s, y in rows if y == k] for k in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


@pytest.fixture(scope="module")
def tables(spark, sf_more):
    return tuple(spark.read.parquet(f"{sf_more}/{t}.parquet") for t in ("documents", "labels"))


@pytest.mark.parametrize("score,label,folds,fold,least", [(toxicity, "toxic", 4, 2, 0.8), (quality_classifier, "quality", 5, 0, 0.9)])
def test_held_out_accuracy(spark, tables, score, label, folds, fold, least):
    docs, labels = tables
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "no id"), (-3, "words " * 30_000), (-3, "words " * 30_000)], "doc_id long, text string")
    got = score(docs.select("doc_id", "text").unionByName(extra).selectExpr("*", "1 as score", "'x' as label", "2 as mass"), labels.selectExpr("*", "'t' as text", "0 as label")).collect()
    assert len(got) == docs.count() + 5
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % folds == fold)
    known = {r["doc_id"]: r[label] for r in labels.collect()}
    held = [(r["score"], known[r["doc_id"]]) for r in got if r["held_out"] and known.get(r["doc_id"]) is not None]
    assert auc(held) >= least, auc(held)


@pytest.mark.parametrize("score", [toxicity, quality_classifier])
def test_labels_of_the_held_out_fold_change_nothing(spark, tables, score):
    docs, labels = tables
    docs = docs.limit(300).cache()
    name, folds, fold = ("toxic", 4, 2) if score is toxicity else ("quality", 5, 0)
    other = labels.selectExpr("doc_id", f"if(pmod(crc32(cast(doc_id as string)), {folds}) = {fold}, 1 - {name}, {name}) as {name}")
    a, b = (sorted(map(repr, score(docs, x).collect())) for x in (labels, other))
    assert a == b


@pytest.mark.parametrize("score,label", [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_no_labels_one_kind_and_empty_tables(spark, score, label):
    docs = spark.createDataFrame([(1, "a b"), (3, None)], "doc_id long, text string")
    none = spark.createDataFrame([(None, 1), (8, None)], f"doc_id long, {label} int")
    one = spark.createDataFrame([(k, 1) for k in range(1, 4)], f"doc_id long, {label} int")
    for labels in (none, one, none.limit(0)):
        assert len(score(docs, labels).collect()) == 2
        assert score(docs.limit(0), labels).collect() == []


def test_toxic_documents_go_and_columns_stay(spark, tables):
    docs, labels = tables
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns
    bad = {r["doc_id"] for r in toxicity(docs, labels).where("predicted = 1").select("doc_id").collect()}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()} - bad


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_automata_match_edit_distance():
    import random

    rng, letters = random.Random(2), "abcd"
    lexicon = [("abcabd", 0, 1.0), ("dddca", 0, 1.0), ("bca", 0, 1.0)]
    m = Matcher(lexicon)
    for _ in range(4000):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(1, 8)))
        if rng.random() < 0.5:
            w = list(rng.choice(lexicon)[0])
            w[rng.randrange(len(w))] = rng.choice(["", "x", "ab", "c"])
            w = "".join(w)
        near = [(distance(t, w), k) for k, (t, _, _) in enumerate(lexicon)]
        want = min(((d, k) for d, k in near if d == 0 or d == 1 and len(lexicon[k][0]) >= 5), default=None)
        assert m.match(w) == ((want[1], want[0]) if want else None), w


def test_context_separates_reports_from_abuse():
    m = Matcher([("wretchling", 0, 1.0)])
    plain, abuse, quote, report = (m.mass(x) for x in ("a wretchling", "you are a wretchling", 'the text has "wretchling" in it', "they wrote the word wretchling"))
    assert abuse > plain > quote > 0 and report == quote
    assert 0 < m.mass("a wretchlung") < plain and m.mass(None) == m.mass("") == 0


def test_quotations_of_any_length_and_unpaired_marks():
    m = Matcher([("wretchling", 0, 1.0)])
    plain, quote = m.mass("a wretchling"), m.mass('the text has "wretchling" in it')
    long = " ".join(f"w{k}" for k in range(300))
    assert m.mass(f'he began: "{long} wretchling {long}", and so on') == quote
    assert m.mass(f"« wretchling» {long}") == m.mass(f'"{long} wretchling {long}') == m.mass(f'it is 5" long, wretchling, {long}, and 6" wide') == plain
    assert m.mass(f'"{long}" wretchling "{long}"') == m.mass(f"don't, wretchling, can't") == plain


def test_a_lexicon_has_no_entry_that_another_covers():
    import random

    rng = random.Random(3)
    for _ in range(200):
        terms = list({("".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))), rng.randrange(3)) for _ in range(12)})
        want = []
        for t, r in terms:
            if not any(s and t.startswith(x) or r and x.startswith(t) or not s and not r and x == t for x, s in want):
                want.append((t, r))
        assert apart(terms) == want


def test_ranking_orders_pairs():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((400, 13))
    y = (x[:, 2] + 0.05 * rng.standard_normal(400) < 0.6).astype(int)
    s = Ranking(x, y, 0.3).scores(x)
    assert auc(list(zip(s, y))) > 0.97 and ((s >= 0.3) == y).mean() > 0.9


def test_quality_is_learned_from_all_labelled_documents(spark):
    """The bad ones are those that a sample of 12,000 by hashes leaves out."""
    rows = spark.range(16_000).selectExpr("id as doc_id", "pmod(crc32(cast(id as string)), 5) = 0 as held", "xxhash64(id) as place").orderBy("held", "place").collect()
    learned = [r["doc_id"] for r in rows if not r["held"]]
    bad = {*learned[12_000:]} | {r["doc_id"] for r in rows if r["held"] and r["doc_id"] % 9 == 0}
    assert len(learned) > 12_500
    docs = spark.createDataFrame([(r["doc_id"], "$$ ## no no no" if r["doc_id"] in bad else "a sentence of plain words, said once") for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r["doc_id"], int(r["doc_id"] not in bad)) for r in rows], "doc_id long, quality int")
    got = quality_classifier(docs, labels).collect()
    assert {(r["doc_id"], r["predicted"]) for r in got} == {(r["doc_id"], int(r["doc_id"] not in bad)) for r in rows}


@pytest.mark.parametrize("good,bad", [(900, 300), (1000, 3), (5, 700)])
def test_groups_have_all_rows_and_the_rarer_label(spark, monkeypatch, good, bad):
    from prosegrain.llm import quality_classifier as q

    monkeypatch.setattr(q, "GROUP", 100)
    monkeypatch.setattr(q, "LEAST", 30)
    rows = spark.createDataFrame([(k, int(k < good), [float(k)]) for k in range(good + bad)], "doc_id long, label int, x array<double>")
    got = [g["rows"] for g in q.dealt(rows, good, bad).collect()]
    assert sorted(r["x"][0] for g in got for r in g if r["first"]) == list(range(good + bad))
    assert len(got) == -(-max(good, bad) // 100) and max(map(len, got)) < 400
    assert all({r["label"] for r in g} == {0, 1} for g in got)


@pytest.mark.parametrize("values", ["normal", "ties", "one", "spread"])
def test_the_threshold_is_the_quantile_of_all_scores(values, monkeypatch):
    import numpy as np

    from prosegrain.llm import quality_classifier as q

    monkeypatch.setattr(q, "NEAR", 5)
    rng = np.random.default_rng(2)
    s = {"normal": rng.standard_normal(4000), "ties": rng.integers(0, 4, 4000) / 3, "one": np.full(50, 0.1), "spread": np.exp(40 * rng.standard_normal(3000))}[values]
    order, parts = np.sort(s), np.array_split(s, 7)
    for rank in {0, 1, len(s) // 3, len(s) // 2, len(s) - 2, len(s) - 1}:
        got = q.lowest(lambda f: [f(x) for x in parts], rank, s.min(), s.max())
        assert got == (order[rank], order[min(rank + 1, len(s) - 1)])


def test_weights_are_the_minimum_of_the_loss_of_all_pairs():
    import numpy as np

    from prosegrain.llm.quality_classifier import expand

    rng = np.random.default_rng(4)
    x = rng.random((150, 13))
    y = (x[:, 3] + 0.3 * rng.standard_normal(150) < 0.5).astype(int)
    m = Ranking(x, y, 0.3)
    z = m.standard(expand(x))
    d = np.array([a - b for a in z[y == 1] for b in z[y == 0]])
    assert np.abs(1e-3 * m.w - (d / (1 + np.exp(d @ m.w))[:, None]).mean(axis=0)).max() < 1e-6
    assert abs(m.cut - np.quantile(z @ m.w, np.mean(y == 0))) < 1e-9
