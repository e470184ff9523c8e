"""The stages on a small fixture, and the components they share."""

import random
from pathlib import Path

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from prosegrain.llm.common import components, cut


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, k) for k in range(2001, 2400)] + [(5, 5), (None, 3), (4, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_stages_keep_clean_documents_and_drop_the_others(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, before, sf), f"test-{name}")
        if name != "sharding":
            assert after.columns == columns
        n, m = before.count(), after.count()
        assert 0 < m and (m == n if name == "sharding" else True), name
        if name in ("toxicity", "near_duplicates", "decontamination"):
            assert n / 2 < m <= n and after.exceptAll(before).isEmpty()
        before = after
    assert {"doc_id", "shard", "slot"} <= set(before.columns)
    assert sorted(map(repr, corpus_pipeline.run(spark, sf).collect())) == sorted(map(repr, before.collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_a_stage_takes_nulls_odd_texts_clashing_names_and_empty_tables(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    odd = [(None, None, None, None), (None, None, None, None), (-1, None, "en", None), (-2, "", None, "web"), (None, "a text of its own without any id here", "en", "web"), (-3, "long " * 300_000, "en", "web"), (-4, "unbroken" * 300_000, "en", None)]
    more = "n_chars long, mass double, label int, row string, rank double, size string, maybe int, its_id int, mark string, shard_ int, copies int"
    docs = spark.createDataFrame([(*r, None, 1.0, 2, "r", 0.5, "s", 1, 7, "m", 3, 4) for r in rows + odd], f"doc_id long, text string, lang string, source string, {more}")
    got = stage(spark, docs, sf)
    if name != "sharding":
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
    ids = [r["doc_id"] for r in got.collect()]
    if name in ("toxicity", "decontamination", "sharding"):
        assert {-1, -2, -3, -4} <= set(ids) and ids.count(None) == 3
    if name == "near_duplicates":  # texts without words are one group, whose least id stays
        assert -2 in ids and -1 not in ids and {-3, -4} <= set(ids) and ids.count(None) == 1
    empty = stage(spark, docs.limit(0), sf)
    assert empty.collect() == [] and empty.columns == got.columns


def test_a_run_over_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_very_long_texts_and_urls(spark):
    from prosegrain.llm.mixing import mix_plan
    from prosegrain.llm.sharding import shards
    from prosegrain.llm.url_filters import url_filters

    docs = spark.createDataFrame([(1, "w " * 400_000, "a"), (2, "x" * 2_000_000, "a"), (3, "y z", "a")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["size"] for r in mix_plan(docs).collect()} == {1: 400_000, 2: 1, 3: 2}
    assert {r["doc_id"]: r["size"] for r in shards(docs).collect()} == {1: 800_016, 2: 2_000_016, 3: 19}
    pages = spark.createDataFrame([(1, "http://x.com/" + "p/" * 200_000), (2, "http://" + "a." * 2_000 + "ads.com/q"), (3, "h" * 300_000), (4, "http://" + "a." * 9 + "deep.er.down.in.a.b.c.com/x")], "page_id long, url string")
    listed = spark.createDataFrame([("http://ads.com/",), ("http://deep.er.down.in.a.b.c.com/",)], "url string")
    got = {r["page_id"]: (r["listed"], r["verdict"]) for r in url_filters(pages, listed, []).collect()}
    assert got == {1: (False, "allow"), 2: (True, "block"), 3: (False, "allow"), 4: (True, "block")}


def test_the_queries_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_no_local_checkpoint_and_no_import_from_outside():
    root = Path(corpus_pipeline.__file__).parent
    for p in root.rglob("prosegrain/**/*.py"):
        assert "localCheckpoint" not in p.read_text()
        if "llm" not in p.parts:
            assert "prosegrain.llm" not in p.read_text()
