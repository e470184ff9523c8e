"""What lets the prose queries grow no faster than their input: fast forms against plain ones, and plans."""

import random

import pyarrow as pa

from prosegrain.operators import coinage


def test_compounds_of_a_batch_are_those_of_its_lines():
    rng, rows = random.Random(5), []
    surfaces = ["床", "語ab", "は", " ", "　", "ab", "a-1", "12", "数x", "", "x y", "々", "ンab", "\x1c"]
    for k in range(3000):
        ms = [{"surface": rng.choice(surfaces), "pos1": rng.choice(["名詞", "助詞", "接尾辞", "接頭辞"]), "pos2": rng.choice(["普通名詞", "数詞", "*"]), "pos3": rng.choice(["一般", "*"]), "has_suffix_reading": rng.random() < 0.3} for _ in range(rng.randrange(9))]
        rows.append({"file": f"f{k}", "line": k, "morphemes": None if k % 50 == 0 else ms})
    kind = pa.list_(pa.struct([("surface", pa.string()), ("pos1", pa.string()), ("pos2", pa.string()), ("pos3", pa.string()), ("has_suffix_reading", pa.bool_())]))
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("line", pa.int32()), ("morphemes", kind)]))
    want = []
    for r in rows:
        for k, c in enumerate(coinage.compounds([coinage.Morpheme(**m) for m in r["morphemes"] or []]), 1):
            want.append({"file": r["file"], "line": r["line"], "seq": k, "compound": "".join(m.surface for m in c), "components": [m.surface for m in c], "strict": bool(coinage.is_strict(c))})
    assert want and coinage.compounds_of(batch).to_pylist() == want
    assert [x for at in range(0, len(rows), 333) for x in coinage.compounds_of(batch.slice(at, 333)).to_pylist()] == want
    assert coinage.compounds_of(batch.slice(0, 0)).num_rows == 0


def test_ranges_stand_for_scripts(spark):
    from pyspark.sql import functions as F

    from prosegrain.functions.text import JA
    from prosegrain.operators.rules import MAYBE_HAN

    points = spark.createDataFrame(pa.table({"x": [chr(k) for k in range(1, 0x110000) if not 0xD800 <= k < 0xE000]}))
    assert points.where(F.col("x").rlike(JA) != F.col("x").rlike(r"[\p{IsHiragana}\p{IsKatakana}\p{IsHan}]")).count() == 0
    assert points.where(F.col("x").rlike(r"[\p{IsHan}々]") & ~F.repeat("x", F.lit(7)).rlike(MAYBE_HAN)).count() == 0


def test_sentences_of_lines_that_wrap_and_that_do_not(spark):
    from prosegrain.operators.scopes import exploded, scopes

    docs = [("a", " 一。二！ 三？四\n\n# 五\n 。。 \n六\t\r\n\n"), ("b", " 一。二！ 三？四\n続き。五\n# 見出し\n六\n")]
    got = exploded(scopes(spark.createDataFrame(docs, "file string, text string")), "sentences").collect()
    assert [(r["line"], r["text"]) for r in got if r["file"] == "a"] == [(1, "一。"), (1, "二！"), (1, "三？"), (1, "四"), (4, "。"), (4, "。"), (5, "六")]
    assert [(r["line"], r["text"]) for r in got if r["file"] == "b"] == [(1, "一。"), (1, "二！"), (1, "三？"), (1, "四続き。"), (2, "五"), (4, "六")]


def test_latin_runs_judge_words_by_what_stands_around_them(spark):
    import re

    from pyspark.sql import functions as F

    from prosegrain.operators.rules import latin_runs

    def plain(line):
        parts = []
        for t in re.findall(r"\S+|\s+", line):
            odd = re.search("[0-9_/]", t) or re.search("[A-Z]", t) and re.search("[a-z]", t) or t.lower().startswith("doi:")
            parts.append("。" if odd and re.search("[A-Za-z]", t) else re.sub("[a-z]+[A-Z-][A-Za-z-]*|[A-Z][A-Za-z-]*", "。", t))
        return re.findall("[a-z]{2,}(?:[ 　]+[a-z]{2,})*", "".join(parts))

    rng = random.Random(9)
    lines = ["".join(rng.choice(["ab", "cde", "A", "B", "-", "1", "_", "/", " ", " ", "　", "の", "doi:", "DOI:", "Doi", ":", " "]) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", latin_runs(F.col("x")).alias("runs")).collect()
    assert [list(r["runs"]) for r in got] == [plain(r["x"]) for r in got]


def test_long_documents_alone_are_made_twice_for_near_duplicates(spark):
    from pyspark.sql import functions as F

    from prosegrain.config import Config
    from prosegrain.operators import rules
    from prosegrain.operators.scopes import scopes
    from prosegrain.plans.fixtures import PARA

    docs = spark.createDataFrame([("long", f"{PARA}\n\n{PARA}\n\n{PARA}"), ("short", f"{PARA}\n\n{PARA}"), ("none", "短い。")], "file string, text string")
    large = docs.where(rules.may_be_large(F.col("text"), 2))
    assert sorted(r["file"] for r in large.collect()) == ["long", "short"]  # and some more than have so many
    want = sorted(map(tuple, rules.near_duplicate(scopes(docs), Config(), 2).collect()))
    assert len(want) == 4 and sorted(map(tuple, rules.near_duplicate(scopes(docs), Config(), 2, scopes(large)).collect())) == want


def test_a_whole_check_keeps_no_scopes(spark):
    from prosegrain.config import Config
    from prosegrain.plans.check import check

    docs = spark.createDataFrame([("f", "md", "止まれ！")], "file string, kind string, raw string")
    plan = check(docs, Config(), {"readability", "rhythm"})._jdf.queryExecution().withCachedData().toString()
    assert "sentences" not in "".join(line for line in plan.splitlines() if "InMemoryRelation" in line)
