import random

import pytest
from pyspark.sql import functions as F

from prosegrain.functions.text import SPACE, trim
from prosegrain.operators.fixes import fixed
from prosegrain.operators.html import strip_html
from prosegrain.operators.scopes import exploded, scopes, source_blocks


def scope(spark, text, name):
    d = exploded(scopes(spark.createDataFrame([("f", text)], "file string, text string")), name).orderBy("seq")
    return [(r["line"], r["text"]) for r in d.collect()]


def test_sentences_join_wrapped_lines_and_keep_their_line(spark):
    assert scope(spark, "本文は\n続く。次の文。途中\n\n残り\n", "sentences") == [(1, "本文は続く。"), (2, "次の文。"), (2, "途中"), (4, "残り")]
    assert scope(spark, "　頭。\r\n  尾！？\n", "sentences") == [(1, "頭。"), (2, "尾！"), (2, "？")]


def test_units_merge_bullets_and_count_lines(spark):
    assert scope(spark, "段落\n二行\n\n\n次", "units") == [(1, "段落\n二行"), (5, "\n次")]
    assert scope(spark, "- 甲\n\n- 乙", "units") == [(1, "- 甲\n- 乙")]


def test_clean_lines_keep_their_numbers(spark):
    text = "# 見出し\n| 表 |\n本文(評論 §2)。  \n`x` と https://example.org/a と R2024_12 と IF-3。\n   \n終"
    assert [t for _, t in scope(spark, text, "clean")] == ["", "", "本文(評論 )。", " と  と  と 。", "", "終"]


BLOCKS = [("前\n```\na\n\nb\n```\n後", "前\n\n\n\n\n\n後"), ("```\n開いたまま", "```\n開いたまま"), ("あ$$\nx\n$$い", "あ\n\nい"), ("`$$` と `$$`", "`$$` と `$$`"), ("$$ a\n\nb $$ c", "$$ a\n\nb $$ c"), ("$$a$$ $$b", " $$b"), ("", "")]


def test_source_blocks(spark):
    d = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(BLOCKS)], "k int, t string")
    got = {r["k"]: r["x"] for r in d.select("k", source_blocks(F.col("t")).alias("x")).collect()}
    assert [got[k] for k in range(len(BLOCKS))] == [w for _, w in BLOCKS]


def test_every_removal_keeps_the_line_ends(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["```", "$$", "`", "\n", "\n\n", "文。", "- ", "a ", "| ", "# "]) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", source_blocks(F.col("t")).alias("x"))
    assert all(r["t"].count("\n") == r["x"].count("\n") for r in d.collect())


def test_trim_takes_unicode_white_space(spark):
    text = SPACE + "本 文" + SPACE
    assert spark.createDataFrame([(text,)], "t string").select(trim(F.col("t"))).first()[0] == "本 文" and len(SPACE) == 25


HTML = [
    ("<p>一</p><p>二</p>", " 。 一 。  。 二 。 "),
    ("a <b>太</b> c", "a  太  c"),
    ('<a title="1 > 0">x</a>', " x "),
    ("前<div\n class='x'>中</div>後", "前" + " " * 4 + "\n" + " " * 11 + "中 。 後"),
    ("<script>var a = '<p>';\n</script>b", None),
    ("<!-- 一\n二 -->三", "\n三"),
    ("&lt;b&gt; &amp;lt;", "<b> &lt;"),
    ("a < b and c", "a < b and c"),
    (None, ""),
]


@pytest.mark.parametrize("source,want", HTML)
def test_html(source, want):
    got = strip_html(source)
    assert got.count("\n") == (source or "").count("\n")
    if want is None:
        assert "var" not in got and got.endswith("b")
    else:
        assert got == want


def test_html_keeps_line_ends_whatever_comes():
    rng = random.Random(8)
    for _ in range(500):
        source = "".join(rng.choice(["<p>", "</p>", "<b\n>", "<!--", "-->", "<script>", "</script>", "<", ">", '"', "x\n", "文", "&amp;", "<td class='a\nb'>", "</pre>", "<pre>"]) for _ in range(rng.randint(1, 15)))
        assert strip_html(source).count("\n") == source.count("\n"), source


FIX = [("再現することができます。", "再現できます。", 1), ("`することができ`る", "`することができ`る", 0), ("```\nすることができる\n```\nすることができる\n", "```\nすることができる\n```\nできる\n", 1), ("", "", 0)]


def test_fix(spark):
    d = spark.createDataFrame([(str(k), t) for k, (t, _, _) in enumerate(FIX)], "file string, text string")
    got = {r["file"]: (r["text"], r["n"]) for r in fixed(d).collect()}
    assert [got[str(k)] for k in range(len(FIX))] == [(w, n) for _, w, n in FIX]
