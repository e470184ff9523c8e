"""Each rule on short texts: the lines of its findings. Positive and negative cases stand in pairs."""

import pytest

from prosegrain.config import Config
from prosegrain.operators import jargon, rules
from prosegrain.operators.scopes import scopes
from prosegrain.plans.fixtures import KANA, PARA

BOLD = "- **名**: 文。\n"
JA40 = KANA + "らり"
EVEN = "".join(f"この文{c}は同じ長さで書く。\n" for c in KANA[:30])
UNEVEN = "".join(("短い。\n" if k % 2 else "こちらの文は相当に長くて、読み終わるまでに時間が掛かるように書いた文である。\n") for k in range(30))
THREE = "一つ目の文。二つ目の文。三つ目の文。"
CONTRAST = "".join(f"これは{c}ではなく——別の物である。\n" for c in KANA[:8])
PLAIN = "".join(f"普通の文{'を長々と' * (k % 4)}{c}に書く。\n" for k, c in enumerate(KANA[:32]))

CASES = {
    "sentence_length": [("前。\n" + "あ" * 120 + "。", [2]), ("あ" * 99 + "。", [])],
    "max_ten": [("春、夏、秋、冬、朝、夜に測る。", [1]), ("春、夏、秋、冬、朝に測る。", [])],
    "double_negative": [("影響がないとは言えない。", [1]), ("必ず記録しなければならない。", [])],
    "hedge_pileup": [("原因は配線かもしれないと考えられる。", [1]), ("原因は配線かもしれない。", [])],
    "demonstrative_chain": [("これはそれとその部品で決まる。", [1]), ("この値はその部品で決まる。", [])],
    "no_chain": [("装置の温度の変化の原因を調べる。", [1]), ("この箱の中の部品を調べる。", []), ("『雪の町の灯』の作者の話を聞く。", []), ("の".join("甲乙丙丁" * 3000) + "の話。", [1])],
    "verbose_potential": [("値を計測することが可能である。", [1]), ("値を計測できる。", [])],
    "kanji_run": [("高速信号処理装置を使う。", [1]), ("信号処理装置を使う。", [])],
    "exclamation": [("止まれ！", [1]), ("止まる。", [])],
    "style_mixing": [("今日は晴れる。\n明日は雨です。\n昨日は曇る。", [2]), ("今日は晴れる。\n明日は曇る。", []), ("晴れる。\n雨です。", [2])],
    "bullet_template": [("前\n" + BOLD * 3, [2]), (BOLD * 2, []), ("```\n" + BOLD * 3 + "```", [])],
    "colon_continuation": [("設定を変えます:\n\n- 項目", [1]), ("使用方法:\n- 項目", [])],
    "connector_pileup": [("また、始める。さらに、進む。そして、終わる。", [1]), ("また、始める。さらに、進む。", [])],
    "opener_repetition": [("本製品は、軽い。本製品は、強い。本製品は、安い。", [1]), ("本製品は、軽い。本製品は、強い。", [])],
    "latin_density": [(JA40 + "framework postgres driver extra", [1]), (JA40 + "HTTP v2 a_b iv", []), ("- " + KANA[:20] + " alpha\n\n- " + KANA[:15] + " beta\n\n- " + KANA[:18] + " gamma delta epsilon", [1])],
    "verb_calque": [("設定を resetして、値を logする。表は mergeされた。", [1, 1, 1]), ("Dockerした。 ls を実行する。 `x` は testした", [1]), ("```\nresetした\n```", [])],
    "low_information_density": [("同じ値を出す。" * 20, [1]), (PARA + KANA, []), ("同じ abcdefgh。" * 20, [])],
    "near_duplicate": [(f"{PARA}\n\n{PARA.replace('最後に', '終わりに')}\n\n{KANA}", [3]), (f"{PARA}\n\n{KANA}", []), (f"{PARA}\n\n{PARA}\n\n{PARA}", [3, 5, 5])],
    "flat_rhythm": [(EVEN, [1]), (UNEVEN, []), (EVEN[: EVEN.rindex("この")], []), ("".join(f"- この文{c}は同じ長さで書く。\n" for c in KANA[:40]), [])],
    "uniform_paragraphs": [("\n\n".join([THREE] * 8), [1]), ("\n\n".join([THREE] * 5), []), ("\n\n".join(["一つの文。"] * 8), []), ("\n\n".join(["文だ。" * 13] * 8), [])],
    "stylometric_uniformity": [(PLAIN + CONTRAST, [33]), (PLAIN + CONTRAST.replace("——", ""), [])],
    "metaphor_density": [(PLAIN + "羅針盤となる旅路を紡ぎ、進む。\n", [33]), (PLAIN + "「羅針盤」と「旅路」と「紡ぎ」を読む。\n", [])],
    "arrow": [("入口 → 出口 ⇒ 終点。", [1, 1]), ("`→`", [])],
    "fullwidth_eq": [("条件＝一致。", [1]), ("結果＝ok とする。", [1]), ("n＝5 とする。", [])],
    "paren_nakaten": [("対象（赤・青・緑）と（上・下）。", [1]), ("（・・・）", [])],
    "unterminated_prose": [("この段落は終わりの記号を持たない", [1]), ("短い段落", []), ("この段落は終わりの記号を持つ。", []), ("**強調で終わる段落である。**", []), ("折り返した段落は\n句点で終わる。", []), ("- 箇条書きの一つ目の項目である\n- 二つ目の項目は句点で終わる。", [1])],
    "missing_counter": [("12 node を使い、5 ms が上限、2026-07-09 run で 3 item（予備）を足す。", [1]), ("3 QoI を下回る。", [1])],
    "slop_phrase": [("見出し\nこれは架け橋となり、いかがでしたか。", [2, 2]), ("`架け橋とな`る。", [])],
    "denied_term": [("前\n禁句を使う。禁句と禁句。", [2]), ("許しの句。", [])],
    "latin_token": [("結果は latency で評価し、 query plan を見る。", [1, 1]), ("結果は API と Node2 と a/b を見る。", []), ("第3版のlatencyを見る。", []), ("値は real-time で出す。", []), (("word " * 20_000), [1])],
}
METAPHORS = (("羅針盤", ""), ("旅路", ""), ("紡ぎ", ""))


@pytest.mark.parametrize("rule", CASES)
def test_rule(spark, rule):
    texts = {f"f{k}": t for k, (t, _) in enumerate(CASES[rule])}
    docs = spark.createDataFrame([*texts.items(), ("null", None), ("empty", ""), ("blank", " \n\n　\n")], "file string, text string")
    config = Config(deny={"禁句": "別の言葉", "許し": "x"}, allow=("許し",), metaphors=METAPHORS, register="consume")
    found = getattr(rules, rule)(scopes(docs), config).collect()
    got = {f: sorted(r["line"] for r in found if r["file"] == f) for f in [*texts, "null", "empty", "blank"]}
    assert got == {f"f{k}": lines for k, (_, lines) in enumerate(CASES[rule])} | {"null": [], "empty": [], "blank": []}


def test_calque_takes_the_first_inflection_that_fits(spark):
    docs = spark.createDataFrame([("f", "buildしている。")], "file string, text string")
    assert [r["word"] for r in rules.verb_calque(scopes(docs), Config()).collect()] == ["buildして"]


def test_settings_exempt_words(spark):
    docs = scopes(spark.createDataFrame([("f", "3 QoI を下回る。結果は latency で見る。" + JA40 + "alpha beta gamma delta")], "file string, text string"))
    free = Config(unit_words=("QoI",), allow_vocabulary=("latency", "alpha", "beta", "gamma", "delta"))
    assert all(f(docs, free).collect() == [] for f in (rules.missing_counter, rules.latin_token, rules.latin_density))


JARGON = [("campaign を始める。", ["campaign"], ["campaign"]), ("menu（献立の一覧）を出す。", [], ["menu"]), ("（方針）policy を決める。", [], ["policy"]), ("scope とは範囲である。", [], ["scope"]), ("| quota | 割当 |\n\nquota を使う。", [], ["quota"]), ("campaigns と my_menu は別。", [], []), ("`menu` を見る。", [], []), ('<table><tr><td class="x mono">menu</td><td>献立</td></tr></table>', [], [])]


@pytest.mark.parametrize("register,which", [("practice", 1), ("consume", 2)])
def test_jargon(spark, register, which):
    from prosegrain.plans.check import documents

    docs = spark.createDataFrame([(f"f{k}", "html" if c[0].startswith("<") else "md", c[0]) for k, c in enumerate(JARGON)], "file string, kind string, raw string")
    found = jargon.jargon_export(scopes(documents(docs)), Config(register=register, jargon=("campaign", "menu", "policy", "scope", "quota"))).collect()
    assert [sorted(r["word"] for r in found if r["file"] == f"f{k}") for k in range(len(JARGON))] == [c[which] for c in JARGON]
    assert jargon.jargon_export(scopes(documents(docs)), Config(jargon=("menu",))).collect() == []


def test_cosines_match_brute_force_whatever_the_tiles(spark):
    import random
    from collections import Counter
    from fractions import Fraction

    from prosegrain.operators.similar import close_pairs

    rng, rows = random.Random(6), []
    for f in range(3):
        base = ["".join(rng.choice("あいうえ𠮷") for _ in range(rng.randrange(2, 12))) for _ in range(6)]
        texts = list(dict.fromkeys(base + [b[:-1] + rng.choice("あかさ") for b in base] + [b + b for b in base] + ["あい", "あいあいあ", "い" * 5]))
        rows += [(f"f{f}", k, t) for k, t in enumerate(texts[: len(texts) if f else 1])]
    grams = {(f, k): Counter(zip(t, t[1:])) for f, k, t in rows}
    want = {}
    for (f, a), x in grams.items():
        for (g, b), y in grams.items():
            if f == g and a < b:
                dot, norm = sum(n * y[w] for w, n in x.items()), sum(n * n for n in x.values()) * sum(n * n for n in y.values())
                if 400 * dot * dot >= 169 * norm:
                    want[f, a, b] = dot / norm**0.5
    units = spark.createDataFrame(rows, "file string, id int, t string")
    for tile in (2, 5, 1024):
        got = close_pairs(units, Fraction(13, 20), tile).collect()
        assert len(got) == len(want) and all(abs(want[r["file"], r["a"], r["b"]] - r["cosine"]) < 1e-9 for r in got)


def test_near_units_say_as_much_as_all_pairs(spark):
    d = scopes(spark.createDataFrame([("f", f"{PARA}\n\n{PARA}\n\n{PARA.replace('最後に', '終わりに')}\n\n{PARA}")], "file string, text string"))
    pairs, members = (x.collect() for x in rules.near_units(d))
    assert len(pairs) == 1 and sorted((r["id"], r["line"]) for r in members) == [(1, 1), (1, 3), (1, 7), (3, 5)]
    for tile in (1024, 3, 1):  # within the row, and by tiles
        assert sorted((r["line"], int(r["word"]), round(r["value"], 3)) for r in rules.near_duplicate(d, Config(), tile).collect()) == sorted((b, a, 1.0 if 5 not in (a, b) else r) for a, b in ((1, 3), (1, 5), (3, 5), (1, 7), (3, 7), (5, 7)) for r in [round(pairs[0]["cosine"], 3)])


def test_marked_names_and_cells_of_html():
    from prosegrain.operators.html import marked

    page = '<table class="mono"><tr><th>alpha x</th><td>b</td></tr>\n<tr><td><code>beta</code></td><td>c</td></tr></table><dl><dt>gamma<dd>d</dl><i class="a mono">run <b>it</b> now</i><p title=">">x</p>'
    got = marked(page)
    assert got["cells"][:2] == ["alpha x", "<code>beta</code>"] and "run it" in got["names"] and marked(None) == marked("no tags") == {"names": [], "cells": []}


def test_many_code_elements_take_time_in_proportion():
    import time

    from prosegrain.operators.html import strip_html

    took = []
    for n in (2_000, 16_000):
        begin = time.process_time()
        assert "x" not in strip_html("<p>a <code>x</code> <pre>x<code>x</code></pre></p>\n" * n)
        took.append(time.process_time() - begin)
    assert took[1] < 24 * took[0] + 0.5
