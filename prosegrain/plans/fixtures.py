"""Short Japanese documents in which each rule has something to find, for the queries and their DuckDB counterparts."""

from __future__ import annotations

KANA = "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよ"
PARA = "測定の手順をまず示し、次に装置の設定と校正の結果を順に述べてから、最後に残った課題をまとめる。"

DOCUMENTS: list[tuple[str, str]] = [
    ("f01", "本文は\n続く。次の文。途中\n\n残り\n"),
    ("f02", f"{'あ' * 120}。\n\n春、夏、秋、冬、朝、夜に測る。\n影響がないとは言えない。\n原因は配線かもしれないと考えられる。"),
    ("f03", "これはそれとその部品で決まる。\n装置の温度の変化の原因を調べる。\n『雪の町の灯』の作者の話を聞く。\nこの箱の中の部品を調べる。"),
    ("f04", "値を計測することが可能である。\n高速信号処理装置を使う。\n信号処理装置を使う。すぐに止める！\n再現することができます。"),
    ("f05", "今日は晴れる。\n明日は雨です。\n昨日は曇った。\n"),
    ("f06", "# 見出し\n- **名**: 文。\n- **量**: 文。\n* **値**：文。\n- **次**: 文。\n\n設定を変えます:\n\n- 項目を足す。\n使用方法:\n- 別の項目。\n"),
    ("f07", "また、始める。さらに、進む。そして、終わる。普通の文だ。また、戻る。\n\n本製品は、軽い。本製品は、強い。本製品は、安い。本製品は、赤い。"),
    ("f08", f"{KANA[:40]}framework collective_x HTTP postgres extra driver{KANA[:5]}。\n\n- {KANA[:20]}\n\n- {KANA[:15]} latency\n\n- {KANA[:18]} query\n"),
    ("f09", "設定を resetして、値を logする。表は mergeされた。\nbuildしている。Dockerした。 ls を実行する。`code` は testした。"),
    ("f10", "結果は latency で評価し、 query plan を見る。\n結果は API と Node2 と a/b を見る。\n第3版のlatencyを見る。 値は real-time で出す。"),
    ("f11", "入口 → 出口 ⇒ 終点。\n条件＝一致。結果＝ok とする。n＝5 とする。\n対象（赤・青・緑）と（上・下）と(a・b・c)。"),
    ("f12", "12 node を使い、5 ms が上限、2026-07-09 run で 3 item（予備）を足す。\n3 QoI を下回る。"),
    ("f13", f"{PARA}\n\n{PARA.replace('最後に', '終わりに')}\n\n無関係な段落で、まったく違う話題として海の魚と空の鳥のことを長々と書き連ねておくことにする。\n\n{PARA}"),
    ("f14", "同じ値を出す。" * 20),
    ("f15", "この段落は終わりの記号を持たない\n\n- 箇条書きの一つ目の項目である\n\n- 二つ目の項目は句点で終わる。\n\n次の段落は**強調で終わる。**\n"),
    ("f16", "\n\n".join("".join(f"第{k}段落の文{j}は同じ長さで書く。" for j in "一二三") for k in "甲乙丙丁戊己庚辛壬癸") + "\n"),
    ("f17", "".join(f"普通の文をここに{'長々と' * (k % 5)}書く。\n" for k in range(30)) + "".join(f"これは案{k}ではなく——実物である。\n" for k in "一二三四五六七八") + "羅針盤となる旅路を紡ぎ、万華鏡を見る。「架け橋」とは言わない。\n"),
    ("f18", "```\n```とは別に $$ x\n```\nあ$$\nx^2 + y\n$$い。`$$` は残る。\n\n$$ 開いたまま\n\n次の $$ 段落。\n| 表 |\n参照 §2)。https://example.org/a を R2024_12 と IF-3 で見る。\n"),
    ("f19", "campaign を始める。\nmenu（献立の一覧）を出す。\n（方針）policy を決める。scope とは範囲である。\n\n| quota | 割当 |\n\nquota を使う。"),
    ("f20", "これは架け橋とな る。架け橋となり、いかがでしたか。`架け橋とな`\n禁句を使う。禁句と禁句。"),
    ("f21", "<!-- prose-ignore exclamation -->\n止まれ！\n進め！\n一つ！ <!-- prose-ignore -->\n二つ！\n三つ！"),
]



def graded(steps: int = 40) -> list[tuple[str, str]]:
    """Documents in which the measure of each rule rises from below its threshold to above it, in many combinations."""
    hedges, turns = ("かもしれ", "と考えられ", "と思われ", "気がする"), ("なくはな", "なくもな", "ないことはな", "ないとは言えな", "ないわけではな", "ない", "ないとは書かな")
    opens, slop = ("また、", "さらに、", "そして、", "加えて、", "一方、"), ("架け橋とな", "いかがでした", "魔法のよう", "潜在能力を引き出", "業界を再定義", "架け橋に", "未来を変える")
    images, out = ("羅針盤", "旅路", "紡ぎ", "万華鏡", "架け橋", "道標"), []
    for k in range(steps):
        c, d, e = KANA[k % len(KANA)], k // 7, k % 7
        parts = [
            f"原因は{c}" + "、".join(hedges[: (k + d) % 5 % 4 + (k % 4 == 3)]) + "と書く。",
            f"影響が{turns[k % 7]}い{c}。" + (f"さらに{turns[d % 7]}いと{c}。" if k % 3 else ""),
            "".join(("これ", "その", "あの", "ここ", "それ")[: (k + d) % 6]) + f"{c}で決まる。",
            f"値を{c}することが{('できる', '可能である', '難しい', 'でき', 'あり得る')[k % 5]}。",
            "高速信号処理装置系統図"[: 5 + (k + d) % 6] + f"を{c}使う。" + "々木主任研究員室"[: 4 + k % 5] + "へ。",
            "\n".join("- **名**: 文。" if j % 5 or k % 3 else "- 名: 文。" for j in range((k + d) % 6)),
            f"設定を{('変えます', '変える', '使用方法', '次の通り', '変えた')[k % 5]}{':：'[k % 2]}" + ("\n" if k % 3 else "\n\n") + ("- 項目", "> 引用", "| 表", "文。", "```\n```")[(k + d) % 5],
            "".join(opens[(j + k) % 5 if j != 2 or k % 4 else 0] + f"{c}を書く。" for j in range((k + d) % 6)) + "普通の文だ。",
            "→" * (k % 3) + f"値{c}⇒終わり。" * (d % 3),
            f"条{c}{'＝=' [k % 2]}一致。" + f"値＝{'ok5あ'[k % 4]}とする。" * (d % 3),
            "（" + "・".join("赤青緑黄"[: (k + d) % 5]) + "）と(a・b)。" + ("（上・下・左）" if k % 2 else ""),
            "禁句を使う。" * (k % 3) + f"{c}" + "禁 句" * (d % 2) + "。",
            f"これは{slop[e]}る。" + ("`" + slop[d % 7] + "`と" if k % 2 else slop[d % 7]) + "。",
        ]
        out.append((f"g{k:02}", "\n\n".join(x for x in parts if x)))
        out.append((f"l{k:02}", (KANA * 2)[: 30 + k] + " ".join((("alpha", "beta", "HTTP", "gamma", "v2", "gamma_x", "delta", "iv", "epsilon", "eta") * 2)[: (k + 3 * d) % 17]) + "。\n\n- " + KANA[:15] + " zeta" * (k % 3) + "\n\n- " + KANA[: 10 + d]))
        out.append((f"r{k:02}", "".join(f"文{KANA[j % len(KANA)]}は{'長' * (1 + (j * (1 + e)) % (2 + 3 * (k % 5)))}く書く。\n" for j in range(26 + k % 9))))
        out.append((f"p{k:02}", "\n\n".join("短い文だ。" * (1 + (k + j * (1 + k % 3)) % (1 + d)) + "終わる文だ。" for j in range(4 + k % 5))))
        plain = [f"普通の文{'を長々と' * (j % 4)}{KANA[j % len(KANA)]}に書く。" for j in range(28 + d)]
        rhetoric = [f"これは{KANA[j]}ではなく{'——' if j < 2 + k % 6 else ''}別の物である。" for j in range((k + d) % 9)]
        out.append((f"s{k:02}", "\n".join([*plain, *rhetoric, *(f"## 見出し{j}{' — 説明' if j < e else ''}" for j in range(k % 8))]) + "\n"))
        said = [f"{'「' if (j + k) % 4 == 0 else ''}{images[(j + d) % 6]}{'」' if (j + k) % 4 == 0 else ''}を見る。" for j in range(k % 6)]
        out.append((f"m{k:02}", "\n".join([*plain, *said]) + "\n"))
    return out


DOCUMENTS += graded()

#: Morphemes of lines, as a tokenizer would give them: surface, part of speech in three parts, whether it has a reading as a suffix.
MORPHEMES: list[tuple[str, int, list[tuple[str, str, str, str, bool]]]] = [
    ("m1", 1, [("家", "名詞", "普通名詞", "一般", True), ("造語", "名詞", "普通名詞", "サ変可能", False), ("を", "助詞", "格助詞", "*", False)]),
    ("m1", 2, [("三", "名詞", "数詞", "*", False), ("床", "名詞", "普通名詞", "一般", False)]),
    ("m1", 3, [("測定", "名詞", "普通名詞", "サ変可能", False), ("法", "名詞", "普通名詞", "一般", True)]),
    ("m2", 1, [("slop", "名詞", "普通名詞", "一般", False), (" ", "空白", "*", "*", False), ("軸", "名詞", "普通名詞", "一般", False)]),
    ("m2", 2, [("機械", "名詞", "普通名詞", "一般", False), ("床", "名詞", "普通名詞", "一般", False), ("だ", "助動詞", "*", "*", False)]),
]
