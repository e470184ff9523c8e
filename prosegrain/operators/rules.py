"""The prose rules. Each takes documents with scopes and settings, and returns file, line, seq, value, word.

value is the measure that the rule compares, word what it found. Rules that look at runs or at a whole document work inside the
document's row; only `near_duplicate` shuffles the units of very long documents, by document and pair of tiles.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosegrain.config import UNITS, Config
from prosegrain.functions.text import JA, JA_RANGES, bound, ends, fenced, first_match, holds, ltrim, matches, rtrim, text, times, trim, without
from prosegrain.operators.scopes import BULLET, ENDS, exploded
from prosegrain.operators.similar import TILE, close_pairs, unit_pairs

#: The words, endings and forms that the rules are defined by.
COSINE = Fraction(13, 20)
CONNECTOR = "^(?:また|さらに|そして|加えて|一方|なお|ただし|つまり|次に|まず)、"
HEDGE = "と思われ|と考えられ|かもしれ|のではないか|ではないだろうか|気がする|感じがする|ように思|ように見え|とみられ"
DOUBLE_NEGATIVE = "なくはな|なくもな|ないことはな|ないとは[言い]えな|ないわけではな"
DEMONSTRATIVE = "これ|それ|あれ|この|その|あの|ここ|そこ"
#: Groups repeat possessively: Java matches other repeated groups by recursion, which a long line would exhaust.
CHAIN = r"(?U)(?:[^\s。、！？の]{1,12}+の){3,}+"
POLITE = "(?:です|ます|ません|でした|ました|ましょう|でしょう|ください)[。！？]$"
PLAIN = "[ぁ-ん][。！？]$"
INFLECTIONS = "する|します|した|して|している|していた|しています|しており|される|された|されて|されない|されました|できる|できた|できない|しない|しなかった|せず|しよう|すれば|すべき|しろ|せよ|させる|させます|させた|させて|させている|させたい|させない|させず|させよう|したい|したく|したければ"
CALQUE = f"(?:^|[^A-Za-z])([a-z][a-zA-Z-]+) *({INFLECTIONS})"
COUNTER = "([0-9]-)?([0-9]+) ([A-Za-z][A-Za-z_-]*) ?[をがはでにとへの。、！？]"
TEMPLATE = r"^[ \t]*[-*+][ \t]\*\*[^*]+\*\*[:：]"
COLON = "[ぁ-ん][:：]$"
BLOCK = rf"^[ \t]*(?:{BULLET}|```|>|\|)"
TERMINATED = r"""[。？！」』）)"']$"""
#: Seven characters of blocks that have all Han characters; asking for a character's script takes many times as long.
MAYBE_HAN = r"[\x{2E80}-\x{303F}\x{3100}-\x{D7FF}\x{F900}-\x{FAFF}\x{10000}-\x{10FFFF}]{7}"
HIT = "array<struct<line: int, seq: int, value: double, word: string, k: int>>"
MARKER = rf"(?U)^\s*(?:>|{BULLET})"


def rows(d: DataFrame, value: Column | None = None, word: Column | None = None) -> DataFrame:
    nothing = F.lit(None)
    return d.select("file", F.col("line").cast("int").alias("line"), F.col("seq").cast("int").alias("seq"), (nothing if value is None else value).cast("double").alias("value"), (nothing if word is None else word).cast("string").alias("word"))


# sentences


def sentence_length(d: DataFrame, c: Config) -> DataFrame:
    n = F.length("text")
    return rows(exploded(d, "sentences").where(n > c.max_sentence), n)


def max_ten(d: DataFrame, c: Config) -> DataFrame:
    n = times(F.col("text"), "、")
    return rows(exploded(d, "sentences").where(n > c.max_ten), n)


def _first(d: DataFrame, pattern: str, *needs: str) -> DataFrame:
    """needs: literals, one of which is in every match."""
    s = exploded(d, "sentences")
    s = s.where(holds(F.col("text"), *needs)) if needs else s
    return rows(s.where(F.col("text").rlike(pattern)), None, first_match(F.col("text"), pattern))


def double_negative(d: DataFrame, c: Config) -> DataFrame:
    return _first(d, DOUBLE_NEGATIVE, "なくはな", "なくもな", "ないこと", "ないとは", "ないわけ")


def hedge_pileup(d: DataFrame, c: Config) -> DataFrame:
    n = matches(F.col("text"), HEDGE)
    return rows(exploded(d, "sentences").where(n >= 2), n)


def demonstrative_chain(d: DataFrame, c: Config) -> DataFrame:
    n = matches(F.col("text"), DEMONSTRATIVE)
    return rows(exploded(d, "sentences").where(n >= 3), n)


def no_chain(d: DataFrame, c: Config) -> DataFrame:
    masked = F.replace(F.regexp_replace("text", "『[^』]*』", "◯"), text("そのもの"), text("◯"))
    s = exploded(d, "sentences").withColumn("chain", first_match(masked, CHAIN))
    n = F.size(F.filter(F.split("chain", "の"), lambda x: ~x.isin("", "こ", "そ", "あ", "ど")))
    return rows(s.where((F.col("chain") != "") & (n >= 3)), n, F.col("chain"))


def verbose_potential(d: DataFrame, c: Config) -> DataFrame:
    return _first(d, "することが(?:でき|可能)", "することが")


def kanji_run(d: DataFrame, c: Config) -> DataFrame:
    some = d.withColumn("sentences", F.filter("sentences", lambda s: s["text"].rlike(MAYBE_HAN)))
    return _first(some, r"[\p{IsHan}々]{7,}")


def exclamation(d: DataFrame, c: Config) -> DataFrame:
    return _first(d, "[！!]", "！", "!")


def style_mixing(d: DataFrame, c: Config) -> DataFrame:
    """The first five lines of the rarer of two styles; a tie is the polite one's."""
    lines = lambda xs: F.transform(xs, lambda s: s["line"])
    tail = lambda s, pattern: F.right(s["text"], F.lit(5)).rlike(pattern)  # noqa: E731  sentences end in no white space, and no ending is longer
    ended = fenced(F.filter("sentences", lambda s: ends(s["text"], *ENDS)))
    both = d.select("file", ended.alias("ended")).select("file", lines(F.filter("ended", lambda s: tail(s, POLITE))).alias("polite"), lines(F.filter("ended", lambda s: tail(s, PLAIN) & ~tail(s, POLITE))).alias("plain"))
    both = both.select("file", *(fenced(F.col(c)).alias(c) for c in ("polite", "plain"))).where((F.size("polite") > 0) & (F.size("plain") > 0))
    is_polite = F.size("polite") <= F.size("plain")
    few = F.slice(F.array_distinct(F.when(is_polite, F.col("polite")).otherwise(F.col("plain"))), 1, 5)
    out = both.select("file", F.least(F.size("polite"), F.size("plain")).alias("n"), F.when(is_polite, "polite").otherwise("plain").alias("style"), F.posexplode(few).alias("seq", "line"))
    return rows(out, F.col("n"), F.col("style"))


# lines and matches


def _each(d: DataFrame, scope: str, found: Column) -> DataFrame:
    """A row for each element of found, an array of structs."""
    return exploded(d, scope).select("file", "seq", "line", F.explode(found).alias("it")).select("file", "seq", "line", "it.*")


def _all(x: str, pattern: str, *groups: int) -> Column:
    """All matches: an array of structs with g0, g1 ... for the groups."""
    zipped = F.arrays_zip(*(F.regexp_extract_all(x, F.lit(pattern), F.lit(g)).alias(f"g{i}") for i, g in enumerate(groups)))
    return F.transform(zipped, lambda z: F.struct(*(z[f"g{i}"].alias(f"g{i}") for i in range(len(groups)))))


def arrow(d: DataFrame, c: Config) -> DataFrame:
    return rows(_each(d, "clean", _all("text", "[→⇒⟹]", 0)), None, F.col("g0"))


def fullwidth_eq(d: DataFrame, c: Config) -> DataFrame:
    return rows(_each(d, "clean", _all("text", f"{JA}＝|＝{JA}", 0)), None, F.col("g0"))


def paren_nakaten(d: DataFrame, c: Config) -> DataFrame:
    both = F.concat(_all("text", "（([^（）]*)）", 1), _all("text", r"\(([^()]*)\)", 1))
    n = F.size(F.filter(F.split("g0", "・"), lambda x: trim(x) != ""))
    return rows(_each(d, "clean", both).where(n >= 3), n, F.col("g0"))


def missing_counter(d: DataFrame, c: Config) -> DataFrame:
    found = _each(d, "clean", _all("text", COUNTER, 1, 2, 3)).where((F.coalesce("g0", F.lit("")) == "") & ~F.col("g2").isin(*UNITS, *c.unit_words))
    return rows(found, F.col("g1"), F.col("g2"))


def verb_calque(d: DataFrame, c: Config) -> DataFrame:
    some = d.withColumn("bare", F.transform("bare", lambda s: F.when(holds(s, *"さしすせで") & s.rlike("[A-Za-z-] *[さしすせで]"), s).otherwise("")))  # no inflection begins with another letter
    return rows(_each(some, "bare", _all("text", CALQUE, 1, 2)), None, F.concat("g0", "g1"))


#: What stands between white space and has a letter, and a digit, an underscore, a slash, letters of both cases or doi: at its start.
_TO = lambda of: rf"(?=[^{of}\s]*+[{of}])"
ODD = rf"(?U)(?<!\S){_TO('A-Za-z')}(?:{_TO('0-9_/')}|{_TO('A-Z')}{_TO('a-z')}|(?=[dD][oO][iI]:))\S++"


def latin_runs(x: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Runs of bare lower-case words of a line. A word is judged by all that stands around it up to white space: with a digit, an
    underscore, a slash or letters of both cases nothing there counts; names in capitals and hyphenated words part runs."""
    line = F.regexp_replace(F.when(x.rlike("[0-9_/:A-Z]"), F.regexp_replace(x, ODD, "。")).otherwise(x), "(?<![a-z])[a-z]++[A-Z-][A-Za-z-]*|[A-Z][A-Za-z-]*", "。")
    if allowed:
        line = F.regexp_replace(line, "(?<![a-z])(?:" + "|".join(sorted(rf"\Q{w}\E" for w in allowed)) + ")(?![a-z])", "。")
    return F.regexp_extract_all(line, F.lit("[a-z]{2,}+(?:[ 　]++[a-z]{2,}+)*+"), F.lit(0))


def latin_token(d: DataFrame, c: Config) -> DataFrame:
    run = F.transform(latin_runs(F.col("text"), c.allow_vocabulary), lambda r: F.struct(F.when(holds(r, "  ", "　"), F.regexp_replace(r, "[ 　]+", " ")).otherwise(r).alias("g0")))
    return rows(_each(d, "clean", run), F.size(F.split("g0", " ")), F.col("g0"))


def denied(d: DataFrame, c: Config, rule: str) -> DataFrame:
    terms = [w for w, _, r in c.denied() if r == rule]
    if not terms:
        return rows(exploded(d, "bare").where(F.lit(False)))
    found = F.transform(F.filter(F.array(*map(F.lit, terms)), lambda t: F.col("text").contains(t)), lambda t: F.struct(t.alias("g0")))
    return rows(_each(d, "bare", found), None, F.col("g0"))


def denied_term(d: DataFrame, c: Config) -> DataFrame:
    return denied(d, c, "denied-term")


def slop_phrase(d: DataFrame, c: Config) -> DataFrame:
    return denied(d, c, "slop-phrase")


# many rules in one pass


def _hits(cond: Column, value: Column | None = None, word: Column | None = None) -> Column:
    nothing = F.lit(None)
    return F.when(cond, F.array(F.struct((nothing if value is None else value).cast("double").alias("value"), (nothing if word is None else word).cast("string").alias("word"))))


def _each_of(found: Column, value: Callable[[Column], Column] | None = None, word: Callable[[Column], Column] = lambda h: h) -> Column:
    return F.transform(found, lambda h: F.struct((F.lit(None) if value is None else value(h)).cast("double").alias("value"), word(h).cast("string").alias("word")))


def _found(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(0))


def _one(x: Column, pattern: str, *needs: str) -> Column:
    return _hits(holds(x, *needs) & x.rlike(pattern), None, first_match(x, pattern))


def _chain(x: Column) -> Column:
    masked = F.replace(F.when(x.contains("『"), F.regexp_replace(x, "『[^』]*』", "◯")).otherwise(x), text("そのもの"), text("◯"))
    n = lambda ch: F.size(F.filter(F.split(ch, "の"), lambda p: ~p.isin("", "こ", "そ", "あ", "ど")))
    return F.when(x.contains("の"), bound(first_match(masked, CHAIN), lambda ch: _hits((ch != "") & (n(ch) >= 3), n(ch), ch)))


def _packed(x: Column) -> Column:
    both = F.concat(*(F.transform(_found(x, p), lambda m: F.substring(m, 2, 1 << 30)) for p in ("（[^（）]*）", r"\([^()]*\)")))
    inner = F.transform(both, lambda m: F.left(m, F.length(m) - 1))
    n = lambda h: F.size(F.filter(F.split(h, "・"), lambda p: trim(p) != ""))
    return F.when(x.contains("・"), _each_of(F.filter(inner, lambda h: n(h) >= 3), n))


def _uncounted(x: Column, c: Config) -> Column:
    part = lambda m, k: F.regexp_extract(m, COUNTER, k)
    bad = F.filter(_found(x, COUNTER), lambda m: (part(m, 1) == "") & ~part(m, 3).isin(*UNITS, *c.unit_words))
    return F.when(x.rlike("[0-9] [A-Za-z]"), _each_of(bad, lambda m: part(m, 2), lambda m: part(m, 3)))


def _calques(x: Column) -> Column:
    return F.when(holds(x, *"さしすせで") & x.rlike("[A-Za-z-] *[さしすせで]"), _each_of(_found(x, CALQUE), None, lambda m: F.concat(F.regexp_extract(m, CALQUE, 1), F.regexp_extract(m, CALQUE, 2))))


def _listed(x: Column, c: Config, rule: str) -> Column | None:
    terms = [w for w, _, r in c.denied() if r == rule]
    return _each_of(F.filter(F.array(*map(F.lit, terms)), lambda t: x.contains(t))) if terms else None


#: By scope, what the rules of these names find in one text: an array of value and word, or null. Each says what the rule itself says of a table.
IN_ROW: dict[str, dict[str, Callable[[Column, Config], Column | None]]] = {
    "sentences": {
        "sentence_length": lambda x, c: _hits(F.length(x) > c.max_sentence, F.length(x)),
        "max_ten": lambda x, c: _hits(times(x, "、") > c.max_ten, times(x, "、")),
        "double_negative": lambda x, c: _one(x, DOUBLE_NEGATIVE, "なくはな", "なくもな", "ないこと", "ないとは", "ないわけ"),
        "hedge_pileup": lambda x, c: _hits(matches(x, HEDGE) >= 2, matches(x, HEDGE)),
        "demonstrative_chain": lambda x, c: _hits(matches(x, DEMONSTRATIVE) >= 3, matches(x, DEMONSTRATIVE)),
        "no_chain": lambda x, c: _chain(x),
        "verbose_potential": lambda x, c: _one(x, "することが(?:でき|可能)", "することが"),
        "kanji_run": lambda x, c: _hits(x.rlike(MAYBE_HAN) & x.rlike(r"[\p{IsHan}々]{7,}"), None, first_match(x, r"[\p{IsHan}々]{7,}")),
        "exclamation": lambda x, c: _one(x, "[！!]", "！", "!"),
    },
    "clean": {
        "latin_token": lambda x, c: _each_of(F.transform(latin_runs(x, c.allow_vocabulary), lambda r: F.when(holds(r, "  ", "　"), F.regexp_replace(r, "[ 　]+", " ")).otherwise(r)), lambda r: F.size(F.split(r, " "))),
        "arrow": lambda x, c: F.when(holds(x, *"→⇒⟹"), _each_of(_found(x, "[→⇒⟹]"))),
        "fullwidth_eq": lambda x, c: F.when(x.contains("＝"), _each_of(_found(x, f"{JA}＝|＝{JA}"))),
        "paren_nakaten": lambda x, c: _packed(x),
        "missing_counter": _uncounted,
    },
    "bare": {
        "verb_calque": lambda x, c: _calques(x),
        "denied_term": lambda x, c: _listed(x, c, "denied-term"),
        "slop_phrase": lambda x, c: _listed(x, c, "slop-phrase"),
    },
}


def in_one_pass(d: DataFrame, c: Config, wanted: dict[str, int]) -> DataFrame:
    """What the wanted rules of IN_ROW find, as rows() with k, the rule's number: the scopes are made once for all of them, in the row."""

    def of(scope: str, chosen: list[tuple[int, Callable]]) -> Column:
        def found(s: Column, i: Column) -> Column:
            x, line = (s["text"], s["line"]) if scope == "sentences" else (s, i + 1)
            parts = [(k, f(x, c)) for k, f in chosen]
            put = lambda k: lambda h: F.struct(line.cast("int").alias("line"), (i + 1).cast("int").alias("seq"), h["value"].alias("value"), h["word"].alias("word"), F.lit(k).alias("k"))
            return F.concat(*(F.coalesce(F.transform(hits, put(k)), F.array().cast(HIT)) for k, hits in parts if hits is not None), F.array().cast(HIT))

        return F.flatten(F.transform(scope, found))

    parts = [of(scope, chosen) for scope, fs in IN_ROW.items() if (chosen := [(wanted[n], f) for n, f in fs.items() if n in wanted])]
    return d.select("file", F.explode(F.concat(*parts)).alias("it")).select("file", "it.line", "it.seq", "it.value", "it.word", "it.k")


# runs


def runs(items: Column) -> Column:
    """items (line, flag, follows): line, n and place of each run of three or more. A run starts at a flag that does not follow the
    one before it. The places are found in a string of one character for each item, so the work is linear."""

    def found(xs: Column) -> Column:
        goes_on = F.array_join(F.transform(xs, lambda x: F.when(x["flag"] & x["follows"], "1").otherwise("0")), "")

        def starts(s: Column) -> Column:
            on = lambda i: F.coalesce(F.get(xs, i)["flag"] & F.get(xs, i)["follows"], F.lit(False))
            start = lambda x, i: x["flag"] & ~x["follows"] & on(i + 1) & on(i + 2)
            end = lambda i: F.call_function("locate", text("0"), F.concat(s, text("0")), i + 2)
            hits = F.transform(xs, lambda x, i: F.when(start(x, i), F.struct(x["line"].alias("line"), (end(i) - i - 1).alias("n"), i.alias("at"))))
            return F.filter(hits, lambda h: h.isNotNull())

        return bound(goes_on, starts)

    return bound(items, found)


def _runs(d: DataFrame, items: Column) -> DataFrame:
    return d.select("file", F.posexplode(runs(items)).alias("seq", "it")).select("file", "seq", "it.*")


def bullet_template(d: DataFrame, c: Config) -> DataFrame:
    same = lambda s: F.coalesce(s.rlike(TEMPLATE), F.lit(False))
    items = bound(F.col("lines"), lambda ls: F.transform(ls, lambda s, i: F.struct((i + 1).alias("line"), same(s).alias("flag"), ((i > 0) & same(F.get(ls, i - 1))).alias("follows"))))
    return rows(_runs(d, items), F.col("n"))


def connector_pileup(d: DataFrame, c: Config) -> DataFrame:
    same = lambda s: F.coalesce(s["text"].rlike(CONNECTOR), F.lit(False))
    items = bound(F.col("sentences"), lambda ss: F.transform(ss, lambda s, i: F.struct(s["line"].alias("line"), same(s).alias("flag"), ((i > 0) & same(F.get(ss, i - 1))).alias("follows"))))
    return rows(_runs(d, items), F.col("n"))


def opener(s: Column) -> Column:
    """A sentence's first six characters up to a mark; null where repeating them is no fault."""
    head = F.substring(F.regexp_extract(s, "^[^、。！？]*", 0), 1, 6)
    return F.when((F.length(head) >= 2) & ~s.rlike(CONNECTOR) & ~s.rlike("^[-*+・#]"), head)


def opener_repetition(d: DataFrame, c: Config) -> DataFrame:
    heads = F.transform("sentences", lambda s: F.struct(s["line"].alias("line"), opener(s["text"]).alias("o")))
    items = bound(heads, lambda hs: F.transform(hs, lambda h, i: F.struct(h["line"].alias("line"), h["o"].isNotNull().alias("flag"), F.coalesce((i > 0) & (F.get(hs, i - 1)["o"] == h["o"]), F.lit(False)).alias("follows"))))
    found = d.select("file", heads.alias("heads"), F.posexplode(runs(items)).alias("seq", "it")).select("file", "seq", "it.*", F.get("heads", F.col("it.at"))["o"].alias("o"))
    return rows(found, F.col("n"), F.col("o"))


def colon_continuation(d: DataFrame, c: Config) -> DataFrame:
    filled = F.filter(F.transform("lines", lambda s, i: F.struct((i + 1).alias("line"), s.alias("s"))), lambda x: trim(x["s"]) != "")
    hits = bound(filled, lambda xs: F.filter(F.transform(xs, lambda x, i: F.when(rtrim(x["s"]).rlike(COLON) & F.coalesce(F.get(xs, i + 1)["s"].rlike(BLOCK), F.lit(False)), x["line"])), lambda n: n.isNotNull()))
    return rows(d.select("file", F.posexplode(hits).alias("seq", "line")))


# units


def latin_density(d: DataFrame, c: Config, every: bool = False) -> DataFrame:
    """Latin words for 100 Japanese characters of each unit with 40 of these or more; every: below the threshold as well."""
    u = exploded(d, "units").where(F.length("text") >= 40).withColumn("ja", fenced(F.length(F.regexp_replace("text", f"[^{JA_RANGES}]++", "")))).where("ja >= 40")
    tokens = F.filter(F.regexp_extract_all("text", F.lit("[a-zA-Z][a-zA-Z0-9_-]*"), F.lit(0)), lambda t: ~t.rlike("[_0-9]") & ~t.rlike("^[A-Z]{2,}$"))
    tokens = F.filter(F.transform(tokens, F.lower), lambda t: (F.length(t) >= 2) & ~t.rlike("^[ivx]+$"))
    if exempt := {w.lower() for w in (*c.allow, *c.allow_vocabulary)}:
        tokens = F.filter(tokens, lambda t: ~t.isin(*sorted(exempt)))
    u = u.withColumn("tokens", tokens).withColumn("density", F.size("tokens") * 100.0 / F.nullif(F.col("ja"), F.lit(0)))
    found = u if every else u.where(F.col("density") >= c.codemix_threshold)
    return rows(found, F.col("density"), F.array_join(F.array_sort(F.array_distinct("tokens")), " "))


def unterminated_prose(d: DataFrame, c: Config) -> DataFrame:
    """Bullets are judged line by line. A unit's line numbers count from its first; leading line ends that belong to its text count too."""
    u = exploded(d, "units")
    parts = F.when(F.col("is_bullet"), F.transform(F.split("text", "\n"), lambda s, i: F.struct((F.col("line") + i).alias("l"), trim(s).alias("s")))).otherwise(F.array(F.struct(F.col("line").alias("l"), trim(F.col("text")).alias("s"))))
    u = u.select("file", "seq", F.explode(parts).alias("it")).select("file", "seq", F.col("it.l").alias("line"), F.col("it.s").alias("s"))
    end = F.when(ends(F.col("s"), "*", "_", "`"), F.regexp_replace("s", r"[*_` \t]+$", "")).otherwise(F.col("s"))  # s ends in no white space
    u = u.where(F.length("s") >= 8).withColumn("end", fenced(end))
    return rows(u.where((F.col("end") != "") & ~F.right(F.col("end"), F.lit(3)).rlike(TERMINATED)), F.length("s"), F.right(F.col("s"), F.lit(20)))


def deflated_bits(x: str) -> Column:
    def bits(xs: pd.Series) -> pd.Series:
        return xs.map(lambda s: 8.0 * len(zlib.compress(s.encode(), 9)))

    return F.pandas_udf(bits, T.DoubleType())(x)


def dense_units(d: DataFrame) -> DataFrame:
    """Units that the rule on information density looks at: 60 characters or more, few of them ASCII."""
    ascii_share = F.length(F.regexp_replace("text", r"[^\x00-\x7F]", "")) / F.nullif(F.length("text"), F.lit(0))
    return exploded(d, "units").where((F.length("text") >= 60) & (ascii_share <= 0.15))


def bits_per_char(d: DataFrame, c: Config) -> DataFrame:
    """Bits of the deflated text for each character of every such unit."""
    return rows(dense_units(d), deflated_bits("text") / F.nullif(F.length("text"), F.lit(0)))


def low_information_density(d: DataFrame, c: Config) -> DataFrame:
    return bits_per_char(d, c).where("value < 11.0")


def _long_units() -> Column:
    """seq, line, t of the units of 40 characters or more, without their white space."""
    us = F.transform("units", lambda u, i: F.struct((i + 1).cast("int").alias("seq"), u["line"].cast("int").alias("line"), F.when(F.length(u["text"]) >= 40, F.regexp_replace(u["text"], r"(?U)\s+", "")).alias("t")))
    return F.filter(us, lambda u: u["t"].isNotNull())


def near_units(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of a document's different unit texts with a cosine of 0.65 or more (file, a, b, cosine), and the units that have each text
    (file, id, seq, line): as much as near_duplicate() says, without a row for each two of many equal units."""
    u = d.select("file", F.explode(_long_units()).alias("u")).select("file", "u.*")
    own = u.groupBy("file", "t").agg(F.min("seq").alias("id"))
    return close_pairs(own, COSINE), u.join(own, ["file", "t"]).select("file", "id", "seq", "line")


def may_be_large(x: Column, tile: int = TILE) -> Column:
    """Whether a text is long enough for more than `tile` units that near_duplicate() looks at."""
    return F.length(x) > 40 * tile


def near_duplicate(d: DataFrame, c: Config, tile: int = TILE, large: DataFrame | None = None) -> DataFrame:
    """Pairs of a document's units whose pairs of letters have a cosine of 0.65 or more, at the later one's line; word is the earlier one's line.

    A document of up to `tile` units stays in its row; a longer one is dealt out by runs of units. The rule asks for all pairs;
    near_units() has pairs of different texts and who has them. large: those of d whose text may_be_large(), or more; without it
    the scopes of all documents are made twice.
    """
    own = lambda x: x.select("file", _long_units().alias("us"))
    found = unit_pairs(own(d), COSINE, tile, None if large is None else own(large))
    return rows(found, F.col("cosine"), F.col("other"))


# documents


def spread(xs: Column) -> Column:
    """n, mean and population deviation of an array of doubles; zeros if it is empty."""

    def use(v: Column) -> Column:
        n = F.size(v)
        mean = F.when(n > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)
        return bound(mean, lambda m: F.struct(n.alias("n"), m.alias("mean"), F.when(n > 0, F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n)).otherwise(0.0).alias("sd")))

    return bound(xs, use)


def rhythm_stats(d: DataFrame) -> DataFrame:
    """A row for each document: sentences, mean_chars, stdev_chars, burstiness, paragraphs, para_mean_sentences, para_cv and first lines."""
    marked = F.transform(F.split("text", "\n"), lambda s: s.rlike(MARKER))
    closed = bound(marked, lambda ms: F.filter("sentences", lambda s: ~F.coalesce(F.get(ms, s["line"] - 1), F.lit(False)) & ends(s["text"], *ENDS)))
    terms = lambda s: F.length(s) - F.length(without(s, ENDS))
    paras = F.filter(F.transform(F.filter("units", lambda u: ~u["is_bullet"] & ~ltrim(u["text"]).startswith(">")), lambda u: F.struct(u["line"].alias("line"), terms(u["text"]).alias("n"))), lambda p: p["n"] >= 1)
    x = d.select("file", closed.alias("closed"), paras.alias("paras"))
    s, p = spread(F.transform("closed", lambda t: F.length(t["text"]).cast("double"))), spread(F.transform("paras", lambda t: t["n"].cast("double")))
    x = x.select("file", "closed", "paras", s.alias("s"), p.alias("p"))
    total = F.col("s.sd") + F.col("s.mean")
    return x.select(
        "file",
        F.col("s.n").alias("sentences"),
        F.col("s.mean").alias("mean_chars"),
        F.col("s.sd").alias("stdev_chars"),
        F.when(total > 0, (F.col("s.sd") - F.col("s.mean")) / total).otherwise(0.0).alias("burstiness"),
        F.col("p.n").alias("paragraphs"),
        F.col("p.mean").alias("para_mean_sentences"),
        F.when(F.col("p.mean") > 0, F.col("p.sd") / F.col("p.mean")).otherwise(0.0).alias("para_cv"),
        F.coalesce(F.get("closed", F.lit(0))["line"], F.lit(1)).alias("first_sentence_line"),
        F.coalesce(F.get("paras", F.lit(0))["line"], F.lit(1)).alias("first_paragraph_line"),
    )


def rhythms(d: DataFrame, c: Config, wanted: dict[str, int]) -> DataFrame:
    """flat_rhythm() and uniform_paragraphs(), as many as are wanted, from one pass; with k, the rule's number."""
    kinds = {"flat_rhythm": ("sentences >= 30 and burstiness < -0.40", "first_sentence_line", "burstiness"), "uniform_paragraphs": ("paragraphs >= 6 and para_mean_sentences between 2 and 6 and para_cv < 0.26", "first_paragraph_line", "para_cv")}
    hit = lambda k, cond, line, value: F.when(F.expr(cond), F.struct(F.col(line).cast("int").alias("line"), F.lit(1).alias("seq"), F.col(value).alias("value"), F.lit(None).cast("string").alias("word"), F.lit(k).alias("k")))
    found = F.explode(F.array(*(hit(wanted[n], *kinds[n]) for n in kinds if n in wanted)))
    return rhythm_stats(d).select("file", found.alias("it")).where("it is not null").select("file", "it.line", "it.seq", "it.value", "it.word", "it.k")


def flat_rhythm(d: DataFrame, c: Config) -> DataFrame:
    st = rhythm_stats(d).where("sentences >= 30 and burstiness < -0.40")
    return rows(st.withColumn("line", F.col("first_sentence_line")).withColumn("seq", F.lit(1)), F.col("burstiness"))


def uniform_paragraphs(d: DataFrame, c: Config) -> DataFrame:
    st = rhythm_stats(d).where("paragraphs >= 6 and para_mean_sentences between 2 and 6 and para_cv < 0.26")
    return rows(st.withColumn("line", F.col("first_paragraph_line")).withColumn("seq", F.lit(1)), F.col("para_cv"))


def own_sentences() -> Column:
    return F.filter("sentences", lambda s: ~s["text"].startswith(">"))


def stylometric_indicators(d: DataFrame) -> DataFrame:
    """A row for each document: sentences, contrast, first_contrast, dashes, headings, glossed, fired (indicators beyond their limits)."""
    heading = lambda p: F.size(F.filter("lines", lambda s: s.rlike(p)))
    x = d.select("file", own_sentences().alias("ss"), heading("^#{2,} ").alias("headings"), heading("^#{2,} .+ — ").alias("glossed"))
    x = x.withColumn("contrasts", F.filter("ss", lambda s: s["text"].contains("ではなく")))
    x = x.select("file", F.size("ss").alias("sentences"), F.size("contrasts").alias("contrast"), F.coalesce(F.get("contrasts", F.lit(0))["line"], F.lit(1)).alias("first_contrast"), F.aggregate("ss", F.lit(0), lambda a, s: a + times(s["text"], "——")).alias("dashes"), "headings", "glossed")
    n = F.col("sentences")
    fired = ((F.col("contrast") >= 6) & (F.col("contrast") * 100.0 >= 4.0 * n)).cast("int") + ((F.col("dashes") >= 5) & (F.col("dashes") * 100.0 >= 4.0 * n)).cast("int") + ((F.col("headings") >= 6) & (F.col("glossed") >= 0.8 * F.col("headings"))).cast("int")
    return x.withColumn("fired", F.when(n >= 30, fired).otherwise(0))


def stylometric_uniformity(d: DataFrame, c: Config) -> DataFrame:
    st = stylometric_indicators(d).where("fired >= 2")
    return rows(st.withColumn("line", F.col("first_contrast")).withColumn("seq", F.lit(1)), F.col("fired"))


def metaphor_counts(d: DataFrame, c: Config) -> DataFrame:
    """file, sentences, total, line (first of any stem), vocabulary (stem×count, by count and then in the lexicon's order)."""
    stems = [s for s, _ in c.metaphors if s not in c.allow]
    if not stems:
        return d.select("file", F.lit(0).alias("sentences"), F.lit(0).alias("total"), F.lit(1).alias("line"), F.lit("").alias("vocabulary")).where(F.lit(False))
    used = F.transform(own_sentences(), lambda s: F.struct(s["line"].alias("line"), F.when(s["text"].contains("「"), F.regexp_replace(s["text"], "「[^」]*」", "")).otherwise(s["text"]).alias("t")))
    x = d.select("file", used.alias("ss"))

    def hit(ss: Column, k: int, stem: str) -> Column:
        n = F.aggregate(ss, F.lit(0), lambda a, s: a + times(s["t"], stem))
        line = F.coalesce(F.get(F.filter(ss, lambda s: s["t"].contains(stem)), F.lit(0))["line"], F.lit(0))
        return F.struct(F.lit(stem).alias("stem"), n.alias("n"), line.alias("line"), F.lit(k).alias("k"))

    # most sentences have no stem at all, so each stem only looks at those that one pattern lets through
    heads = sorted({stem[0] for stem in stems})  # a range and then their set, so that most places of a text are passed over at once
    head = rf"(?=[\x{{{ord(heads[0]):x}}}-\x{{{ord(heads[-1]):x}}}])[" + "".join(rf"\x{{{ord(h):x}}}" for h in heads) + "]"
    some = F.filter("ss", lambda s: s["t"].rlike(rf"(?={head})(?:" + "|".join(rf"\Q{stem}\E" for stem in stems) + ")"))
    hits = bound(some, lambda ss: F.filter(F.array(*(hit(ss, k, stem) for k, stem in enumerate(stems))), lambda p: p["n"] > 0))
    x = x.select("file", F.size("ss").alias("sentences"), fenced(hits).alias("hits"))
    by_count = F.array_sort(F.transform("hits", lambda h: F.struct((-h["n"]).alias("m"), h["k"].alias("k"), h["stem"].alias("stem"))))
    return x.select("file", "sentences", F.aggregate("hits", F.lit(0), lambda a, h: a + h["n"]).alias("total"), F.coalesce(F.array_min(F.transform("hits", lambda h: h["line"])), F.lit(1)).alias("line"), F.array_join(F.transform(by_count, lambda h: F.concat(h["stem"], F.lit("×"), (-h["m"]).cast("string"))), "・").alias("vocabulary"))


def metaphor_density(d: DataFrame, c: Config) -> DataFrame:
    m = metaphor_counts(d, c).withColumn("seq", F.lit(1)).withColumn("rate", F.col("total") * 100.0 / F.nullif(F.col("sentences"), F.lit(0)))
    return rows(m.where("sentences >= 30 and total >= 3 and rate >= 2.0"), F.col("rate"), F.col("vocabulary"))
