"""What the rules look at: source blocks, lines, sentences and prose units of a document, with their source line numbers.

A document stays in its row. Every scope is an array made by built-in expressions in time linear in the text, so no scope
needs a shuffle, and a rule only explodes the array it looks at. Removals keep the number of line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrain.functions.text import CUT, DOLLAR, GAP, MARK, MARKS, NAMED, bound, ends, fenced, holds, lines_of, ltrim, rtrim, text, times, trim, without

#: What is no prose, and what begins a list item.
FENCE = "```"
BULLET = r"(?:[-*+][ \t]|・|[0-9０-９]+[.．)])"
#: What is no prose within a line: inline code, addresses, section references, ledger numbers.
ASIDE = r"(?U)`[^`]*`|https?://\S+|§[\p{IsHan}\p{IsKatakana}\p{IsHiragana}0-9A-Za-z.\-]+|R\d{4}_\d+|IF-\d"
INLINE = "`[^`]*`"
ENDS = "。！？"


def line_ends(x: Column) -> Column:
    return F.repeat(text("\n"), times(x, "\n"))


def _alternating(x: Column, mark: str, pattern: str, inner) -> Column:
    """x with inner() applied to what lies between closed pairs of a mark, which go; an open mark stays."""
    part = lambda p, i, n: F.when(i % 2 == 0, p).when(i < n - 1, inner(p)).otherwise(F.concat(text(mark), p))
    return bound(F.split(x, pattern, -1), lambda ps: F.array_join(F.transform(ps, lambda p, i: part(p, i, F.size(ps))), ""))


def without_fences(x: Column) -> Column:
    """Closed code fences as their line ends; an open one stays."""
    return F.when(x.contains(FENCE), _alternating(x, FENCE, FENCE, line_ends)).otherwise(x)


def without_math(x: Column) -> Column:
    """Display formulas as their line ends, but for pairs of marks within inline code or around an empty line."""
    hide = lambda p, i, n: F.when((i % 2 == 1) & (i < n - 1), F.replace(p, text("$"), text(DOLLAR))).otherwise(p)
    line = lambda s: bound(F.split(s, "`", -1), lambda ps: F.array_join(F.transform(ps, lambda p, i: hide(p, i, F.size(ps))), "`"))
    masked = F.when(x.contains("`"), F.array_join(F.transform(F.split(x, "\n", -1), lambda s: F.when(s.contains("`"), line(s)).otherwise(s)), "\n")).otherwise(x)
    pair = lambda p: F.when(p.contains("\n\n"), F.concat(text("$$"), p, text("$$"))).otherwise(line_ends(p))
    return F.when(x.contains("$$"), F.replace(_alternating(masked, "$$", r"\$\$", pair), text(DOLLAR), text("$"))).otherwise(x)


def source_blocks(x: Column) -> Column:
    return bound(without_fences(x), without_math)


def clean_line(x: Column) -> Column:
    """A line's prose: table rows and headings are empty, asides go, a line of white space is empty."""
    aside = holds(x, "`", "://", "§", "IF-") | x.contains("R") & x.contains("_")
    return F.when(F.substring(ltrim(x), 1, 1).isin("|", "#"), "").otherwise(rtrim(F.when(aside, F.regexp_replace(x, ASIDE, "")).otherwise(x)))


def cut_at_ends(x: Column) -> Column:
    """x cut behind each full stop, question and exclamation mark; the last piece may be empty."""
    return F.split(F.replace(F.when(holds(x, "！", "？"), F.replace(F.replace(x, text("！"), text(f"！{CUT}")), text("？"), text(f"？{CUT}"))).otherwise(x), text("。"), text(f"。{CUT}")), CUT, -1)


def sentences_of(clean: Column) -> Column:
    """Sentences of clean lines: array of (line, text). Each piece of a line that ends at a full stop, question or exclamation mark
    carries its line number; wrapped pieces join, empty lines part. Without wrapped lines each piece is a sentence as it stands."""
    piece = lambda i: lambda p: F.concat(text(MARK), i, text(NAMED), p, F.when(ends(p, *ENDS), text(CUT)).otherwise(text("")))
    pieces = lambda s, i: F.array_join(F.transform(F.filter(cut_at_ends(trim(s)), lambda p: p != ""), piece((i + 1).cast("string"))), "")
    marked = F.transform(clean, lambda s, i: F.when(trim(s) == "", text(CUT)).otherwise(pieces(s, i)))
    parts = F.filter(F.split(F.array_join(marked, ""), CUT, -1), lambda p: p != "")
    found = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, f"{MARK}([0-9]+){NAMED}", 1).cast("int").alias("line"), trim(F.regexp_replace(p, f"{MARK}[0-9]+{NAMED}", "")).alias("text")))
    wraps = lambda s, i: (s != "") & ~ends(s, *ENDS) & (F.coalesce(F.get(clean, i + 1), text("")) != "")
    alone = F.flatten(F.transform(clean, lambda s, i: F.transform(cut_at_ends(s), lambda p: F.struct((i + 1).cast("int").alias("line"), ltrim(p).alias("text")))))  # clean lines and what ends in a mark have no white space at their end
    return F.filter(F.when(F.size(F.filter(clean, wraps)) == 0, alone).otherwise(found), lambda s: s["text"] != "")


def units_of(clean: Column) -> Column:
    """Prose units of clean lines: array of (line, text, is_bullet). Paragraphs are parted by an empty line; bullet paragraphs that follow
    each other are one unit, and a segment of empty lines alone makes the unit before it no bullet unit."""
    numbered = F.array_join(F.transform(clean, lambda s, i: F.when(s == "", s).otherwise(F.concat(text(MARK), (i + 1).cast("string"), text(NAMED), s))), "\n")
    bullet = lambda seg: F.forall(F.split(seg, "\n", -1), lambda s: (s == "") | s.rlike(rf"(?U)^{MARK}[0-9]+{NAMED}\s*{BULLET}")) & (F.replace(seg, text("\n"), text("")) != "")
    segments = F.transform(F.split(numbered, "\n\n", -1), lambda seg: F.struct(seg.alias("s"), bullet(seg).alias("b")))
    joined = bound(segments, lambda gs: F.array_join(F.transform(gs, lambda g, i: F.when(F.replace(g["s"], text("\n"), text("")) == "", text(GAP)).when(g["b"] & (i > 0) & F.get(gs, i - 1)["b"], F.concat(text("\n"), g["s"])).otherwise(F.concat(text(CUT), g["s"], F.when(g["b"], text(DOLLAR)).otherwise(text(""))))), ""))
    parts = F.filter(F.split(joined, CUT, -1), lambda p: p.contains(MARK))
    body = lambda ps: F.array_join(F.transform(ps, lambda q, i: F.when(i == 0, q).otherwise(F.substring_index(q, NAMED, -1))), "")
    return F.transform(parts, lambda p: bound(F.split(p, MARK, -1), lambda ps: F.struct(F.substring_index(F.get(ps, F.lit(1)), NAMED, 1).cast("int").alias("line"), F.when(holds(p, GAP, DOLLAR), without(body(ps), GAP + DOLLAR)).otherwise(body(ps)).alias("text"), (p.contains(DOLLAR) & ~p.contains(GAP)).alias("is_bullet"))))


def scopes(docs: DataFrame) -> DataFrame:
    """docs (file, text) with lines (of the source blocks), bare (those without inline code), clean, sentences and units.

    A null text counts as empty; other columns are kept.
    """
    given = F.coalesce("text", F.lit(""))
    safe = F.when(holds(given, *MARKS), F.translate(given, MARKS, "�" * len(MARKS))).otherwise(given)
    d = docs.withColumn("text", safe).withColumn("lines", lines_of(source_blocks(F.col("text"))))
    d = d.withColumns({"bare": F.transform("lines", lambda s: F.when(s.contains("`"), F.regexp_replace(s, INLINE, "")).otherwise(s)), "clean": F.transform("lines", clean_line)})
    d = d.withColumns({"sentences": sentences_of(F.col("clean")), "units": units_of(F.col("clean"))})
    return d.withColumns({c: fenced(F.col(c)) for c in ("lines", "bare", "clean", "sentences", "units")})


def exploded(d: DataFrame, scope: str) -> DataFrame:
    """file, seq (from 1), line and text of each line, sentence or unit."""
    rows = d.select("file", F.posexplode(scope).alias("seq", "it"))
    if scope in ("lines", "bare", "clean"):
        return rows.select("file", (F.col("seq") + 1).alias("seq"), (F.col("seq") + 1).alias("line"), F.col("it").alias("text"))
    return rows.select("file", (F.col("seq") + 1).alias("seq"), "it.*")
