"""Quality rules by weak supervision, native: rules vote or abstain, expectation-maximisation estimates how far each can be
trusted, and the posterior probability of good quality replaces the filter that all rules must pass.

Everything on the rows is a Spark SQL expression. The model is fitted on counts of vote patterns, at most 3^8 rows,
which is all the driver gets; the posterior is a sum of literals by vote, so scoring needs neither a join nor a shuffle.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrain.llm.common import cut

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Bits of a sort key that hold the window's place; the others hold the head of its hash.
PLACE = (1 << 28) - 1
HEAD = f"~{PLACE}L"

#: Places of windows found twice, from sorted keys p: neighbours with equal heads.
TWICE = f"""filter(transform(p, (x, k) -> if((k > 0 and (p[k - 1] & {HEAD}) = (x & {HEAD})) or (k < size(p) - 1 and (p[k + 1] & {HEAD}) = (x & {HEAD})), x & {PLACE}L, -1L)), x -> x >= 0)"""
#: Whether neighbours with equal heads have different hashes: then heads do not tell windows apart.
MIXED = f"""exists(sequence(1, size(p) - 1), k -> (p[k - 1] & {HEAD}) = (p[k] & {HEAD}) and h[cast(p[k - 1] & {PLACE}L as int)] <> h[cast(p[k] & {PLACE}L as int)])"""
#: The same from sorted (hash, place) pairs q, which is slower and right for any hashes.
SURE = """filter(transform(q, (x, k) -> if((k > 0 and q[k - 1].x = x.x) or (k < size(q) - 1 and q[k + 1].x = x.x), cast(x.i as bigint), -1L)), x -> x >= 0)"""

#: Words in windows found twice. wh: hashes of the words. A window's hash has 64 bits of those of its three words. Places and heads of
#: hashes are sorted as primitive longs, so that a long text costs n log n; where two windows have equal heads and different
#: hashes, whole hashes are sorted instead.
REPEATS = f"""
transform(array(if(size(wh) < 3, cast(array() as array<bigint>), transform(slice(wh, 1, greatest(size(wh) - 2, 0)), (w, i) -> xxhash64(w, wh[i + 1], wh[i + 2])))), h ->
  if(size(array_distinct(h)) = size(h), 0L, aggregate(
    transform(array(sort_array(transform(h, (x, i) -> (x & {HEAD}) | cast(i as bigint)))), p ->
      if({MIXED}, transform(array(array_sort(transform(h, (x, i) -> struct(x as x, i as i)))), q -> array_sort({SURE}))[0], sort_array({TWICE})))[0],
    named_struct('last', -3L, 'n', 0L),
    (a, x) -> named_struct('last', x, 'n', a.n + least(3L, x - a.last)),
    a -> a.n)))[0]
"""


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures of each whole text and a few more for the rules. Null texts count as empty."""
    t = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", t.alias("t")).select(
        "doc_id",
        F.regexp_count("t", F.lit(f"[{re.escape(SYMBOLS)}]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        (F.octet_length("t") - F.octet_length(F.replace("t", F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
        F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("ls"),
        # trimmed, a text has no empty words but the one that an empty text has
        F.split(F.btrim("t", F.lit(SPACE)), r"[\x20\x09-\x0D]+", -1).alias("ws"),
    )
    none = F.array().cast("array<bigint>")
    out = out.select("*", F.length(F.array_join("ws", "")).cast("long").alias("word_chars"), F.when(F.get("ws", F.lit(0)) == "", none).otherwise(F.transform("ws", lambda w: F.xxhash64(w))).alias("wh"))
    return out.select(
        "doc_id",
        F.size("wh").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.expr(REPEATS).alias("n_repeat_words"),
        "n_upper",
        "n_shouts",
        F.size("ls").cast("long").alias("n_lines"),
    )


def votes() -> dict[str, Column]:
    """By rule: 1 for good, 0 for bad, null to abstain. A text without words gets no vote but that on its size."""
    words = F.nullif(F.col("n_words"), F.lit(0))

    def by(x: Column, good: Column, bad: Column) -> Column:
        return F.when(x.isNull(), None).when(bad, 0).when(good, 1)

    def low(x: Column, good: float, bad: float) -> Column:
        return by(x, x <= good, x > bad)

    size, mean = F.col("n_words"), F.col("word_chars") / words
    return {
        "size": by(size, size >= 60, size < 50),
        "mean_word": by(mean, (mean >= 3) & (mean <= 10), (mean < 2) | (mean > 14)),
        "symbols": low(F.col("n_symbols") / words, 0.02, 0.1),
        "symbol_share": low(F.col("n_symbols") / F.nullif(F.col("word_chars"), F.lit(0)), 0.005, 0.03),
        "repeats": low(F.col("n_repeat_words") / words, 0.15, 0.3),
        "dup_lines": low(F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)), 0.2, 0.5),
        "capitals": low(F.col("n_upper") / F.nullif(F.col("word_chars"), F.lit(0)), 0.15, 0.4),
        "shouts": low(F.col("n_shouts") / words, 0.03, 0.2),
    }


def fit(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 50) -> tuple[float, list[dict[int | None, tuple[float, float]]]]:
    """Expectation-maximisation on (votes, count) rows: the share of good texts, and for each rule how often it says good (1), bad (0) or
    nothing (None), among good texts and among bad ones.

    It starts from the texts that some rule calls bad. A bad vote stays at least twice as frequent among bad texts as among
    good ones, and a good vote at least as frequent among good ones, so that the two kinds cannot change places. Made-up
    cases, one of each kind, keep the estimates off 0 and 1.
    """
    n = len(patterns[0][0]) if patterns else 0
    p = [0.1 if 0 in vote else 0.95 for vote, _ in patterns]
    good, says = 0.8, [{v: (1 / 3, 1 / 3) for v in (1, 0, None)} for _ in range(n)]
    for _ in range(rounds if patterns else 0):
        total = sum(c for _, c in patterns)
        all_good = sum(c * q for (_, c), q in zip(patterns, p))
        good = min(0.99, max(0.01, all_good / total))
        for i in range(n):
            said = {v: [1.0, 1.0] for v in (1, 0, None)}
            for (vote, c), q in zip(patterns, p):
                said[vote[i]][0] += c * q
                said[vote[i]][1] += c * (1 - q)
            rate = {v: (g / (all_good + 3), b / (total - all_good + 3)) for v, (g, b) in said.items()}
            rate[0] = (min(rate[0][0], rate[0][1] / 2), rate[0][1])
            rate[1] = (rate[1][0], min(rate[1]))
            says[i] = rate
        p = [posterior(good, says, vote) for vote, _ in patterns]
    return good, says


def weight(rate: tuple[float, float]) -> float:
    """Log odds that a vote adds."""
    return math.log(rate[0] / rate[1])


def posterior(good: float, says: list[dict[int | None, tuple[float, float]]], vote: tuple[int | None, ...]) -> float:
    z = math.log(good / (1 - good)) + sum(weight(s[v]) for s, v in zip(says, vote) if v is not None)
    return 1 / (1 + math.exp(-z))


def quality_rules(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """One row for each row of docs (doc_id, text): base measures, base_failed, quality (the posterior) and kept.

    One narrow pass over the texts, written as a table of numbers, and one over those numbers. Empty and null texts have
    zero measures and fail the base rule (fewer than 50 words); null doc_ids and repeated rows pass through; an empty
    table gives an empty result; other columns of docs are not read.
    """
    rules = votes()
    m = cut(measured(docs), "measures")
    marks = m.select("*", *(v.alias(f"vote_{k}") for k, v in rules.items()))
    names = [f"vote_{k}" for k in rules]
    counted = marks.groupBy(*names).count().collect()  # 3^8 rows at most
    good, says = fit([(tuple(r[x] for x in names), r["count"]) for r in counted])
    z = F.lit(math.log(good / (1 - good)))
    for name, s in zip(names, says):
        z = z + F.when(F.col(name) == 1, weight(s[1])).when(F.col(name) == 0, weight(s[0])).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    quality = 1 / (1 + F.exp(-z))
    return marks.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & (quality >= keep_at)).alias("kept"), quality.alias("quality"))
