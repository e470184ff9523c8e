"""The check: every rule over every document, as one table of findings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosegrain.config import Config
from prosegrain.operators import coinage, jargon, report, rules
from prosegrain.operators.html import html_text
from prosegrain.operators.scopes import exploded, scopes
from prosegrain.sources import lexicons

Rule = Callable[[DataFrame, Config], DataFrame]
Tokenizer = Callable[[str], list[coinage.Morpheme]]

#: Detector, rule, severity, what it looks for, message. The order settles ties of place in a report.
REGISTRY: list[tuple[str, str, str, Rule, str]] = [
    ("deny", "denied-term", "error", rules.denied_term, "the phrase {word} is on the deny list"),
    ("deny", "slop-phrase", "error", rules.slop_phrase, "the stock phrase {word} says nothing"),
    ("codemix", "latin-density", "advisory", rules.latin_density, "{value} latin words for 100 Japanese characters: {word}"),
    ("codemix", "latin-token", "register", rules.latin_token, "bare English in Japanese text: {word}"),
    ("readability", "sentence-length", "error", rules.sentence_length, "the sentence has {value} characters"),
    ("readability", "max-ten", "error", rules.max_ten, "the sentence has {value} commas"),
    ("readability", "double-negative", "error", rules.double_negative, "a double negative: {word}"),
    ("readability", "hedge-pileup", "error", rules.hedge_pileup, "{value} hedges in one sentence"),
    ("readability", "demonstrative-chain", "error", rules.demonstrative_chain, "{value} demonstratives in one sentence"),
    ("readability", "no-chain", "error", rules.no_chain, "a chain of possessives: {word}"),
    ("readability", "verbose-potential", "error", rules.verbose_potential, "a long way to say can: {word}"),
    ("readability", "kanji-run", "advisory", rules.kanji_run, "a long run of characters: {word}"),
    ("readability", "exclamation", "advisory", rules.exclamation, "an exclamation mark"),
    ("readability", "style-mixing", "error", rules.style_mixing, "the rarer, {word}, of two sentence styles"),
    ("structure", "bullet-template", "advisory", rules.bullet_template, "{value} bullets with bold labels in a row"),
    ("structure", "colon-continuation", "advisory", rules.colon_continuation, "a predicate and a colon lead into a block"),
    ("structure", "connector-pileup", "advisory", rules.connector_pileup, "{value} sentences in a row begin with a connector"),
    ("structure", "opener-repetition", "advisory", rules.opener_repetition, "{value} sentences in a row begin with {word}"),
    ("calque", "verb-calque", "advisory", rules.verb_calque, "an English verb with a Japanese ending: {word}"),
    ("density", "low-information-density", "advisory", rules.low_information_density, "{value} bits a character after compression"),
    ("density", "near-duplicate", "advisory", rules.near_duplicate, "as line {word} but for little (cosine {value})"),
    ("rhetoric", "stylometric-uniformity", "advisory", rules.stylometric_uniformity, "{value} devices are used uniformly"),
    ("rhetoric", "metaphor-density", "advisory", rules.metaphor_density, "{value} decorative metaphors for 100 sentences: {word}"),
    ("rhythm", "flat-rhythm", "advisory", rules.flat_rhythm, "sentences of even length (burstiness {value})"),
    ("rhythm", "uniform-paragraphs", "advisory", rules.uniform_paragraphs, "paragraphs of even size (variation {value})"),
    ("notation", "arrow", "advisory", rules.arrow, "an arrow in prose: {word}"),
    ("notation", "fullwidth-eq", "advisory", rules.fullwidth_eq, "an equals sign in prose: {word}"),
    ("notation", "paren-nakaten", "advisory", rules.paren_nakaten, "{value} items packed in parentheses"),
    ("completeness", "unterminated-prose", "advisory", rules.unterminated_prose, "prose without an end: {word}"),
    ("counter", "missing-counter", "advisory", rules.missing_counter, "{value} {word} lacks a counter"),
    ("jargon", "jargon-export", "advisory", jargon.jargon_export, "readers do not know {word}"),
]


def documents(docs: DataFrame, keep: bool = False) -> DataFrame:
    """docs (file, kind, raw) with text: HTML stripped, everything else as it is. Null raw counts as empty. keep: HTML's text stays on the
    executors' disks, since Python makes it; other texts are not kept."""
    raw = F.coalesce("raw", F.lit(""))
    is_html = F.coalesce(F.col("kind") == "html", F.lit(False))
    if keep:
        html, other = docs.where(is_html), docs.where(~is_html)
        return other.withColumns({"raw": raw, "text": raw}).unionByName(documents(html).persist(StorageLevel.DISK_ONLY))
    return docs.withColumn("raw", raw).withColumn("text", F.when(F.col("kind") == "html", html_text(docs.sparkSession, raw)).otherwise(raw))


def severity_of(severity: str, config: Config) -> str:
    return severity if severity != "register" else "error" if config.register == "consume" else "advisory"


def _message(template: str, hint: Column | None) -> Column:
    value = F.regexp_replace(F.format_string("%.2f", "value"), r"\.?0+$", "")
    parts = F.lit(template)
    for name, x in (("{value}", value), ("{word}", F.col("word"))):
        if name in template:
            parts = F.replace(parts, F.lit(name), F.coalesce(x, F.lit("")))
    return parts if hint is None else F.concat(parts, F.coalesce(F.concat(F.lit("; write "), hint), F.lit("")))


def _hint(rule: str, config: Config) -> Column | None:
    """What to write instead of word, where a list has it."""
    known = {"denied-term": config.deny, "latin-token": dict(reversed(config.katakana))}.get(rule, {})
    known = {k: v for k, v in known.items() if v}
    return F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), F.col("word")) if known else None


def _data(rule: str, hint: Column | None) -> Column:
    if rule in ("denied-term", "slop-phrase"):
        return F.to_json(F.struct("word", F.coalesce(F.lit(None).cast("string") if hint is None else hint, F.lit("")).alias("suggestion")))
    if rule == "latin-density":
        return F.to_json(F.struct(F.col("value").alias("density"), F.split("word", " ").alias("vocab")))
    return F.to_json(F.struct("word")) if rule == "verb-calque" else F.lit(None).cast("string")


def findings_of(scoped: DataFrame, config: Config, only: set[str] | None = None, large: DataFrame | None = None) -> DataFrame:
    """Findings of documents with scopes, before suppression. only: detectors. large: the documents with scopes that may have very many units.

    Rules on single sentences and lines share one pass over the documents, and those on rhythm another, so that scopes need not be kept.
    """
    parts, shared = [], {}
    together = {n for names in rules.IN_ROW.values() for n in names} | {"flat_rhythm", "uniform_paragraphs"}
    for k, (detector, rule, severity, find, template) in enumerate(REGISTRY):
        if only and detector not in only or rule == "latin-token" and config.register == "internal" or rule == "jargon-export" and (config.register == "internal" or not config.jargon):
            continue
        if find.__name__ in together:
            shared[find.__name__] = k
            continue
        hint = _hint(rule, config)
        found = rules.near_duplicate(scoped, config, large=large) if find is rules.near_duplicate else find(scoped, config)
        parts.append(found.select("file", "line", F.lit(detector).alias("detector"), F.lit(rule).alias("rule"), F.lit(severity_of(severity, config)).alias("severity"), _message(template, hint).alias("message"), _data(rule, hint).alias("data"), F.lit(k).alias("detector_ord"), "seq"))
    row = {k: v for k, v in shared.items() if k not in ("flat_rhythm", "uniform_paragraphs")}
    passes = [(f, own) for f, own in ((rules.in_one_pass, row), (rules.rhythms, {k: v for k, v in shared.items() if k not in row})) if own]
    for one_pass, own in passes:
        by = {k: (REGISTRY[k], _hint(REGISTRY[k][1], config)) for k in own.values()}
        told = lambda make: F.coalesce(*(F.when(F.col("k") == k, make(*x)) for k, x in by.items()))
        parts.append(
            one_pass(scoped, config, own).select("file", "line", told(lambda r, _: F.lit(r[0])).alias("detector"), told(lambda r, _: F.lit(r[1])).alias("rule"), told(lambda r, _: F.lit(severity_of(r[2], config))).alias("severity"), told(lambda r, hint: _message(r[4], hint)).alias("message"), told(lambda r, hint: _data(r[1], hint)).alias("data"), F.col("k").alias("detector_ord"), "seq")
        )
    return reduce(DataFrame.unionByName, parts)


def coined(scoped: DataFrame, config: Config, tokenizer: Tokenizer) -> DataFrame:
    """Strict coinages, but for words that are allowed, denied or in the corpus' list; a corpus that is not there is passed over."""
    spark = scoped.sparkSession
    table = lambda words: spark.createDataFrame([(w,) for w in words], "word string") if words else None
    corpus = lexicons.corpus_words(spark, config.coinage_corpus) if config.coinage_corpus and Path(config.coinage_corpus).is_file() else None
    lines = exploded(scoped, "bare").where(~F.col("text").rlike(r"^\s*\|"))
    found = coinage.coinages(coinage.tokenized(lines, tokenizer), table(sorted({*config.allow, *config.coinage_allow})), corpus, table(sorted(config.deny))).where("strict")
    message = F.concat(F.col("compound"), F.lit(" is in no dictionary"))
    return found.select("file", "line", F.lit("coinage").alias("detector"), F.lit("dictionary-coinage").alias("rule"), F.lit("advisory").alias("severity"), message.alias("message"), F.to_json(F.struct("compound", "components")).alias("data"), F.lit(len(REGISTRY)).alias("detector_ord"), "seq")


def check(docs: DataFrame, config: Config, only: set[str] | None = None, keep: bool = True, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Findings of docs (file, kind, raw) that no marker in the text silences.

    Scopes take many times the room of their texts, so none are kept: a few passes make them again. Texts of HTML are kept on the
    executors' disks, and lost parts made again; keep=False leaves that to the caller. With a tokenizer, from a line to its morphemes,
    coinages are looked for as well.
    """
    texts = documents(docs, keep)
    scoped = scopes(texts)
    parts = [] if only == {"coinage"} else [findings_of(scoped, config, only, scopes(texts.where(rules.may_be_large(F.col("text")))))]
    if tokenizer and (not only or "coinage" in only):
        parts.append(coined(scoped, config, tokenizer))
    elif not parts:
        raise ValueError("coinages need a tokenizer")
    return report.unsuppressed(reduce(DataFrame.unionByName, parts), report.suppressions(texts, config.ignore_marker))
