"""Registry of the prose queries and of their DuckDB counterparts.

The corpus of the queries is the driver's documents in two forms, and the literal documents of `fixtures`. The first form has
Japanese punctuation and a paragraph for each line, the second has kana for the twelve most frequent letters as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegrain.config import Config
from prosegrain.functions.text import swapped
from prosegrain.operators import coinage, fixes, jargon, report, rules
from prosegrain.operators.html import html_text
from prosegrain.operators.scopes import exploded, scopes
from prosegrain.plans import oracle
from prosegrain.plans.check import check
from prosegrain.plans.fixtures import DOCUMENTS
from prosegrain.sources import documents, lexicons

Query = Callable[[SparkSession, str], DataFrame]
TERMS = ("campaign", "menu", "policy", "scope", "quota", "the", "en")
DENIED = "禁句"


def config(**more) -> Config:
    return Config(metaphors=tuple(lexicons.pairs(lexicons.SHIPPED / "metaphors.tsv")), katakana=tuple(lexicons.pairs(lexicons.SHIPPED / "katakana.tsv")), deny={DENIED: "別の言葉"}, **more)


def spread(docs: DataFrame) -> DataFrame:
    """docs over all cores: a table of fewer splits than cores, thus a small one, is dealt out; a larger one stays as it lies."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def corpus(spark: SparkSession, sf_dir: str, large: bool = False) -> DataFrame:
    """file, text. large: those alone that may have very many units, and some more; neither form is over twice as long as its row's text."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    docs = docs.where(rules.may_be_large(F.col("text"), rules.TILE // 2)) if large else docs
    plain: Column = F.replace(swapped(F.col("text"), *oracle.MARKS), F.lit("\n"), F.lit("\n\n"))
    name = lambda x: F.concat(F.lit(x), F.col("doc_id").cast("string")).alias("file")
    a = docs.select(name("a"), plain.alias("text"))
    b = docs.select(name("b"), F.translate(F.lower(plain), oracle.ALPHABET, oracle.KANA).alias("text"))
    return spark.createDataFrame(DOCUMENTS, "file string, text string").unionByName(a).unionByName(b)


def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scopes(corpus(spark, sf_dir))


def _rule(find: Callable[[DataFrame, Config], DataFrame], **settings) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = find(scoped(spark, sf_dir).withColumn("raw", F.col("text")), config(**settings))
        return found.select("file", "line", F.round("value", 6).alias("value"), "word")

    return query


def _numbers(make: Callable[[DataFrame], DataFrame], *leave: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = make(scoped(spark, sf_dir)).drop(*leave)
        return found.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes))

    return query


def lines_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(scoped(spark, sf_dir), "clean").select("file", "line", "text")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(scoped(spark, sf_dir), "sentences").select("file", "line", "seq", "text")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(scoped(spark, sf_dir), "units").select("file", "line", "seq", "text", "is_bullet")


def near_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.near_duplicate(scoped(spark, sf_dir), config(), large=scopes(corpus(spark, sf_dir, large=True)))
    return found.select("file", "line", F.round("value", 6).alias("value"), "word")


def metaphor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.metaphor_counts(scoped(spark, sf_dir), config()).where("total > 0").select("file", "sentences", "total", "line", "vocabulary")


def suppressed_exclamation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    found = rules.exclamation(scopes(docs), config()).withColumn("detector", F.lit("readability")).withColumn("rule", F.lit("exclamation"))
    return report.unsuppressed(found, report.suppressions(docs, config().ignore_marker)).select("file", "line", F.round("value", 6).alias("value"), "word")


def autofix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixes.fixed(corpus(spark, sf_dir))


def pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", html_text(spark, F.coalesce("html", F.lit(""))).alias("text"))


def pages_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole check of every page, by rule."""
    docs = documents.from_table(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", "html")
    return check(docs, config(register="consume", jargon=TERMS)).groupBy("detector", "rule", "severity").agg(F.count("*").alias("n"))


def conversation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlong sentences of every turn of every conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.translate(F.coalesce("text", F.lit("")), *oracle.MARKS)
    docs = turns.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("file"), text.alias("text"))
    return rules.sentence_length(scopes(docs), config()).select("file", "line", "value")


def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a whole check of the corpus by detector and rule, with subtotals."""
    docs = corpus(spark, sf_dir).select("file", F.lit("md").alias("kind"), F.col("text").alias("raw"))
    return report.rolled_up(check(docs, config(register="consume", jargon=TERMS))).select("detector", "rule", "n", "errors")


def coinage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounds of all lines of documents, by a made-up tokenizer that SQL can follow: what a word is goes by its number of letters."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    lines = docs.select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "text"))

    def morpheme(w: Column) -> Column:
        n = F.length(w)
        first = F.when(n % 4 == 2, F.lit("助詞")).when(n % 4 == 3, F.lit("接尾辞")).otherwise(F.lit("名詞"))
        second = F.when(n % 4 == 0, F.lit("普通名詞")).when(n % 4 == 1, F.lit("数詞")).otherwise(F.lit("*"))
        surface = F.when(n % 8 == 0, F.lit("床")).when(n % 4 == 0, F.concat(F.lit("語"), w)).when(n % 4 == 1, F.concat(F.lit("数"), w)).when(n % 4 == 2, F.lit("は")).otherwise(w)
        return F.struct(surface.alias("surface"), first.alias("pos1"), second.alias("pos2"), F.lit("一般").alias("pos3"), (n % 16 == 0).alias("has_suffix_reading"))

    words = F.filter(F.split("text", " "), lambda w: w != "")
    found = coinage.coinages(lines.select("file", (F.col("k") + 1).alias("line"), F.transform(words, morpheme).alias("morphemes")))
    return found.select("file", "line", "compound", F.array_join("components", "+").alias("components"), "strict")


COINAGES = """
with l as (select cast(doc_id as varchar) as file, string_split(coalesce(text, ''), chr(10)) as s from documents),
x as (select file, generate_subscripts(s, 1) as line, list_filter(string_split(unnest(s), ' '), lambda w: w <> '') as ws from l),
w as (select file, line, generate_subscripts(ws, 1) as k, unnest(ws) as w from x),
m as (select *, length(w) as n, length(w) % 4 in (0, 1) as native, length(w) % 4 = 3 and regexp_full_match(w, '[A-Za-z0-9_-]+') and regexp_matches(w, '[A-Za-z]') as latin,
  case when length(w) % 8 = 0 then '床' when length(w) % 4 = 0 then '語' || w when length(w) % 4 = 1 then '数' || w else w end as surface from w),
g as (select *, native or latin as content, sum(case when native or latin then 0 else 1 end) over (partition by file, line order by k) as g from m),
c as (select *, k > min(k) over (partition by file, line, g) as later from g where content)
select file, cast(line as int) as line, string_agg(surface, '' order by k) as compound, string_agg(surface, '+' order by k) as components,
  not bool_or(n % 4 = 1) and bool_or(n % 8 = 0 and not (later and n % 16 = 0)) as strict
from c group by file, line, g having count(*) > 1 and bool_or(native)
"""


def queries() -> dict[str, Query]:
    every = lambda d, c: rules.latin_density(d, c, every=True)
    return {
        "lines_clean": lines_clean,
        "sentences": sentences,
        "units": units,
        **{n: _rule(getattr(rules, n)) for n in "sentence_length max_ten double_negative hedge_pileup demonstrative_chain no_chain verbose_potential kanji_run exclamation style_mixing".split()},
        **{n: _rule(getattr(rules, n)) for n in "bullet_template colon_continuation connector_pileup opener_repetition latin_density verb_calque bits_per_char low_information_density".split()},
        "near_duplicate": near_duplicate,
        "latin_density_all_units": _rule(every),
        "latin_token_runs": _rule(rules.latin_token, register="consume"),
        **{n: _rule(getattr(rules, n)) for n in "flat_rhythm uniform_paragraphs stylometric_uniformity metaphor_density arrow fullwidth_eq paren_nakaten unterminated_prose missing_counter".split()},
        "denied_terms": _rule(rules.denied_term),
        "slop_phrases": _rule(rules.slop_phrase),
        "jargon_practice": _rule(jargon.jargon_export, register="practice", jargon=TERMS),
        "jargon_consume": _rule(jargon.jargon_export, register="consume", jargon=TERMS),
        "rhythm_stats": _numbers(rules.rhythm_stats, "first_sentence_line", "first_paragraph_line"),
        "stylometric_indicators": _numbers(rules.stylometric_indicators),
        "metaphor_counts": metaphor_counts,
        "suppressed_exclamation": suppressed_exclamation,
        "autofix": autofix,
        "pages_text": pages_text,
        "pages_findings": pages_findings,
        "conversation_findings": conversation_findings,
        "findings_summary": findings_summary,
        "coinage_runs": coinage_runs,
    }


def oracle_sql() -> dict[str, str]:
    stems = [s for s, _ in lexicons.pairs(lexicons.SHIPPED / "metaphors.tsv")]
    out = oracle.queries(stems, TERMS, DENIED)
    turns = f"select cast(conv_id as varchar) || '/' || cast(turn as varchar) as file, translate(coalesce(text, ''), '{oracle.MARKS[0]}', '{oracle.MARKS[1]}') as text from conversations"
    out["conversation_findings"] = f"{oracle.PRELUDE.replace(oracle.CORPUS, turns)} select file, cast(line as int) as line, cast(length(t) as double) as value from se where length(t) > 100"
    return out | {"coinage_runs": COINAGES}
