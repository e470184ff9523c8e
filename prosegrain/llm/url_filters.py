"""URL filters, native: rules by host and path, and a blocked Bloom filter of listed canonical URLs whose possible hits go on to
an exact hash join that removes false positives."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the filter for each listed URL, bits of a block, bytes of a block's row when it is broadcast.
BITS, BLOCK, BLOCK_BYTES = 16, 256, 40
#: A filter or list is broadcast up to so many bytes; beyond that Spark joins by shuffling.
BROADCAST = 32 << 20

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Roots of sites that only carry advertising, betting, pills, adult or spam pages.
LISTED = tuple(f"http://{name}.example.{top}/" for name in ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets") for top in ("com", "net", "org"))


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty without :// or for a null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none does. rules is a list in code, not a table."""
    name = verdict = None
    for v, rh, rp in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        name = F.when(fits, rh + rp) if name is None else name.when(fits, rh + rp)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    null = F.lit(None).cast("string")
    return (null, null) if name is None else (name, verdict)


def canonical_host(url: Column) -> Column:
    """host() without user information, port, www. and a final dot."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host(url), r"^.*@", ""), r"(:[0-9]*)?$", ""), r"^www\.|\.$", "")


def canonical(url: Column) -> Column:
    """Host and path alone, without the path's final slash: what a list and a page's URL are compared by. Null without a host."""
    h = canonical_host(url)
    return F.when(h != "", F.concat(h, F.regexp_replace(path(url), r"/+$", "")))


def keys(url: Column) -> Column:
    """The listed URLs that would cover this one: itself, and the roots of its host and of that host's parents."""
    h, own = canonical_host(url), canonical(url)
    parents = F.transform(F.sequence(F.lit(1), F.size(F.split(h, r"\."))), lambda n: F.call_function("substring_index", h, F.lit("."), -n))
    return F.array_compact(F.array_distinct(F.concat(F.array(own, F.when(h != "", h)), F.when(h != "", parents).otherwise(F.array().cast("array<string>")))))


def marks(key: Column, blocks: int) -> list[Column]:
    """Block of a key and the four words of its eight bits."""
    bits = F.xxhash64(key, F.lit(7))
    bytes_ = [F.shiftright(bits, 8 * k).bitwiseAND(F.lit(255)).cast("int") for k in range(8)]

    def word(w: int) -> Column:
        out = F.lit(0).cast("long")
        for b in bytes_:
            out = out.bitwiseOR(F.when(F.shiftright(b, 6) == w, F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long")))
        return out

    return [F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *(word(w).alias(f"w{w}") for w in range(4))]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter as a table: block, f0..f3. listed: key."""
    return listed.select(*marks(F.col("key"), blocks)).groupBy("block").agg(*(F.bit_or(f"w{w}").alias(f"f{w}") for w in range(4)))


def hits(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct urls (url) that the list (key, distinct) covers."""
    n = listed.count()
    blocks = max(1, math.ceil(n * BITS / BLOCK))
    near = bloom(listed, blocks)
    near = F.broadcast(near) if blocks * BLOCK_BYTES <= BROADCAST else near
    asked = urls.select("url", F.explode(keys(F.col("url"))).alias("key"))
    asked = asked.select("url", "key", *marks(F.col("key"), blocks))
    possible = asked.join(near, "block")
    for w in range(4):
        possible = possible.where(F.col(f"f{w}").bitwiseAND(F.col(f"w{w}")) == F.col(f"w{w}"))
    exact = listed
    if n <= 100_000 and (listed.agg(F.sum(F.octet_length("key"))).first()[0] or 0) <= BROADCAST:
        exact = F.broadcast(listed)
    return possible.select("url", "key").join(exact, "key", "left_semi").select("url").distinct()


def url_filters(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row for each row of pages (page_id, url): page_id, host, path, rule, verdict and listed (whether the list covers the url).

    listed has a column url. The rule's verdict holds; without a rule, block what the list covers and allow the rest. A url is
    looked up once however many pages have it. A null url and one without :// have an empty host and path, no rule and
    no listing; null rows of the list are ignored; an empty list allows all; other columns of pages are not read.
    """
    keyed = listed.select(canonical(F.col("url")).alias("key")).where("key is not null").distinct()
    own = pages.select("page_id", "url")
    found = hits(own.select("url").where("url is not null").distinct(), keyed).withColumn("hit", F.lit(True))
    h, p = host(F.col("url")), path(F.col("url"))
    both = own.join(found, "url", "left").select("page_id", h.alias("host"), p.alias("path"), F.coalesce("hit", F.lit(False)).alias("listed"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return both.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


ORACLE_SQL = """
with u as (select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{U}', '{L}') as host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
v as (select *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?$', ''), '^www\\.|\\.$', '') as h,
  case {RULE} end as rule from u),
l as (select *, exists(select 1 from (values {LISTED}) s(r) where h = r or suffix(h, '.' || r)) as listed from v)
select page_id, host, path, rule, case {VERDICT} when listed then 'block' else 'allow' end as verdict, listed from l
"""


def oracle() -> str:
    by_length = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fits = " ".join(f"when (host = '{h}' or suffix(host, '.{h}')) and starts_with(path, '{p}') then '{h}{p}'" for _, h, p in by_length)
    said = " ".join(f"when rule = '{h}{p}' then '{v}'" for v, h, p in by_length)
    roots = ", ".join(f"('{x.removeprefix('http://').removesuffix('/')}')" for x in LISTED)
    return ORACLE_SQL.replace("{U}", UPPER).replace("{L}", LOWER).replace("{RULE}", fits).replace("{VERDICT}", said).replace("{LISTED}", roots)
