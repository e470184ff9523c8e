import duckdb
import pytest

from prosegrain.llm import url_filters as u

URLS = [
    "http://Example.COM/en/x?q#f", "https://www.example.com/en/a", "http://example.com/de/", "http://a.net/es/b", "http://a.net/fr/", "http://net/es/", "http://xnet/es/x", "http://example.com.net/fr/a/b?c", "ftp://u:p@www.example.org:80/", "no scheme", "http://", "http:///path", "http://h?x/y", "http://h#x", "", "a://b://c/d", "http://sub.ads-track.example.org/p/", "http://ads-track.example.org.", "https://www.spam-farm.example.net:8080/a", "http://xspam-farm.example.net/a", "http://É.COM/Ü/",
]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:end], rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for v, h, p in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    h = host.rpartition("@")[2]
    h = h[: h.rfind(":")] if ":" in h and h[h.rfind(":") + 1 :].isdigit() else h
    h = h.removeprefix("www.").removesuffix(".")
    listed = any(h == r or h.endswith("." + r) for r in (x.split("/")[2] for x in u.LISTED))
    return host, path, rule, verdict or ("block" if listed else "allow"), listed


@pytest.fixture()
def listed(spark):
    return spark.createDataFrame([(x,) for x in u.LISTED] + [(None,), (u.LISTED[0],)], "url string")


def test_verdicts_match_brute_force(spark, listed):
    rows = [(k, x) for k, x in enumerate(URLS)] + [(90, None), (None, URLS[0]), (0, URLS[0])]
    pages = spark.createDataFrame([(k, x, "h", True) for k, x in rows], "page_id long, url string, host string, listed boolean")
    got = sorted((tuple(r) for r in u.url_filters(pages, listed).collect()), key=repr)
    assert got == sorted(((k, *judged(x)) for k, x in rows), key=repr)
    assert u.url_filters(pages.limit(0), listed).collect() == []
    assert all(r["verdict"] == "allow" for r in u.url_filters(pages, listed.limit(0), rules=[]).collect())


def test_no_python_in_the_plan_and_false_positives_go(spark, listed, sf_more):
    pages = spark.read.parquet(f"{sf_more}/pages.parquet")
    got = u.url_filters(pages, listed)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    many = spark.range(3000).selectExpr("concat('http://site', id, '.test/') as url")
    keyed = many.select(u.canonical(many["url"]).alias("key"))
    asked = spark.range(6000).selectExpr("concat('http://site', id, '.test/deep/page?x') as url")
    assert u.hits(asked, keyed).count() == 3000


def test_sql_agrees(spark, listed, sf_more):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_more}/pages.parquet'")
    want = sorted(con.execute(u.oracle()).fetchall(), key=repr)
    assert sorted((tuple(r) for r in u.url_filters(spark.read.parquet(f"{sf_more}/pages.parquet"), listed).collect()), key=repr) == want


def test_a_root_of_many_labels_covers_its_subdomains(spark):
    pages = spark.createDataFrame([(1, "http://x.y.a.b.c.d.e.f.org/p"), (2, "http://a.b.c.d.e.f.org/q"), (3, "http://b.c.d.e.f.org/"), (4, None), (5, "no host")], "page_id long, url string")
    listed = spark.createDataFrame([("http://a.b.c.d.e.f.org/",)], "url string")
    assert {r["page_id"] for r in u.url_filters(pages, listed).where("listed").collect()} == {1, 2}
