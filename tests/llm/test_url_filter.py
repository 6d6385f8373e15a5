import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import queries, url_filter as U

URLS = [
    (1, "http://Example.ORG/es/1?x=/de/"), (2, "https://a.example.org/en/12"), (3, "https://a.example.org/en/2"),
    (4, "http://www.shop.com/fr/x"), (5, "http://shop.com/de/x#y"), (6, "http://shop.com"), (7, "http://notorg/"),
    (8, None), (9, "no scheme"), (10, ""), (11, "http:///fr/x"), (12, "x://com/fr/"), (13, "ftp://ÄB.com/fr/é?q"),
    (14, "http://h.net/a?ref=1"), (15, "http://H.net/a#z"), (16, "http://example.org?q=/es/"), (None, "http://org/"),
    (1, "http://Example.ORG/es/1?x=/de/"), (17, "a://b://c.org/d"), (18, "http://u:p@k.org:80/es/"),
]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return host, path[:end]


def expected(rows, rules, listed):
    out = []
    for i, url in rows:
        host, path = plain(url)
        fit = []
        for r in rules:
            rh, rp = r.rule.split("/", 1)
            if (host == rh or host.endswith("." + rh)) and path.startswith("/" + rp) and host:
                fit.append((len(r.rule), r.rule, r.verdict))
        rule = max(fit)[1:] if fit else (None, "block" if host and host + path in listed else "allow")
        out.append((i or -1, host, path, rule[0] or "", rule[1]))
    return sorted(out)


def test_rules_and_list(spark):
    df = spark.createDataFrame([(i, u, "own") for i, u in URLS], "page_id long, url string, host string")
    listed = spark.createDataFrame([("h.net/a",), ("shop.com",), (None,), ("elsewhere/",)], "key string")
    got = U.judge(df, queries.URL_RULES, listed).collect()
    assert sorted((r["page_id"] or -1, r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in got) == \
        expected(URLS, queries.URL_RULES, {"h.net/a", "shop.com"})


def test_empty_tables(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(df, queries.URL_RULES, df.select(F.col("url").alias("key"))).count() == 0
    one = spark.createDataFrame([(1, "http://h.net/a")], "page_id long, url string")
    assert U.judge(one, queries.URL_RULES, df.select(F.col("url").alias("key"))).first()["verdict"] == "allow"


@pytest.mark.parametrize("share,slice_bits", [(0.3, U.SLICE_BITS), (0.02, U.SLICE_BITS), (0.3, 2048), (1.0, 4096)])
def test_cascade_is_exact_over_the_universe(spark, share, slice_bits):
    h1, h2 = U.key_hashes(F.col("key"))
    keys = (spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"),
                                     (F.col("id") % 100 < int(share * 100)).alias("listed"))
            .withColumn("h1", h1).withColumn("h2", h2))
    cascade = U.build_cascade(keys.select("h1", "h2", "listed"), slice_bits=slice_bits)
    p = keys.toPandas()
    assert (cascade.contains(p.h1.to_numpy(), p.h2.to_numpy()) == p.listed.to_numpy()).all()
    if share < 1:
        assert max(map(len, cascade.slices)) > 1
    if slice_bits < U.SLICE_BITS and share < 1:
        assert len(cascade.slices) > 1
    bits = sum(lv.bits for s in cascade.slices for lv in s)
    assert bits < 16 * max(p.listed.sum(), 64) or share < 0.1


def test_no_listed_keys(spark):
    assert not U.Cascade([[]]).contains(np.array([1, 2]), np.array([3, 4])).any()


def test_one_slice_at_a_time_equals_one_cascade(spark):
    """A list cut into many slices, with nulls, long URLs and repeated rows."""
    urls = [f"https://h{i % 90}.example.org/p{i % 37}/{'x' * (i % 5)}?q={i}" for i in range(600)]
    urls += [None, "no scheme", "http://", "https://LONG.org/" + "y" * 20_000, "https://LONG.org/" + "y" * 20_000]
    pages = spark.createDataFrame([(i if i % 50 else None, u) for i, u in enumerate(urls)], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i}.example.org/p{j}/",) for i in range(0, 90, 2) for j in range(37)] + [("long.org/" + "y" * 20_000,)],
                                   "key string")
    rules = [U.Rule("org/", "allow"), U.Rule("h4.example.org/p1", "block")][1:]

    def out(bits):
        return sorted(map(str, U.judge(pages, rules, listed, slice_bits=bits).collect()))

    one = out(1 << 20)
    assert out(2000) == one and len(one) == len(urls) and any("block" in r for r in one) and any("allow" in r for r in one)
