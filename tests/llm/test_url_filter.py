import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lintora.llm import url_filter
from lintora.llm.queries import URL_RULES, op7_url_filter

PAGES, RULES = "page_id long, url string, host string, verdict string", "host string, path string, verdict string"


def brute(pages, rules):
    out = []
    for page, url, *_ in pages:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
            tail = rest[end:]
            path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(h + p), h + p, v == "block") for h, p, v in rules if h and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((page, host, path, best and best[1], ("block" if best[2] else "allow") if best else "allow"))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_equals_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(url_filter, "MAX_BROADCAST_ROWS", bound)
    rng = random.Random(7)
    bits = ["http://", "HTTPS://", "://", "a.", "Example.", "org", "com", ".", "/", "/es/", "/en/1", "?", "#", "x", "é", ":80", "\n"]
    pages = [(i, "".join(rng.choices(bits, k=rng.randint(0, 9))), "h", "v") for i in range(400)]
    pages += [(i, f"https://www.example.org{p}", "", "") for i, p in enumerate(["", "/", "/es/x", "/en/12?q", "/en/2"], 500)]
    pages += [(None, "http://a.com/fr/1", None, None), (1, None, None, None), (2, "", "", ""), (2, "", "", ""), (3, "http://x.org/" + "y" * 50000, "", "")]
    rules = [*URL_RULES, ("example.org", "/es/", "allow"), ("", "/", "block"), (None, "/", "block"), ("com", None, "block"), ("a.org", "", "block")]
    got = url_filter.judge(spark.createDataFrame(pages, PAGES), spark.createDataFrame(rules, RULES)).collect()
    assert sorted(map(tuple, got), key=str) == brute(pages, rules)


def test_long_lists_hosts_and_paths(spark):
    """Thousands of rules with hundreds of path lengths, and URLs of many labels."""
    rng = random.Random(8)
    hosts = [f"h{i}.example{i % 9}.org" for i in range(300)] + ["org", "example1.org", ".".join("abc"[i % 3] for i in range(300))]
    rules = [(rng.choice(hosts), "/" + "p" * rng.randint(0, 400), rng.choice(["block", "allow"])) for _ in range(3000)]
    pages = [(i, f"http://{rng.choice(['', 'www.', 'x.y.'])}{rng.choice(hosts)}/{'p' * rng.randint(0, 500)}{rng.choice(['', 'q'])}", "", "") for i in range(600)]
    pages += [(1000, "http://" + "l." * 16000 + "h3.example3.org/pp", "", ""), (1001, "http://" + "." * 9000 + "org/" + "p" * 90_000, "", "")]
    got = url_filter.judge(spark.createDataFrame(pages, PAGES), spark.createDataFrame(rules, RULES)).collect()
    assert sorted(map(tuple, got), key=str) == brute(pages, list(dict.fromkeys(rules)))
    assert sum(r.rule is not None for r in got) > 300


def test_empty_tables(spark):
    none, rules = spark.createDataFrame([], PAGES), spark.createDataFrame(URL_RULES, RULES)
    assert url_filter.judge(none, rules).collect() == []
    one = spark.createDataFrame([(1, "http://a.com/de/", "", "")], PAGES)
    assert [r.verdict for r in url_filter.judge(one, spark.createDataFrame([], RULES)).collect()] == ["allow"]


def test_filter_holds_all_keys_and_few_others(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks, n_blocks = url_filter.bloom_filter(keys)
    assert url_filter.possible(keys, blocks, n_blocks).count() == 20000
    others = spark.range(20000).select(F.concat(F.lit("o"), "id").alias("key"))
    assert url_filter.possible(others, blocks, n_blocks).count() < 60


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = db.sql(url_filter.SQL).fetchall()
    got = [tuple(r) for r in op7_url_filter(spark, sf).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {r[4] for r in got} == {"allow", "block"}
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(got, key=str) == brute(pages, URL_RULES)
