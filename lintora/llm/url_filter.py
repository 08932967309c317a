"""URL filtering: a blocked Bloom filter, then an exact hash join.

The list holds canonical URLs: a host and the beginning of a path, with a
verdict. Hosts match with all their subdomains. The filter is a table of blocks
of 256 bits; a listed key sets eight bits of one block, one in each of eight
words of 32 bits. It holds the listed hosts, and the listed URLs.

A URL's possible hosts are its own and the parent domains that have as many
labels as any listed host. Those that pass the filter meet a table of the path
lengths listed for each host, which gives the possible keys; those that pass the
filter meet the list in a hash join, and what they find is compared as text.
Keys are hashes, so that long hosts and paths are not repeated.

All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintora.llm.common import small, written

WORDS = 8
#: Bits for each key. A block then holds about 16 keys, and about one other key
#: in a thousand passes wrongly.
BITS_PER_KEY = 16
#: Filters and lists of no more rows (and of bounded bytes) are broadcast.
MAX_BROADCAST_ROWS = 1_000_000


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return _lower(F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    bare = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    return F.when(F.contains(bare, F.lit("/")), F.substring(bare, F.instr(bare, "/"), F.lit(2_000_000_000))).otherwise("")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.lit(2_000_000_000))).otherwise("")


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(n_blocks))


def _bits(key: Column) -> list[Column]:
    """One bit for each word of a block, five bits of a hash each."""
    h = F.xxhash64(key, F.lit(2))
    return [F.call_function("shiftleft", F.lit(1), F.shiftright(h, 5 * w).bitwiseAND(31).cast("int")) for w in range(WORDS)]


def bloom_filter(keys: DataFrame) -> tuple[DataFrame, int]:
    """Blocks (block, w0 .. w7) that have the bits of all keys.key, and the
    number of blocks, by which look-ups find theirs."""
    n_blocks = max(1, keys.count() * BITS_PER_KEY // (32 * WORDS))
    bits = keys.select(_block(F.col("key"), n_blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), n_blocks


def possible(probes: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The rows of probes whose key the filter may hold: all listed keys, few others."""
    columns = probes.columns
    met = probes.withColumn("block", _block(F.col("key"), n_blocks)).join(small(blocks, MAX_BROADCAST_ROWS), "block")
    held = [F.col(f"w{i}").bitwiseAND(b) == b for i, b in enumerate(_bits(F.col("key")))]
    passes = held[0]
    for h in held[1:]:
        passes = passes & h
    return met.filter(passes).select(*columns)


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages.

    listed: host, path, verdict. A listed URL fits the URLs of its host and all
    subdomains whose path begins with its path. The longest (host and path
    together) wins, by name in a tie; of equal ones with different verdicts,
    block. A URL that none fits has a null rule and the verdict `default`.

    The list may hold any number of hosts, labels and path lengths. Only the
    different numbers of labels of its hosts are collected: k of them need hosts
    of k * k bytes together.

    Null URLs and URLs without :// have empty host and path and fit nothing but
    an empty rule, which is ignored as are null ones. Repeated rows and null ids
    are kept; other columns are ignored; empty tables give no rows, or defaults.
    Each distinct URL is looked up once."""
    rules = listed.filter("host is not null and path is not null and host <> ''").select(_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max(F.col("rule_verdict") == "block").alias("blocks"))
    host_key = F.xxhash64("rule_host")
    rules = written(rules.select(F.xxhash64(host_key, "rule_path").alias("key"), host_key.alias("host_key"), "rule_host", "rule_path", F.size(F.split("rule_host", r"\.", -1)).alias("n_labels"), F.char_length("rule_path").alias("length"), "blocks"), "rules")
    depths = sorted(r.n_labels for r in rules.select("n_labels").distinct().collect())
    lengths = written(rules.groupBy("host_key").agg(F.collect_set("length").alias("lengths")), "path-lengths")
    listed_keys = rules.select("key").unionByName(lengths.select(F.col("host_key").alias("key")))
    blocks, n_blocks = bloom_filter(listed_keys)
    blocks = written(blocks, "bloom-filter")

    url = F.col("url")
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.xxhash64(url_col).alias("u"), F.xxhash64(F.col(url_col), F.lit(1)).alias("v"))
    urls = named.filter("url is not null").groupBy("u", "v").agg(F.first("url").alias("url")).select("u", "v", host_of(url).alias("host"), path_of(url).alias("path"))
    urls = written(urls, "urls")
    n_labels = F.length("host") - F.length(F.replace("host", F.lit("."))) + 1
    fitting = F.filter(F.array(*[F.lit(d) for d in depths]).cast("array<int>"), lambda d: d <= n_labels)
    domains = F.transform(fitting, lambda d: F.xxhash64(F.call_function("substring_index", F.col("host"), F.lit("."), -d)))
    hosts = possible(urls.select("u", "v", "path", F.explode(domains).alias("key")), blocks, n_blocks)
    known = hosts.withColumnRenamed("key", "host_key").join(small(lengths, MAX_BROADCAST_ROWS), "host_key")
    starts = F.transform(F.filter("lengths", lambda n: n <= F.char_length("path")), lambda n: F.xxhash64("host_key", F.substring("path", F.lit(1), n)))
    probes = possible(known.select("u", "v", F.explode(starts).alias("key")), blocks, n_blocks)
    hits = probes.join(small(rules.select("key", "rule_host", "rule_path", "blocks"), MAX_BROADCAST_ROWS), "key").drop("key")
    same = (F.col("host") == F.col("rule_host")) | F.endswith("host", F.concat(F.lit("."), "rule_host"))
    fits = hits.join(urls, ["u", "v"]).filter(same & F.startswith("path", "rule_path"))
    rule = F.concat("rule_host", "rule_path")
    best = fits.groupBy("u", "v").agg(F.max(F.struct(F.char_length(rule).alias("n"), rule.alias("rule"), "blocks")).alias("best"))
    found = named.join(best, ["u", "v"], "left")
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.blocks"), "block").otherwise("allow")
    empty = F.lit("")
    return found.select("page_id", F.coalesce(host_of(url), empty).alias("host"), F.coalesce(path_of(url), empty).alias("path"), F.col("best.rule").alias("rule"), verdict.alias("verdict"))


SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT p.page_id, p.host, p.path, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path DESC) AS nth
  FROM parts p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rule_verdict, 'allow') AS verdict
FROM parts p LEFT JOIN (SELECT * FROM fits WHERE nth = 1) f ON p.page_id = f.page_id
"""
