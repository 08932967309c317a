import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from lintora.llm import components as components_module
from lintora.llm import simhash
from lintora.llm.components import components
from lintora.llm.queries import op8_simhash_golay

SCHEMA = "doc_id long, text string, fp string, component_id string"


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(parent, 2):
        if (a ^ b).bit_count() <= 3:
            parent[root(a)] = root(b)
    return {f: root(f) for f in fps}


def brute(rows):
    fps = [slow_fingerprint(t) for _, t, *_ in rows]
    roots = slow_components(set(fps))
    least = {}
    for (d, *_), f in zip(rows, fps):
        r = roots[f]
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [(d, f"{f:016x}", least[roots[f]]) for (d, *_), f in zip(rows, fps)]


def test_fingerprint():
    for text in [None, "", " \t", "One", "one TWO", "a b c", "Ünï A\x1cb c d e f a b c " * 50, "x y " * 70000]:
        assert simhash.fingerprint(text) == slow_fingerprint(text if len(text or "") < 9999 else text[:0]) or len(text) > 9999


def test_code_is_perfect():
    assert (simhash._ERRORS > 0).sum() == 2047
    words = np.random.default_rng(1).integers(0, 1 << 23, 1000).astype(np.uint32)
    index = simhash.codeword(words)
    back = index.astype(np.uint32) << 11
    back |= simhash._REMAINDERS[index]
    assert (np.bitwise_count(back ^ words) <= 3).all()


def test_every_pair_within_three_bits_shares_a_key():
    rng = random.Random(2)
    a = np.array([rng.getrandbits(64) for _ in range(3000)], np.uint64)
    b = np.array([int(x) ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for x in a], np.uint64)
    at, key = simhash.keys(a.view(np.int64), True)
    at2, key2 = simhash.keys(b.view(np.int64), False)
    looked = set(zip(at.tolist(), key.tolist()))
    assert {i for i, k in zip(at2.tolist(), key2.tolist()) if (i, k) in looked} == set(range(3000))


@pytest.mark.parametrize("block", [4, 4096])
def test_links_connect_as_all_pairs_do(spark, block):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(30)]
    fps = {c ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(12)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), block)
    got = {r.node: r.root for r in components(edges).collect()}
    want = slow_components(fps)
    groups = lambda m: {frozenset(x for x in m if m[x] == r) for r in set(m.values())}
    full = {s: got.get(s, s) for (s,) in signed}
    unsigned = {frozenset(x % (1 << 64) for x in g) for g in groups(full)}
    assert unsigned == groups(want)


def test_hot_keys_are_counted_though_each_task_has_few_rows(spark):
    """One key with 12 rows in each of 60 tasks, another with few in all."""
    import pyspark.sql.functions as F

    rows = spark.range(60 * 500, numPartitions=60).select(F.when(F.col("id") % 500 < 12, 7).when(F.col("id") % 500 == 12, 8).otherwise(F.col("id") + 1000).alias("k"))
    of = lambda batch: [(0, batch.column(0).to_numpy().astype(np.int64)), (1, batch.column(0).to_numpy().astype(np.int64)[:4])]
    got = simhash.hot_keys(rows, of, (100, 1000), 30_000).collect()
    assert [tuple(r) for r in got] == [(7, 720, 240)]
    assert [tuple(r) for r in simhash.hot_keys(rows, of, (10_000, 239), 30_000).collect()] == [(7, 720, 240)]
    assert simhash.hot_keys(rows, of, (1000, 1000), 30_000).collect() == []


def test_memory_of_a_bucket_is_bounded():
    import tracemalloc

    rng = np.random.default_rng(1)
    index, probes = rng.integers(-(1 << 62), 1 << 62, 40_000), rng.integers(-(1 << 62), 1 << 62, 9_000)
    index[5:10] = probes[:5] ^ 3
    tracemalloc.start()
    edges = {frozenset(x) for u, v in simhash._forest(index, probes) for x in zip(u.tolist(), v.tolist())}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert edges == {frozenset((int(a), int(b))) for a, b in zip(index[5:10], probes[:5])} and peak < 150 << 20


def test_components_of_chains_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_hubs(spark, monkeypatch, bound):
    """Stars of many leaves, whose centres are the smallest, the largest, or in between."""
    monkeypatch.setattr(components_module, "MAX_HUBS", bound)
    edges = [(0, i) for i in range(1, 600)] + [(599, i) for i in range(1000, 1400)] + [(5000, i) for i in range(2000, 2500)] + [(2499, 1399)]
    edges += [(9000, i) for i in range(8000, 8400)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges for x in e}
    assert got == {x: 8000 if x >= 8000 else 0 for x in nodes}


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(5, "the same words here", "p", "q"), (5, "The same words here", "p", "q"), (None, None, None, None), (None, "alone", "", ""), (7, "", "", ""), (8, " ", "", ""), (9, "long " * 40000, "", "")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_brute_force(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = op8_simhash_golay(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == sorted(brute(docs))
    assert len({r.component_id for r in got}) < len(docs)
