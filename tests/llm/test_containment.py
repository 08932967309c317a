import math
import random
import re

import duckdb
import pytest

from lintora.llm import containment
from lintora.llm.queries import op4_containment

DOCS, ITEMS = "doc_id long, text string, item string, h long", "item_id long, text string, doc long"


def shingles(text, width=None):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    width = width or min(5, len(words))
    return width, {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute(docs, items, t=0.8):
    out = {}
    for i, s, *_ in items:
        width, own = shingles(s)
        for d, text, *_ in docs:
            n = len(own & shingles(text, width)[1]) if own else 0
            if own and n >= math.ceil(t * len(own) - 1e-9):
                out[d, i] = max(out.get((d, i), (0, 0, 0)), (n / len(own), n, len(own)))
    return sorted(((d, i, n, q, c) for (d, i), (c, n, q) in out.items()), key=str)


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_equals_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(containment, "MAX_BROADCAST_ROWS", bound)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 3, 4, 5, 6, 12, 40]))), 0) for i in range(40)]
    items += [(1, items[1][1], 0), (7, "quite another text of the seventh item", 0), (None, "item without any id at all here", 0), (50, None, 0), (51, "", 0), (52, " ... ", 0)]
    docs = []
    for d in range(60):
        parts = rng.choices(vocab, k=rng.randint(0, 80))
        words = items[rng.randrange(len(items))][1] or ""
        words = words.split()
        for _ in range(rng.randint(0, 3)):
            if words:
                words[rng.randrange(len(words))] = "changed"
        docs.append((d, " ".join([*parts[: len(parts) // 2], *words, *parts[len(parts) // 2 :]]).upper().replace(" ", ", "), None, 1))
    docs += [(None, None, None, None), (99, "", "", 0), (3, docs[3][1], None, 1), (3, "other", None, 1), (100, "w1 " * 40000, "", 0)]
    got = containment.contained_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)
    assert len(got) > 20


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "some words", "", 0)], DOCS)
    assert containment.contained_items(none, spark.createDataFrame([(1, "some words", 0)], ITEMS)).collect() == []
    assert containment.contained_items(one, spark.createDataFrame([], ITEMS)).collect() == []


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.sql(f"SELECT doc_id, item_id, n_shared, n_shingles, containment FROM ({containment.SQL})").fetchall()
    assert sorted(map(tuple, op4_containment(spark, sf).collect())) == sorted(want)
    assert len(want) > 5
