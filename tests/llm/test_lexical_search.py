import random

import numpy as np
import pyarrow as pa

from lintora.llm import lexical_search as ls
from lintora.llm.queries import op11_lexical_search

DOCS, ITEMS = "doc_id long, text string, term string, score long, block long", "item_id long, text string, rank int, pos string"


def search(spark, docs, items, **options):
    docs = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in docs], DOCS)
    items = spark.createDataFrame([(i, t, 9, "y") for i, t in items], ITEMS)
    return sorted(map(tuple, ls.search(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def expected(docs, items, k=ls.K):
    return sorted(ls.brute_force(docs, items, k), key=str)


def corpus(n, seed, words=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É", "日本", "ß9"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(d, " ".join(rng.choices(vocabulary, weights, k=rng.choice((0, 3, 20, 200))))) for d in range(n)]


def test_terms_are_runs_of_kept_characters():
    assert ls.terms("Ab-É9_x\x7fÉa [日本]") == [b"ab", "É9".encode(), b"x", "Éa".encode(), "日本".encode()]
    assert ls.terms("a\u00a0b") == ["a\u00a0b".encode()]  # beyond ASCII: part of a term
    assert ls.terms(None) == ls.terms(" -_\t") == []


def test_nulls_ties_repeated_rows_long_texts_and_clashing_columns(spark):
    docs = [(1, "red fish"), (2, "red fish"), (2, "red fish"), (None, "red fish"), (3, None), (4, ""), (5, "blue " * 300_000 + "fish"), (6, "-- !"), (7, "Red RED fish-fish")]
    items = [(1, "red fish"), (1, "red fish"), (None, "blue"), (2, None), (3, ""), (4, "unknown words"), (5, "fish fish red")]
    assert search(spark, docs, items) == expected(docs, items)
    assert search(spark, docs, items, k=2, block_docs=2, group=2) == expected(docs, items, 2)


def test_empty_tables(spark):
    assert search(spark, [], [(1, "a")]) == []
    assert search(spark, [(1, "a")], []) == []
    assert search(spark, [(1, None), (2, "!")], [(1, "a")]) == []


def test_bundles_over_many_blocks_and_groups_equal_brute_force(spark):
    docs, items = corpus(700, 1), [(i, t) for i, t in corpus(60, 2)]
    want = expected(docs, items)
    assert search(spark, docs, items) == want
    assert search(spark, docs, items, block_docs=37, group=5) == want
    assert search(spark, docs, items, owners=(), block_docs=100) == want
    assert search(spark, docs, items, owners=(0.001, 0.01, 0.05, 0.2, 0.5), block_docs=100) == want


def test_a_word_of_all_documents_and_a_large_group_of_copies(spark):
    docs = [(d, "common") for d in range(3000)] + [(d, f"common rare{d % 7}") for d in range(3000, 3300)]
    items = [(1, "common"), (2, "common rare3"), (3, "rare1 rare1 common")]
    assert search(spark, docs, items, block_docs=256) == expected(docs, items)


def test_a_stage_leaves_out_only_documents_that_cannot_be_first():
    def lists(pos, impact, rest):
        asked = [[{"item": 7, "weight": 10, "rest": rest}]]
        return pa.table({"pos": pa.array([pos], pa.list_(pa.int32())), "impact": pa.array([impact], pa.list_(pa.int32())), "asked": pa.array(asked)})

    key, none = (pa.scalar(3), pa.scalar(0)), pa.table({})
    kept = ls.visit(key, none, lists([0, 1, 2, 3], [50, 40, 30, 5], 100), 2, False).to_pylist()
    assert kept == [{"block": 3, "group": 0, "item": 7, "pos": [0, 1, 2], "score": [500, 400, 300]}]  # 300 + 100 may still reach 400
    bundles = ls.visit(key, none, lists([0, 1, 2, 3], [50, 40, 30, 5], 100), 2, False)
    last = ls.visit(key, bundles, lists([2], [10], 0), 2, True).to_pylist()
    assert last == [{"block": 3, "group": 0, "item": 7, "pos": [0, 1], "score": [500, 400]}]  # a tie goes to the lower place
    assert ls.first_places(np.array([0, 5, 5, 9]), 2).tolist() == [1, 3]


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = ls.brute_force(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect())
    assert sorted(map(tuple, op11_lexical_search(spark, sf_dir).collect())) == sorted(want)
