import hashlib
import random
import re

import numpy as np
import pytest

from lintora.llm import substrings
from lintora.llm.queries import op9_substrings

SCHEMA = "doc_id long, text string, path long, first int"


def brute(rows, k):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    ids = [float("inf") if d is None else d for d, *_ in rows]
    seen = {}
    for i, w in enumerate(words):
        for at in range(len(w) - k + 1):
            seen.setdefault(tuple(w[at : at + k]), []).append((ids[i], i, at))
    removed = [set() for _ in rows]
    for window, places in seen.items():
        for d, i, at in places:
            if any(e < d or (j == i and b < at) for e, j, b in places):
                removed[i].update(range(at, at + k))
    return sorted(((d, len(w), len(r), " ".join(x for n, x in enumerate(w) if n not in r)) for (d, *_), w, r in zip(rows, words, removed)), key=str)


@pytest.mark.parametrize("k,anchor,seed", [(5, 2, 0), (20, 6, 1), (8, 8, 2)])
def test_equals_brute_force(spark, k, anchor, seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "cé", "d\x1ce", "f."] if k == 5 else [f"w{i}" for i in range(60)]
    passages = [rng.choices(vocab, k=rng.randint(k - 2, 3 * k)) for _ in range(6)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choices(vocab, k=rng.randint(0, k)) + rng.choice(passages)
        rows.append((d * 3, rng.choice([" ", "\n", "\t "]).join(words), 1, 2))
    rows += [(7 * 3, rows[9][1], 0, 0), (9 * 3, rows[9][1], 0, 0), (None, rows[5][1], None, None), (None, rows[6][1], None, None), (1000, None, 0, 0), (1001, "", 0, 0), (1002, "same " * 3000, 0, 0)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA), k=k, anchor=anchor).collect()
    want = brute(rows, k)
    assert sorted(map(tuple, got), key=str) == want
    assert sum(r[2] for r in want) > 100


def test_super_kmers_cover_all_windows():
    text = " ".join(random.Random(3).choices([f"w{i}" for i in range(9)], k=700))
    walk = substrings.Walk(text)
    _, path, first, count = walk.super_kmers()
    assert (first[1:] == (first + count)[:-1]).all() and first[0] == 0 and count.sum() == walk.n
    other = substrings.Walk("x " + text + " y")
    _, path2, first2, count2 = other.super_kmers()
    assert set(path[1:-1].tolist()) <= set(path2.tolist())
    assert np.array_equal(other.kmers()[1:-1], walk.kmers())


def test_walks_cost_a_few_times_the_cutting_of_words():
    import time

    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(20_000)]
    texts = [" ".join(rng.choices(vocab, k=550)) for _ in range(300)]

    def seconds(work):
        took = []
        for _ in range(4):
            began = time.process_time()
            for t in texts:
                work(t)
            took.append(time.process_time() - began)
        return min(took)

    def walked(text):
        walk = substrings.Walk(text)
        walk.super_kmers(), walk.own_repeats()

    assert seconds(walked) <= 11 * seconds(lambda t: t.encode().split())


def test_spans_that_are_not_their_source_stay(spark):
    """A hash that met by chance names a span whose words differ at the source."""
    words = [f"w{i}" for i in range(60)]
    texts = spark.createDataFrame([(1, 11, 1, " ".join(words)), (2, 22, 2, " ".join(["x", *words[10:40]]))], "d long, text_hash long, doc_id long, text string")
    spans = spark.createDataFrame([(2, 22, 1, 3, 1, 11, 10), (2, 22, 9, 2, 1, 11, 30)], substrings._SPAN)
    got = {r.doc_id: r for r in substrings.without_spans(texts, spans, k=5).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 7 and got[2].kept == " ".join(["x", *words[17:40]])


def test_words_are_those_of_split_and_equal_ones_have_equal_hashes():
    rng = random.Random(6)
    for i in range(60):
        text = "".join(rng.choices(" \t\n\x0b\x0c\r\x1c\x85aéb\u2003", k=rng.randint(0, 300)))
        data = (text + (" x" * 40_000 + " " + "y" * 70_000 + " z y " + "q" * 65_535 + " " + "q" * 65_536 if i % 20 == 0 else "")).encode()
        starts, ends = substrings._word_places(data)
        words = data.split()
        assert [data[a:b] for a, b in zip(starts, ends)] == words
        hashes = substrings.word_hashes(data, starts, ends).tolist()
        known = dict(zip(words, hashes))
        assert [known[w] for w in words] == hashes and len(set(hashes)) == len(known)


def test_stretches_that_follow_each_other_are_one_span(spark):
    found = [(2, 22, 4, 3, 1, 11, 14), (2, 22, 7, 1, 1, 11, 17), (2, 22, 8, 2, 1, 11, 30), (2, 22, 7, 1, 1, 11, 17), (2, 22, 20, 1, 1, 11, 30)]
    got = substrings.long_spans(spark.createDataFrame(found, substrings._SPAN)).collect()
    assert sorted(map(tuple, got)) == [(2, 22, 4, 4, 1, 11, 14), (2, 22, 8, 2, 1, 11, 30), (2, 22, 20, 1, 1, 11, 30)]
    walk = substrings.Walk("same " * 100 + "and other words", 5, 2)
    assert [x.tolist() for x in walk.own_repeats()] == [[1], [95], [0]]


def test_many_rows_without_an_id_take_linear_time(spark):
    import time

    rng = random.Random(4)
    text = " ".join(rng.choices([f"w{i}" for i in range(900)], k=400))
    rows = [(None, text if i % 2 else text + f" tail{i % 300}", 0, 0) for i in range(3000)]
    began = time.time()
    got = substrings.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3000 and all(r.n_removed == 0 for r in got) and time.time() - began < 60


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(d, n, r, hashlib.sha256(kept.encode()).hexdigest()) for d, n, r, kept in brute(docs, 20)]
    assert sorted(map(tuple, op9_substrings(spark, sf).collect())) == sorted(want)
