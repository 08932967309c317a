import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lintora.llm import quality
from lintora.llm.queries import op12_quality

DOCS, LABELS = "doc_id long, text string, label int, slots string, score double", "doc_id long, quality int, text string"


def tables(spark, docs, labels):
    return spark.createDataFrame([(d, t, 7, "x", 0.5) for d, t in docs], DOCS), spark.createDataFrame([(d, q, "z") for d, q in labels], LABELS)


def test_features_are_indicators_of_words_and_pairs():
    f = quality.Features()
    assert len(f.of("a b")) == 3 and f.of("a b a b").tolist() == np.unique(np.concatenate([f.of("a b"), f.of("b a")])).tolist()
    assert len(f.of(None)) == len(f.of("")) == len(f.of(" \n")) == 0
    assert f.of("word%%%").tolist() == f.of("word %%%").tolist()
    shared = set(f.of("x x x").tolist()) & set(f.of("y y y").tolist())
    assert len(shared) >= 2  # the sign of repetition and its pair
    assert f.of("w " * 200_000).tolist() == f.of("w w w").tolist()


def test_ratios_are_counted_over_all_labelled_documents(spark):
    docs, labels = tables(spark, [(d, t) for d, t in ((1, "good fish"), (2, "good"), (3, "bad fish"), (4, "bad bad bad"), (None, "bad"), (6, None))], [(1, 1), (2, 1), (3, 0), (4, 0), (6, 1), (9, 0), (2, None)])
    described = quality._described(quality.labelled(docs, labels))
    f, n, kept = quality.Features(), [Counter(), Counter()], {d for d in (1, 2, 3, 4, 6) if zlib.crc32(str(d).encode()) % 5}
    for d, t, label in ((1, "good fish", 1), (2, "good", 1), (3, "bad fish", 0), (4, "bad bad bad", 0), (6, None, 1)):
        if d in kept:
            n[label].update(f.of(t).tolist())
    sums = [sum(c.values()) + quality.FEATURES for c in n]
    got = quality.log_count_ratios(described)
    for slot in {*n[0], *n[1], 5}:
        assert got[slot] == pytest.approx(math.log((n[1][slot] + 1) / sums[1]) - math.log((n[0][slot] + 1) / sums[0]))


def objective(weights, bias, slots, labels, ratios, penalty):
    share = np.array([np.mean(labels == 0), np.mean(labels > 0)])
    losses = [penalty / (2 * share[int(y > 0)]) * max(0, 1 - (1 if y > 0 else -1) * (weights[x] @ ratios[x] + bias)) for x, y in zip(slots, labels)]
    return (weights @ weights + bias * bias) / 2 + sum(losses)


def test_descent_reaches_the_least_objective():
    rng = np.random.default_rng(3)
    slots = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(40)]
    labels = np.array([int(len(x) and x[0] < 2 or rng.random() < 0.2) for x in slots])
    ratios = np.array([2.0, 1.0, -0.5, 0.3, -1.0, 0.7])
    weights, bias = quality.descend(slots, labels, ratios, penalty=0.5, epochs=20_000, tolerance=1e-7)
    least = objective(weights, bias, slots, labels, ratios, 0.5)
    for _ in range(3000):  # no nearby model is better, so that none is: it is convex
        step = rng.normal(size=7) * 10 ** rng.uniform(-4, 0)
        assert objective(weights + step[:6], bias + step[6], slots, labels, ratios, 0.5) >= least - 1e-6


def test_curve_is_monotone_and_meets_the_rate():
    margins = np.array([-2, -1, -1, 0, 1, 1, 2, 3.0])
    labels = np.array([0, 0, 1, 0, 1, 0, 1, 1])
    a, b = quality.curve(margins, labels)
    assert a > 0 and (1 / (1 + np.exp(-(a * margins + b)))).mean() == pytest.approx(0.5, abs=0.05)
    assert quality.curve(-margins, labels)[0] == 0


def test_nulls_repeated_rows_and_extra_columns(spark):
    docs = [(d, "fine words here" if d % 3 else "junk !! junk !!") for d in range(1, 200)] + [(5, "fine words here"), (None, "junk !!"), (300, None), (301, ""), (302, " "), (303, "junk !! " * 100_000)]
    docs, labels = tables(spark, docs, [(d, int(d % 3 > 0)) for d in range(1, 200)] + [(5, 1), (5, None), (None, 0), (7, 3)])
    model = quality.learn(docs, labels)
    got = quality.score(docs, model)
    assert got.columns == ["doc_id", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == 205 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].score > 0.9 and by[3].score < 0.1 and by[None].score < 0.3 and by[303].score < 0.1
    assert by[300].score == by[301].score == by[302].score
    again = quality.learn(docs.repartition(7), labels.repartition(3))
    assert again.bias == model.bias and (again.weights == model.weights).all()


def test_empty_tables_and_one_label(spark):
    docs, labels = tables(spark, [(1, "a"), (2, "b")], [])
    assert [r.score for r in quality.score(docs, quality.learn(docs, labels)).collect()] == [0.5, 0.5]
    none, _ = tables(spark, [], [])
    assert quality.score(none, quality.learn(none, labels)).collect() == []
    _, ones = tables(spark, [], [(d, 1) for d in (1, 2)])
    assert all(r.score > 0.5 for r in quality.score(docs, quality.learn(docs, ones)).collect())


def test_bounds_of_the_sample(spark):
    docs, labels = tables(spark, [(d, f"{'good' if d % 2 else 'bad'} w{d}") for d in range(1, 400)], [(d, d % 2) for d in range(1, 400)])
    model = quality.learn(docs, labels, max_docs=60)
    assert np.count_nonzero(model.weights) <= 2**18
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert np.mean([(scores[d] >= 0.5) == d % 2 for d in scores]) > 0.95


def test_query_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = op12_quality(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    told = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    low, high = [s for s, _, y in told if y == 0], [s for s, _, y in told if y == 1]
    assert len(told) > 500 and np.mean([[h > s for h in high] for s in low]) > 0.99
    assert np.mean([p == y for _, p, y in told]) > 0.98
