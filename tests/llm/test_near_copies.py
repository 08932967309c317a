import itertools
import random

import numpy as np
import pytest

from lintora.llm import near_copies
from lintora.llm.near_copies import MAX_WIDE_BITS, Prints, forest, keys


def brute(rows):
    """component_id of every row by all pairs of wide fingerprints."""
    prints = Prints()
    held = [prints.of(t) for _, t in rows]
    wide = {node: np.array(w, np.int64) for node, _, w in held}
    nodes = list(wide)
    table = np.array([wide[n] for n in nodes]).reshape(-1, 4)
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(nodes)):
        near = np.bitwise_count((table[i + 1 :] ^ table[i]).view(np.uint64)).sum(1) <= MAX_WIDE_BITS
        for j in np.flatnonzero(near) + i + 1:
            parent[root(i)] = root(j)
    at, least = {n: i for i, n in enumerate(nodes)}, {}
    for (d, _), (node, _, _) in zip(rows, held):
        r = root(at[node])
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [(d, least[root(at[node])]) for (d, _), (node, _, _) in zip(rows, held)]


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def made(rng, groups=8, copies=13, words=400, longest=300):
    """Edited copies, chains of them, and a passage that many texts share."""
    words = [f"w{i}" for i in range(words)]
    passage, texts = rng.choices(words, k=30), []
    for _ in range(groups):
        base = rng.choices(words, k=rng.randint(60, longest))
        chain = [base]
        for _ in range(copies - 1):
            copy = list(base if rng.random() < 0.6 else chain[-1])
            for _ in range(rng.randint(0, 1 + len(base) // 60)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            chain.append(copy)
        texts += chain
    texts += [rng.choices(words, k=rng.randint(60, 100)) + passage + rng.choices(words, k=20) for _ in range(60)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [3, near_copies.BLOCK])
def test_components_equal_all_pairs(spark, block):
    rows = made(random.Random(1))
    rows += [(None, rows[3][1]), (5, rows[5][1].upper()), (900, None), (901, " "), (None, "alone"), (902, "one two")]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_recall_of_jaccard_pairs(spark):
    """Of the linked pairs of different texts with a Jaccard similarity of 0.8 or
    more, at least 0.97 end in one component; those under 0.5 do not."""
    rows = made(random.Random(4), groups=25, copies=6, words=4000)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = {d: shingles(t) for d, t in rows}
    like = {(a, b): len(held[a] & held[b]) / len(held[a] | held[b]) for a, b in itertools.combinations(held, 2)}
    close = [got[a] == got[b] for (a, b), s in like.items() if s >= 0.8]
    assert len(close) > 100 and sum(close) >= 0.97 * len(close)
    apart = {d for d in held if all(s < 0.5 for p, s in like.items() if d in p)}
    assert len(apart) > 40 and all(got[d] == d for d in apart)


def test_recall_over_all_pairs_of_a_table(spark):
    """Of all pairs of different texts with a five-word Jaccard similarity of 0.8
    or more at least 0.9 end in one component, and nearly all that are near no
    other text stay alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    held = {d: shingles(t) for d, t in docs.select("doc_id", "text").collect()}
    by_shingle = {}
    for d, s in held.items():
        for x in s:
            by_shingle.setdefault(x, []).append(d)
    common, nearest = {}, dict.fromkeys(held, 0.0)
    for ids in by_shingle.values():
        for pair in itertools.combinations(ids, 2):
            common[pair] = common.get(pair, 0) + 1
    close = []
    for (a, b), n in common.items():
        like = n / (len(held[a]) + len(held[b]) - n)
        nearest[a], nearest[b] = max(nearest[a], like), max(nearest[b], like)
        if like >= 0.8:
            close.append(got[a] == got[b])
    assert len(close) > 50 and np.mean(close) >= 0.9
    alone = [d for d, like in nearest.items() if like < 0.5]
    assert len(alone) > 500 and np.mean([got[d] == d for d in alone]) >= 0.999


def test_edges_do_not_repeat_by_bucket(spark):
    """A group of near copies meets in some 170 buckets; its edges are few all the same."""
    rng, prints = random.Random(6), Prints()
    base, rows = [f"w{rng.randrange(3000)}" for _ in range(120)], {}
    for i in range(600):
        text = list(base)
        for _ in range(rng.randint(1, 2)):
            text[rng.randrange(len(text))] = f"x{i}"
        node, words, wide = prints.of(" ".join(text))
        rows[node] = (node, *words, *wide)
    nodes = spark.createDataFrame(list(rows.values()), ", ".join(f"{c} long" for c in ("node", *near_copies.WORDS, *near_copies.WIDES)))
    edges = near_copies.links(nodes)
    assert edges.count() <= 1.1 * len(rows)
    roots = near_copies.components(edges).collect()
    assert len(roots) >= 0.99 * len(rows) and len({r.root for r in roots}) == 1


def test_a_very_long_text_and_its_copy(spark):
    words = [f"w{i % 9973}" for i in range(300_000)]
    other = words[:150_000] + ["changed"] + words[150_001:]
    rows = [(3, " ".join(words)), (2, " ".join(other)), (1, "w1 w2 w3 w4 w5 w6")]
    assert sorted(near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [(1, 1), (2, 2), (3, 2)]


def test_five_bits_always_share_a_key():
    rng = random.Random(2)
    a = np.array([rng.getrandbits(64) for _ in range(2000)], np.uint64)
    b = np.array([int(x) ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for x in a], np.uint64)
    (at, key), (at2, key2) = (keys(x.view(np.int64), 1) for x in (a, b))
    assert {i for i, _ in set(zip(at.tolist(), key.tolist())) & set(zip(at2.tolist(), key2.tolist()))} == set(range(2000))


def test_forest_and_empty(spark):
    rng = np.random.default_rng(3)
    wide = rng.integers(-(1 << 62), 1 << 62, (40, 4))
    wide[20:] = wide[:20]
    wide[20:, 0] ^= 7
    u, v = forest(wide)
    assert {frozenset(x) for x in zip(u.tolist(), v.tolist())} == {frozenset((i, i + 20)) for i in range(20)}
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id long, text string, node string")).collect() == []
