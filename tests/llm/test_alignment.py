import functools
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lintora.llm import alignment as al
from lintora.llm.queries import op13_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row long, a string, start string"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["a", "the", "É", "é", " ", "  ", "   ", "\n", "\t", " \n", "\x1c", "\x85", "\xa0", "9", "Σ", "<|endoftext|>", "<s>", "<0x41>", "'s", "'", ".", ",", "!!", "日本", "　", "\U0001f600", "\x00", "½", "ing", "-"]


@functools.cache
def libraries():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {letter: i for i, letter in enumerate(al.byte_letters())}
    return a, b, letters


def whole(text):
    """Ids of the whole text by the libraries, with the bytes of each token."""
    a, b, letters = libraries()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
    ids_b = b.encode(text) if text else []
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], [], [], []
    return ids_a, bytes_a, ids_b, bytes_b


def brute_force(docs):
    out, total = [], Counter()
    for doc_id, text in docs:
        ids_a, bytes_a, ids_b, bytes_b = whole(text)
        spans, at = [], 0
        for i, t in zip(ids_a, bytes_a):
            spans.append((at, at := at + len(t), i))
        links, groups, held, at, first = [], [], [], 0, 0
        ends_a = {e for _, e, _ in spans}
        for i, t in zip(ids_b, bytes_b):
            start, at = at, at + len(t)
            while first < len(spans) and spans[first][1] <= start:
                first += 1
            k = first
            while k < len(spans) and spans[k][0] < at:
                links.append((spans[k][2], i))
                k += 1
            held.append((start, at, i))
            if at in ends_a:
                low = held[0][0]
                groups.append(",".join(str(x) for s, e, x in spans if low <= s < at) + "|" + ",".join(str(x) for *_, x in held) if len(spans) < 3000 else None)
                held = []
        total.update(links)
        out.append((doc_id, len(ids_a), len(ids_b), len(groups), links, groups))
    best = defaultdict(int)
    for (_, b), n in total.items():
        best[b] = max(best[b], n)
    rows = []
    for doc_id, n_a, n_b, n_groups, links, groups in out:
        text = None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append((doc_id, n_a, n_b, n_groups, len(links), sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links), text))
    return rows


def digests(spark, docs, most_frequent=al.MAX_FREQUENT, **options):
    table = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in docs], SCHEMA)
    runs = al.align(table, A, B, **options)
    return sorted(map(tuple, al.alignment_digests(runs, A, B, most_frequent).select(*COLUMNS).collect()), key=str)


def odd_text(rng, n=40):
    return "".join(rng.choices(ODD, k=rng.randint(0, n)))


def test_parts_give_the_ids_of_the_libraries():
    own, rng = al.tokenizers(A, B), random.Random(3)
    for _ in range(3000):
        text = odd_text(rng)
        (a, b), none = own.encode([text, None])
        assert none == (b"", b"")
        ids_a, _, ids_b, _ = whole(text)
        assert (np.frombuffer(a, "<u4").tolist(), np.frombuffer(b, "<u4").tolist()) == (ids_a, ids_b), text
    assert own.encode(["x▁y z", ""]) == [(b"", b"")] * 2


def fragments_of(text, size):
    own = al.tokenizers(A, B)
    monoid = al.Monoid(own.sizes_a, own.sizes_b)
    ids = lambda f, t: np.frombuffer(f(t) if t else b"", "<u4")
    return monoid, [monoid.fragment(s, t, ids(own.a, x), ids(lambda y: own.b([y])[0], y)) for _, s, x, t, y in al.ranges(text, size)]


def flat(x):
    lists = [x.a, x.b, x.tail_a, x.tail_b]
    runs = [(s, a.tolist(), b.tolist()) for s, a, b in x.runs if len(a)]
    merged = []  # runs that follow each other are one
    for s, a, b in runs:
        merged = [(merged[0][0], merged[0][1] + a, merged[0][2] + b)] if merged else [(s, a, b)]
    return [x.start, x.b_start, x.tail_start, *(y.tolist() for y in lists), merged]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(ODD + ["word. next", " and,then"]), min_size=1, max_size=60), st.integers(3, 40), st.randoms(use_true_random=False))
def test_ranges_compose_to_the_whole_in_any_order(parts, size, rng):
    text = "".join(parts)
    monoid, found = fragments_of(text, size)
    ids_a, _, ids_b, _ = whole(text)
    if not ids_a:
        return
    want = flat(monoid.fragment(0, 0, np.array(ids_a, "<u4"), np.array(ids_b, "<u4")))
    assert flat(functools.reduce(monoid.compose, found)) == want
    while len(found) > 1:  # any tree
        i = rng.randrange(len(found) - 1)
        found[i : i + 2] = [monoid.compose(found[i], found[i + 1])]
    assert flat(found[0]) == want


def test_a_range_leaves_open_ends():
    _, found = fragments_of("one two, three four. " * 20, 16)
    assert any(x.tail_start is not None and (len(x.tail_a) or len(x.tail_b)) for x in found[:-1])


def test_nulls_ties_odd_texts_and_clashing_columns(spark):
    rng = random.Random(5)
    docs = [(1, "The cat sat."), (1, "The cat sat."), (None, "naïve 日本"), (2, None), (3, ""), (4, "x▁y"), (5, " "), (6, "  "), (7, "a  b \n c ")]
    docs += [(i, odd_text(rng)) for i in range(10, 60)]
    want = sorted(brute_force(docs), key=str)
    for most in (0, 40, 1 << 19):
        assert digests(spark, docs, most) == want
    assert digests(spark, docs, long=10, size=7, fan=2) == want  # nearly all are cut
    assert digests(spark, []) == []


def test_very_long_texts_are_reduced_as_trees(spark):
    rng = random.Random(7)
    words = ["alpha", "beta,", "gamma.", "delta", "'s", "été", "x", "  ", "9,5", "\n"]
    docs = [(1, " ".join(rng.choices(words, k=1200))), (2, "".join(rng.choices("abcdefgh.", k=5000))), (3, " " * 3000), (4, "ok " * 800 + "▁" + " ok" * 800), (5, "short")]
    want = sorted(brute_force(docs), key=str)
    got = digests(spark, docs, long=500, size=200, fan=3)
    assert [g if w[-1] is not None else (*g[:-1], None) for g, w in zip(sorted(got, key=str), want)] == want
    assert digests(spark, docs) == got
    runs = al.align(spark.createDataFrame([(d, t, 1, "x", "y") for d, t in docs], SCHEMA), A, B, long=500, size=200, fan=3).filter("doc_id = 1").orderBy("start").collect()
    assert len(runs) > 10  # what is closed leaves the tree at once
    assert [np.frombuffer(b"".join(r[c] for r in runs), "<u4").tolist() for c in "ab"] == [whole(docs[0][1])[0], whole(docs[0][1])[2]]


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got, want = sorted(map(tuple, op13_alignment(spark, sf_dir).select(*COLUMNS).collect())), sorted(brute_force(docs))
    assert [g if w[-1] is not None else (*g[:-1], None) for g, w in zip(got, want, strict=True)] == want
