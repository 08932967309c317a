import pickle
import random
import struct
import zlib
from fractions import Fraction

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lintora.llm import packing
from lintora.llm.queries import op3_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, ids string, offset int"


@pytest.mark.parametrize("seed", range(12))
def test_schedule_serves_each_token_once_and_keeps_targets(seed):
    rng = random.Random(seed)
    size = rng.choice([16, 64, 256])
    totals = [rng.choice([0, 1, 5, 100, 3000, 20000]) for _ in range(rng.randint(1, 9))]
    weights = None if seed % 2 else [rng.choice([0, 1, 3, 50]) for _ in totals]
    schedule = packing.Schedule(totals, weights, size)
    schedule = pickle.loads(pickle.dumps(schedule))
    assert schedule.windows == -(-sum(totals) // size)
    last = [0] * len(totals)
    for window in range(schedule.windows + 1):
        now = schedule.served(window)
        assert all(a <= b for a, b in zip(last, now))
        assert sum(now) == min(window * size, sum(totals))
        assert all(abs(d) <= 1 + len(totals) / 2 for d in schedule.deficits(min(window, schedule.windows - 1)))
        last = now
    assert last == totals
    seen = {}
    for q, n in enumerate(totals):
        at = 0
        while at < n:
            step = min(n - at, rng.randint(1, 700))
            for start, length, window, offset in schedule.pieces(q, at, step):
                for i in range(length):
                    assert seen.setdefault((window, offset + i), (q, at + start + i)) == (q, at + start + i)
            at += step
    assert len(seen) == sum(totals)
    assert all((w, o - 1) in seen for w, o in seen if o)


@pytest.mark.parametrize("seed", range(8))
def test_schedule_equals_the_order_of_due_times(seed):
    """All tokens sorted by the time at which they are due, cut into windows."""
    rng = random.Random(seed)
    size = rng.choice([8, 64])
    totals = [rng.choice([1, 2, 7, 30, 400, 2500]) for _ in range(rng.randint(1, 12))]
    weights = None if seed % 2 else [rng.choice([0, 1, 2, 3, 50, 1000]) for _ in totals]
    schedule = packing.Schedule(totals, weights, size)
    due = [(not w, Fraction(2 * j + 1, 2 * (w or n)), q, j) for q, (n, w) in enumerate(zip(totals, weights or totals)) for j in range(n)]
    served = [0] * len(totals)
    for i, (_, _, q, j) in enumerate(sorted(due)):
        if i % size == 0:
            assert schedule.served(i // size) == served
        assert schedule.window_of(q, j) == i // size
        served[q] += 1


def test_rare_sources_come_all_along():
    """A source with far under one token a window is served to the end."""
    schedule = packing.Schedule([10**10, 100_000], None, 4096)
    windows = [schedule.window_of(1, j) for j in range(0, 100_000, 1000)]
    assert all(abs(w / schedule.windows - (j + 0.5) / 100_000) < 1e-4 for w, j in zip(windows, range(0, 100_000, 1000)))
    assert windows[-1] > 0.98 * schedule.windows


def check(pieces, docs, size=packing.SIZE):
    library = Tokenizer.from_file(PATH)
    want = sorted((d, tuple(library.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in docs if d is not None)
    held, places = {}, {}
    for p in pieces:
        ids = struct.unpack(f"<{p.length}I", p.ids)
        held.setdefault(p.doc_id, []).append((p.start, ids, p.doc_tokens))
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for d, ids in want:
        got = sorted(held[d])
        assert sum((x[1] for x in got), ()) == ids and all(x[2] == len(ids) for x in got)
        assert [x[0] for x in got] == [sum(len(y[1]) for y in got[:i]) for i in range(len(got))]
    for at, rows in places.items():
        end = 0
        for offset, length in sorted(rows):
            assert offset == end and length > 0
            end += length
        assert end == size or at == max(places)
    assert sorted(places) == list(range(len(places)))


def test_pack_nulls_clashing_columns_and_targets(spark):
    rng = random.Random(6)
    words = "alpha beta gamma delta the of and".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 90))), rng.choice(["a", "b", "c", None, ""]), "x", 1) for i in range(200)]
    rows += [(900, None, "a", "", None), (901, "", "d", "", None), (902, "word " * 30000, "a", "", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for targets in (None, {"a": 1, "b": 3}, {}):
        check(packing.pack(docs, PATH, 2, targets, size=256).collect(), [r[:2] for r in rows], 256)
    twice = spark.createDataFrame([(1, "same", None, "", 0), (1, "same", None, "", 0), (None, "no id", "a", "", 0)], SCHEMA)
    got = packing.pack(twice, PATH, 2).collect()
    assert sum(p.length for p in got) == sum(len(Tokenizer.from_file(PATH).encode(t).ids) + 1 for t in ("same", "same", "no id"))
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH, 2).collect() == []


def test_rare_sources_share_the_tail_in_due_order(spark):
    rows = [(i, "some words here", f"s{i % 300}", "", 0) for i in range(900)]
    rows += [(i, "many words of a hot source go on and on " * 9, "hot", "", 0) for i in range(900, 1200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for targets in (None, {"hot": 1}, {f"s{i}": 1 + i % 3 for i in range(200)} | {"hot": 900}):
        got = packing.pack(docs, PATH, 2, targets, size=64).collect()
        check(got, [r[:2] for r in rows], 64)
        assert {p.queue for p in got} == {r[2] for r in rows}
    got = packing.pack(docs, PATH, 2, size=64).collect()
    last = max(p.sequence_id for p in got)
    for source in ("s0", "s150", "s299"):
        at = sorted(p.sequence_id for p in got if p.queue == source)
        assert at[0] < 0.3 * last and at[-1] > 0.6 * last


def test_sequences_are_padded(spark):
    rows = [(i, "alpha beta gamma " * 5, "ab"[i % 2], "", 0) for i in range(10)]
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA), PATH, 2, size=32)
    got = packing.sequences(pieces, pad_id=7, size=32).orderBy("sequence_id").collect()
    assert all(len(r.ids) == 128 for r in got[:-1]) and sum(r.n_tokens for r in got) == sum(p.length for p in pieces.collect())
    last = struct.unpack(f"<{len(got[-1].ids) // 4}I", got[-1].ids)
    n = got[-1].n_tokens
    assert len(last) == (n if n & (n - 1) == 0 else 32) and set(last[n:]) <= {7}


def test_query_equals_the_library_and_mixes_alike(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    pieces = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), PATH, 2).collect()
    check(pieces, docs)
    got = op3_packing(spark, sf).collect()
    assert sorted((p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, p.sequence_id, p.offset) for p in pieces) == sorted(map(tuple, got))
