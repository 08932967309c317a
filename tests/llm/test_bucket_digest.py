import hashlib

import numpy as np

from lintora.llm import bucket_digest as bd
from lintora.llm.queries import op2_bucket_digest

SCHEMA = "doc_id long, text string, fingerprint string, part string"


def slow_counts(data):
    counts = [0] * 256
    data = data.ljust(5, b"\0")
    for i in range(len(data) - 4):
        for salt, (a, b, c) in enumerate(bd.TRIPLETS):
            x = data[i + a] + (data[i + b] << 8) + (data[i + c] << 16) + ((salt + 1) << 24)
            counts[(x * 0x9E3779B1 % 2**32) >> 24] += 1
    return counts


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (d, t, *_) in enumerate(rows):
        t, u = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        a, b, c = (bd.codes(x.encode()) for x in (t, e, u))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), bd.to_text(a), bd.to_text(b), bd.likeness(a, b), bd.likeness(a, c)))
    return out


def test_codes_follow_counts_and_round_trip():
    for text in ["", "a", "abc", "hello world " * 30, "日本語テキスト"]:
        code = bd.codes(text.encode())
        assert (bd.from_text(bd.to_text(code)) == code).all()
        if text:
            counts = slow_counts(text.encode())
            cuts = [sorted(counts)[i] for i in (63, 127, 191)]
            assert [sum(c > q for q in cuts) for c in counts] == code[2:].tolist()


def test_score_is_bounded_and_orders_texts():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(4000)]
    base = words[:400]
    near, half, far = [*base[:390], *words[400:410]], [*base[:200], *words[400:600]], words[600:1000]
    like = [bd.likeness(bd.codes(" ".join(base).encode()), bd.codes(" ".join(x).encode())) for x in (base, near, half, far)]
    assert like[0] == 1 and like[0] > like[1] > like[2] > like[3] >= 0
    assert bd.difference(bd.codes(b"a"), bd.codes(b"zq" * 9999)) <= bd.BOUND


def test_neighbours_with_nulls_ties_and_clashing_columns(spark):
    rows = [(3, "some words here", "x", "y"), (3, "some words here", "x", "y"), (3, "other words", "x", "y"), (None, "no id at all", "x", "y"), (1, None, "x", "y"), (2, "", "x", "y"), (9, "ünï " * 9000, "x", "y")]
    got = bd.compare_neighbours(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)
    assert bd.compare_neighbours(spark.createDataFrame(rows[:1], SCHEMA)).first().near_next == 1.0
    assert bd.compare_neighbours(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_brute_force(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = op2_bucket_digest(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(brute(docs))
    assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(got)
