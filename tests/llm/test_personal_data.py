import hashlib
import random
import re

from lintora.llm import personal_data as pd
from lintora.llm.queries import op10_personal_data

SCHEMA = "doc_id long, text string, spans string, kind int"


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def slow_base(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), at, m.end(), kind) for at, (kind, rule, good) in enumerate(rules) for m in re.finditer(rule, text or "") if good(m)]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    bits = ["a@b.c", "@", "a", "x.y@", ".", "1.2.3.4", "0001.2.3.4", "300.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 010-9999", "+", "(", "-", " ", "9", "12", "٣", "é", "..", "d-e.f", "+49 30 1234567."]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 12)))
        assert pd.base_spans(text) == slow_base(text), text
    assert pd.base_spans("@" + "a" * 100_000) == []


def slow_trusted(seen):
    """The graph scored by plain loops until nothing changes."""
    instances, seeds = {}, set()
    for kind, instance, pattern, seed in seen:
        instances.setdefault((kind, pattern), set()).add(instance)
        seeds |= {(kind, instance, pattern)} if seed else set()
    confidence, before = {}, None
    while before != confidence:
        before, sure = confidence, {}
        for (kind, pattern), held in instances.items():
            known = [1.0 if (kind, i, pattern) in seeds else before.get((kind, i), 0.0) for i in held]
            if sum(known) / len(known) >= 0.75 and sum(c >= 0.75 for c in known) >= 3:
                sure[kind, pattern] = sum(known) / len(known)
        wrong = {}
        for (kind, pattern), p in sure.items():
            for i in instances[kind, pattern]:
                if (kind, i, pattern) not in seeds:
                    wrong[kind, i] = wrong.get((kind, i), 1.0) * max(1 - p, 1e-12)
        confidence = {k: round(1 - w, 9) for k, w in wrong.items()}
    return {k for k, c in confidence.items() if c >= 0.75}


def slow_spans(texts):
    """All spans of each text: base ones, and candidates that are trusted."""
    held, seen = [], []
    for text in texts:
        text = text or ""
        base = slow_base(text)
        loose = pd.candidates(text, base)
        held.append((text, base, loose))
        for spans, seed in ((base, True), (loose, False)):
            for s, e, k in spans:
                left, right = text[max(0, s - 80) : s].lower().split(), text[e : e + 40].lower().split()
                around = [(left[-2:], []), (left[-1:], right[:1]), ([], right[:2])]
                seen += [(k, text[s:e].lower(), " ".join([*a, "_", *b]), seed) for a, b in around if len(a) + len(b) == 2]
    good = slow_trusted(seen)
    order = lambda x: (x[0], pd.KINDS.index(x[2]), x[1])
    return [sorted([*base, *[(s, e, k) for s, e, k in loose if (k, text[s:e].lower()) in good]], key=order) for text, base, loose in held]


def chains():
    """Seeds teach a first pattern; what it finds teaches a second one, and so on."""
    rows = [f"please ring us under +1 (555) 010-{1000 + i} at noon" for i in range(12)]
    for step in range(4):
        before = "please ring us under" if not step else f"step{step} or else dial"
        rows += [f"{before} 555-{step}10{i} at noon, then step{step + 1} or else dial 555-{step}10{i} by night{step}" for i in range(3)]
        rows += [f"only step{step + 1} or else dial 555-{step}10{i} by night{step}" for i in range(3)]
    return rows + ["the score was 555-9999 in all", "step9 or else dialled 555-0199"]


def test_chains_of_patterns_run_to_the_end(spark):
    texts = chains() + [t for _, t, *_ in contexts()]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pd.find(spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA)).collect()}
    want = slow_spans(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(map(len, want)) > sum(len(slow_base(t)) for t in texts) + 10
    assert not want[len(chains()) - 2] and not want[len(chains()) - 1]


def test_long_runs_take_linear_time():
    import time

    for run in ("Aa9+/" * 200_000 + " dot (at)", "a@" * 400_000 + " dot", "a at b dot " * 90_000, "1 " * 500_000 + "dot", "[at]" * 250_000, "1" * 1_000_000, "12-" * 300_000, "+1(" * 300_000, "1.2." * 250_000):
        began = time.time()
        pd.candidates(run, base := pd.base_spans(run))
        assert time.time() - began < 8, run[:20]
    assert base is not None


def contexts():
    rows = [(i, f"please phone me at +1 (555) 010-{1000 + i} in the morning", "", 0) for i in range(6)]
    rows += [(10, "please phone me at 555-7788 in the morning", "", 0), (11, "then again 555-7788 is here", "", 0), (12, "the score was 555-9999 to all", "", 0)]
    rows += [(20 + i, f"my mail address is user{i}@example.org thanks", "", 0) for i in range(6)]
    return [*rows, (30, "my mail address is someone (at) example (dot) org thanks", "", 0)]


def test_contexts_discover_unseen_identifiers(spark):
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pd.find(spark.createDataFrame(contexts(), SCHEMA)).collect()}
    texts = {d: t for d, t, *_ in contexts()}
    said = {d: [(k, texts[d][s:e]) for s, e, k in spans] for d, spans in got.items()}
    assert said[10] == [("phone", "555-7788")] and said[11] == [("phone", "555-7788")] and said[12] == []
    assert said[30] == [("email", "someone (at) example (dot) org")]
    assert said[0] == [("phone", "+1 (555) 010-1000")]


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(1, None, None, None), (None, "a@b.cd", "", 0), (2, "", "", 0), (3, "x 1.2.3.4", "", 0), (3, "x 1.2.3.4", "", 0), (4, "word " * 40000 + "+1 555 010 9999", "", 0)]
    got = pd.find(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in got), key=str) == sorted(((d, slow_base(t)) for d, t, *_ in rows), key=str)
    assert pd.find(spark.createDataFrame([], SCHEMA)).collect() == []


def test_redact():
    text = "call +1 555 010 9999 or a@b.cd."
    assert pd.redact(text, pd.base_spans(text)) == "call [PHONE] or [EMAIL]."
    assert pd.redact("abcdef", [(0, 3, "card"), (1, 5, "phone")]) == "[CARD]f"


def test_query_equals_brute_force(spark):
    docs = {d.doc_id: d.text for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = op10_personal_data(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    want = dict(zip(docs, slow_spans(docs.values())))
    for r in got:
        base = slow_base(docs[r.doc_id])
        said = [f"{k}:{s}:{e}" for s, e, k in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, _, k in base) for x in pd.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{s}:{e}" for s, e, k in want[r.doc_id])
        assert r.n_spans == len(want[r.doc_id]) and r.n_found == r.n_spans - len(base)
