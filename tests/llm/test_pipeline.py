import collections
import struct

from test_containment import brute as leaks
from test_near_copies import brute as near
from test_packing import check
from test_personal_data import slow_base

import corpus_pipeline as cp
from lintora.llm import language
from lintora.llm import personal_data as pd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_each_stage_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(i.item_id, i.text) for i in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    stages = dict(cp.STAGES)
    known = language.Classifier(language.learn(docs.filter(~language.held_out("doc_id"))))
    one = stages["language"](spark, docs, sf)
    assert one.columns == docs.columns
    said = {d.doc_id: known.predict(d.text) for d in docs.collect()}
    kept = {r.doc_id: (r.text, r.lang) for r in one.collect()}
    assert {d: p[0] for d, p in said.items() if p[2] >= language.MIN_MARGIN} == {d: x[1] for d, x in kept.items()}
    two = stages["near_duplicates"](spark, one, sf)
    groups = near([(d, t) for d, (t, _) in kept.items()])
    assert sorted(r.doc_id for r in two.collect()) == sorted({c for _, c in groups})
    three = stages["decontamination"](spark, two, sf)
    rows = [(r.doc_id, r.text) for r in two.collect()]
    bad = {d for d, *_ in leaks(rows, items)}
    assert {r.doc_id for r in three.collect()} == {d for d, _ in rows} - bad
    four = stages["personal_data"](spark, three, sf)
    before = {r.doc_id: r.text for r in three.collect()}
    after = {r.doc_id: r for r in four.collect()}
    assert set(before) == set(after) and four.columns == docs.columns
    for d, text in before.items():
        assert after[d].n_chars == len(after[d].text) and not slow_base(after[d].text)
        if not slow_base(text):
            assert after[d].text == text
    check(stages["packing"](spark, four, sf).collect(), [(r.doc_id, r.text) for r in after.values()])


def test_run_with_nulls_repeats_and_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "an item that is found nowhere at all here")], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    text = {x: " ".join(f"{x}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)) for x in "pq"}
    rows = [(i, text["pq"[i % 2]] + f" own{i} words{i} " * 40, "pq"[i % 2], None, None) for i in range(12)]
    rows += [(3, rows[3][1], "q", "s", 1), (None, text["p"], None, None, None), (50, None, "p", None, None), (51, "", "q", "s", 0), (52, "??? 12", "q", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/a/documents.parquet")
    got = cp.run(spark, f"{tmp_path}/a").collect()
    held = collections.Counter(p.doc_id for p in got)
    assert not {50, 51, 52} & set(held) and held[3] <= len(rows)
    assert all(len(struct.unpack(f"<{p.length}I", p.ids)) == p.length for p in got)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    assert cp.run(spark, f"{tmp_path}/b").collect() == []


def test_redacted_keeps_rows_and_columns(spark):
    rows = [(1, "mail a@b.cd now", "x", "s", 1), (1, "mail a@b.cd now", "x", "s", 1), (None, "9.9.9.9", None, None, None), (2, None, None, None, None), (3, "nothing", "x", "s", 7)]
    got = pd.redacted(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(1, "mail [EMAIL] now", "x", "s", 1)] * 2 + [(None, "[IP]", None, None, None), rows[3], rows[4]], key=str)
