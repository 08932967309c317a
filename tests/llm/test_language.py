import re
import unicodedata
import zlib

import zstandard

from lintora.llm import language
from lintora.llm.queries import op6_language

TEXTS = {"aa": "the quick brown house of many words that they were reading about ", "bb": "der schnelle braune Hund läuft über die lange Straße nach Hause und "}


def rows(n=40):
    return [(i, TEXTS["aa" if i % 2 else "bb"] + f"x{i}", "aa" if i % 2 else "bb", "s", 1.0) for i in range(n)]


SCHEMA = "doc_id long, text string, lang string, margin string, score double"


def test_learn_and_identify_with_nulls_ties_and_clashing_columns(spark):
    docs = spark.createDataFrame([*rows(), (90, "nothing to learn", None, "", None), (91, None, "aa", "", None), (92, "", "bb", "", None)], SCHEMA)
    known = language.learn(docs)
    assert sorted(known) == ["aa", "bb"]
    odd = [(1, None, "zz", "m", 0.5), (None, "12 !", None, None, None), (2, "", None, "", None), (3, "quick words of many house", "bb", "", 0.0), (3, "quick words of many house", "bb", "", 0.0), (4, "Hund läuft nach Hause " * 9000, None, "", None)]
    got = language.identify(spark.createDataFrame(odd, SCHEMA), known).collect()
    assert len(got) == len(odd) and got[0].__fields__ == ["doc_id", "text", "lang", "lang_pred", "score", "margin", "rejected"]
    by = {r.doc_id: (r.lang_pred, r.rejected) for r in got}
    assert by == {1: ("und", True), None: ("und", True), 2: ("und", True), 3: ("aa", False), 4: ("bb", False)}
    assert all(0 <= r.score <= 1 for r in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert language.learn(none) == {}
    assert language.identify(none, {}).collect() == []
    got = language.identify(spark.createDataFrame(rows(1), SCHEMA), {}).first()
    assert got.lang_pred == "und" and got.rejected


def test_many_languages_share_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(language, "TOTAL_BYTES", 80)
    known = language.learn(spark.createDataFrame(rows(), SCHEMA))
    assert sorted(known) == ["aa", "bb"] and all(0 < len(x) <= 40 for x in known.values())
    monkeypatch.setattr(language, "MAX_LANGUAGES", 1)
    more = [*rows(), (200, TEXTS["bb"] + "zz", "bb", "s", 1.0)]
    assert sorted(language.learn(spark.createDataFrame(more, SCHEMA))) == ["bb"]


def slow_prediction(dictionaries, text):
    """The smallest by fresh compressors, on letters found one by one."""
    words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    words = [re.sub(r"^[^\w]+", "", w) for w in words.split()]
    words = [w for w in words if any(unicodedata.category(c)[0] == "L" for c in w)]
    data = " ".join(words).encode()
    if not data:
        return "und"
    sizes = {}
    for lang, content in dictionaries.items():
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=9, dict_data=held, write_checksum=False, write_content_size=False)
        sizes[lang] = sum(len(packer.compress(data[i : i + 4000])) for i in range(0, len(data), 4000))
    return min(sorted(sizes), key=sizes.get)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {d.doc_id: d.text for d in docs.collect()}
    known = language.learn(docs.filter(~language.held_out("doc_id")))
    taught = [language.normal(d.text) for d in docs.collect() if d.lang and d.text and zlib.crc32(str(d.doc_id).encode()) % 4 != 2]
    for content in known.values():  # nothing else is in the dictionaries
        assert all(any(content[i : i + 60] in t for t in taught) for i in range(0, 1500, 500))
    got = {r.doc_id: r.lang_pred for r in op6_language(spark, sf).collect()}
    want = {d: slow_prediction(known, t) for d, t in texts.items()}
    assert sum(got[d] != want[d] for d in want) <= 0.01 * len(want)  # precomputed dictionaries may differ by a byte


def test_numerals_are_no_letters():
    known = language.Classifier({"aa": b"some words", "bb": b"andere"})
    for text in ("\u00bd \u00b2", "\u2460\u0664 12 _-", "\u0301", ""):
        assert known.predict(text) == ("und", 0.0, 0.0)
    assert known.predict("\u4e2d")[0] in known.compressors


def test_equal_sizes_are_rejected():
    lang, score, margin = language.Classifier({"aa": b"same words", "bb": b"same words"}).predict("some words")
    assert (lang, margin) == ("aa", 0.0) and score == 0.5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {d.doc_id: d.lang for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op6_language(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.96 * len(held)
    assert sum(r.rejected for r in got) < 0.02 * len(got)
