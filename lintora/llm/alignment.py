"""Alignment of two tokenizers' tokens by an associative monoid of fragments.

Both tokenizers cut the same bytes (a space and the text). Where tokens of both
end, a group closes: its tokens of A and of B cover the same bytes. What groups
two tokenizers give is found without passing over a document from its start:

- a document is cut into byte ranges, each tokenizer at the first place after the
  nominal one where its own tokens surely end, so that the ranges of A and B
  overlap but seldom end alike;
- the tokens of a range are a fragment: an open prefix up to the first place
  where A and B both end, closed groups, and an open suffix;
- compose() joins two neighbouring fragments: the suffix of one and the prefix of
  the other close the groups between them. It is associative, so that fragments
  of a long document are made in any task and reduced as a tree, FAN at a time.

Closed groups leave the tree where they close, as runs: tokens of A and B over the
same bytes. Only open ends climb. Documents of up to LONG characters are one run.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from itertools import batched

import numpy as np
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintora.llm.common import discard, rows_of, to_batches, written
from lintora.llm.tokens import byte_letters

#: Characters beyond which a document is cut, and of a nominal range.
LONG, RANGE = 32_768, 16_384
#: Fragments that one task composes at a time.
FAN = 8
#: Most pairs whose counts are sent to every executor (17 bytes each).
MAX_FREQUENT = 1 << 19

#: Where pre-tokens of A surely begin, and where pieces of B do.
A_SAFE = re.compile(r"(?= \S)|(?<=[A-Za-z0-9])(?=[.,;:!?])")
B_SAFE = re.compile(r"(?<=[^ ▁])(?= )")

_RUN_SQL = "row long, doc_id long, start long, a binary, b binary"
_RUN = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_RANGE_SQL = "row long, doc_id long, at long, a_start long, a_text string, b_start long, b_text string"
_RANGE = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("a_start", pa.int64()), ("a_text", pa.string()), ("b_start", pa.int64()), ("b_text", pa.string())])
_PART_SQL = "row long, doc_id long, at long, kind string, start long, b_start long, a binary, b binary, tail_start long, tail_a binary, tail_b binary"
_PART = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("b_start", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("tail_start", pa.int64()), ("tail_a", pa.binary()), ("tail_b", pa.binary())])


def _ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")


class Tokenizers:
    """A byte-level tokenizer (A), whose ids follow the order of its merges, and a
    sentencepiece model (B), with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        with open(path_a, encoding="utf-8") as file:
            own = json.load(file)
        self.library_b = b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {letter: i for i, letter in enumerate(byte_letters())}
        special = {t["id"] for t in own["added_tokens"]}
        self.bytes_a = [b""] * (max(own["model"]["vocab"].values()) + 1)
        for token, i in own["model"]["vocab"].items():
            if i not in special:
                self.bytes_a[i] = bytes(byte[c] for c in token)
        self.library_a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.bytes_a) if t}, special_tokens={})
        self.bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))

    def a(self, text: str) -> bytes:
        """Ids of A; special strings are plain text. Their bytes are the text's."""
        return array("I", self.library_a.encode_ordinary(text)).tobytes()

    def b(self, texts: list[str]) -> list[bytes | None]:
        """Ids of B, which adds a space itself, for texts that begin with one;
        None where their bytes are not the text's."""
        out = []
        for text, ids in zip(texts, self.library_b.encode([t[1:] for t in texts], num_threads=1)):
            if text == " ":
                ids = [self.library_b.piece_to_id("▁")]
            out.append(array("I", ids).tobytes() if b"".join(map(self.bytes_b.__getitem__, ids)) == text.encode() else None)
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids of a space and each text by A and B; none if the bytes differ."""
        ids_b = self.b([" " + (t or "") for t in texts])
        return [(self.a(" " + t), b) if t and b is not None else (b"", b"") for t, b in zip(texts, ids_b)]


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """One for each Python worker."""
    return Tokenizers(path_a, path_b)


@dataclass
class Fragment:
    """Tokens of neighbouring ranges. a and b, the open prefix, begin at bytes
    start and b_start and end alike unless tail_start is None, where no tokens
    end alike and they are all there is. The open suffix begins at tail_start.
    runs: (start, a, b) of the closed groups between."""

    start: int
    b_start: int
    a: np.ndarray
    b: np.ndarray
    tail_start: int | None = None
    tail_a: np.ndarray = field(default_factory=lambda: _ids(b""))
    tail_b: np.ndarray = field(default_factory=lambda: _ids(b""))
    runs: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)


class Monoid:
    """Fragments of two tokenizers, given the bytes of each token."""

    def __init__(self, sizes_a: np.ndarray, sizes_b: np.ndarray):
        self.sizes_a, self.sizes_b = sizes_a, sizes_b

    def fragment(self, start: int, b_start: int, a: np.ndarray, b: np.ndarray) -> Fragment:
        ends_a, ends_b = start + np.cumsum(self.sizes_a[a]), b_start + np.cumsum(self.sizes_b[b])
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not len(both):
            return Fragment(start, b_start, a, b)
        (i, k), (j, m) = (np.searchsorted(ends, both[[0, -1]], "right") for ends in (ends_a, ends_b))
        runs = [(int(both[0]), a[i:k], b[j:m])] if len(both) > 1 else []
        return Fragment(start, b_start, a[:i], b[:j], int(both[-1]), a[k:], b[m:], runs)

    def compose(self, x: Fragment, y: Fragment) -> Fragment:
        """The fragment of x's ranges and y's, which follow them."""
        if x.tail_start is None:
            met = self.fragment(x.start, x.b_start, np.concatenate([x.a, y.a]), np.concatenate([x.b, y.b]))
            if y.tail_start is None:
                return met
            return Fragment(x.start, x.b_start, met.a, met.b, y.tail_start, y.tail_a, y.tail_b, met.runs + y.runs)
        met = self.fragment(x.tail_start, x.tail_start, np.concatenate([x.tail_a, y.a]), np.concatenate([x.tail_b, y.b]))
        if met.tail_start is None:
            return Fragment(x.start, x.b_start, x.a, x.b, x.tail_start, met.a, met.b, x.runs)
        closed = [*x.runs, (x.tail_start, met.a, met.b), *met.runs, *y.runs]
        tail = (met.tail_start, met.tail_a, met.tail_b) if y.tail_start is None else (y.tail_start, y.tail_a, y.tail_b)
        return Fragment(x.start, x.b_start, x.a, x.b, *tail, closed)


def ranges(text: str, size: int = RANGE) -> Iterator[tuple[int, int, str, int, str]]:
    """(number, first byte and text for A, first byte and text for B) of the
    ranges of a space and the text."""
    spaced = " " + text
    at, cuts, starts = 0, [0, 0], [0, 0]
    for number, nominal in enumerate(range(size, len(spaced) + size, size)):
        out = [number]
        for i, safe in enumerate((A_SAFE, B_SAFE)):
            at = len(spaced)
            if nominal < at:
                found = safe.search(spaced, max(nominal, cuts[i]))
                at = found.start() if found else at
            part = spaced[cuts[i] : at]
            out += [starts[i], part]
            cuts[i], starts[i] = at, starts[i] + len(part.encode())
        yield tuple(out)


def _part(row: int, doc_id: int | None, at: int, x: Fragment) -> Iterator[tuple]:
    yield row, doc_id, at, "open", x.start, x.b_start, x.a.tobytes(), x.b.tobytes(), x.tail_start, x.tail_a.tobytes(), x.tail_b.tobytes()
    yield from ((row, doc_id, at, "run", start, start, a.tobytes(), b.tobytes(), None, None, None) for start, a, b in x.runs if len(a))


def _long_runs(texts: DataFrame, path_a: str, path_b: str, size: int, fan: int) -> DataFrame:
    """Runs of documents that are cut into ranges."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = 1 << 62 | TaskContext.get().partitionId() << 40
        rows = ((first + i, doc_id, *x) for i, (doc_id, text) in enumerate(rows_of(batches, 16)) for x in ranges(text, size))
        yield from to_batches(rows, _RANGE)

    def leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(path_a, path_b)
        monoid = Monoid(own.sizes_a, own.sizes_b)

        def rows():
            for row, doc_id, at, start, a_text, b_start, b_text in rows_of(batches, 64):
                a, b = own.a(a_text), own.b([b_text])[0] if b_text else b""
                if b is None:
                    yield row, doc_id, at, "bad", 0, 0, b"", b"", None, None, None
                else:
                    yield from _part(row, doc_id, at, monoid.fragment(start, b_start, _ids(a), _ids(b)))

        yield from to_batches(rows(), _PART)

    def composed(parts: pa.Table) -> pa.Table:
        own = tokenizers(path_a, path_b)
        monoid = Monoid(own.sizes_a, own.sizes_b)
        rows = sorted(zip(*(c.to_pylist() for c in parts.select([f.name for f in _PART]).columns)), key=lambda r: r[2])
        found = [Fragment(s, t, _ids(a), _ids(b), c, _ids(d), _ids(e)) for *_, s, t, a, b, c, d, e in rows]
        row, doc_id, at = rows[0][:3]
        out = list(_part(row, doc_id, at // fan, reduce(monoid.compose, found)))
        return pa.Table.from_batches(to_batches(out, _PART, size=len(out)), schema=_PART)

    cut_up = written(texts.mapInArrow(cut, _RANGE_SQL), "ranges")
    parts = written(cut_up.repartition("row", "at").mapInArrow(leaves, _PART_SQL), "fragments")
    discard(cut_up)
    bad = parts.filter("kind = 'bad'").groupBy("row").agg(F.max("doc_id").alias("doc_id"))
    parts = parts.join(bad.select("row"), "row", "left_anti")
    runs = [bad.select("row", "doc_id", F.lit(0).cast("long").alias("start"), F.lit(b"").alias("a"), F.lit(b"").alias("b"))]
    most = parts.agg(F.max("at")).first()[0] or 0
    run_columns = ("row", "doc_id", "start", "a", "b")
    while most > 0:
        runs.append(parts.filter("kind = 'run'").select(*run_columns))
        open_ = parts.filter("kind = 'open'").groupBy("row", F.floor(F.col("at") / fan).alias("parent"))
        parts, most = written(open_.applyInArrow(composed, _PART_SQL), "fragments"), most // fan
    whole, end = parts.filter("kind = 'open'"), F.col("tail_start")
    runs += [parts.filter("kind = 'run'").select(*run_columns), whole.select(*run_columns)]
    runs.append(whole.filter(F.octet_length("tail_a") > 0).select("row", "doc_id", end.alias("start"), F.col("tail_a").alias("a"), F.col("tail_b").alias("b")))
    return reduce(DataFrame.unionByName, runs)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, size: int = RANGE, fan: int = FAN) -> DataFrame:
    """Runs, a written table: row (one for each document), doc_id, start, and the
    ids a and b (little-endian unsigned 32-bit) of tokens that cover the same bytes
    from start on. The runs of a document follow each other; a run ends where a
    group ends.

    Null and empty texts, and those of which the tokens' bytes differ from those of
    a space and the text, have one run without tokens. Repeated rows and null ids
    are documents of their own; other columns are ignored; no rows, no runs."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_chars = F.coalesce(F.char_length("text"), F.lit(0))

    def short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = tokenizers(path_a, path_b), TaskContext.get().partitionId() << 40
        found = ((doc_id, *ids) for part in batched(rows_of(batches, 32), 32) for (doc_id, _), ids in zip(part, own.encode([t for _, t in part])))
        yield from to_batches(((first + i, doc_id, 0, a, b) for i, (doc_id, a, b) in enumerate(found)), _RUN, max_bytes=4 << 20)

    few = texts.filter(n_chars <= long).mapInArrow(short, _RUN_SQL)
    return written(few.unionByName(_long_runs(texts.filter(n_chars > long), path_a, path_b, size, fan)), "token-runs")


class Links:
    """Groups and links of runs that follow each other in arrays of ids."""

    def __init__(self, sizes_a: np.ndarray, sizes_b: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        self.ends_a, self.ends_b = np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])
        merged = np.concatenate([self.ends_a, self.ends_b])
        merged.sort(kind="stable")
        first = np.ones(len(merged), bool)
        first[1:] = merged[1:] != merged[:-1]
        self.ends = merged[first]  # of links: each overlap of two tokens ends where one of them does
        self.groups = merged[1:][~first[1:]]  # of groups: there two tokens end

    def pairs(self) -> np.ndarray:
        """id of A and id of B of each link, as one number."""
        a, b = (ids[np.searchsorted(ends, self.ends)].astype(np.int64) for ids, ends in ((self.a, self.ends_a), (self.b, self.ends_b)))
        return a << 32 | b

    def written_out(self, texts: np.ndarray) -> bytes:
        """`a1,a2|b1;a3|b2,b3;`: texts has those of every id by _id_texts."""
        n = len(texts) // 3
        in_a, in_b = np.searchsorted(self.groups, self.ends_a), np.searchsorted(self.groups, self.ends_b)
        last_a, last_b = (np.searchsorted(ends, self.groups) for ends in (self.ends_a, self.ends_b))
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        own = self.a.astype(np.int64)
        own[last_a] += n
        codes[np.arange(len(own)) + np.concatenate([[0], last_b + 1])[in_a]] = own
        own = self.b.astype(np.int64)
        own[last_b] += 2 * n
        codes[np.arange(len(own)) + (last_a + 1)[in_b]] = own
        return texts[codes].tobytes().translate(None, b"\0")


@lru_cache(maxsize=2)
def _id_texts(n: int) -> np.ndarray:
    """Every id below n in decimal with each of three marks after it, padded with zero bytes."""
    return np.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(n)])


def _gathered(batches: Iterable[pa.RecordBatch], most: int = 200_000) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
    """Runs by about `most` tokens: their rows, and all their ids of A and of B."""
    held, n = [], 0
    for r in rows_of(batches):
        held.append(r)
        n += (len(r[3]) + len(r[4])) // 4
        if n >= most:
            yield held, _ids(b"".join([r[3] for r in held])), _ids(b"".join([r[4] for r in held]))
            held, n = [], 0
    if held:
        yield held, _ids(b"".join([r[3] for r in held])), _ids(b"".join([r[4] for r in held]))


def pair_counts(runs: DataFrame, path_a: str, path_b: str, flush: int = 1 << 20) -> DataFrame:
    """pair, n (links that hold it in all runs), best (whether n is the highest of
    its id of B), a written table."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, counts, n = tokenizers(path_a, path_b), [], [], 0

        def merged() -> Iterator[pa.RecordBatch]:
            pairs, at = np.unique(np.concatenate(held), return_inverse=True)
            totals = np.bincount(at, np.concatenate(counts)).astype(np.int64)
            for start in range(0, len(pairs), 65_536):
                yield pa.record_batch([pa.array(pairs[start : start + 65_536]), pa.array(totals[start : start + 65_536])], names=["pair", "n"])

        for _, a, b in _gathered(batches):
            pairs, times = np.unique(Links(own.sizes_a, own.sizes_b, a, b).pairs(), return_counts=True)
            held.append(pairs)
            counts.append(times)
            n += len(pairs)
            if n >= flush:
                yield from merged()
                held, counts, n = [], [], 0
        if held:
            yield from merged()

    counted = written(runs.select("row", "doc_id", "start", "a", "b").mapInArrow(gather, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-sums")
    of_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    highest = counted.groupBy(of_b.alias("id_b")).agg(F.max("n").alias("highest"))
    found = written(counted.join(highest, of_b == F.col("id_b")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "pair-counts")
    discard(counted)
    return found


def frequent(counts: DataFrame, most: int = MAX_FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (ascending), n and best of the most frequent pairs: as many as fit in
    the bound when those above a common threshold are taken."""
    level = F.floor(8 * F.log2("n")).cast("long")
    histogram = dict(counts.groupBy(level.alias("level")).count().collect())
    least, total = None, 0
    for at in sorted(histogram, reverse=True):
        total += histogram[at]
        if total > most:
            break
        least = at
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    table = counts.filter(level >= least).toArrow()
    pairs, n, best = (table[c].to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pairs)
    return pairs[order], n[order], best[order]


def alignment_digests(runs: DataFrame, path_a: str, path_b: str, most_frequent: int = MAX_FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of
    each document of align(). The counts of frequent pairs (a bounded table) are
    added where a run is read; rare pairs join the table of counts."""
    counts = pair_counts(runs, path_a, path_b)
    known = runs.sparkSession.sparkContext.broadcast(frequent(counts, most_frequent))
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    rare_type = pa.list_(pa.struct([("pair", pa.int64()), ("k", pa.int64())]))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in names), ("digest", pa.string()), ("rare", rare_type)])

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of a document follow each other; its last one has the digest."""
        own = tokenizers(path_a, path_b)
        texts = _id_texts(max(len(own.bytes_a), len(own.bytes_b)))
        pairs, n, best = known.value
        state = [None, None, None]  # a row, its hash so far, the output of its latest run

        def rows():
            for held, all_a, all_b in _gathered(batches):
                at_a = at_b = 0
                for row, doc_id, _, a, b in held:
                    len_a, len_b = len(a) // 4, len(b) // 4
                    x = Links(own.sizes_a, own.sizes_b, all_a[at_a : at_a + len_a], all_b[at_b : at_b + len_b])
                    at_a, at_b = at_a + len_a, at_b + len_b
                    out, rare = [row, doc_id, len_a, len_b, len(x.groups), len(x.ends), 0, 0], []
                    new = row != state[0]
                    if new:
                        if state[2]:
                            yield *state[2][:-1], state[1] and state[1].hexdigest(), state[2][-1]
                        state[:2] = [row, None]
                    else:
                        yield *state[2][:-1], None, state[2][-1]
                    if len_a:
                        found = x.pairs()
                        if len(pairs):
                            place = np.minimum(np.searchsorted(pairs, found), len(pairs) - 1)
                            hit = pairs[place] == found
                            out[6:8] = [int(best[place[hit]].sum()), int(n[place[hit]].sum())]
                            found = found[~hit]
                        if len(found):
                            rare = [{"pair": p, "k": k} for p, k in zip(*(y.tolist() for y in np.unique(found, return_counts=True)))]
                        text = x.written_out(texts)[:-1]
                        if state[1] is None:
                            state[1] = hashlib.sha256(text)
                        else:
                            state[1].update(b";" + text)
                    state[2] = (*out, rare)
            if state[2]:
                yield *state[2][:-1], state[1] and state[1].hexdigest(), state[2][-1]

        yield from to_batches(rows(), schema, size=512)

    sql = "row long, doc_id long, " + ", ".join(f"{c} long" for c in names) + ", digest string, rare array<struct<pair: bigint, k: bigint>>"
    columns, is_long = ("row", "doc_id", "start", "a", "b"), F.col("row") >= F.lit(1 << 62)
    short = runs.filter(~is_long).select(*columns).mapInArrow(digest, sql)
    long = runs.filter(is_long).select(*columns).repartition("row").sortWithinPartitions("row", "start").mapInArrow(digest, sql)
    partial = written(short.unionByName(long), "run-digests")
    rare = partial.select("row", F.inline("rare")).join(counts, "pair")
    zero, none = F.lit(0).cast("long"), F.lit(None)
    more = rare.groupBy("row").agg(F.sum(F.col("k") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
    more = more.select("row", none.cast("long").alias("doc_id"), *[zero.alias(c) for c in names[:4]], "n_best", "count_sum", none.cast("string").alias("digest"))
    sums = partial.drop("rare").unionByName(more).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in names], F.max("digest").alias("digest"))
    return sums.select("doc_id", *names, F.coalesce("digest", F.lit("")).alias("groups_sha256"))
