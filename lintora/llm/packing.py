"""Mixture-controlled packing of documents into sequences.

Each source is a queue of tokens with a weight. Deficit round-robin with a
quantum of one token serves the queue that is owed most: token j of a queue is due
when (j + 1/2) / weight of the common time has passed, and all tokens are served
in the order in which they are due. A window (sequence) is each next `size` tokens
in that order. What a queue is owed and has not been served, its deficit, is
carried to the next window whole; a source that is due less than one token a
window gets one every few windows.

So what all queues have been served in any window follows from its number: it is
a floor at one common time, found by bisection. Tasks that hold any stretch of
any queue compute where its tokens go without a pass over the windows before, and
deficits carry across partitions as they do across windows.

Sources with a token or more in each window, no more than `size` of them, are
queues of their own. All others share one queue, the tail, in which a sort brings
their documents into the order in which they are due.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintora.llm.common import rows_of, small, to_batches, written
from lintora.llm.tokens import word_encoder

SIZE = 4096
TAIL, REST = -2, -1


class Order:
    """Tokens of several queues in the order in which they are due, ties by
    queue. totals: tokens of each queue; weights: positive integers."""

    def __init__(self, totals: list[int], weights: list[int]):
        self.totals, self.weights = totals, weights
        self.grain = 2 * max(weights, default=1)  # in 1 / grain of time a queue has one token due at most
        dry = sorted((Fraction(n, w), w) for n, w in zip(totals, weights) if n)
        self.times, self.counts, active, time, count = [], [], sum(w for _, w in dry), Fraction(0), Fraction(0)
        self.active = []
        for at, w in dry:  # between two of these times all that are not dry are served by their weights
            self.times.append(time)
            self.counts.append(count)
            self.active.append(active)
            count, time, active = count + (at - time) * active, at, active - w
        self.end = time

    def _due(self, step: int) -> list[int]:
        """Tokens due at the time step / grain."""
        twice = 2 * self.grain
        return [min(n, (2 * w * step + self.grain) // twice) for n, w in zip(self.totals, self.weights)]

    def served(self, count: int) -> list[int]:
        """How many of each queue are among the first `count`."""
        if count >= sum(self.totals):
            return list(self.totals)
        at = max(0, bisect_right(self.counts, count) - 1)
        guess = int((self.times[at] + (count - self.counts[at]) / self.active[at]) * self.grain) if self.times else 0
        reach = 1 + len(self.totals)
        low, high = max(0, guess - reach), guess + reach
        while low and sum(self._due(low)) > count:
            low, reach = max(0, low - reach), 2 * reach
        while sum(self._due(high)) <= count:
            high, reach = high + reach, 2 * reach
        while high - low > 1:  # the last step at which not too many are due
            middle = (low + high) // 2
            low, high = (middle, high) if sum(self._due(middle)) <= count else (low, middle)
        out, after = self._due(low), self._due(high)
        more = sorted((Fraction(2 * out[q] + 1, 2 * self.weights[q]), q) for q in range(len(out)) if after[q] > out[q])
        for _, q in more[: count - sum(out)]:
            out[q] += 1
        return out

    def place(self, queue: int, at: int) -> int:
        """How many tokens come before token `at` of the queue."""
        due, own, count = 2 * at + 1, self.weights[queue], 0
        for q, (n, w) in enumerate(zip(self.totals, self.weights)):
            earlier = (w * due - own) // (2 * own) + 1 if q < queue else -((own - w * due) // (2 * own))
            count += min(n, max(0, earlier)) if q != queue else at
        return count


class Schedule:
    """Which tokens of which queue are in which window.

    totals: tokens of each queue. weights: target proportions as integers;
    queues of weight 0 are served by their totals when all others are dry. None:
    the totals, by which all queues last to the end."""

    def __init__(self, totals: list[int], weights: list[int] | None = None, size: int = SIZE):
        self.size, self.queues, self.total = size, len(totals), sum(totals)
        self.windows = -(-self.total // size)
        weights = weights or totals
        self.first = [q for q in range(self.queues) if weights[q] and totals[q]]
        self.then = [q for q in range(self.queues) if not weights[q] and totals[q]]
        self.orders = Order([totals[q] for q in self.first], [weights[q] for q in self.first]), Order([totals[q] for q in self.then], [totals[q] for q in self.then])
        self.cut = sum(totals[q] for q in self.first)
        self._cache()

    def _cache(self) -> None:
        self.number = {q: (part, i) for part, queues in enumerate((self.first, self.then)) for i, q in enumerate(queues)}
        self.served = lru_cache(1 << 14)(self._served)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("served", "number")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._cache()

    def _served(self, window: int) -> list[int]:
        """Tokens of each queue in all windows before this one."""
        count, out = min(window * self.size, self.total), [0] * self.queues
        for queues, order, n in ((self.first, self.orders[0], min(count, self.cut)), (self.then, self.orders[1], max(0, count - self.cut))):
            for q, served in zip(queues, order.served(n)):
                out[q] = served
        return out

    def deficits(self, window: int) -> list[Fraction]:
        """What each weighted queue that is not dry is owed when a window begins
        and was not served: its due share of all that such queues were served,
        since the last of the others ran dry, less its own."""
        order, count = self.orders[0], min(window * self.size, self.cut)
        if count in (0, self.cut):
            return [Fraction(0)] * self.queues
        at = max(0, bisect_right(order.counts, count) - 1)
        time, out = order.times[at] + (count - order.counts[at]) / order.active[at], [Fraction(0)] * self.queues
        for q, n, w, served in zip(self.first, order.totals, order.weights, order.served(count)):
            out[q] = min(Fraction(n), w * time) - served
        return out

    def window_of(self, queue: int, at: int) -> int:
        """The window that holds token `at` of the queue."""
        part, i = self.number[queue]
        return (self.orders[part].place(i, at) + part * self.cut) // self.size

    def pieces(self, queue: int, at: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, window, offset in it) of a stretch of the queue."""
        start, window = 0, self.window_of(queue, at) if length else 0
        while start < length:
            before, after = self.served(window), self.served(window + 1)
            n = min(length - start, after[queue] - at - start)
            if n:
                offset = sum(after[:queue]) - sum(before[:queue]) + at + start - before[queue]
                yield start, n, window, offset
                start += n
            window += 1
            if start < length and after[queue] == at + start and self.served(window + 1)[queue] == after[queue]:
                window = self.window_of(queue, at + start)  # a rare source: its next token is far


_ENCODED = pa.schema([("part", pa.int64()), ("source", pa.string()), ("at", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("queue", pa.string()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _tokens() -> Column:
    return (F.octet_length("ids") / 4).cast("long")


def _based(rows: DataFrame, key: str, name: str) -> DataFrame:
    """part, key, base: the tokens of the key in all parts before."""
    by_part = rows.groupBy("part", key).agg(F.sum(_tokens()).alias("n"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written(by_part.select("part", key, "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), name)


def _merged(rows: DataFrame) -> DataFrame:
    """Rows of sources that share a queue (number TAIL or REST) with their place
    in it: the documents in the order in which their middle token is due."""
    due = (F.col("at") + _tokens() / 2) / F.col("weight")
    keys = ["number", "due", "source", "at"]
    ranged = rows.withColumn("due", due).select(*keys, "doc_id", "ids").repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ends = TaskContext.get().partitionId(), {}
        schema = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("source", pa.string()), ("at", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())])

        def placed():
            for number, source, doc_id, ids in rows_of(b.select(["number", "source", "doc_id", "ids"]) for b in batches):
                at = ends.get(number, 0)
                ends[number] = at + len(ids) // 4
                yield part, number, source, at, doc_id, ids

        yield from to_batches(placed(), schema)

    found = written(ranged.mapInArrow(run, "part long, number long, source string, at long, doc_id long, ids binary"), "shared-queues")
    base = small(_based(found, "number", "shared-places").select("part", "number", "base"))
    return found.join(base, ["part", "number"]).select("doc_id", "source", "number", (F.col("base") + F.col("at")).alias("at"), "ids")


def pack(docs: DataFrame, tokenizer: str, end_id: int, targets: dict[str, int] | None = None, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pieces of documents in sequences of `size` tokens: doc_id, start, length,
    ids, doc_tokens, queue (its source), sequence_id, offset.

    A document's ids and end_id lie in one piece or several; sequences are full
    without gaps but for the last. targets: integer weights by source (others 0:
    last, by their totals); None: the proportions of the corpus, so that all
    sequences are mixed alike. The order of a source is that of the written table
    of ids. A schedule of no more than `size` + 2 queues is sent to the executors,
    however many sources there are.

    Null and empty texts have the end id alone. Null sources are the empty one.
    Rows with equal or null ids are all packed. Other columns are ignored; no
    rows give no pieces."""
    spark = docs.sparkSession

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, part, ends = word_encoder(tokenizer), struct.pack("<I", end_id), TaskContext.get().partitionId(), {}

        def rows():
            for doc_id, text, source in rows_of(batches):
                ids = encoder.encode(text) + end
                at = ends.get(source, 0)
                ends[source] = at + len(ids) // 4
                yield part, source, at, doc_id, ids

        yield from to_batches(rows(), _ENCODED)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    encoded = written(texts.mapInArrow(encode, "part long, source string, at long, doc_id long, ids binary"), "ids")
    places = _based(encoded, "source", "places")
    sources = places.groupBy("source").agg(F.sum("n").alias("n"))
    if targets is None:
        sources = sources.withColumn("weight", F.col("n"))
    else:
        wanted = spark.createDataFrame(list(targets.items()), "source string, weight long")
        sources = sources.join(wanted, "source", "left").fillna(0, ["weight"])
    sources = written(sources, "sources")
    whole = sources.agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("long")).first()[0]
    own = [tuple(r) for r in sources.filter((F.col("weight") > 0) & (F.col("weight").cast("decimal(38,0)") * size >= whole)).orderBy("source").collect()]  # at most `size`
    numbers = spark.createDataFrame([(r[0], i) for i, r in enumerate(own)], "source string, number long")
    shared = F.when(F.col("weight") > 0, F.lit(TAIL)).otherwise(F.lit(REST)).cast("long")
    sources = sources.join(F.broadcast(numbers), "source", "left").select("source", F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.col("n")).alias("weight"), F.coalesce("number", shared).alias("number"), "n")
    merged = {r.number: (r.n, r.weight) for r in sources.filter("number < 0").groupBy("number").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).collect()}
    totals = [r[1] for r in own] + [merged.get(q, (0, 0))[0] for q in (TAIL, REST)]
    weights = [r[2] for r in own] + [merged.get(TAIL, (0, 0))[1], 0]
    known = spark.sparkContext.broadcast(Schedule(totals, weights, size))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = known.value

        def rows():
            for doc_id, source, number, at, ids in rows_of(batches):
                n = len(ids) // 4
                for start, length, window, offset in schedule.pieces(number % schedule.queues, at, n):
                    yield doc_id, start, length, ids[4 * start : 4 * (start + length)], n, source, window, offset

        yield from to_batches(rows(), _PIECES, size=4096)

    where = small(places.select("part", "source", "base").join(small(sources.select("source", "weight", "number")), "source"))
    placed = encoded.join(where, ["part", "source"]).select("doc_id", "source", "number", (F.col("base") + F.col("at")).alias("at"), "ids", "weight")
    ready = placed.filter("number >= 0").drop("weight")
    if merged:
        ready = ready.unionByName(_merged(placed.filter("number < 0")))
    return ready.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, queue string, sequence_id long, offset long")


def sequences(pieces: DataFrame, pad_id: int = 0, size: int = SIZE) -> DataFrame:
    """One row for each sequence: sequence_id, ids (padded to `size` tokens
    unless their number is a power of two), n_tokens without padding, and parts:
    (offset, length, doc_id) of the pieces in order."""
    gathered = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    padded = F.when(F.bit_count("n_tokens") == 1, F.col("ids")).otherwise(F.rpad("ids", F.lit(4 * size), F.lit(struct.pack("<I", pad_id))))
    parts = F.transform("p", lambda x: F.struct(x["offset"].alias("offset"), x["length"].alias("length"), x["doc_id"].alias("doc_id")))
    return gathered.select("sequence_id", ids.alias("ids"), "n_tokens", parts.alias("parts")).withColumn("ids", padded)
