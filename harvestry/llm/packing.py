"""Mixture-controlled packing: deficit round-robin over source queues, with the deficits carried through all windows.

Every source is a queue of its documents' tokens with a target weight w_i; its share of the tokens if none is given, which
is the one mixture that every window can have. A window of L tokens gives queue i the quantum q_i = L * w_i / W, W the
weight of the queues that have tokens left, and the queue's deficit, what it was owed before and did not get, is added;
it is served whole tokens, and what it is still owed, under one token, is its deficit for the next window. A queue that
runs dry leaves the round, and the others share the windows from there on. Between two such points a queue has had
floor(x * (w_1 + ... + w_i) / W) - floor(x * (w_1 + ... + w_(i-1)) / W) of the x tokens served since the first of them:
what all queues are owed comes to whole tokens, and each window is full. So deficits after any window follow from its
number and the queues' sizes, and are carried across windows, partitions and machines without any of them waiting for
another: a task needs a document's place in its queue, which is a prefix sum, and the table of queues. The tokens left
after the last full window are cut to lengths that are powers of two, so nothing is padded.

A source with less than one token a window can't be in every window: those share one queue, the joint one, in which they take
turns by a round of their own, in windows of TURN tokens: so each has pieces of a size, spread over the whole. Sources
with less than 1/L of that queue take one lane of it, in the order of their rows. So there are L queues and L lanes at
most.

Tokens are read from the tokenizer's file by a word cache in front of its ranks, which gives the ids of the tokenizers
library (tested), and by that library itself for texts that hold a special token.

Defined cases: a null text is empty: a document of its end alone; a null source is a source; rows that share a doc_id
are documents of their own, repeated rows too; a text of any length is cut over as many sequences as it needs, and held by
one worker with its ids; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm import common as C

LENGTH = 1024
#: Tokens of the joint queue in which small sources take turns once.
TURN = 1 << 20
#: Words whose ids a task remembers.
CACHE = 400_000


class Ids:
    """Token ids of texts as little-endian 16-bit numbers (vocabularies up to 65,536), with the id 0 after each text."""

    def __init__(self, path: str):
        import json

        import tiktoken

        import public_tokenizers

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        if max(vocab.values()) > 0xFFFF:
            raise ValueError("ids must fit 16 bits")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        # the printable stand-ins of bytes in byte-level vocabularies
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        self.enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        outer = self

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= CACHE:
                    self.clear()
                self[word] = out = outer.plain(word)
                return out

        self.words = Words()

    @functools.cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def plain(self, text: str) -> bytes:
        return array("H", self.enc.encode_ordinary(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes() + b"\0\0"
        # a space before another character than white space begins a token, whatever is around it
        first, *rest = text.split(" ")
        if "" in rest or any(w[0].isspace() for w in rest):
            out, at = [], 0
            for i in range(1, len(text)):
                if text[i - 1] == " " and not text[i].isspace() and i - 1 > at:
                    out.append(text[at : i - 1])
                    at = i - 1
            return b"".join(map(self.words.__getitem__, [*out, text[at:]])) + b"\0\0"
        get = self.words.__getitem__
        return get(first) + b"".join([get(" " + w) for w in rest]) + b"\0\0"


@functools.cache
def ids_of(path: str) -> Ids:
    """One for each Python worker, so that its tasks share what it remembers."""
    if sys.byteorder != "little":
        raise RuntimeError("ids are kept as little-endian numbers")
    return Ids(path)


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, part, had = ids_of(path), TaskContext.get().partitionId(), {}
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                b = big.slice(at, 1000)
                out = [ids(t or "") for t in b.column(1).to_pylist()]
                starts = []
                for source, x in zip(b.column(2).to_pylist(), out, strict=True):
                    starts.append(had.get(source, 0))
                    had[source] = starts[-1] + len(x) // 2
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([part] * n, pa.int32()), pa.array(starts, pa.int64()), pa.array([len(x) // 2 for x in out], pa.int64()), pa.array(out, pa.binary())], ["id", "source", "part", "local", "n", "ids"])

    return C.lean(run)


class Schedule:
    """Windows and offsets of the tokens of queues, from the queues' sizes and weights (whole numbers)."""

    def __init__(self, sizes: list[int], length: int, weights: list[int] | None = None):
        self.length, self.total = length, sum(sizes)
        self.full = self.total // length
        self.tail = self.total - self.full * length
        left, had, at = list(sizes), [0] * len(sizes), 0
        #: Where a phase begins; tokens of queues up to i by then; cumulative weights in the phase.
        self.starts: list[int] = []
        self.bases: list[list[int]] = []
        self.weights: list[list[int]] = []
        while at < self.total:
            active = [w if n else 0 for w, n in zip(weights or sizes, left, strict=True)]
            if not any(active):  # queues without a weight come when all others are dry
                active = left
            up, every = list(itertools.accumulate(active)), sum(active)
            self.starts.append(at)
            self.bases.append(list(itertools.accumulate(had)))
            self.weights.append(up)
            m = min(n * every // w for n, w in zip(left, active, strict=True) if w)  # until the first runs dry
            for i, (lo, hi) in enumerate(itertools.pairwise([0, *up])):
                n = m * hi // every - m * lo // every
                had[i], left[i] = had[i] + n, left[i] - n
            at += m

    def edge(self, i: int, n: int) -> int:
        """Tokens of queues up to i in the first n windows."""
        x = min(n * self.length, self.total)
        if i < 0 or not x:
            return 0
        k = bisect.bisect_left(self.starts, x) - 1 if len(self.starts) > 1 else 0
        up = self.weights[k]
        return self.bases[k][i] + (x - self.starts[k]) * up[i] // up[-1]

    def served(self, i: int, n: int) -> int:
        return self.edge(i, n) - self.edge(i - 1, n)

    def deficit(self, i: int, n: int) -> float:
        """What queue i is owed after n windows, since the last queue ran dry, beyond what it had."""
        x = min(n * self.length, self.total)
        k = max(0, bisect.bisect_left(self.starts, x) - 1)
        up, base = self.weights[k], self.bases[k]
        own = lambda xs: xs[i] - (xs[i - 1] if i else 0)
        return (x - self.starts[k]) * own(up) / up[-1] - (self.served(i, n) - own(base))

    def runs(self, i: int, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(first token, length, window, offset) of tokens start to start + n of queue i; what is left over is a window too."""
        w, high = 0, self.full
        while w < high:  # the window that has the first of them
            mid = (w + high) // 2
            if self.served(i, mid + 1) <= start:
                w = mid + 1
            else:
                high = mid
        at, end = start, start + n
        low, top = self.edge(i - 1, w), self.edge(i, w)
        while at < end:
            next_low, next_top = self.edge(i - 1, w + 1), self.edge(i, w + 1)
            upto = min(next_top - next_low, end)
            if upto > at:
                yield at - start, upto - at, w, next_low - low + at - (top - low)
                at = upto
            low, top, w = next_low, next_top, w + 1

    def pieces(self, i: int, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """As runs(), but (first token, length, sequence, offset): what is left over is cut to powers of two."""
        for first, size, w, offset in self.runs(i, start, n):
            if w < self.full:
                yield first, size, w, offset
                continue
            begin, sequence = 0, self.full
            for bit in range(self.tail.bit_length() - 1, -1, -1):
                if part := self.tail & 1 << bit:
                    lo, hi = max(offset, begin), min(offset + size, begin + part)
                    if hi > lo:
                        yield first + lo - offset, hi - lo, sequence, lo - begin
                    begin, sequence = begin + part, sequence + 1


class Plan:
    """The schedule of the queues, and that of the joint queue's lanes, which are numbered after the queues before it."""

    def __init__(self, queues: list[int], lanes: list[int], length: int, weights: list[int] | None = None, turn: int = TURN):
        self.own, self.turn = len(queues), turn
        self.outer = Schedule([*queues, sum(lanes)], length, weights)
        self.inner = Schedule(lanes, turn)

    def pieces(self, lane: int, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        if lane < self.own:
            yield from self.outer.pieces(lane, start, n)
            return
        for first, size, w, offset in self.inner.runs(lane - self.own, start, n):
            for more, k, sequence, at in self.outer.pieces(self.own, w * self.turn + offset, size):
                yield first + more, k, sequence, at


def _cut(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                b = big.slice(at, 2000)
                out: list[tuple] = []
                for doc, lane, place, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    ids = np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                    n = len(ids) // 4
                    out += [(doc, s, k, zlib.crc32(ids[4 * s : 4 * (s + k)]), n, q, o) for s, k, q, o in plan.pieces(lane, place, n)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)

    return C.lean(run)


def _by_name(rows: list) -> list[tuple[str | None, int]]:
    return sorted(((r["source"], r["size"]) for r in rows), key=lambda x: (x[0] is None, (x[0] or "").encode()))


def pack(docs: DataFrame, path: str, length: int = LENGTH, weights: dict[str | None, int] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pieces of documents: id, start, length, ids_crc32, doc_tokens, sequence_id, offset. path: of the tokenizer's file.

    weights: target proportions of sources, as whole numbers, for as long as they last; each must come to one token a
    window at least. Sources without one follow when those are used up. None: every window has the sources' own shares.
    """
    shape = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{source_col}`").cast("string").alias("source"))
    tokens = C.written(docs.mapInArrow(_tokenize(path), "id long, source string, part int, local long, n long, ids binary"))
    # prefix sums: each task of _tokenize() has numbered its own tokens by source; a row for each source and task is left
    sums = C.written(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")))
    by_source = C.written(sums.groupBy("source").agg(F.sum("n").alias("size")))
    total = by_source.agg(F.sum("size")).first()[0]
    if not total:
        return tokens.sparkSession.createDataFrame([], shape)
    if weights is None:
        large = F.col("size") * length >= total
    else:
        if len(weights) > length or any(int(w) != w or w * length < sum(weights.values()) for w in weights.values()):
            raise ValueError("weights are whole numbers that come to one token a window at least")
        large = F.exists(F.array(*(F.lit(s).cast("string") for s in weights)), lambda s: s.eqNullSafe(F.col("source")))
    queues = _by_name(by_source.where(large).collect())  # `length` rows at most
    small = by_source.where(~large)
    joint = small.agg(F.sum("size")).first()[0] or 0
    lanes = _by_name(small.where(F.col("size") * length >= joint).collect())  # again
    rest = joint - sum(n for _, n in lanes)
    plan = Plan([n for _, n in queues], [*(n for _, n in lanes), rest], length, None if weights is None else [*(int(weights[s]) for s, _ in queues), 0])
    common = len(queues) + len(lanes)
    named = tokens.sparkSession.createDataFrame([(s, i) for i, (s, _) in enumerate([*queues, *lanes])], "of string, queue int")
    from pyspark.sql import Window

    # the list has 2 * `length` rows at most
    sums = sums.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("of")), "left").withColumn("queue", F.coalesce("queue", F.lit(common))).drop("of")
    # where each task's tokens begin: a sum by blocks of 1,000 tasks, then within, so that no task sorts all of them
    sums = sums.withColumn("block", F.floor(F.col("part") / 1000).cast("int"))
    before = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy("queue", "block").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("queue").alias("q"), F.col("block").alias("b"), "base")
    inner = Window.partitionBy("queue", "block").orderBy("part", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    bases = C.written(sums.join(blocks, (F.col("queue") == F.col("q")) & (F.col("block") == F.col("b"))).select(F.col("source").alias("s"), F.col("part").alias("p"), "queue", (F.col("base") + F.col("before")).alias("base")))
    placed = tokens.join(bases, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).select("id", "queue", (F.col("base") + F.col("local")).alias("place"), "ids")
    return placed.mapInArrow(_cut(plan), shape)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's packing of all documents, each window in the sources' own shares, which lets it use up every token."""
    import public_tokenizers

    return pack(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")
