"""Substring deduplication: Rabin-Karp hashes of every window of words, counted in Spark, repeated windows removed.

One pass over the texts hashes every window of `window` consecutive words. Batches of documents settle their own
repeats first, so that a window met a million times leaves one row for each batch, then send the rest as packed
columns to the partition that a second, independent hash names. There, windows are counted: of those with equal hashes
all but the earliest (smallest doc_id, then start) go back to their documents, where overlapping windows merge into
maximal intervals. Texts are shuffled once, compressed.

Windows are equal if 64 bits of one hash and the partition named by another agree, which for n windows in p partitions
joins some unequal pair with probability n*n / (p * 2**65) at most: under 0.001 for 10**10 windows in 3,000 partitions;
of 10**13 windows in a million partitions about three pairs are to be expected.

Defined cases: a null text has no words; texts under `window` words have no windows; a null doc_id counts as the
largest id; rows that share a doc_id are places of one document, and the same start in two of them is no earlier place;
of repeated rows with ids of their own the smallest id's stays whole; a text of any length is hashed whole, in one worker;
an empty table gives no rows; columns named like results are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestry.llm import common as C

WINDOW = 20
#: Bytes of text hashed at a time.
BATCH = 2 << 20
_FIRST, _SECOND = C.Powers(0x2545F4914F6CDD1D), C.Powers(0xDA942042E4DD58B5)
_LAST = (1 << 63) - 1


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(map(C.planes, columns)))


def _unpack(data: bytes, n: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    size = len(raw) // n
    return [C.unplanes(raw[i * size : (i + 1) * size]) for i in range(n)]


def _places(docs: np.ndarray, starts: np.ndarray, *more: np.ndarray) -> bytes:
    """Places in order, as differences."""
    step = np.diff(docs, prepend=0)
    same = np.zeros(len(docs), bool)
    same[1:] = step[1:] == 0
    return _pack(step, np.where(same, np.diff(starts, prepend=0), starts), *more)


def _placed(data: bytes, n: int = 2) -> list[np.ndarray]:
    step, starts, *more = _unpack(data, n)
    docs = np.cumsum(step)
    if len(starts):
        new = np.flatnonzero(np.concatenate(([True], step[1:] != 0)))
        total = np.cumsum(starts)
        starts = total - np.repeat(total[new] - starts[new], np.diff(np.append(new, len(step))))
    return [docs, starts, *more]


def _hashed(texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """Index of the text, start, and both hashes of every window."""
    buf = np.frombuffer(b" ".join(texts), np.uint8)
    s, e = C.word_bounds(buf)
    h = C.word_hashes(buf, s, e)
    ends = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(ends, s, "right")
    n = max(0, len(h) - window + 1)
    ok = np.flatnonzero(of[:n] == of[window - 1 :][:n])
    first = np.searchsorted(of, np.arange(len(texts)))
    return of[ok], ok - first[of[ok]], C.rolled(h, window, _FIRST)[ok], C.rolled(C.mix(h + np.uint64(1)), window, _SECOND)[ok]


def _later(order: np.ndarray, key: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """order sorts by key, then place. Those that lead a run of equal keys, and those at a later place than their leader."""
    k = key[order]
    head = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))] if len(k) else order
    return order[head], order[(docs[order] != docs[lead]) | (starts[order] != starts[lead])]


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if len(x) else np.zeros(0, int)
    return zip(at[:-1].tolist(), at[1:].tolist(), strict=True)


def _group(docs: np.ndarray, groups: int) -> np.ndarray:
    return (C.mix(docs.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _back(docs: np.ndarray, starts: np.ndarray, key: np.ndarray, groups: int) -> Iterator[tuple]:
    """Windows to remove with their hashes, which tell rows that share a doc_id apart, packed by the group of their document."""
    to = _group(docs, groups)
    order = np.lexsort((starts, docs, to))
    to, docs, starts, key = (x[order] for x in (to, docs, starts, key))
    for lo, hi in _runs(to):
        yield int(to[lo]), 1, _places(docs[lo:hi], starts[lo:hi], key[lo:hi].view(np.int64))


def _code(starts: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A start and a window's hash as one word."""
    return C.mix(key + (starts.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


_WAY = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("hashes", pa.binary()), ("places", pa.binary())])
_WAY_SQL = "part int, kind int, hashes binary, places binary"


def _send(window: int, buckets: int, groups: int):
    def of_batch(ids: list[int], texts: list[bytes]) -> list[tuple]:
        by = sorted(range(len(ids)), key=ids.__getitem__)
        of, starts, key, second = _hashed([texts[i] for i in by], window)
        docs = np.array([ids[i] for i in by], np.int64)[of]
        # the places are in order but where rows share a doc_id
        order = np.argsort(key, kind="stable") if len(set(ids)) == len(ids) else np.lexsort((starts, docs, key))
        lead, later = _later(order, key, docs, starts)
        rows = [(t, k, None, d) for t, k, d in _back(docs[later], starts[later], key[later], groups)]
        to = (second[lead] >> np.uint64(32)) % np.uint64(buckets)
        by = np.lexsort((starts[lead], docs[lead], to))
        lead, to = lead[by], to[by]
        for lo, hi in _runs(to):
            x = lead[lo:hi]
            rows.append((int(to[lo]), 0, key[x].astype("<u8").tobytes(), _places(docs[x], starts[x])))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(dict(zip(_WAY.names, zip(*rows, strict=True), strict=True)) if (rows := of_batch(ids, texts)) else {k: [] for k in _WAY.names}, _WAY)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if (t := t.as_buffer()) is None or t.size < 2 * window - 1:
                    continue
                ids.append(_LAST if i is None else i)
                texts.append(t.to_pybytes())
                size += t.size
                if size >= BATCH:
                    yield out()
                    ids, texts, size = [], [], 0
        if ids:
            yield out()

    return C.lean(run)


def _count(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple] = []
        for b in batches:
            for kind, hashes, places in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if kind == 0:
                    got.append((np.frombuffer(hashes, "<u8"), *_placed(places)))
            if on := [(p, k, d) for p, k, d in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True) if k == 1]:
                yield _rows(on)
        if not got:
            return
        key, docs, starts = (np.concatenate(x) for x in zip(*got, strict=True))
        got.clear()
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]  # hashes met once need no place
        order = order[np.lexsort((starts[order], docs[order], key[order]))]
        _, later = _later(order, key, docs, starts)
        if len(later):
            yield _rows(list(_back(docs[later], starts[later], key[later], groups)))

    return C.lean(run)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    p, k, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"part": p, "kind": k, "hashes": [None] * len(p), "places": d}, _WAY)


def intervals(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of words that sorted windows cover."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(starts[1:] > starts[:-1] + window)
    return starts[np.concatenate(([0], gap + 1))], starts[np.concatenate((gap, [len(starts) - 1]))] + window


def _cut(text: bytes, asked: np.ndarray, window: int, whole_words: bool) -> tuple[int, int, bytes]:
    """Words, words removed and what is left of a text, whose windows with a code among the sorted asked are removed."""
    words, gone = text.split(), np.zeros(0, np.int64)
    if len(asked):
        _, starts, key, _ = _hashed([text], window)
        code = _code(starts, key)
        gone = starts[asked[np.minimum(np.searchsorted(asked, code), len(asked) - 1)] == code]
    lo, hi = intervals(gone, window)
    if not len(lo):
        return len(words), 0, b" ".join(words) if whole_words else text
    if whole_words:
        for a, b in zip(lo[::-1], hi[::-1], strict=True):
            del words[a:b]
        return len(words) + int((hi - lo).sum()), int((hi - lo).sum()), b" ".join(words)
    s, e = C.word_bounds(np.frombuffer(text, np.uint8))
    out, at = [], 0
    for a, b in zip(lo, hi, strict=True):
        out.append(text[at : s[a]])
        at = int(s[b]) if b < len(s) else len(text)
    return len(words), int((hi - lo).sum()), b"".join([*out, text[at:]])


def _apply(window: int, whole_words: bool, names: list[str], out_schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, docs, code = [], None, None
        for b in batches:
            kinds = np.asarray(b.column(1))
            for p in b.column(2).filter(pa.array(kinds == 1)).to_pylist():
                got.append(_placed(p, 3))
            if not (kinds == 2).any():
                continue
            if docs is None:  # removals are sorted before texts
                docs, starts, key = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3
                got.clear()
                code = _code(starts, key.view(np.uint64))
                order = np.lexsort((code, docs))
                docs, code = docs[order], code[order]
            rows = b.filter(pa.array(kinds == 2))
            ids = np.asarray(rows.column(3).fill_null(_LAST))
            lo, hi = np.searchsorted(docs, ids), np.searchsorted(docs, ids, "right")
            open_ = zstandard.ZstdDecompressor()
            done = [(0, 0, b"") if t is None else _cut(open_.decompress(t), code[x:y], window, whole_words) for t, x, y in zip(rows.column(4).to_pylist(), lo, hi, strict=True)]
            n, cut, kept = zip(*done, strict=True)
            rest = rows.column(5)
            yield pa.RecordBatch.from_arrays([*(rest.field(i) for i in range(len(names))), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema=out_schema)

    return C.lean(run)


def _shrink(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            ids = b.column(0).fill_null(_LAST)
            z = pa.array([None if (t := x.as_buffer()) is None else pack.compress(t) for x in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(_group(np.asarray(ids), groups), pa.int32()), ids, z, b.column(2)], ["part", "id", "z", "rest"])

    return C.lean(run)


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", whole_words: bool = True) -> DataFrame:
    """docs, without text_col but with n_words, n_removed and kept_text (these replace columns of the same names).

    kept_text has the kept words joined by one space; with whole_words false it has the text with the removed intervals
    cut out and all else as it was.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed", "kept_text")]
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    key, text = F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")
    n = C.parts(docs, 8.0)
    found = docs.select(key, text).mapInArrow(_send(window, n, n), _WAY_SQL).repartitionById(n, F.col("part")).mapInArrow(_count(n), _WAY_SQL)
    full = docs.select(key, text, F.struct(*rest, F.lit(0).alias("_")).alias("rest"))
    shape = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("z", T.BinaryType()), full.schema["rest"]])
    full = full.mapInArrow(_shrink(n), shape).select("part", F.lit(2).alias("kind"), F.lit(None).cast("binary").alias("places"), "id", "z", "rest")
    found = found.select("part", "kind", "places", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("z"), F.lit(None).cast(full.schema["rest"].dataType).alias("rest"))
    both = found.unionByName(full).repartitionById(n, F.col("part")).sortWithinPartitions("kind")
    out = T.StructType([*(T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(names)), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return both.mapInArrow(_apply(window, whole_words, names, to_arrow_schema(out)), out).toDF(*names, "n_words", "n_removed", "kept_text")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of all documents: what is left without words of windows that occur earlier."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, s, array_to_string(words[s + 1:s + 20], ' ') AS k FROM w, unnest(range(0, len(words) - 19)) AS t(s)),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win),
gone AS (SELECT DISTINCT doc_id, s + i AS p FROM ranked, unnest(range(0, 20)) AS t(i) WHERE r > 1),
pos AS (SELECT doc_id, p, words[p + 1] AS word FROM w, unnest(range(0, len(words))) AS t(p)),
kept AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.p) AS kept, count(*) AS n FROM pos ANTI JOIN gone ON pos.doc_id = gone.doc_id AND pos.p = gone.p GROUP BY pos.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
