"""SimHash near-duplicates: bit-sliced comparison of fingerprints, and the components of the links.

A fingerprint has `bits` bits: bit j is 1 if it is set in over half of the hashes of the text's word shingles. Equal
fingerprints are one from here on. Candidates meet in tables:

* exact search (64 bits): the bits are cut into radius + t blocks; two fingerprints within the radius agree in t whole
  blocks at least, so a table for every choice of t blocks, keyed by their bits, holds every link. t grows with the
  logarithm of the number of fingerprints, so buckets stay short; any t gives the same links.
* sampled search (wider fingerprints, radii that are a share of the bits): tables keyed by random bits, as many as are
  needed for a pair at the radius to miss all of them with probability `miss`. A similarity is estimated from the
  share of differing bits: with 1,024 bits and at 0.8, one standard deviation of the estimate is 0.015.

In a bucket, fingerprints lie as bit planes: word j of plane i holds bit i of 64 fingerprints. A query's distances to
64 fingerprints are counted at once in carry-save counters, four planes of bits with a sticky overflow, and a block of
words is abandoned once all its counters are beyond the radius. Of wide fingerprints the first 256 bits are compared so,
within 2.5 standard deviations of the radius' share, and what they leave is compared in all bits. A bucket returns a star
for each component of its links, not the links, and a bucket over `most` fingerprints is dealt out to pairs of parts, each a task of its own, so no group of
copies or near copies grows one task or a quadratic result. Components are found by alternating large-star and
small-star steps over the forests' edges, each step a table in the shared folder.

near_duplicates() takes such links as candidates only: their radius is wide, so that hardly a pair at the threshold is
lost, and within the candidates' components every pair's sets of shingles are compared exactly.

Defined cases: a null text has no words; a text without words has fingerprint zero and is linked like any other; a text
of fewer words than a shingle has one shingle of all; a null id is kept and counts as the largest; repeated rows are rows
of one fingerprint; rows that share an id are rows of their own; texts of any length are taken whole, each in one worker;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm import common as C

SEED = 42
#: Fingerprints that one task compares with each other.
MOST = 16_384
#: Bytes of rows for each fingerprint, and in all, that tables searched together have.
HELD, HELD_AT_LEAST = 2_304, 64_000_000
_UP, _LOW = bytes(range(65, 91)), bytes(range(97, 123))
_LOWER = bytes.maketrans(_UP, _LOW)
_ONES = np.uint64(C.MASK)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every run of words, lower-cased and joined by a space; of all words if there are fewer."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    plain = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    h = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    return np.array([h(plain[a:b], SEED) for a, b in zip(starts[:n], ends[min(shingle, len(words)) - 1 :], strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray, bits: int, step: int = 1 << 14) -> np.ndarray:
    """bits / 64 words, the most significant first. Beyond 64, words of a hash are its mixed multiples.

    For wide fingerprints the hashes that set a bit are counted in carry-save adders, all bits at once: three rows of a
    weight become a sum of that weight and a carry of the next. For narrow ones adding up bytes is quicker.
    """
    words = bits // 64
    if not len(hashes):
        return np.zeros(words, np.uint64)
    if words == 1:
        counts = np.zeros(bits, np.int64)
        for i in range(0, len(hashes), 255):  # sums of 255 rows fit a byte
            counts += np.add.reduce(np.unpackbits(hashes[i : i + 255].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.uint8)
        return np.packbits(counts * 2 > len(hashes)).view(">u8").astype(np.uint64)
    weights: list[np.ndarray] = []
    for i in range(0, len(hashes), step):
        h = hashes[i : i + step]
        rows = C.mix(h[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = 0
        while rows is not None:
            if at == len(weights):
                weights.append(rows[:0])
            rows, carries = np.concatenate((weights[at], rows)), []
            while len(rows) > 1:
                t = max(1, len(rows) // 3)
                a, b = rows[:t], rows[t : 2 * t]
                c = rows[2 * t : 3 * t]
                x = a ^ b
                carries.append((a & b) | (c & x) if len(c) else a & b)
                rows = np.concatenate((x ^ c if len(c) else x, rows[3 * t :]))
            weights[at] = rows
            rows, at = np.concatenate(carries) if carries else None, at + 1
    half = len(hashes) // 2
    above, level = np.zeros(words, np.uint64), np.full(words, _ONES)
    for d in range(len(weights) - 1, -1, -1):
        if half >> d & 1:
            level = level & weights[d][0]
        else:
            above, level = above | (level & weights[d][0]), level & ~weights[d][0]
    return above if half < 1 << len(weights) else np.zeros(words, np.uint64)


def _fingerprints(shingle: int, bits: int, repeats: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = (shingle_hashes(b"" if (t := x.as_buffer()) is None else t.to_pybytes(), shingle) for x in b.column(1))
            out = [fingerprint(h if repeats else np.unique(h), bits).astype(">u8").tobytes() for h in hashes]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "fp"])

    return C.lean(run)


def choose(distinct: int, bits: int, radius: int, miss: float, per_bucket: int = 256) -> list[np.ndarray]:
    """The bits that key each table."""
    want = max(1.0, math.log2(max(2, distinct) / per_bucket))
    if bits <= 64:
        t = 1
        while t * bits / (radius + t) < want and t < 6:
            t += 1
        blocks = np.array_split(np.arange(bits), radius + t)
        return [np.concatenate(x) for x in itertools.combinations(blocks, t)]
    n = min(48, max(10, math.ceil(want)))
    tables = math.ceil(math.log(miss) / math.log1p(-((1 - radius / bits) ** n)))
    draw = np.random.default_rng(7)
    return [np.sort(draw.choice(bits, n, replace=False)) for _ in range(tables)]


def _bits_of(fps: np.ndarray) -> np.ndarray:
    """(n, words) words as (n, bits) bits."""
    return np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1)


def _keys(tables: list[np.ndarray], words: int):
    """A row for each fingerprint and table: the table's key with its number mixed in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                b = big.slice(at, 2048)
                raw = b"".join(b.column(0).to_pylist())
                bits = _bits_of(np.frombuffer(raw, ">u8").reshape(-1, words))
                for i, chosen in enumerate(tables):
                    key = np.zeros(len(bits), np.uint64)
                    for j in chosen:
                        key = (key << np.uint64(1)) | bits[:, j]
                    key = C.mix(key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0)], ["key", "fp"])

    return C.lean(run)


def near(rows: np.ndarray, cols: np.ndarray, radius: int, after: int | None = None, abandon: int = 8) -> np.ndarray:
    """(len(rows), ceil(len(cols) / 64)) words: bit j % 64 of word j // 64 is set if that column is within the radius.

    rows and cols are (n, words) arrays of fingerprints. A block is a row against the 64 columns of a word; the vertical
    counters of all blocks go on together, and every few planes those whose distances are all beyond the radius are
    abandoned. after: columns up to row + after don't count (of a set with itself, 0 leaves each pair once).
    """
    width = -(-len(cols) // 64)
    bits = np.zeros((width * 64, cols.shape[1] * 64), np.uint8)
    bits[: len(cols)] = _bits_of(cols)
    plane = np.packbits(bits.reshape(width, 64, -1), axis=1, bitorder="little").transpose(2, 0, 1)  # (bits, width, 8)
    plane = np.ascontiguousarray(plane).view("<u8")[:, :, 0]
    mine = _bits_of(rows).T.astype(np.uint64) * _ONES  # (bits, rows): all ones where the bit is set
    row, word = (x.ravel() for x in np.indices((len(rows), width)))
    dead = np.zeros((len(rows), width), np.uint64)
    if len(cols) % 64:
        dead[:, -1] = _ONES << np.uint64(len(cols) % 64)
    if after is not None:
        gone = np.clip(np.arange(len(rows))[:, None] + after + 1 - 64 * np.arange(width)[None, :], 0, 64)
        dead |= np.where(gone == 64, _ONES, (np.uint64(1) << (gone % 64).astype(np.uint64)) - np.uint64(1))
    over = dead.ravel()
    depth = max(1, radius.bit_length())  # counters hold 2**depth - 1 >= radius; the carry out of them is sticky
    count = [np.zeros(len(row), np.uint64) for _ in range(depth)]
    for i in range(len(plane)):
        carry = plane[i][word] ^ mine[i][row]
        for d in range(depth):
            old = count[d]
            count[d] = old ^ carry
            carry = carry & old
        over = over | carry
        if i % abandon == abandon - 1:
            stay = np.flatnonzero(_beyond(count, over, radius) != _ONES)
            if len(stay) < 0.8 * len(row):
                row, word, over, count = row[stay], word[stay], over[stay], [c[stay] for c in count]
                if not len(row):
                    break
    out = np.zeros((len(rows), width), np.uint64)
    out[row, word] = ~_beyond(count, over, radius)
    return out


def _beyond(count: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Bits whose counters are above the radius."""
    above, level = np.zeros_like(over), np.full_like(over, _ONES)
    for d in range(len(count) - 1, -1, -1):
        if radius >> d & 1:
            level = level & count[d]
        else:
            above = above | (level & count[d])
            level = level & ~count[d]
    return above | over


def _joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest members of components, given those before links x to y: all links hook larger roots to smaller ones at a
    time, until none is left between two components."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


#: Words that the bit-sliced search looks at; of wider fingerprints it takes the first, and all words decide on what it finds.
SCAN = 4


def forest(rows: np.ndarray, cols: np.ndarray, same: bool, radius: int, tile: int = 512) -> list[tuple[int, int]]:
    """A star for each component of the links of rows with cols: as many pairs as there are members besides its smallest.

    same: rows and cols are the same; columns are numbered after rows if not. Tiles whose members are one component
    already are not compared.
    """
    words = rows.shape[1]
    scan, loose = min(words, SCAN), radius
    if words > scan:
        p = radius / (64 * words)
        loose = round(64 * scan * p + 2.5 * math.sqrt(64 * scan * p * (1 - p)))
    base = 0 if same else len(rows)
    root = np.arange(base + len(cols))
    for r in range(0, len(rows), tile):
        for c in range(r if same else 0, len(cols), 8 * tile):
            known = np.concatenate((root[r : r + tile], root[base + c : base + c + 8 * tile]))
            if (known == known[0]).all():
                continue
            hit = near(rows[r : r + tile, :scan], cols[c : c + 8 * tile, :scan], loose, r - c if same else None)
            i, w = np.nonzero(hit)
            if not len(i):
                continue
            which = np.unpackbits(hit[i, w].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, j = np.nonzero(which)
            x, y = i[k] + r, w[k] * 64 + j + c
            apart = root[x] != root[y + base]
            x, y = x[apart], y[apart]
            if words > scan:
                true = np.bitwise_count(rows[x] ^ cols[y]).sum(axis=1, dtype=np.int64) <= radius
                x, y = x[true], y[true]
            root = _joined(root, x, y + base)
    member = np.flatnonzero(root != np.arange(len(root)))
    return list(zip(root[member].tolist(), member.tolist(), strict=True))


def _compare(radius: int, words: int):
    """Sorted rows (key, part pair, side, fp); a group of a key and a pair of parts is whole in its partition."""

    def of_group(sides: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
        if (sides == 2).all():
            return forest(fps, fps, True, radius)
        a, b = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        at = np.concatenate((a, b))
        return [(int(at[x]), int(at[y])) for x, y in forest(fps[a], fps[b], False, radius)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                t = pa.Table.from_batches([b])
                rest = t if rest is None else pa.concat_tables([rest, t])
            if rest is None or not rest.num_rows:
                continue
            key, pair = np.asarray(rest.column(0)), np.asarray(rest.column(1))
            cut = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
            ends = [*cut.tolist(), *([len(key)] if b is None else [])]  # the last group may go on in the next batch
            if not ends:
                continue
            raw = rest.column(3).slice(0, ends[-1]).to_pylist()
            fps = np.frombuffer(b"".join(raw), ">u8").reshape(-1, words).astype(np.uint64)
            sides, lo, left, right = np.asarray(rest.column(2)), 0, [], []
            for hi in ends:
                if hi - lo > 1:
                    for x, y in of_group(sides[lo:hi], fps[lo:hi]):
                        left.append(raw[lo + x])
                        right.append(raw[lo + y])
                lo = hi
            rest = rest.slice(ends[-1])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return C.lean(run)


def _dealt(pair_of: str) -> F.Column:
    """For a row of a part of so many: the pairs of parts that it goes to, and on which side."""
    return F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda o: F.struct((F.least("part", o) * F.col("parts") + F.greatest("part", o)).cast(pair_of).alias("pair"), F.when(F.col("part") == o, 2).when(F.col("part") < o, 0).otherwise(1).alias("side")),
    )


def links(fps: DataFrame, bits: int, radius: int, distinct: int, miss: float, most: int = MOST, held: int = HELD, least: int = HELD_AT_LEAST) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that span those within the radius.

    More fingerprints need more tables, and large buckets send a row to several pairs of parts. So tables are searched
    some at a time, as many as have `held` bytes for each fingerprint (or `least` in all), a part of the buckets at a time
    if those have more: shuffle files of one round go before the next, and what they take of disk follows the input.
    """
    spark, words, row = fps.sparkSession, bits // 64, bits // 8 + 16
    tables, room = choose(distinct, bits, radius, miss), max(least, held * distinct)
    some, found = max(1, room // (row * max(1, distinct))), []
    for at in range(0, len(tables), some):
        now = tables[at : at + some]
        keyed = fps.mapInArrow(_keys(now, words), "key long, fp binary")
        # buckets with more than `most`: how many parts; few rows, for a bucket has `most` of the fingerprints or more
        large = C.written(keyed.groupBy("key").count().where(F.col("count") > most).select(F.col("key").alias("k"), "count", F.ceil(F.col("count") / most).cast("int").alias("parts")))
        size = row * (distinct * len(now) + (large.agg(F.sum(F.col("count") * (F.col("parts") - 1))).first()[0] or 0))
        rounds = math.ceil(size / (2 * room))
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / max(1, rounds) / 16e6))
        keyed = keyed.join(large.drop("count"), F.col("key") == F.col("k"), "left").drop("k")
        keyed = keyed.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        whole = F.array(F.struct(F.lit(0).alias("pair"), F.lit(2).alias("side")))
        for r in range(rounds):
            to = F.when(F.col("parts").isNull(), whole).otherwise(_dealt("int"))
            if rounds > 1:
                to = F.filter(to, lambda t: F.pmod(F.xxhash64("key", t["pair"]), F.lit(rounds)) == r)  # noqa: B023
            dealt = keyed.withColumn("to", F.explode(to)).select("key", F.col("to.pair").alias("pair"), F.col("to.side").cast("int").alias("side"), "fp")
            found.append(C.written(dealt.repartition(n, "key", "pair").sortWithinPartitions("key", "pair").mapInArrow(_compare(radius, words), "a binary, b binary")))
        C.forget(spark, large.written_at)
    return functools.reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "a binary, b binary")


def components(edges: DataFrame, least: str = "a", other: str = "b") -> DataFrame:
    """(node, root) for every node of undirected edges, root the smallest node of its component.

    Alternating large-star and small-star steps: each joins a node's neighbours to the smallest of them. A step is two
    exchanges of edges with partial aggregation; the number of steps grows with the logarithm of the longest path.
    """
    edges = C.written(edges.select(F.least(least, other).alias("a"), F.greatest(least, other).alias("b")).where("a <> b").distinct())
    while True:
        # large star: every larger neighbour of a node to the smallest of the node and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        small = C.written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")).withColumnRenamed("a", "n"))
        large = C.written(both.where("b > a").join(small, F.col("a") == F.col("n")).select(F.col("m").alias("a"), "b").where("a <> b").distinct())
        # small star: every smaller neighbour of a node, and the node, to the smallest of them
        small2 = C.written(large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "n"))
        new = large.join(small2, F.col("b") == F.col("n")).select(F.col("m"), F.explode(F.array("a", "b")).alias("b")).where("m <> b").select(F.col("m").alias("a"), "b").distinct()
        new = C.written(new)
        # a star has no node on both sides: then all hang from their roots
        done = not new.select("a").distinct().join(new.select(F.col("b").alias("a")), "a", "left_semi").head(1) and not new.groupBy("b").count().where("count > 1").head(1)
        for df in (small, large, small2, edges):
            C.forget(df.sparkSession, df.written_at)
        edges = new
        if done:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def simhash_groups(docs: DataFrame, shingle: int = 5, bits: int = 1024, radius: int | None = None, similarity: float = 0.8, miss: float = 0.01, repeats: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, group) for every row of docs; group is the smallest id of those linked to it, itself included.

    radius: differing bits of linked fingerprints; if None, the expectation of texts of that Jaccard similarity of
    their shingles, which have cosine 2s / (1 + s), and half a standard deviation more. repeats: shingles count as often as
    they occur; without, a text is the set of its shingles.
    """
    if radius is None:
        p = math.acos(2 * similarity / (1 + similarity)) / math.pi
        radius = round(bits * p + 0.5 * math.sqrt(bits * p * (1 - p)))
    if radius <= 0 or bits % 64:
        raise ValueError("bits must be a multiple of 64 and the radius positive")
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marked = C.written(docs.mapInArrow(_fingerprints(shingle, bits, repeats), "id long, fp binary"))
    firsts = C.written(marked.groupBy("fp").agg(F.min(F.coalesce("id", F.lit((1 << 63) - 1))).alias("first")))
    edges = links(firsts.select("fp"), bits, radius, firsts.count(), miss)
    roots = components(edges)
    # the smallest id of a component, by root; then by fingerprint
    named = C.written(roots.join(firsts, F.col("node") == F.col("fp")).select("node", "root", "first"))
    # a table of its own, so that the plan can split the join by roots of very many fingerprints
    least = C.written(named.groupBy("root").agg(F.min("first").alias("least")).withColumnRenamed("root", "r"))
    named = named.join(least, F.col("root") == F.col("r")).select("node", "least")
    groups = C.written(firsts.join(named, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("least", "first").alias("group")))
    # one join, straight from two tables: the plan splits fingerprints that very many documents have
    done = marked.join(groups, F.col("fp") == F.col("f"))
    return done.select("id", "fp", F.when((F.col("group") == (1 << 63) - 1) & F.col("id").isNull(), F.lit(None)).otherwise(F.col("group")).alias("group"))


#: Texts of up to so many shingles are also searched by a radius of their own: of four shingles against five, a bit
#: differs with probability 0.1875, of all others at Jaccard 0.8 and over with at most 0.162, of over 24 with 0.157.
SHORT, SHORT_SHARE = 30, 0.1875
#: Sets of shingles, and shingles, that one part of a component has at most, about.
SETS, SHINGLES = 4_096, 1_000_000


def _marks(shingle: int, bits: int):
    """For each row its key and id, the digest and size of its set of shingles, and the set's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, n, fp = [], [], []
            for x in b.column(2):
                h = np.unique(shingle_hashes(b"" if (t := x.as_buffer()) is None else t.to_pybytes(), shingle))
                digest.append(xxhash.xxh128_digest(h.astype("<u8").tobytes()))
                n.append(len(h))
                fp.append(fingerprint(h, bits).astype(">u8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(fp, pa.binary())], ["key", "id", "node", "n", "fp"])

    return C.lean(run)


def alike(sets: list[np.ndarray], sides: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that span the pairs of sets with at least that Jaccard similarity; of sides 0 and 1, only pairs across count.

    A search in breadth: a set is compared with all that were not reached yet, by counting through an index of their
    members, which is made anew once half of its sets are reached. Reached sets need no comparison: they are linked.
    """
    m, size = len(sets), np.array([len(x) for x in sets], np.int64)
    of = np.repeat(np.arange(m), size)
    _, member = np.unique(np.concatenate(sets) if m else np.zeros(0, np.uint64), return_inverse=True)
    ends = np.cumsum(size)
    order = np.argsort(member, kind="stable")
    index, by = of[order], member[order]  # sets by member
    fresh, indexed, out = np.ones(m, bool), m, []
    left = m
    for first in range(m):
        if not fresh[first]:
            continue
        fresh[first], left, queue = False, left - 1, [first]
        while queue and left:
            if left < indexed // 2:
                stay = fresh[index]
                index, by, indexed = index[stay], by[stay], left
            x = queue.pop()
            mine = member[ends[x] - size[x] : ends[x]]
            lo, hi = np.searchsorted(by, mine), np.searchsorted(by, mine, "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            y, common = np.unique(index[at], return_counts=True)
            # in doubles: n / m is not under s just if the pair's similarity is not
            y = y[(common / np.maximum(1, size[x] + size[y] - common) >= similarity) & fresh[y] & ((sides[x] == 2) | (sides[y] != sides[x]))]
            fresh[y] = False
            left -= len(y)
            queue.extend(y.tolist())
            out += [(x, z) for z in y.tolist()]
    return out


def _verify(shingle: int, similarity: float):
    """Sorted rows (comp, pair of parts, side, node, text); a group of a component and a pair is whole in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sides, sets = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1 and (found := alike(sets, np.array(sides), similarity)):
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in x], pa.binary()) for x in zip(*found, strict=True)], ["a", "b"])

        for b in batches:
            for comp, pair, side, node, text in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), strict=True):
                if (comp, pair) != now:
                    yield from done()
                    now, nodes, sides, sets = (comp, pair), [], [], []
                nodes.append(node)
                sides.append(side)
                sets.append(np.unique(shingle_hashes(b"" if (t := text.as_buffer()) is None else t.to_pybytes(), shingle)))
        yield from done()

    return C.lean(run)


def near_duplicates(docs: DataFrame, key_col: str, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bits: int = 1024, similarity: float = 0.8, miss: float = 0.01) -> DataFrame:
    """(key): of rows that are linked by an exact Jaccard similarity of their sets of shingles, the first by id and key, and
    the first without an id, which goes only for another without.

    key_col names each row, the same at each reading. Candidates are texts whose fingerprints are within the
    expectation for the similarity and 3.5 standard deviations; short texts have a wider radius. Shingles are equal if
    their 64-bit hashes are.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    wide = lambda p: round(bits * p + 3.5 * math.sqrt(bits * p * (1 - p)))
    rows = docs.select(F.col(f"`{key_col}`").alias("key"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marked = C.written(rows.mapInArrow(_marks(shingle, bits), f"key {rows.schema['key'].dataType.simpleString()}, id long, node binary, n long, fp binary"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "key")
    firsts = C.written(marked.groupBy("node").agg(F.min(place).alias("place"), F.min(F.when(F.col("id").isNull(), place)).alias("unnamed"), F.first("n").alias("n"), F.first("fp").alias("fp")))
    fps = C.written(firsts.groupBy("fp").agg(F.min("n").alias("n")))
    edges = links(fps.select("fp"), bits, wide(p), fps.count(), miss)
    short = C.written(fps.where(F.col("n") <= SHORT).select("fp"))
    if (few := short.count()) > 1:
        edges = edges.unionByName(links(short, bits, wide(max(p, SHORT_SHARE)), few, miss))
    roots = components(edges)
    # the members of each component of candidates, with their texts; large components in pairs of parts
    held = C.written(firsts.join(roots.withColumnRenamed("node", "f"), F.col("fp") == F.col("f"), "left").select("node", "n", F.col("place.key").alias("k"), F.coalesce("root", "fp").alias("comp")))
    several = held.groupBy("comp").agg(F.count("*").alias("sets"), F.sum("n").alias("all")).where("sets > 1")
    several = C.written(several.select(F.col("comp").alias("c"), F.ceil(F.greatest(F.col("sets") / SETS, F.col("all") / SHINGLES, F.lit(1))).cast("int").alias("parts")))
    held = C.written(held.join(several, F.col("comp") == F.col("c")).select("k", "node", "n", "comp", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")))
    # texts that go to many pairs of parts do so in rounds, each of which sends about as much as all texts have
    sent, all_ = held.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] or 0, firsts.agg(F.sum("n")).first()[0] or 0
    rounds = max(1, math.ceil(sent / max(1, all_)))
    asked = rows.select("key", "text").join(held.drop("n"), F.col("key") == F.col("k"))
    asked, n, true = C.written(asked) if rounds > 1 else asked, C.parts(docs), []
    for r in range(rounds):
        to = _dealt("long")
        if rounds > 1:
            to = F.filter(to, lambda t: F.pmod(F.xxhash64("comp", t["pair"]), F.lit(rounds)) == r)  # noqa: B023
        dealt = asked.withColumn("to", F.explode(to)).select("comp", F.col("to.pair").alias("pair"), F.col("to.side").cast("int").alias("side"), "node", "text")
        dealt = dealt.repartition(n, "comp", "pair").sortWithinPartitions("comp", "pair")
        true.append(C.written(dealt.mapInArrow(_verify(shingle, similarity), "a binary, b binary")))
    if rounds > 1:
        C.forget(docs.sparkSession, asked.written_at)
    true = functools.reduce(DataFrame.unionByName, true)
    roots = C.written(components(true).withColumnRenamed("node", "f"))
    named = C.written(firsts.select("node", "place", "unnamed").join(roots, F.col("node") == F.col("f"), "left").select(F.coalesce("root", "node").alias("root"), "place", "unnamed"))
    stay = named.groupBy("root").agg(F.min("place").alias("place"), F.min("unnamed").alias("unnamed"))
    return stay.select(F.explode(F.array_distinct(F.array_compact(F.array("place.key", "unnamed.key")))).alias("key"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's fingerprints and components of all documents: 64 bits of 4-word shingles, links at 4 bits."""
    found = simhash_groups(C.table(spark, sf_dir, "documents"), shingle=4, bits=64, radius=4, repeats=True)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("group").alias("component_id"))
