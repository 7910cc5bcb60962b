"""Document fingerprints by winnowing, in DataFrame operations only.

A text is a run of tokens: its words, and the code points of words over 16 of them one by one, so that text without
white space has a fingerprint too, the same at whatever place it stands. Every token has a hash below the prime P, and
every k consecutive tokens have the Rabin-Karp hash of theirs: the sum of hash times power of BASE, modulo P. Hashes of
runs of 1, 2, 4, ... tokens roll up, each from the two halves before it, and those of k from the powers of two in k, so a
gram costs as many steps as k has bits, not k. Every w consecutive hashes select their minimum, the rightmost if it occurs
more than once, and the selected hashes with their positions (numbers of tokens before them) are the fingerprint. Texts
that share w + k - 1 consecutive tokens share a selected hash; those that share fewer than k share none, up to collisions
of 36-bit hashes. Minima of runs of 1, 2, 4, ... hashes are built like the hashes, so w is a power of two; a hash carries
its position in its low bits such that the smaller number is the rightmost.

Defined cases: a null text is empty; an empty text, or one of white space, has an empty fingerprint; a text of fewer
than k tokens has one hash of all of them; two empty fingerprints are alike (1.0), an empty and another are not (0.0).
A text is one row's array, so one worker holds it; positions are exact up to 2**27 tokens. In next_text() null ids come
after the smallest, rows of equal id are in the order of a hash of their texts, by which a hot id is spread over tasks
(only rows equal in id and text stay together), and the only row of a table is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestry.llm import common as C

K, W = 5, 16
#: Longer words count as their code points.
WORD = 16
#: A token, in the pattern language of Java: a whole word of up to WORD code points, or one of a longer word.
TOKEN = rf"(?<![^ \x09-\x0D])[^ \x09-\x0D]{{1,{WORD}}}(?![^ \x09-\x0D])|[^ \x09-\x0D]"
#: 2**36 - 5; BASE squared times a hash fits a long.
P, BASE = 68_719_476_731, 7_919
#: Ranges of ids at most, for their bounds are part of the plan; larger ranges spill.
BUCKETS = 16_384
_AT = (1 << 27) - 1
_TIES = 1 << 40


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _times(x: Column, m: int) -> Column:
    """x * m below P or a small multiple of it, for x below P, without leaving the range of longs."""
    if m < 1 << 27:
        return x * F.lit(m).cast("long")
    return (x * F.lit(m >> 18).cast("long")) % P * F.lit(1 << 18).cast("long") + x * F.lit(m & ((1 << 18) - 1)).cast("long")


def _rolled(hashes: Column, k: int) -> Column:
    """Hashes of all runs of k tokens, from those of single ones; at the end are some of shorter runs, to be cut off."""

    def after(left: Column, right: Column, skip: int, power: int) -> Column:
        """left's runs with those of right that begin skip tokens later, of so many tokens."""
        m = pow(BASE, power, P)
        return F.zip_with(left, F.slice(right, F.lit(skip + 1), F.greatest(F.size(right), F.lit(1))), lambda x, y: (_times(x, m) + y) % P)

    def build(rest: Column, done: Column | None, covered: int, width: int) -> Column:
        """rest: of runs of width tokens; done: of the runs of covered tokens that follow."""
        if k & width:
            done, covered = (rest if done is None else after(rest, done, width, covered)), covered + width
        if covered == k:
            return done
        twice = after(rest, rest, width, width)
        if done is None:
            return let(twice, lambda r: build(r, None, 0, 2 * width))
        return let(F.struct(twice.alias("r"), done.alias("d")), lambda x: build(x["r"], x["d"], covered, 2 * width))

    return build(hashes, None, 0, 1)


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """The fingerprint of a text as an array of longs: 36 bits of hash, then _AT - position, in the order of positions."""
    if w & (w - 1):
        raise ValueError("w must be a power of two")
    steps = F.array(*(F.lit(1 << s) for s in range(w.bit_length() - 1)))

    def of(hashes: Column) -> Column:
        few = F.array(F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: (_times(a, BASE) + x) % P))
        rolled = F.when(F.size(hashes) < k, few).otherwise(F.slice(_rolled(hashes, k), F.lit(1), F.greatest(F.size(hashes) - (k - 1), F.lit(1))))
        grams = F.transform(rolled, lambda h, i: F.shiftleft(h, 27) + (F.lit(_AT) - i.bitwiseAND(F.lit(_AT))).cast("long"))
        if w == 1:
            return F.array_distinct(grams)
        # where the second half is short, zip_with gives nulls, which least() passes over
        half = lambda a, s: F.zip_with(a, F.slice(a, s + 1, F.size(a)), lambda x, y: F.least(x, y))
        whole = lambda a: F.array_distinct(F.slice(a, F.lit(1), F.greatest(F.size(a) - (w - 1), F.lit(1))))
        return F.aggregate(steps, grams, half, whole)

    tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.shiftrightunsigned(F.xxhash64(t), 28) % P)
    return let(tokens, lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(of(h)))


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda v: F.shiftrightunsigned(v, 27)))


def as_text(fingerprint: Column) -> Column:
    """hash:position of each, the hash in hexadecimal."""
    return F.array_join(F.transform(fingerprint, lambda v: F.concat(F.hex(F.shiftrightunsigned(v, 27)), F.lit(":"), (F.lit(_AT) - v.bitwiseAND(F.lit(_AT))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two fingerprints."""
    return let(F.size(F.array_union(hashes(a), hashes(b))), lambda n: F.when(n == 0, 1.0).otherwise((F.size(hashes(a)) + F.size(hashes(b)) - n) / n))


def _buckets(docs: DataFrame, key: str, tie: str, n: int) -> Column:
    """Number of the range that a row is in, of about n even ones in ascending order of keys, nulls before all, and
    descending order of ties: a key that fills several ranges is spread over them by its rows' ties."""
    coarse = max(1, math.isqrt(n))
    fine = math.ceil(n / coarse)
    marks = [i / (coarse * fine) for i in range(1, coarse * fine)]
    found = docs.agg(F.count("*").alias("rows"), F.count(key).alias("known"), *([F.percentile_approx(key, marks, 10 * n).alias("cuts")] if marks else [])).first()
    cuts = (marks and found["cuts"]) or [0] * len(marks)
    unknown = found["rows"] - found["known"]
    tops = [cuts[i * fine - 1] for i in range(1, coarse)]
    rows = [cuts[i * fine : (i + 1) * fine - 1] for i in range(coarse)]
    longs = lambda xs: F.array(*(F.lit(int(x)).cast("long") for x in xs)).cast("array<bigint>")

    def count(under: Callable[[Column], Column]) -> Column:
        """How many cuts are under a key."""
        below = lambda xs: F.coalesce(F.size(F.filter(xs, under)), F.lit(0))
        first = below(longs(tops)) if tops else F.lit(0)
        return let(first, lambda i: i * fine + below(F.element_at(F.array(*map(longs, rows)), i + 1)))

    part = lambda of: F.floor(F.col(tie) * of / _TIES).cast("int")
    top = count(lambda c: c <= F.col(key))
    if len(set(cuts)) < len(cuts):
        top = let(F.struct(top.alias("t"), count(lambda c: c < F.col(key)).alias("b")), lambda x: x["t"] - part(F.greatest(x["t"] - x["b"], F.lit(1))))
    return F.when(F.col(key).isNull(), -1 - part(F.lit(max(1, math.ceil(unknown * n / max(1, found["rows"])))))).otherwise(top).cast("int")


def next_text(docs: DataFrame, add: Callable[[DataFrame], DataFrame], lead: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as add() returns them, with columns of the next row in descending order of ids (after the last: the first).

    lead: new names by column. Texts are shuffled once, by ranges of ids; the first row of each range is also a guest
    at the end of the range before it. add() runs after the shuffle, so that what it makes is not shuffled.
    """
    n = C.parts(docs)
    many = min(4 * n, BUCKETS)
    docs = docs.withColumn("__key", F.col(f"`{id_col}`").cast("long")).withColumn("__tie", F.pmod(F.xxhash64(F.col(f"`{text_col}`")), F.lit(_TIES)))
    docs = docs.withColumn("__bucket", _buckets(docs, "__key", "__tie", many))
    # one row for each range, many at most
    heads = docs.groupBy("__bucket").agg(F.max(F.struct("__key", (-F.col("__tie")).alias("late"))).alias("head")).collect()
    heads = sorted(((r[0], r[1]["__key"], -r[1]["late"]) for r in heads), key=lambda r: -r[0])
    pairs = [(*heads[i], heads[i - 1][0]) for i in range(len(heads))]  # heads[-1]: the last is before the first
    guests = docs.sparkSession.createDataFrame(pairs, "__of int, __head long, __head_tie long, __to int")
    first = (F.col("__bucket") == F.col("__of")) & F.col("__key").eqNullSafe(F.col("__head")) & (F.col("__tie") == F.col("__head_tie"))
    docs = docs.join(F.broadcast(guests), first, "left")
    own, guest = F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("g")), F.struct(F.col("__to").alias("b"), F.lit(1).alias("g"))
    docs = docs.withColumn("__places", F.when(F.col("__to").isNull(), F.array(own)).otherwise(F.array(own, guest))).withColumn("__place", F.explode("__places"))
    docs = docs.withColumn("__in", F.col("__place.b")).withColumn("__guest", F.col("__place.g")).drop("__of", "__head", "__head_tie", "__to", "__places", "__place", "__bucket")
    docs = add(docs.repartition(n, "__in"))
    order = Window.partitionBy("__in").orderBy("__guest", F.col("__key").desc_nulls_last(), "__tie", f"`{text_col}`")
    docs = docs.select("*", *(F.lead(c).over(order).alias(name) for c, name in lead.items()))
    return docs.where("__guest = 0").drop("__in", "__guest", "__key", "__tie")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's fingerprints of all documents and of their edited texts."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = next_text(docs, lambda d: d.withColumn("fp", winnow(F.col("text"))), {"text": "after", "fp": "after_fp"})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    docs = docs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("after"), F.lit(1), half)))
    docs = docs.withColumn("edited_fp", winnow(F.col("edited")))
    return docs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("after_fp")).alias("near_next"),
    )
