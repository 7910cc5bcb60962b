"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Sources get weights in the order of their names, targets by weight of a budget, and no target above `most` times the
source's size: the excess is shared again by weight until none is above. Within a source a document asks for copies in
proportion to a weight of its own (sample_weight(): the square root of its words, so that long documents, which have
more to be learned from, are taken more often than in proportion to their number), none for more than `most`: what is cut
off there is shared again too, so that copies times words add up to the target. The whole copies of what a document
asks for are allocated for certain; what is left, p, is its inclusion probability. Documents rank by their odds
u/(1-u) over p/(1-p), u a random number that only the document decides, and the first in rank are taken once more
until the sample has the size, in words, that is left of the target: the fixed size is met to within half of the
document at the border.

The border is found without sorting a source in one task: ranks are in (0, 1), so words are summed by source and
1/65,536 of the ranks, and only the part at the border, of that share of the source, is summed by rank. Rows of the rank at the border are equal in id, text and source; a number of each row tells them apart,
searched in the same way, so a group of equal rows may be of any size and any part of it can be taken.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source, last in order; a source
without words has target 0; sources that tie stop in the order of their names; a null weight is 1, a negative or NaN one 0,
a document of weight 0 is taken only where all of its source are; an empty table gives no rows. The md5 of id and text
is the randomness: reruns, and other engines, agree, but for which of equal rows are taken. Texts of any length are
counted by one expression. Columns of docs besides the three named ones are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestry.llm import common as C

STEPS = 1 << 16
#: Parts of the rows that tie at a border; what is sorted in one task is one part.
TIES = 4096


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sizes (source, source_size) with target. One row for each source: the only place where all sources meet."""
    name = (F.col("source").isNull(), F.col("source").cast("binary"))
    place = F.pmod(F.row_number().over(Window.orderBy(*name)) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (place + 1).cast("int"))
    full = sizes.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # fill up evenly by weight: sources whose cap over weight is lowest stop first
    order = Window.orderBy(F.col("cap") / F.col("w"), *name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    full = full.withColumn("n", F.row_number().over(order)).withColumn("level", level)
    # the first in this order that doesn't stop sets the level of all after it, also of those that tie with it
    goes_on = F.col("level") * F.col("w") < F.col("cap")
    full = full.withColumn("at", F.min(F.when(goes_on, F.struct("n", "level"))).over(everything))
    target = F.when(F.col("at").isNull() | (F.col("n") < F.col("at.n")), F.col("cap")).otherwise(F.col("at.level") * F.col("w"))
    return full.select("source", "source_size", target.alias("target"))


def uniform(*key: Column) -> Column:
    """A number in (0, 1) from 52 bits of the md5 of the keys, joined by spaces."""
    digest = F.md5(F.concat_ws(" ", *(F.coalesce(k.cast("string"), F.lit("")) for k in key)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def sample_weight(size: Column) -> Column:
    return F.sqrt(size)


def measured(id_col: str, text_col: str, source_col: str, weight: Column | None, row: Column) -> list[Column]:
    """source, size, u, weight and tie of a row of documents; row: a number of its own, the same at each reading."""
    text, size = F.col(f"`{text_col}`"), C.size_of_words(F.col(f"`{text_col}`"))
    w = F.coalesce(weight if weight is not None else sample_weight(size), F.lit(1.0)).cast("double")
    return [
        F.col(f"`{source_col}`").alias("source"),
        size.alias("size"),
        uniform(F.col(f"`{id_col}`"), text).alias("u"),
        F.round(F.when(w > 0, F.when(~F.isnan(w), w)).otherwise(0.0), 4).alias("weight"),
        F.pmod(F.xxhash64(row), F.lit(1 << 40)).alias("tie"),
    ]


def _asked(rows: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """rows (source, size, u, weight) with goals' columns, sure, the whole copies, and rank, of what is asked for besides."""
    # one row for each source: few against the documents; the plan joins them by its size
    of = goals.withColumnRenamed("source", "__of")
    rows = rows.join(of, F.col("source").eqNullSafe(F.col("__of"))).drop("__of")
    asked = F.when(F.col("weight") > F.coalesce("full_above", F.lit(-1.0)), F.lit(float(most)))
    asked = asked.otherwise(F.least(F.round(F.col("level") * F.col("weight"), 9), F.lit(float(most))))
    rows = rows.withColumn("__asked", F.when(F.col("size") > 0, F.coalesce(asked, F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumn("sure", F.floor("__asked")).withColumn("__p", F.col("__asked") - F.col("sure"))
    # Pareto order sampling: q is small for those to take; q / (1 + q) has the same order
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("__p") / (1 - F.col("__p")))
    return rows.withColumn("rank", F.when(F.col("__p") > 0, q / (1 + q))).drop("__asked", "__p")


def _border(sums: DataFrame, goal: DataFrame, step: str) -> DataFrame:
    """(at_source, border, rest): the step of sums (source, step, words) at which each source's goal (at_source, goal) is
    reached, and what it is to add."""
    run = Window.partitionBy("source").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    at = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    at = at.join(goal, F.col("at_source").eqNullSafe(F.col("source")))
    at = at.where((F.col("before") <= F.col("goal")) & (F.col("before") + F.col("words") > F.col("goal")))
    return C.written(at.select("at_source", F.col(step).alias("border"), (F.col("goal") - F.col("before")).alias("rest")))


def _within(rows: DataFrame, border: DataFrame, step: str) -> DataFrame:
    """Those of rows whose step is their source's border."""
    at = border.select("at_source", F.col("border").alias("__border"))
    return rows.join(at, F.col("source").eqNullSafe(F.col("at_source")) & (F.col(step) == F.col("__border"))).drop("at_source", "__border")


def _goal(border: DataFrame) -> DataFrame:
    return border.select("at_source", F.col("rest").alias("goal"))


def _summed(rows: DataFrame, step: str) -> DataFrame:
    return rows.groupBy("source", step).agg(F.sum("size").alias("words"))


def borders(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """The mix of rows (source, size, u, weight, tie), a row for each source: what documents need to know their copies."""
    by_weight = C.written(rows.groupBy("source", "weight").agg(F.sum("size").alias("words")))
    goals = targets(by_weight.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    # weights count to four decimals, so a source has few against its documents; the largest reach `most` first
    order = Window.partitionBy("source").orderBy(F.col("weight").desc())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("target") - float(most) * F.coalesce(F.sum("words").over(before), F.lit(0))
    level = left / F.nullif(F.sum(F.col("weight") * F.col("words")).over(after), F.lit(0.0))
    levels = by_weight.join(goals.select(F.col("source").alias("of"), "target"), F.col("source").eqNullSafe(F.col("of")))
    levels = levels.where("words > 0").withColumn("level", level)
    goes_on = F.coalesce(F.col("level") * F.col("weight") < float(most), F.lit(True))
    first = levels.groupBy("source").agg(F.min(F.when(goes_on, F.struct((-F.col("weight")).alias("w"), "level"))).alias("at"))
    first = first.select(F.col("source").alias("of"), (-F.col("at.w")).alias("full_above"), F.col("at.level").alias("level"))
    goals = C.written(goals.join(first, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"))

    ranked = _asked(rows, goals, most)
    ranked = ranked.withColumn("step", F.floor(F.col("rank") * STEPS).cast("int"))
    parts = C.written(ranked.groupBy("source", "step").agg(F.sum("size").alias("words"), F.sum(F.col("sure") * F.col("size")).alias("sure_words")))
    sure = parts.groupBy(F.col("source").alias("of")).agg(F.sum("sure_words").alias("sure_words"))
    goal = goals.join(sure, F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("at_source"), (F.col("target") - F.col("sure_words")).alias("goal"))
    first = _border(parts.where("step IS NOT NULL"), goal, "step")
    inner = C.written(_within(ranked, first, "step").select("source", "size", "rank", "tie"))
    second = _border(_summed(inner, "rank"), _goal(first), "rank")
    # the rows of the rank at the border, by their numbers
    equal = _within(inner, second, "rank").withColumn("part", F.pmod("tie", F.lit(TIES)))
    third = _border(_summed(equal, "part"), _goal(second), "part")
    last = _within(equal, third, "part").join(_goal(third), F.col("source").eqNullSafe(F.col("at_source")))
    run = Window.partitionBy("source").orderBy("tie").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
    # the document at the border is taken if that comes nearer than leaving it
    last = last.where(F.col("before") + F.col("size") / 2.0 <= F.col("goal")).groupBy("source").agg(F.max("tie").alias("last_tie"))
    out = goals.join(goal.select(F.col("at_source").alias("s0"), "goal"), F.col("source").eqNullSafe(F.col("s0")), "left")
    out = out.join(second.select(F.col("at_source").alias("s1"), F.col("border").alias("last_rank")), F.col("source").eqNullSafe(F.col("s1")), "left")
    out = out.join(third.select(F.col("at_source").alias("s2"), F.col("border").alias("last_part")), F.col("source").eqNullSafe(F.col("s2")), "left")
    out = out.join(last.select(F.col("source").alias("s3"), "last_tie"), F.col("source").eqNullSafe(F.col("s3")), "left")
    return C.written(out.drop("s0", "s1", "s2", "s3"))  # written, its size is known: documents need not be shuffled to it


def copies(rows: DataFrame, mix: DataFrame, most: float) -> DataFrame:
    """rows (source, size, u, weight, tie and any others) with source_size, target and copies, by the mix of borders().

    Rows stay where they are: only the mix, a row for each source, is sent about.
    """
    ranked = _asked(rows, mix, most)
    part = F.pmod("tie", F.lit(TIES))
    more = (
        F.when(F.col("rank").isNull() | (F.col("goal") <= 0), 0)
        .when(F.col("last_rank").isNull() | (F.col("rank") < F.col("last_rank")), 1)  # without a border all are taken
        .when(F.col("rank") > F.col("last_rank"), 0)
        .when((part < F.col("last_part")) | ((part == F.col("last_part")) & (F.col("tie") <= F.col("last_tie"))), 1)
        .otherwise(0)
    )
    asked = ["level", "full_above", "goal", "last_rank", "last_part", "last_tie", "sure", "rank"]
    return ranked.withColumn("copies", (F.col("sure") + more).cast("long")).drop(*asked)


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
) -> DataFrame:
    """docs' rows as id, source, size, source_size, target, copies: how often the mix takes the document.

    weight, of four decimals, scales the copies of each document against the others of its source; sample_weight() of
    its words if not given. Only ids, sources and sizes are shuffled or stored.
    """
    row = F.monotonically_increasing_id()  # written, a row keeps its number
    slim = C.written(docs.select(F.col(f"`{id_col}`").alias("id"), *measured(id_col, text_col, source_col, weight, row)))
    return copies(slim, borders(slim, weights, share, most), most).select("id", "source", "size", "source_size", "target", "copies")


def repeated(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """docs, each row as often as the mix takes it. Texts are read twice and not shuffled, but for docs that are not a file's."""
    docs, row = C.numbered(docs)
    names = [c for c in docs.columns]
    wide = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.lit(0).alias("_")).alias("row"), *measured(id_col, text_col, source_col, weight, row))
    slim = C.written(wide.drop("row"))
    taken = copies(wide, borders(slim, weights, share, most), most).where("copies > 0")
    taken = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return taken.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's mix of all documents: weights 3, 1, 2, a share of 150 %, twice a size at most; see mix_sources()."""
    mixed = mix_sources(C.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, text, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
l AS (SELECT *, row_number() OVER (ORDER BY cap / w, source IS NULL, encode(source)) AS n, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
f AS (SELECT min(n) AS n, arg_min(level, n) AS level FROM l WHERE level * w < cap),
t AS (SELECT source, source_size, CASE WHEN f.n IS NULL OR l.n < f.n THEN cap ELSE f.level * w END::DOUBLE AS target FROM l, f),
p AS (SELECT d.doc_id, d.source, size, source_size, target, round(sqrt(size), 4) AS w, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u, row_number() OVER () AS id FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
a AS (SELECT *, row_number() OVER x AS n, (target - 2.0::DOUBLE * coalesce(sum(size) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(w * size) OVER (x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level FROM p WINDOW x AS (PARTITION BY source ORDER BY w DESC, id)),
b AS (SELECT source, min(n) AS n, arg_min(level, n) AS level FROM a WHERE coalesce(level * w < 2, true) GROUP BY source),
c AS (SELECT a.*, CASE WHEN size = 0 THEN 0 WHEN b.n IS NULL OR a.n < b.n THEN 2 ELSE coalesce(least(round(b.level * w, 9), 2), 0) END::DOUBLE AS asked FROM a LEFT JOIN b ON a.source IS NOT DISTINCT FROM b.source),
q AS (SELECT *, (u / (1 - u)) / nullif((asked - floor(asked)) / (1 - (asked - floor(asked))), 0) AS odds, sum(floor(asked) * size) OVER (PARTITION BY source) AS sure_words FROM c),
r AS (SELECT *, sum(CASE WHEN asked > floor(asked) THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds / (1 + odds) NULLS LAST, id ROWS UNBOUNDED PRECEDING) - size AS before FROM q)
SELECT doc_id, size, source_size, target, (size * (floor(asked) + CASE WHEN asked > floor(asked) AND target > sure_words AND before + size / 2.0 <= target - sure_words THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
