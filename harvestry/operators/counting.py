"""Counts of items, pairs and given itemsets over transactions (tid, items)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exploded(tx: DataFrame) -> DataFrame:
    return tx.select("tid", F.explode("items").alias("item"))


def num_transactions(tx: DataFrame) -> int:
    return tx.count()


def item_counts(tx: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return tx.select(*by, F.explode("items").alias("item")).groupBy(*by, "item").agg(F.count("*").alias("count"))


def item_support(tx: DataFrame) -> DataFrame:
    n = num_transactions(tx)
    return item_counts(tx).withColumn("support", F.col("count") / F.lit(float(max(n, 1))))


def pair_counts(tx: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, count) of the unordered pairs, a < b, made within each transaction: the only shuffle is of partial sums.

    The left items are exploded first, so a row never holds more than one item's pairs.
    """
    left = tx.select(*by, F.sort_array(F.array_distinct("items")).alias("i")).select(*by, "i", F.posexplode("i").alias("k", "a"))
    pairs = left.select(*by, "a", F.explode(F.slice("i", F.col("k") + 2, F.size("i"))).alias("b"))
    return pairs.groupBy(*by, "a", "b").agg(F.count("*").alias("count"))


def cooccurrence(tx: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The symmetric graph: pairs in both directions, made after they are counted."""
    both = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    return pair_counts(tx, by).select(*by, both.alias("p"), "count").select(*by, F.col("p.x").alias("a"), F.col("p.y").alias("b"), "count")


def neighbours(tx: DataFrame) -> DataFrame:
    """(item, degree, weight): how many items it occurs with, and how often."""
    return cooccurrence(tx).groupBy(F.col("a").alias("item")).agg(F.count("*").alias("degree"), F.sum("count").alias("weight"))


def retract(counts: DataFrame, removed: DataFrame, key: str = "item", value: str = "count") -> DataFrame:
    """Counter algebra: counts less removed. Keys stay, also at 0."""
    both = counts.select(key, value).unionByName(removed.select(key, (-F.col(value)).alias(value)))
    return both.groupBy(key).agg(F.sum(value).alias(value))


def add(a: DataFrame, b: DataFrame, key: str = "item", value: str = "count") -> DataFrame:
    return a.select(key, value).unionByName(b.select(key, value)).groupBy(key).agg(F.sum(value).alias(value))


def count_itemsets(tx: DataFrame, itemsets: DataFrame) -> DataFrame:
    """itemsets (items) with count; 0 where an item is unknown, all transactions for the empty itemset.

    Equi-joins only: candidates' items meet transactions' items, and a transaction counts for a candidate if all the
    candidate's items are there.
    """
    cand = itemsets.select(F.sort_array(F.array_distinct("items")).alias("items")).distinct().withColumn("size", F.size("items"))
    n = tx.count()
    parts = cand.select("items", "size", F.explode("items").alias("item"))
    hits = exploded(tx).distinct().join(parts, "item").groupBy("items", "size", "tid").count().where("count = size")
    found = hits.groupBy("items").agg(F.count("*").alias("count"))
    return cand.join(found, "items", "left").select("items", F.when(F.col("size") == 0, F.lit(n)).otherwise(F.coalesce("count", F.lit(0))).alias("count"))


def tid_lists(tx: DataFrame) -> DataFrame:
    """(item, bucket, bits): bitmaps of the transactions with an item, a row for each 32,768 tids."""
    e = exploded(tx).distinct()
    return e.groupBy("item", F.bitmap_bucket_number("tid").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("tid")).alias("bits"))


def count_by_bitmaps(lists: DataFrame) -> DataFrame:
    return lists.groupBy("item").agg(F.sum(F.bitmap_count("bits")).alias("count"))


def sliding_counts(tx: DataFrame, window: int, at: int) -> DataFrame:
    """(tid, item, count) over the last `window` transactions, at every `at`-th transaction (tid + 1 a multiple of it).

    Windows end at multiples of `at` and begin at one offset between two, so each stretch of `at` transactions has two
    parts, before the offset and from it on. Sums of parts are added up by the windows that hold them: no window function
    over all transactions in one task, and copies of two sums for a stretch, not of its transactions.
    """
    offset = -window % at
    part, late = F.floor(F.col("tid") / at), F.pmod("tid", F.lit(at)) >= offset
    parts = exploded(tx).groupBy("item", part.alias("part"), late.alias("late")).agg(F.count("*").alias("n"))
    first, last = F.col("part") + 1, F.col("part") + F.when(F.col("late"), (offset + window) // at).otherwise(window // at)
    ends = parts.where(first <= last).select("item", "n", F.explode(F.sequence(first, last)).alias("e"))
    top = tx.agg(F.max("tid")).first()[0]
    ends = ends.where(F.col("e") * at - 1 <= F.lit(-1 if top is None else top))
    return ends.groupBy((F.col("e") * at - 1).alias("tid"), "item").agg(F.sum("n").alias("count"))


def length_histogram(tx: DataFrame) -> DataFrame:
    return tx.groupBy(F.size("items").alias("length")).agg(F.count("*").alias("count"))


def first_seen(tx: DataFrame) -> DataFrame:
    """(item, count, tid, pos): where an item occurs first."""
    e = tx.select("tid", F.posexplode("items").alias("pos", "item"))
    return e.groupBy("item").agg(F.count("*").alias("count"), F.min(F.struct("tid", "pos")).alias("at")).select("item", "count", "at.tid", "at.pos")


def average_ranks(counts: DataFrame) -> DataFrame:
    """Rank by count, descending; ties have the mean of their ranks. A row for each item: the window is over items, not data."""
    w = Window.orderBy(F.col("count").desc())
    ties = Window.partitionBy("count")
    return counts.select("item", "count", (F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0).alias("rank"))


def spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two tables (item, rank), from the squares of differences; one row."""
    d = a.select("item", F.col("rank").alias("ra")).join(b.select("item", F.col("rank").alias("rb")), "item")
    return d.agg((1 - 6 * F.sum((F.col("ra") - F.col("rb")) * (F.col("ra") - F.col("rb"))) / (F.count("*") * (F.count("*") * F.count("*") - 1))).alias("rho"))


def rank_entropy(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Normalised sum of rank changes of two tables (item, rank); null for one item. One row."""
    d = now.select("item", F.col("rank").alias("ra")).join(stored.select("item", F.col("rank").alias("rb")), "item")
    n = F.count("*")
    return d.agg((F.sum(F.abs(F.col("ra") - F.col("rb"))) / F.nullif(n * (n - 1) + F.floor(n * n / 4), F.lit(0))).alias("entropy"))


def discriminativeness(tx: DataFrame, by: tuple[str, ...] = (), n: int | None = None) -> DataFrame:
    """(item, disc): half the sum, over the items that it occurs with, of the information that either gives of the other.

    by: columns of groups of n transactions each.
    """
    n = float(max(1, tx.count() if n is None else n))
    sup = item_counts(tx, by).select(*by, "item", (F.col("count") / n).alias("s"))
    g = cooccurrence(tx, by).select(*by, "a", "b", (F.col("count") / n).alias("xy"))
    g = g.join(sup.select(*by, F.col("item").alias("a"), F.col("s").alias("x")), [*by, "a"]).join(sup.select(*by, F.col("item").alias("b"), F.col("s").alias("y")), [*by, "b"])
    xy, x, y, eps = F.col("xy"), F.col("x"), F.col("y"), 1e-6
    each = -xy * F.log(xy / x) - (x - xy) * F.log((x - xy + eps) / x) - xy * F.log(xy / y) - (y - xy) * F.log((y - xy + eps) / y)
    found = g.groupBy(*by, F.col("a").alias("item")).agg((F.sum(each) / 2).alias("disc"))
    return sup.select(*by, "item").join(found, [*by, "item"], "left").select(*by, "item", F.coalesce("disc", F.lit(0.0)).alias("disc"))
