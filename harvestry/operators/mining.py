"""Frequent itemsets, level by level and by growing patterns, for all transactions or for every block of a stream at once."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestry.functions import stats
from harvestry.operators import counting
from harvestry.sources.scratch import written

#: Keeps an itemset of a level? Columns items, count, n are at hand.
Filter = Callable[[DataFrame], DataFrame]
#: Transactions of a block that one task mines.
IN_MEMORY = 1 << 18


def least_count(n: int, min_support: float) -> int:
    """The smallest count k with k / n >= min_support in doubles."""
    k = max(0, math.ceil(min_support * n) - 2)
    while n and k / n < min_support:
        k += 1
    return k


def always() -> Filter:
    return lambda sets: sets


def min_support(value: float) -> Filter:
    return lambda sets: sets.where(F.col("count") / F.col("n") >= value)


def min_count(value: int) -> Filter:
    return lambda sets: sets.where(F.col("count") >= value)


def min_abs_sup(tx: DataFrame, e: float = 0.999, first_item: bool = False) -> Filter:
    """An itemset must occur more often than its rarest item (first_item: its first) and the rest do by chance.

    The rest of a set of size k is a set of size k - 1, counted on the transactions. Single items always pass.
    """
    singles = written(counting.item_counts(tx))

    def keep(sets: DataFrame) -> DataFrame:
        one = sets.where(F.size("items") == 1)
        more = sets.where(F.size("items") > 1)
        items = more.select("items", "count", "n", F.explode("items").alias("item")).join(singles.withColumnRenamed("count", "c1"), "item")
        order = F.struct("item", "c1") if first_item else F.struct("c1", "item")
        rare = items.groupBy("items", "count", "n").agg(F.min(order).alias("r")).select("items", "count", "n", F.col("r.c1").alias("a"), F.array_remove("items", F.col("r.item")).alias("rest"))
        rest = counting.count_itemsets(tx, rare.select(F.col("rest").alias("items"))).select(F.col("items").alias("rest"), F.col("count").alias("b"))
        rare = rare.join(rest, "rest").where(F.col("count") > stats.min_abs_sup_udf("a", "b", "n", F.lit(e))).select("items", "count", "n")
        return one.select("items", "count", "n").unionByName(rare)

    return keep


def candidates(level: DataFrame, size: int) -> DataFrame:
    """Sets of `size` items of which every subset with one item less is in level (items)."""
    last, head = F.element_at("items", -1), F.slice("items", 1, size - 2) if size > 2 else F.array().cast("array<string>")
    heads = level.select(head.alias("head"), last.alias("last"))
    pairs = heads.alias("x").join(heads.alias("y"), (F.col("x.head") == F.col("y.head")) & (F.col("x.last") < F.col("y.last")))
    cand = pairs.select(F.concat(F.col("x.head"), F.array(F.col("x.last"), F.col("y.last"))).alias("items"))
    return closed(cand, level, size)


def closed(cand: DataFrame, level: DataFrame, size: int) -> DataFrame:
    """Those of cand whose subsets with one item less are all in level."""
    subsets = cand.select("items", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("sub"))
    there = subsets.join(level.select(F.col("items").alias("sub")), "sub", "left_semi")
    return there.groupBy("items").count().where(F.col("count") == size).select("items")


def ready(tx: DataFrame, *more: str) -> DataFrame:
    """tx's distinct items as a table of its own: what makes them is done once, and a file knows its number of rows."""
    return written(tx.select(*more, F.array_distinct("items").alias("items")))


def apriori(tx: DataFrame, keep: Filter, max_size: int | None = None, is_ready: bool = False) -> DataFrame:
    """(items, count) level by level. Transactions stay as (tid, item) rows of the items that can still occur.

    Pairs are counted in each transaction. From three items on, the transactions that hold a set of the level before
    are at hand as (tid, set); a candidate is a set and a later item, so its transactions are an equi-join away.
    """
    tx = tx if is_ready else ready(tx, "tid")
    n = tx.count()
    tag = lambda df: df.withColumn("n", F.lit(n))
    distinct = counting.exploded(tx)
    # levels are small against the transactions: kept in memory, made again if an executor is lost
    one = keep(tag(distinct.groupBy(F.array("item").alias("items")).agg(F.count("*").alias("count")))).select("items", "count").persist()
    levels, level, size = [one], one, 2
    if max_size == 1:
        return one
    rows = written(distinct.join(one.select(F.element_at("items", 1).alias("item")), "item", "left_semi").select("tid", "item"))
    small = rows.groupBy("tid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    level = keep(tag(counting.pair_counts(small).select(F.array("a", "b").alias("items"), "count"))).select("items", "count").persist()
    held = None
    while level.head(1) and (max_size is None or size <= max_size):
        levels.append(level)
        size += 1
        if max_size is not None and size > max_size:
            break
        cand = candidates(level.select("items"), size).persist()
        if not cand.head(1):
            break
        if held is None:
            pairs = rows.alias("x").join(rows.alias("y"), "tid").where(F.col("x.item") < F.col("y.item")).select("tid", F.array(F.col("x.item"), F.col("y.item")).alias("items"))
            held = pairs.join(level.select("items"), "items", "left_semi")
        grown = held.join(cand.select(F.slice("items", 1, size - 1).alias("items"), F.element_at("items", -1).alias("item")), "items").join(rows, ["tid", "item"], "left_semi")
        held = written(grown.select("tid", F.concat("items", F.array("item")).alias("items")))
        level = keep(tag(held.groupBy("items").agg(F.count("*").alias("count")))).select("items", "count").persist()
        held = held.join(level.select("items"), "items", "left_semi")
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def mllib(tx: DataFrame, min_support_: float, n: int | None = None, is_ready: bool = False) -> DataFrame:
    """(items, count) by pyspark.ml's parallel FP-growth. n: what support is a share of, if not the rows of tx."""
    spark = tx.sparkSession
    tx = tx if is_ready else ready(tx)  # the model reads transactions several times
    rows = tx.count()
    k = max(1, least_count(rows if n is None else n, min_support_))
    if k > rows:
        return spark.createDataFrame([], "items array<string>, count long")
    # between k - 1 and k, so that rounding can't move the smallest count
    model = FPGrowth(itemsCol="items", minSupport=(k - 0.5) / rows, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(tx)
    return model.freqItemsets.select(F.sort_array("items").alias("items"), F.col("freq").alias("count"))


def weighted(tx: DataFrame, singles: DataFrame) -> DataFrame:
    """(prefix, w): transactions as the lists of their items in singles (item, rank), in the order of ranks, equal ones
    once with their number. What a tree of transactions shares, and no tree."""
    sets = tx.groupBy(F.sort_array("items").alias("items")).agg(F.count("*").alias("w"))
    kept = sets.select("items", "w", F.explode("items").alias("item")).join(singles.select("item", "rank"), "item").groupBy("items", "w")
    lists = kept.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("prefix"))
    return lists.groupBy("prefix").agg(F.sum("w").alias("w"))


def fpgrowth(tx: DataFrame, min_support_: float, n: int | None = None, max_size: int | None = None, is_ready: bool = False) -> DataFrame:
    """(items, count) by growing patterns over conditional bases, those of all patterns of a size as one relation.

    A row (pattern, prefix, w) says that w transactions have the pattern's items after those of the prefix, in the order
    of frequencies; equal rows are one, as paths in a conditional tree are. Items of prefixes are counted by pattern, and
    those that are frequent extend it, with what stands before them as prefix. So a transaction that occurs a million times
    costs as much as one, and no task holds a tree. n: what support is a share of, if not the rows of tx.
    """
    tx = tx if is_ready else ready(tx)
    rows = tx.count()
    k = max(1, least_count(rows if n is None else n, min_support_))
    singles = counting.item_counts(tx).where(F.col("count") >= k)
    # a row for each frequent item
    singles = written(singles.select("item", "count", F.row_number().over(Window.orderBy(F.col("count").desc(), "item")).alias("rank")))
    out = singles.select(F.array("item").alias("items"), "count")
    before = lambda df, *more: df.select(*more, "w", F.posexplode("prefix").alias("at", "x"), "prefix")
    shorter = F.slice("prefix", F.lit(1), F.col("at"))
    state = before(weighted(tx, singles)).where("at > 0").select(F.array("x").alias("pattern"), shorter.alias("prefix"), "w")
    size = 2
    while max_size is None or size <= max_size:
        state = written(state.groupBy("pattern", "prefix").agg(F.sum("w").alias("w")))
        longer = state.select("pattern", F.explode("prefix").alias("x"), "w").groupBy("pattern", "x").agg(F.sum("w").alias("count")).where(F.col("count") >= k)
        # small against the transactions: kept in memory, made again if an executor is lost
        longer = longer.persist()
        if not longer.head(1):
            return out
        out = out.unionByName(longer.select(F.sort_array(F.concat(F.array("x"), "pattern")).alias("items"), "count"))
        state = before(state, "pattern").where("at > 0").join(longer.select("pattern", "x"), ["pattern", "x"], "left_semi")
        state = state.select(F.concat(F.array("x"), "pattern").alias("pattern"), shorter.alias("prefix"), "w")
        size += 1
    return out


def frequent_itemsets(tx: DataFrame, min_support_: float, engine: str = "fpgrowth", max_size: int | None = None, n: int | None = None) -> DataFrame:
    """(items, size, count, support) with support >= min_support_. n: what support is a share of, if not the rows of tx.

    engine: fpgrowth, apriori, or mllib for pyspark.ml's model.
    """
    if engine not in ("fpgrowth", "apriori", "mllib"):
        raise ValueError("engine is fpgrowth, apriori or mllib")
    tx = ready(tx, *(["tid"] if engine == "apriori" else []))
    n = tx.count() if n is None else n
    if engine == "fpgrowth":
        sets = fpgrowth(tx, min_support_, n, max_size, is_ready=True)
    elif engine == "mllib":
        sets = mllib(tx, min_support_, n, is_ready=True)
        sets = sets if max_size is None else sets.where(F.size("items") <= max_size)
    else:
        sets = apriori(tx, min_count(max(1, least_count(n, min_support_))), max_size, is_ready=True)
    return sets.select("items", F.size("items").alias("size"), "count", (F.col("count") / F.lit(float(max(n, 1)))).alias("support"))


def whole_blocks(tx: DataFrame, block: int) -> DataFrame:
    """tx with column block, without the transactions of a last block that is not full."""
    b = tx.withColumn("block", F.floor(F.col("tid") / block))
    full = b.groupBy("block").count().where(F.col("count") == block).select("block")
    return b.join(full, "block", "left_semi")


def block_itemsets(tx: DataFrame, block: int, min_support_: float, max_size: int | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(block, items, count) of every whole block of `block` transactions, all blocks in one job.

    A block is one task's, which mines it depth first over bit sets. Blocks of more than IN_MEMORY transactions are mined
    level by level in one distributed run instead: an item of a block is made an item of its own, so that transactions
    of different blocks have no item in common. prepare: what becomes of the transactions (block, tid, items) of whole
    blocks before they are mined; support stays a share of the whole block.
    """
    b = whole_blocks(tx, block)
    b = b if prepare is None else prepare(b)
    least = max(1, least_count(block, min_support_))
    if block <= IN_MEMORY:
        from harvestry.streaming.blocks import mine_block

        def of_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            found = mine_block(rows["items"].tolist(), least, max_size)
            return pd.DataFrame({"block": [key[0]] * len(found), "items": [i for i, _ in found], "count": [n for _, n in found]})

        return b.select("block", "items").groupBy("block").applyInPandas(of_block, "block long, items array<string>, count long")
    marked = b.select("tid", F.transform("items", lambda x: F.concat(F.col("block").cast("string"), F.lit("|"), x)).alias("items"))
    sets = apriori(marked, min_count(least), max_size)
    return sets.select(F.substring_index(F.element_at("items", 1), "|", 1).cast("long").alias("block"), F.sort_array(F.transform("items", lambda x: F.regexp_replace(x, r"^\d+\|", ""))).alias("items"), "count")


def association_rules(itemsets: DataFrame, n: int, min_confidence: float = 0.9, min_lift: float = 1.0, max_len: int = 20, by: list[str] | None = None) -> DataFrame:
    """Every split of every itemset (items, count) with confidence and lift above the thresholds, both strictly.

    An itemset of k items has 2**k - 2 splits: sets beyond max_len raise. Supports are equi-joins against the itemsets
    themselves, which hold all subsets. by: columns that tell blocks apart.
    """
    by = by or []
    sized = itemsets.select(*by, F.sort_array("items").alias("items"), "count")
    k = F.size("items")
    many = F.when(k > max_len, F.raise_error(F.lit(f"an itemset of more than {max_len} items has too many splits")).cast("bigint")).otherwise(F.expr("shiftleft(1L, size(items))") - 2)
    split = sized.where(k > 1).select(*by, "items", "count", F.explode(F.sequence(F.lit(1).cast("long"), many)).alias("m"))
    side = lambda want: F.expr(f"filter(items, (x, i) -> (shiftright(m, i) & 1) = {want})")
    split = split.select(*by, side(1).alias("antecedent"), side(0).alias("consequent"), "count")
    known = lambda name, c: sized.select(*by, F.col("items").alias(name), F.col("count").alias(c))
    r = split.join(known("antecedent", "ca"), [*by, "antecedent"]).join(known("consequent", "cb"), [*by, "consequent"])
    total = F.lit(float(max(n, 1)))
    conf = (F.col("count") / total) / (F.col("ca") / total)
    r = r.withColumn("confidence", conf).withColumn("lift", F.col("confidence") / (F.col("cb") / total))
    return r.where((F.col("confidence") > min_confidence) & (F.col("lift") > min_lift)).select(*by, "antecedent", "consequent", "confidence", "lift", "count")

