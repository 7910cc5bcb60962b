"""The run modes and their options: what to mine, in which order of items, over what."""

from __future__ import annotations

from dataclasses import MISSING, dataclass, field, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestry.operators import counting, mining, trie
from harvestry.plans import forecast
from harvestry.sources.scratch import written

BATCH = ("apriori", "minabssup", "fptree", "cantree", "cptree", "spotree")
BLOCKS = ("stream", "cptreeStream", "spotreeStream", "ExtrapStream", "disctree")
DRIFT = ("SSDD", "DBDD", "DDTreeStream")
TREES = ("fptree", "cantree", "cptree", "spotree", *BLOCKS, *DRIFT)
#: What each mode reads besides thresholds of support and rules, the block's size and max_size.
READS = {
    "minabssup": {"first_item"},
    "cptree": {"sort_interval"},
    "cptreeStream": {"sort_interval"},
    "spotree": {"entropy_threshold"},
    "spotreeStream": {"entropy_threshold"},
    "disctree": {"sort_interval", "min_disc"},
    "ExtrapStream": {"kernel_points", "half_interval"},
    "DDTreeStream": {"sort_interval", "kernel_points", "stop_depth", "depth_threshold", "drift_threshold"},
    "SSDD": {"adaptive", "almost_exact", "automatic_threshold", "compare_windows", "tree_drift", "tree_merge", "item_drift", "item_merge", "print_blocks"},
    "DBDD": {"delta", "print_blocks"},
}


@dataclass
class Options:
    """Options of a run; names follow the command line."""

    mode: str
    min_support: float = 0.0
    min_confidence: float = 0.9
    min_lift: float = 1.0
    block_size: int = 10_000
    sort_interval: int | None = None
    entropy_threshold: float | None = None
    half_interval: int | None = None
    kernel_points: int | None = None
    prune_depth: int | None = None
    min_disc: float | None = None
    tree_sizes_at: list[int] = field(default_factory=list)
    stop_depth: int | None = None
    depth_threshold: int = 1
    drift_threshold: float = 20.0
    adaptive: bool = False
    almost_exact: bool = False
    automatic_threshold: bool = False
    compare_windows: bool = False
    tree_drift: float | None = None
    tree_merge: float | None = None
    item_drift: float | None = None
    item_merge: float | None = None
    delta: float | None = None
    first_item: bool = False
    max_size: int | None = None
    print_blocks: bool = False

    def check(self) -> Options:
        if self.mode not in (*BATCH, *BLOCKS, *DRIFT):
            raise ValueError(f"unknown mode {self.mode}")
        if self.mode != "minabssup" and not 0 < self.min_support <= 1:
            raise ValueError("min_support must be above 0, and at most 1")
        reads = READS.get(self.mode, set()) | ({"prune_depth", "tree_sizes_at"} if self.mode in TREES else set())
        common = {"mode", "min_support", "min_confidence", "min_lift", "block_size", "max_size"}
        for f in fields(self):
            default = f.default if f.default is not MISSING else f.default_factory() if f.default_factory is not MISSING else None
            if f.name not in reads | common and getattr(self, f.name) != default:
                raise ValueError(f"{self.mode} has no {f.name}")
        needs = {
            "cptree": ["sort_interval"], "cptreeStream": ["sort_interval"], "DDTreeStream": ["sort_interval", "stop_depth"],
            "spotree": ["entropy_threshold"], "spotreeStream": ["entropy_threshold"], "disctree": ["sort_interval", "prune_depth"], "DBDD": ["delta"],
        }
        for name in needs.get(self.mode, []):
            if getattr(self, name) is None:
                raise ValueError(f"{self.mode} needs {name}")
        if self.mode == "SSDD" and self.tree_drift is None and self.item_drift is None and not self.automatic_threshold:
            raise ValueError("SSDD needs a drift threshold")
        if self.compare_windows and self.tree_drift is None and not self.automatic_threshold:
            raise ValueError("windows are compared by tree_drift or an automatic threshold")
        if self.prune_depth is not None and self.prune_depth < 2:
            raise ValueError("prune_depth must be 2 or more")
        if self.half_interval is not None and not 0 < self.half_interval < self.block_size:
            raise ValueError("half_interval lies within a block")
        if self.kernel_points is not None and self.kernel_points < 1:
            raise ValueError("kernel_points must be positive")
        for name in ("tree_drift", "tree_merge", "item_drift", "item_merge", "delta"):
            if (x := getattr(self, name)) is not None and not 0 <= x <= 1:
                raise ValueError(f"{name} must be in [0, 1]")
        return self


@dataclass
class Result:
    itemsets: DataFrame
    rules: DataFrame
    #: Runs of drift modes; (tid, entropy) of the points at which cptree and spotree modes sort their items anew.
    events: DataFrame | None = None
    #: (item, rank), and block or run, of the order that trees have at the end.
    order: DataFrame | None = None


def _seen_ranks(counts: DataFrame, value: str) -> DataFrame:
    """(block, item, rank) by a column of (block, item, first, value), largest first, unknown last, then by first occurrence."""
    w = Window.partitionBy("block").orderBy(F.col(value).desc_nulls_last(), "first")  # over a block's items
    return counts.select("block", "item", F.row_number().over(w).alias("rank"))


def sorted_parts(b: DataFrame, tx: DataFrame, block: int, every: int) -> DataFrame:
    """(block, tid, items): the transactions that the window of `block` held as the items of its tree were last sorted, which
    is after every so many transactions of the stream. None for a block before the first sort."""
    if not every:
        return b.limit(0)
    blocks = b.select("block").distinct()
    q = F.floor(F.col("tid") / block)
    may = tx.select("tid", "items", F.explode(F.sequence(q, q + (every // block + 1))).alias("block"))
    at = F.floor((F.col("block") + 1) * block / every) * every
    return may.where((F.col("tid") < at) & (F.col("tid") >= at - block)).join(blocks, "block", "left_semi")


def block_order(b: DataFrame, tx: DataFrame, o: Options) -> DataFrame:
    """(block, item, rank) of whole blocks b (block, tid, items): how a mode orders the items of a block's tree at its end."""
    at = b.select("block", "tid", F.posexplode("items").alias("pos", "item"))
    seen = at.groupBy("block", "item").agg(F.count("*").alias("count"), F.min(F.struct("tid", "pos")).alias("first"))
    if o.mode == "ExtrapStream":
        ahead = forecast.kernel(tx, o.block_size, o.kernel_points) if o.kernel_points else forecast.linear(tx, o.block_size, o.half_interval)
        return _seen_ranks(seen.join(ahead, ["block", "item"], "left"), "forecast")
    if o.mode == "spotreeStream":
        return _seen_ranks(seen, "count")
    if o.mode in ("cptreeStream", "disctree"):
        parts = sorted_parts(b, tx, o.block_size, o.sort_interval)
        if o.mode == "cptreeStream":
            value = counting.item_counts(parts, ("block",)).withColumnRenamed("count", "value")
        else:
            value = counting.discriminativeness(parts, ("block",), o.block_size).withColumnRenamed("disc", "value")
        return _seen_ranks(seen.join(value, ["block", "item"], "left"), "value")
    return _seen_ranks(seen.withColumn("value", F.lit(0)), "value")


def _prepared(tx: DataFrame, o: Options):
    """What becomes of whole blocks before they are mined: disctree leaves items out, a depth cuts ordered transactions."""

    def prepare(b: DataFrame) -> DataFrame:
        if o.mode == "disctree" and o.min_disc is not None and o.sort_interval:
            value = counting.discriminativeness(sorted_parts(b, tx, o.block_size, o.sort_interval), ("block",), o.block_size)
            poor = value.where(F.col("disc") <= o.min_disc).select("block", "item")
            # an item that the last sort did not see is kept, as all are before the first sort
            rows = b.select("block", "tid", F.posexplode("items").alias("pos", "item")).join(poor, ["block", "item"], "left_anti")
            b = rows.groupBy("block", "tid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items"))
        if o.prune_depth is None:
            return b
        b = trie.ordered(b, block_order(b, tx, o), ("block",))
        return b.withColumn("items", F.slice("items", 1, o.prune_depth - 1))

    return prepare


def order_of(tx: DataFrame, o: Options) -> DataFrame:
    """(item, rank): how a batch mode orders the items of its tree at the end."""
    if o.mode == "cantree":
        return trie.ranks(tx, "first_seen")
    if o.mode == "cptree":
        return trie.ranks_every(tx, 0, tx.count(), o.sort_interval)
    return trie.ranks(tx, "frequency")  # fptree counts before it loads, spotree sorts at the end


def pruned(tx: DataFrame, o: Options) -> DataFrame:
    """tx without what lies below the pruning depth of its tree; all transactions but empty ones stay."""
    if o.prune_depth is None:
        return tx
    kept = trie.ordered(tx, order_of(tx, o))
    return kept.withColumn("items", F.slice("items", 1, o.prune_depth - 1))


def run(tx: DataFrame, options: Options) -> Result:
    """Mines transactions (tid, items). Results of block and drift modes have a column block or run.

    The orders of items that the modes differ in shape the tree; they matter to results where prune_depth cuts trees.
    disctree also leaves items out. Support is a share of all transactions of the batch, block or run, also of those
    that lose their items.
    """
    o = options.check()
    if o.mode in DRIFT:
        from harvestry.streaming import drift

        return drift.mine(tx, o)
    spark = tx.sparkSession
    events = None
    if o.mode in ("cptree", "cptreeStream") and o.sort_interval:
        last = tx.agg(F.max("tid")).first()[0]
        events = spark.range(o.sort_interval - 1, -1 if last is None else last + 1, o.sort_interval).select(F.col("id").alias("tid"), F.lit(None).cast("double").alias("entropy"))
    if o.mode in ("spotree", "spotreeStream"):
        events = spark.createDataFrame(resort_points(tx, min(o.block_size, 1000), o.entropy_threshold), "tid long, entropy double")
    if o.mode in BLOCKS:
        tx = written(tx.select("tid", "items"))
        sets = mining.block_itemsets(tx, o.block_size, o.min_support, o.max_size, _prepared(tx, o))
        sets = written(sets)
        rules = mining.association_rules(sets, o.block_size, o.min_confidence, o.min_lift, by=["block"])
        return Result(sets, rules, events, block_order(mining.whole_blocks(tx, o.block_size), tx, o))
    if o.mode == "minabssup":
        tx = written(tx.select("tid", "items"))
        sets = mining.apriori(tx, mining.min_abs_sup(tx, first_item=o.first_item), o.max_size)
        return Result(sets, mining.association_rules(sets, tx.count(), o.min_confidence, o.min_lift))
    if o.mode == "apriori":
        tx = written(tx.select("tid", "items"))
        n = tx.count()
        sets = mining.frequent_itemsets(tx, o.min_support, "apriori", o.max_size, n)
        return Result(sets.select("items", "count"), mining.association_rules(sets, n, o.min_confidence, o.min_lift))
    tx = written(tx.select(*(c for c in ("tid", "items") if c in tx.columns)))
    n = tx.count()
    sets = written(mining.frequent_itemsets(pruned(tx, o), o.min_support, max_size=o.max_size, n=n).select("items", "count"))
    order = order_of(tx, o) if "tid" in tx.columns else None
    return Result(sets, mining.association_rules(sets, n, o.min_confidence, o.min_lift), events, order)


def running_ranks(tx: DataFrame, interval: int) -> DataFrame:
    """(part, item, rank, first): ranks by frequency up to the end of every interval of transactions, for the items seen by
    then; first: the item's first interval. A row for each item and interval, none of them on the driver."""
    at = tx.select(F.floor(F.col("tid") / interval).alias("part"), "tid", F.posexplode("items").alias("pos", "item"))
    counts = at.groupBy("part", "item").agg(F.count("*").alias("n"))
    last = tx.agg(F.max("tid")).first()[0]
    seen = at.groupBy("item").agg(F.min("part").alias("first"), F.min(F.struct("tid", "pos")).alias("seen"))
    parts = F.sequence(F.col("first"), F.lit((last or 0) // interval).cast("long"))
    grid = seen.select("item", "first", "seen", F.explode(parts).alias("part")).join(counts, ["part", "item"], "left")
    total = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("item").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    grid = grid.withColumn("total", total)
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("total").desc(), "seen"))
    return grid.select("part", "item", rank.alias("rank"), "first")


def resort_points(tx: DataFrame, interval: int, threshold: float) -> list[tuple[int, float]]:
    """(tid, entropy) of the checkpoints, `interval` transactions apart, at which the order of items has moved by more
    than the threshold since it was stored; then it is stored. Items that came since count from where they came in.

    Checkpoints after a stored order are compared with it in one job, which brings one number each to the driver.
    """
    ranks = written(running_ranks(tx, interval))
    out, stored = [], 0
    while True:
        later = ranks.where(F.col("part") > stored)
        old = ranks.select(F.col("part").alias("p"), F.col("item").alias("i"), F.col("rank").alias("was"))
        # the order that is stored, or an item's first place in a later one
        both = later.join(old, (F.col("item") == F.col("i")) & (F.col("p") == F.greatest(F.col("first"), F.lit(stored))))
        n = F.count("*")
        entropy = F.sum(F.abs(F.col("rank") - F.col("was"))) / F.nullif((n * (n - 1) + F.floor(n * n / 4)).cast("double"), F.lit(0.0))
        first = both.groupBy("part").agg(entropy.alias("entropy")).where(F.col("entropy") > threshold).agg(F.min(F.struct("part", "entropy")).alias("at")).first()["at"]
        if first is None:
            return out
        stored = first["part"]
        out.append(((stored + 1) * interval - 1, first["entropy"]))
