"""The tree of ordered transactions as a relation: a row for every prefix of an ordered transaction, with its count.

Nothing is kept up to date: at any point the tree follows from the live transactions and an order of the items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry.operators import counting

#: Stand-ins for items when sequences are compared: characters beyond those that escape or combine.
_ALPHABET = "".join(chr(0x4E00 + i) for i in range(4096))


def ranks(tx: DataFrame, order: str = "frequency") -> DataFrame:
    """(item, rank) from 1. frequency: more often first, ties by first occurrence; first_seen; alphabetical."""
    seen = counting.first_seen(tx)
    by = {"frequency": [F.col("count").desc(), F.col("tid"), F.col("pos")], "first_seen": [F.col("tid"), F.col("pos")], "alphabetical": [F.col("item")]}[order]
    return seen.select("item", F.row_number().over(Window.orderBy(*by)).alias("rank"))  # a row for each item


def ranks_by(values: DataFrame, value: str, tx: DataFrame) -> DataFrame:
    """(item, rank) by a column of (item, value), largest first, unknown items last; ties by first occurrence."""
    seen = counting.first_seen(tx).drop("count").join(values.select("item", value), "item", "left")
    return seen.select("item", F.row_number().over(Window.orderBy(F.col(value).desc_nulls_last(), "tid", "pos")).alias("rank"))


def ranks_every(tx: DataFrame, at: int, n: int, every: int) -> DataFrame:
    """(item, rank) of n transactions from tid `at` on, sorted anew after every so many of them: by their frequency up to
    the last time, then, and before any, by first occurrence."""
    upto = n // every * every if every else 0
    return ranks_by(counting.item_counts(tx.where(F.col("tid") < at + upto)), "count", tx) if upto else ranks(tx, "first_seen")


def ordered(tx: DataFrame, rank: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Transactions with their items in the order of ranks; items without one come last, by name. by: columns that tell
    orders apart."""
    e = tx.select(*by, "tid", F.explode("items").alias("item")).join(rank, [*by, "item"], "left")
    place = F.struct(F.coalesce("rank", F.lit((1 << 31) - 1)).alias("r"), F.col("item").alias("i"))
    return e.groupBy(*by, "tid").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["i"]).alias("items"))


def prefixes(ordered_tx: DataFrame, weight: Column | None = None, prune_depth: int | None = None) -> DataFrame:
    """(prefix, item, depth, count), depth from 1. weight: of each transaction, negative to remove it; nodes at 0 go.

    prune_depth leaves out nodes at that depth and below.
    """
    items = F.col("items") if prune_depth is None else F.slice("items", 1, prune_depth - 1)
    w = F.lit(1) if weight is None else weight
    rows = ordered_tx.select(items.alias("items"), w.alias("w")).groupBy("items").agg(F.sum("w").alias("w")).where(F.size("items") > 0)
    rows = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("items")), lambda i: F.slice("items", F.lit(1), i))).alias("prefix"), "w")
    nodes = rows.groupBy("prefix").agg(F.sum("w").alias("count")).where("count > 0")
    return nodes.select("prefix", F.element_at("prefix", -1).alias("item"), F.size("prefix").alias("depth"), "count")


def tree(tx: DataFrame, order: str = "frequency", prune_depth: int | None = None) -> DataFrame:
    return prefixes(ordered(tx, ranks(tx, order)), prune_depth=prune_depth)


def node_count(nodes: DataFrame) -> int:
    """With the root."""
    return nodes.count() + 1


def sizes_at(tx: DataFrame, rank: DataFrame, at: list[int]) -> DataFrame:
    """(n, nodes) of the trees of the first n transactions, for each n of a list."""
    tids = tx.sparkSession.createDataFrame([(n,) for n in at], "n long")
    first = ordered(tx, rank).select("tid", F.explode(F.transform(F.sequence(F.lit(1), F.size("items")), lambda i: F.slice("items", F.lit(1), i))).alias("prefix")).groupBy("prefix").agg(F.min("tid").alias("tid"))
    # a node is there from its first transaction on; the list is given by the caller
    return first.join(F.broadcast(tids), F.col("tid") < F.col("n")).groupBy("n").agg((F.count("*") + 1).alias("nodes"))


def leaves(nodes: DataFrame) -> DataFrame:
    """Paths that no other path goes on from."""
    parents = nodes.where("depth > 1").select(F.slice("prefix", F.lit(1), F.col("depth") - 1).alias("prefix")).distinct()
    return nodes.join(parents, "prefix", "left_anti").select(F.col("prefix").alias("path"), "count")


def header(nodes: DataFrame) -> DataFrame:
    """(item, nodes, count): the header table."""
    return nodes.groupBy("item").agg(F.count("*").alias("nodes"), F.sum("count").alias("count"))


def has_single_path(nodes: DataFrame) -> bool:
    """True for chains of two nodes and more."""
    r = nodes.groupBy("depth").count().agg(F.max("count").alias("wide"), F.count("*").alias("deep")).first()
    return r["wide"] == 1 and r["deep"] >= 2


def patterns_in_path(paths: DataFrame, most: int = 24) -> DataFrame:
    """(items, count) of all non-empty subsets of chains (path, count), counts of equal ones added up. Chains of more than
    `most` items have too many and raise."""
    n = F.size("path")
    masks = F.when(n > most, F.raise_error(F.lit(f"a path of more than {most} items has too many subsets")).cast("bigint")).otherwise(F.expr("shiftleft(1L, size(path))") - 1)
    each = paths.where(n > 0).select("path", "count", F.explode(F.sequence(F.lit(1).cast("long"), masks)).alias("m"))
    return each.groupBy(F.expr("filter(path, (x, i) -> (shiftright(m, i) & 1) = 1)").alias("items")).agg(F.sum("count").alias("count"))


def to_vector(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(item, depth, count) of the nodes, the root first as item null at depth 0, to a depth if one is given."""
    root = nodes.sparkSession.createDataFrame([(None, 0, 0)], "item string, depth int, count long")
    some = nodes if max_depth is None else nodes.where(F.col("depth") <= max_depth)
    return root.unionByName(some.select("item", F.col("depth").cast("int"), "count"))


def frequencies(nodes: DataFrame) -> DataFrame:
    """Lines `item count` of the tree's frequency table."""
    return header(nodes).select(F.concat_ws(" ", "item", F.col("count").cast("string")).alias("line"))


def conditional_base(nodes: DataFrame, item: str) -> DataFrame:
    """(items, count): what stands above an item, with the counts of its nodes."""
    return nodes.where((F.col("item") == item) & (F.col("depth") > 1)).select(F.slice("prefix", F.lit(1), F.col("depth") - 1).alias("items"), "count")


def conditional_tree(nodes: DataFrame, item: str, least: int = 1) -> DataFrame:
    """The tree of an item's base: items under `least` drop out, the others are ordered by how often they are in it."""
    base = conditional_base(nodes, item).withColumn("tid", F.monotonically_increasing_id())
    e = base.select("tid", "count", F.posexplode("items").alias("pos", "item"))
    freq = e.groupBy("item").agg(F.sum("count").alias("f"), F.min(F.struct("pos", "item")).alias("p")).where(F.col("f") >= least)
    rank = freq.select("item", F.row_number().over(Window.orderBy(F.col("f").desc(), F.col("p.pos"), "item")).alias("rank"))
    kept = e.join(rank, "item").groupBy("tid").agg(F.first("count").alias("w"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias("items"))
    return prefixes(kept, F.col("w"))


def edges(nodes: DataFrame) -> DataFrame:
    """(parent, child, count, next_items): connections of the tree, summed over its nodes; next_items: the child's children."""
    e = nodes.where("depth > 1").select(F.element_at("prefix", -2).alias("parent"), F.col("item").alias("child"), "count", "prefix")
    below = nodes.where("depth > 1").select(F.slice("prefix", F.lit(1), F.col("depth") - 1).alias("prefix"), F.col("item").alias("next"))
    e = e.join(below.groupBy("prefix").agg(F.collect_set("next").alias("next")), "prefix", "left")
    return e.groupBy("parent", "child").agg(F.sum("count").alias("count"), F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.coalesce("next", F.array().cast("array<string>")))))).alias("next_items"))


def reweigh(old: DataFrame, new: DataFrame, purge: float | None = None, decay: float = 0.99) -> DataFrame:
    """Weights of connections (parent, child, count, weight) from one tree to the next.

    1 for new and grown ones, the old weight for shrunk ones, decayed for unchanged ones. purge drops weights up to it.
    """
    o = old.select("parent", "child", F.col("count").alias("had"), F.col("weight").alias("was"))
    w = F.when(F.col("had").isNull() | (F.col("count") > F.col("had")), 1.0).when(F.col("count") == F.col("had"), F.col("was") * decay).otherwise(F.col("was"))
    out = new.join(o, ["parent", "child"], "left").select("parent", "child", "count", w.alias("weight"))
    return out if purge is None else out.where(F.col("weight") > purge)


def steps_from(conn: set[tuple[str, str]]) -> dict[str, list[str]]:
    """What each item leads to directly."""
    out: dict[str, list[str]] = {}
    for a, b in conn:
        out.setdefault(a, []).append(b)
    return out


def connected(steps: dict[str, list[str]], freq: dict[str, int], a: str, b: str) -> bool:
    """Whether a leads to b, directly or through items as frequent as b."""
    seen, front, same = {a}, [a], freq.get(b, 0)
    while front:
        for c in steps.get(front.pop(), ()):
            if c == b:
                return True
            if c not in seen and freq.get(c, 0) == same:
                seen.add(c)
                front.append(c)
    return False


def reachable(conn: DataFrame, freq: DataFrame, max_steps: int = 64) -> DataFrame:
    """(a, b) of all connections, direct or through items as frequent as b; a fixpoint of joins over items' edges."""
    f = freq.select("item", F.col("count").alias("f"))
    direct = conn.select(F.col("parent").alias("a"), F.col("child").alias("b")).distinct()
    hop = direct.join(f.withColumnRenamed("item", "b"), "b").select(F.col("a").alias("x"), F.col("b").alias("y"), "f")
    out, size = direct, direct.count()
    for _ in range(max_steps):
        with_f = out.join(f.withColumnRenamed("item", "b"), "b").select("a", F.col("b").alias("x"), F.col("f").alias("fx"))
        more = with_f.join(hop, "x").where(F.col("fx") == F.col("f")).select("a", F.col("y").alias("b"))
        from harvestry.sources.scratch import written

        out = written(out.unionByName(more).distinct())
        if (now := out.count()) == size:
            return out
        size = now
    raise RuntimeError("no fixpoint: raise max_steps")


def similarity(left: DataFrame, right: DataFrame, within: int = 1) -> DataFrame:
    """One row (similarity): share, in percent, of left's nodes with a node of the same item at a near depth in right.

    The roots are nodes too, of an item that is only theirs. A join by item and a few depths: no comparison by range.
    """
    root = left.sparkSession.createDataFrame([("\0", 0)], "item string, depth int")
    lhs = left.select("item", "depth").unionByName(root).withColumn("id", F.monotonically_increasing_id())
    rhs = right.select("item", "depth").unionByName(root).distinct()
    near = lhs.select("id", "item", F.explode(F.sequence(F.col("depth") - within, F.col("depth") + within)).alias("depth")).join(rhs, ["item", "depth"], "left_semi").select("id").distinct().withColumn("hit", F.lit(1))
    return lhs.join(near, "id", "left").agg((F.lit(100.0) * F.count("hit") / F.count("*")).alias("similarity"))


def edit_distance(a: Column, b: Column) -> Column:
    """Of two sequences of items: items become characters by their place in either, and levenshtein does the rest."""
    both = F.array_union(a, b)
    code = lambda xs: F.array_join(F.transform(xs, lambda x: F.substring(F.lit(_ALPHABET), F.array_position(both, x).cast("int"), F.lit(1))), "")
    return F.when(F.size(both) > len(_ALPHABET), F.raise_error(F.lit(f"paths of more than {len(_ALPHABET)} items")).cast("int")).otherwise(F.levenshtein(code(a), code(b)))


def _sorted_by(paths: DataFrame, tables: DataFrame, key: str, name: str) -> DataFrame:
    """paths (id, path) once for each table of (key, item, rank), sorted by it."""
    e = paths.select("id", "path", F.explode("path").alias("item"))
    j = e.join(tables, "item").groupBy(key, "id", "path")
    return j.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda x: x["item"]).alias(name))


def instability(paths: DataFrame, tables: DataFrame, key: str = "k") -> DataFrame:
    """(k, instability): the mean over leaf paths of edit distance to the path sorted by a table, over the length."""
    p = paths.select("path").withColumn("id", F.monotonically_increasing_id())
    s = _sorted_by(p, tables, key, "other")
    return s.groupBy(key).agg(F.avg(edit_distance(F.col("path"), F.col("other")) / F.size("path")).alias("instability"))


def instability_between(paths: DataFrame, left: DataFrame, right: DataFrame, key: str = "k") -> DataFrame:
    """As instability(), squared, between the orders of tables and one other (item, rank)."""
    p = paths.select("path").withColumn("id", F.monotonically_increasing_id())
    one = _sorted_by(p, left, key, "l")
    two = _sorted_by(p, right.withColumn("__one", F.lit(0)), "__one", "r").select("id", "r")
    d = edit_distance(F.col("l"), F.col("r")) / F.size("l")
    return one.join(two, "id").groupBy(key).agg(F.avg(d * d).alias("instability"))


def render(nodes: DataFrame, max_depth: int | None = None) -> str:
    """(root:0 (a:2 (b:1))): children in the order of their names. Trees that fit a screen."""
    rows = nodes.collect() if max_depth is None else nodes.where(F.col("depth") <= max_depth).collect()
    below: dict[tuple, list] = {}
    for r in rows:
        below.setdefault(tuple(r["prefix"][:-1]), []).append((r["item"], r["count"], tuple(r["prefix"])))

    def of(prefix: tuple) -> str:
        return "".join(f" ({i}:{c}{of(p)})" for i, c, p in sorted(below.get(prefix, [])))

    return f"(root:0{of(())})"


def graphviz(nodes: DataFrame) -> DataFrame:
    """Lines of a GraphViz digraph's edges."""
    name = lambda c: F.concat(F.lit('"'), F.array_join(c, "/"), F.lit('"'))
    return nodes.select(F.concat(name(F.slice("prefix", F.lit(1), F.col("depth") - 1)), F.lit(" -> "), name(F.col("prefix")), F.lit(' [label="'), F.col("count").cast("string"), F.lit('"];')).alias("line"))


def is_sorted(ordered_tx: DataFrame, rank: DataFrame) -> bool:
    """Whether every transaction follows the ranks."""
    again = ordered(ordered_tx, rank).select("tid", F.col("items").alias("want"))
    return not ordered_tx.join(again, "tid").where(F.col("items") != F.col("want")).head(1)


def edit_distance_of(a: list, b: list) -> int:
    """Levenshtein's, of sequences of any items."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def instability_exact(paths: DataFrame, left: dict[str, int], right: dict[str, int], conn: set[tuple[str, str]], freq: dict[str, int], gone: list[str]) -> float:
    """As instability(), between two orders (items to ranks), with what the left tree tells about steps.

    Items that have gone on the right join every left path; a left step that the connections conn don't allow, directly
    or through items as frequent as its end, is taken out. Tables of items only; the paths stay where they are.
    """
    last, steps = 1 << 31, steps_from(conn)

    def of(batches):
        import pandas as pd

        n, total = 0, 0.0
        known: dict[tuple[str, str], bool] = {}
        for b in batches:
            for path in b["path"]:
                path = list(path)
                lhs = sorted([*path, *(x for x in gone if x not in path)], key=lambda x: (left.get(x, last), x))
                kept = lhs[:1]
                for x in lhs[1:]:
                    step = (kept[-1], x)
                    if step not in known:
                        known[step] = connected(steps, freq, *step)
                    if known[step]:
                        kept.append(x)
                rhs = sorted(path, key=lambda x: (right.get(x, last), x))
                n, total = n + 1, total + edit_distance_of(kept, rhs) / len(path)
        yield pd.DataFrame({"n": [n], "total": [total]})

    r = paths.select("path").mapInPandas(of, "n long, total double").agg(F.sum("n").alias("n"), F.sum("total").alias("t")).first()
    return r["t"] / r["n"] if r["n"] else 0.0
