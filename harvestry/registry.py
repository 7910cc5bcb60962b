"""One query for each operator of the library, with the same as SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.functions import itemsets, stats
from harvestry.operators import counting, mining, trie
from harvestry.plans import forecast, modes
from harvestry.sources import sinks
from harvestry.sources import transactions as T
from harvestry.sources.scratch import shared_path, written
from harvestry.streaming import drift

QUERIES: dict = {}
SQL: dict[str, str] = {}
BLOCK = 2500


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir). Views of the transactions precede the SQL as they are named in it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            views = [f"{v} AS ({text})" for v, text in T.VIEWS_SQL.items() if f"{v}" in sql.replace("stream_", "")]
            first, _, rest = sql.lstrip().partition(" ")
            head = "WITH RECURSIVE" if rest.startswith("RECURSIVE ") else "WITH"
            rest = f", {rest.removeprefix('RECURSIVE ')}" if first == "WITH" else f" {sql}"
            SQL[f.__name__] = f"{head} {', '.join(views)}{rest}" if views else sql
        return f

    return add


def _text(sets: DataFrame, *more: str) -> DataFrame:
    return sets.select(*more, F.array_join("items", " ").alias("items"), F.size("items").alias("size"), "count")


LEVELS = """
e AS (SELECT * FROM {v}), n AS (SELECT count(DISTINCT tid) AS n FROM e),
f1 AS (SELECT item AS a, count(*) AS count FROM e GROUP BY 1 HAVING count(*) / (SELECT n FROM n)::DOUBLE >= {s}),
k AS (SELECT tid, item FROM e WHERE item IN (SELECT a FROM f1)),
f2 AS (SELECT x.item AS a, y.item AS b, count(*) AS count FROM k x JOIN k y ON x.tid = y.tid AND x.item < y.item GROUP BY 1, 2 HAVING count(*) / (SELECT n FROM n)::DOUBLE >= {s}),
f3 AS (SELECT x.item AS a, y.item AS b, z.item AS c, count(*) AS count FROM k x JOIN k y ON x.tid = y.tid AND x.item < y.item JOIN k z ON x.tid = z.tid AND y.item < z.item GROUP BY 1, 2, 3 HAVING count(*) / (SELECT n FROM n)::DOUBLE >= {s}),
f4 AS (SELECT x.item AS a, y.item AS b, z.item AS c, w.item AS d, count(*) AS count FROM k x JOIN k y ON x.tid = y.tid AND x.item < y.item JOIN k z ON x.tid = z.tid AND y.item < z.item JOIN k w ON x.tid = w.tid AND z.item < w.item GROUP BY 1, 2, 3, 4 HAVING count(*) / (SELECT n FROM n)::DOUBLE >= {s}),
sets AS (SELECT a AS items, 1 AS size, count FROM f1 UNION ALL SELECT a || ' ' || b, 2, count FROM f2 UNION ALL SELECT a || ' ' || b || ' ' || c, 3, count FROM f3 UNION ALL SELECT a || ' ' || b || ' ' || c || ' ' || d, 4, count FROM f4)
"""


@query("SELECT item, count(*)::BIGINT AS count FROM basket GROUP BY item")
def item_counts(spark: SparkSession, d: str) -> DataFrame:
    return counting.item_counts(T.basket(spark, d))


@query("SELECT item, count(*)::BIGINT AS count, round(count(*) / (SELECT count(DISTINCT tid) FROM basket)::DOUBLE, 6) AS support FROM basket GROUP BY item")
def item_support(spark: SparkSession, d: str) -> DataFrame:
    return counting.item_support(T.basket(spark, d)).withColumn("support", F.round("support", 6))


@query("SELECT count(DISTINCT item)::BIGINT AS items, count(DISTINCT tid)::BIGINT AS transactions FROM basket")
def distinct_items(spark: SparkSession, d: str) -> DataFrame:
    tx = T.basket(spark, d)
    return tx.select("tid", F.explode("items").alias("i")).agg(F.countDistinct("i").alias("items"), F.countDistinct("tid").alias("transactions"))


@query("SELECT length, count(*)::BIGINT AS count FROM (SELECT tid, count(*)::INT AS length FROM basket GROUP BY tid) GROUP BY length")
def txn_len_hist(spark: SparkSession, d: str) -> DataFrame:
    return counting.length_histogram(T.basket(spark, d))


@query("SELECT x.item AS a, y.item AS b, count(*)::BIGINT AS count FROM basket x JOIN basket y ON x.tid = y.tid AND x.item < y.item GROUP BY 1, 2")
def pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return counting.pair_counts(T.basket(spark, d))


@query("SELECT a AS item, count(*)::BIGINT AS degree, sum(c)::BIGINT AS weight FROM (SELECT x.item AS a, y.item AS b, count(*) AS c FROM userday x JOIN userday y ON x.tid = y.tid AND x.item <> y.item GROUP BY 1, 2) GROUP BY 1")
def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    return counting.neighbours(T.userday(spark, d))


@query("WITH e AS (SELECT * FROM basket), n AS (SELECT count(DISTINCT tid) AS n FROM e) SELECT x.item AS a, y.item AS b, count(*)::BIGINT AS count FROM e x JOIN e y ON x.tid = y.tid AND x.item < y.item GROUP BY 1, 2 HAVING count(*) / (SELECT n FROM n)::DOUBLE >= 0.01")
def frequent_pairs(spark: SparkSession, d: str) -> DataFrame:
    tx = written(T.basket(spark, d))
    return counting.pair_counts(tx).where(F.col("count") / F.lit(float(tx.count())) >= 0.01)


@query(f"WITH {LEVELS.format(v='attr', s=0.01)} SELECT items, size, count::BIGINT AS count FROM sets")
def frequent_all_fpgrowth(spark: SparkSession, d: str) -> DataFrame:
    return _text(mining.frequent_itemsets(T.attr(spark, d), 0.01, "fpgrowth"))


@query(f"WITH {LEVELS.format(v='basket', s=0.01)} SELECT items, size, count::BIGINT AS count FROM sets")
def frequent_basket_fpgrowth(spark: SparkSession, d: str) -> DataFrame:
    return _text(mining.frequent_itemsets(T.basket(spark, d), 0.01, "fpgrowth"))


@query(f"WITH {LEVELS.format(v='userday', s=0.01)} SELECT items, size, count::BIGINT AS count FROM sets")
def frequent_all_apriori(spark: SparkSession, d: str) -> DataFrame:
    return _text(mining.frequent_itemsets(T.userday(spark, d), 0.01, "apriori", max_size=4))


@query(f"WITH {LEVELS.format(v='userday', s=0.02)} SELECT items, count::BIGINT AS count FROM sets WHERE size = 3")
def frequent_triples(spark: SparkSession, d: str) -> DataFrame:
    return _text(mining.frequent_itemsets(T.userday(spark, d), 0.02, "apriori", max_size=3)).where("size = 3").drop("size")


@query(f"""WITH {LEVELS.format(v='userday', s=0.02)},
l AS (SELECT string_split(items, ' ') AS i, size, count FROM sets WHERE size > 1),
m AS (SELECT i, size, count, unnest(range(1, (1 << size) - 1)) AS m FROM l),
r AS (SELECT count, [i[j + 1] for j in range(0, size) if (m >> j) & 1 = 1] AS x, [i[j + 1] for j in range(0, size) if (m >> j) & 1 = 0] AS y FROM m),
c AS (SELECT array_to_string(x, ' ') AS antecedent, array_to_string(y, ' ') AS consequent, r.count, (r.count / (SELECT n FROM n)::DOUBLE) / (sa.count / (SELECT n FROM n)::DOUBLE) AS confidence, sb.count AS cb FROM r JOIN sets sa ON sa.items = array_to_string(x, ' ') JOIN sets sb ON sb.items = array_to_string(y, ' '))
SELECT antecedent, consequent, count::BIGINT AS count, round(confidence, 6) AS confidence, round(confidence / (cb / (SELECT n FROM n)::DOUBLE), 6) AS lift FROM c WHERE confidence > 0.3 AND confidence / (cb / (SELECT n FROM n)::DOUBLE) > 0.5""")
def rules_all_splits(spark: SparkSession, d: str) -> DataFrame:
    tx = written(T.userday(spark, d))
    n = tx.count()
    sets = mining.frequent_itemsets(tx, 0.02, max_size=4, n=n)
    r = mining.association_rules(sets, n, 0.3, 0.5)
    return r.select(F.array_join("antecedent", " ").alias("antecedent"), F.array_join("consequent", " ").alias("consequent"), "count", F.round("confidence", 6).alias("confidence"), F.round("lift", 6).alias("lift"))


@query("""WITH c AS (SELECT item, count(*) AS c FROM userday GROUP BY 1), n AS (SELECT count(DISTINCT tid)::DOUBLE AS n FROM userday),
p AS (SELECT x.item AS a, y.item AS b, count(*) AS ab FROM userday x JOIN userday y ON x.tid = y.tid AND x.item <> y.item GROUP BY 1, 2)
SELECT a, b, round((ab / n) / (ca.c / n), 6) AS confidence, round((ab / n) / (ca.c / n) / (cb.c / n), 6) AS lift FROM p JOIN c ca ON ca.item = a JOIN c cb ON cb.item = b, n""")
def pair_confidence_lift(spark: SparkSession, d: str) -> DataFrame:
    tx = T.userday(spark, d)
    n, c = F.lit(float(tx.count())), counting.item_counts(tx)
    p = counting.cooccurrence(tx).join(c.select(F.col("item").alias("a"), F.col("count").alias("ca")), "a").join(c.select(F.col("item").alias("b"), F.col("count").alias("cb")), "b")
    return p.select("a", "b", F.round(stats.confidence(F.col("count"), F.col("ca"), n), 6).alias("confidence"), F.round(stats.lift(F.col("count"), F.col("ca"), F.col("cb"), n), 6).alias("lift"))


@query(f"""WITH {LEVELS.format(v='userday', s=0.05)}, p AS (SELECT a, b FROM f2)
SELECT x.a || ' ' || x.b || ' ' || y.b AS items FROM p x JOIN p y ON x.a = y.a AND x.b < y.b JOIN p z ON z.a = x.b AND z.b = y.b""")
def closure_filter(spark: SparkSession, d: str) -> DataFrame:
    tx = T.userday(spark, d)
    pairs = counting.pair_counts(tx).where(F.col("count") / F.lit(float(tx.count())) >= 0.05)
    return mining.candidates(pairs.select(F.array("a", "b").alias("items")), 3).select(F.array_join("items", " ").alias("items"))


@query("""WITH e AS (SELECT * FROM userday), s AS (SELECT item AS items, count(*)::BIGINT AS count FROM e GROUP BY 1 UNION ALL SELECT x.item || ' ' || y.item, count(*) FROM e x JOIN e y ON x.tid = y.tid AND x.item < y.item GROUP BY 1)
SELECT items, count FROM s WHERE count >= 600""")
def min_count_filter(spark: SparkSession, d: str) -> DataFrame:
    sets = mining.apriori(T.userday(spark, d), mining.min_count(600), max_size=2)
    return sets.select(F.array_join("items", " ").alias("items"), "count")


@query("""WITH e AS (SELECT * FROM basket), n AS (SELECT count(DISTINCT tid)::BIGINT AS n FROM e), c AS (SELECT item, count(*)::BIGINT AS c FROM e GROUP BY 1),
p AS (SELECT x.item AS a, y.item AS b, count(*)::BIGINT AS count FROM e x JOIN e y ON x.tid = y.tid AND x.item < y.item GROUP BY 1, 2),
q AS (SELECT p.*, ca.c AS x, cb.c AS y, n FROM p JOIN c ca ON ca.item = a JOIN c cb ON cb.item = b, n),
t AS (SELECT a, b, count, x, y, n, unnest(range(greatest(0, x + y - n), least(x, y) + 1)) AS k FROM q),
u AS (SELECT *, sum(exp(lgamma(y + 1) + lgamma(n - y + 1) + lgamma(x + 1) + lgamma(n - x + 1) - lgamma(k + 1) - lgamma(y - k + 1) - lgamma(x - k + 1) - lgamma(n - x - y + k + 1) - lgamma(n + 1))) OVER (PARTITION BY a, b ORDER BY k ROWS UNBOUNDED PRECEDING) AS s FROM t),
m AS (SELECT a, b, count, coalesce(min(k) FILTER (s > 0.5), least(any_value(x), any_value(y)))::BIGINT AS bound FROM u GROUP BY a, b, count)
SELECT a || ' ' || b AS items, count, bound FROM m WHERE count > bound""")
def minabssup_pairs(spark: SparkSession, d: str) -> DataFrame:
    tx = T.basket(spark, d)
    n, c = tx.count(), counting.item_counts(tx)
    p = counting.pair_counts(tx).join(c.select(F.col("item").alias("a"), F.col("count").alias("x")), "a").join(c.select(F.col("item").alias("b"), F.col("count").alias("y")), "b")
    p = p.withColumn("bound", stats.min_abs_sup_udf("x", "y", F.lit(n), F.lit(0.5)))
    return p.where("count > bound").select(F.concat_ws(" ", "a", "b").alias("items"), "count", "bound")


def minabssup_sets(spark: SparkSession, d: str) -> DataFrame:
    tx = T.userday(spark, d)
    return _text(mining.apriori(tx, mining.min_abs_sup(tx)))


QUERIES["minabssup_sets"] = minabssup_sets

BLOCKS_SQL = f"""e AS (SELECT tid, tid // {BLOCK} AS block, item FROM stream WHERE tid // {BLOCK} IN (SELECT tid // {BLOCK} FROM (SELECT DISTINCT tid FROM stream) GROUP BY 1 HAVING count(*) = {BLOCK})),
f1 AS (SELECT block, item AS items, 1 AS size, count(*)::BIGINT AS count FROM e GROUP BY ALL HAVING count(*) / {BLOCK}.0::DOUBLE >= 0.05),
f2 AS (SELECT x.block, x.item || ' ' || y.item AS items, 2 AS size, count(*)::BIGINT AS count FROM e x JOIN e y ON x.tid = y.tid AND x.item < y.item GROUP BY ALL HAVING count(*) / {BLOCK}.0::DOUBLE >= 0.05),
f3 AS (SELECT x.block, x.item || ' ' || y.item || ' ' || z.item AS items, 3 AS size, count(*)::BIGINT AS count FROM e x JOIN e y ON x.tid = y.tid AND x.item < y.item JOIN e z ON x.tid = z.tid AND y.item < z.item GROUP BY ALL HAVING count(*) / {BLOCK}.0::DOUBLE >= 0.05),
sets AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3)"""


@query(f"WITH {BLOCKS_SQL} SELECT block, items, size, count FROM sets")
def block_itemsets(spark: SparkSession, d: str) -> DataFrame:
    return _text(mining.block_itemsets(T.stream(spark, d), BLOCK, 0.05, max_size=3), "block")


@query(f"""WITH {BLOCKS_SQL}, p AS (SELECT block, string_split(items, ' ') AS i, count FROM sets WHERE size = 2),
r AS (SELECT block, i[1] AS antecedent, i[2] AS consequent, count FROM p UNION ALL SELECT block, i[2], i[1], count FROM p),
c AS (SELECT r.*, (r.count / {BLOCK}.0::DOUBLE) / (a.count / {BLOCK}.0::DOUBLE) AS confidence, b.count AS cb FROM r JOIN f1 a ON a.block = r.block AND a.items = antecedent JOIN f1 b ON b.block = r.block AND b.items = consequent)
SELECT block, antecedent, consequent, count, round(confidence, 6) AS confidence FROM c WHERE confidence > 0.2 AND confidence / (cb / {BLOCK}.0::DOUBLE) > 1.0""")
def block_rules(spark: SparkSession, d: str) -> DataFrame:
    sets = mining.block_itemsets(T.stream(spark, d), BLOCK, 0.05, max_size=2)
    r = mining.association_rules(sets, BLOCK, 0.2, 1.0, by=["block"])
    return r.select("block", F.array_join("antecedent", " ").alias("antecedent"), F.array_join("consequent", " ").alias("consequent"), "count", F.round("confidence", 6).alias("confidence"))


@query("WITH t AS (SELECT unnest(range(999, (SELECT max(tid) + 1 FROM stream), 1000)) AS tid) SELECT t.tid, s.item, count(*)::BIGINT AS count FROM t JOIN stream s ON s.tid BETWEEN t.tid - 1499 AND t.tid GROUP BY 1, 2")
def sliding_item_counts(spark: SparkSession, d: str) -> DataFrame:
    return counting.sliding_counts(T.stream(spark, d), 1500, 1000)


RANK_SQL = """r AS (SELECT item, row_number() OVER (ORDER BY count(*) DESC, min(tid * 1000 + pos)) AS rank FROM (SELECT tid, item, row_number() OVER (PARTITION BY tid ORDER BY item) AS pos FROM {v}) GROUP BY item),
o AS (SELECT tid, list(item ORDER BY rank) AS items FROM {v} JOIN r USING (item) GROUP BY tid),
nodes AS (SELECT array_to_string(items[:k], ' ') AS prefix, items[k] AS item, k::INT AS depth, count(*)::BIGINT AS count FROM o, unnest(range(1, len(items) + 1)) AS t(k) GROUP BY 1, 2, 3)"""


@query(f"WITH {RANK_SQL.format(v='userday')} SELECT prefix, item, depth, count FROM nodes")
def trie_nodes(spark: SparkSession, d: str) -> DataFrame:
    return trie.tree(T.userday(spark, d)).select(F.array_join("prefix", " ").alias("prefix"), "item", "depth", "count")


@query(f"WITH {RANK_SQL.format(v='userday')} SELECT prefix AS path, count FROM nodes x WHERE NOT EXISTS (SELECT 1 FROM nodes y WHERE y.depth = x.depth + 1 AND starts_with(y.prefix, x.prefix || ' '))")
def trie_leaves(spark: SparkSession, d: str) -> DataFrame:
    return trie.leaves(trie.tree(T.userday(spark, d))).select(F.array_join("path", " ").alias("path"), "count")


@query(f"WITH {RANK_SQL.format(v='userday')} SELECT item, count(*)::BIGINT AS nodes, sum(count)::BIGINT AS count FROM nodes GROUP BY item")
def trie_header(spark: SparkSession, d: str) -> DataFrame:
    return trie.header(trie.tree(T.userday(spark, d)))


@query(f"""WITH {RANK_SQL.format(v='stream')}, n AS (SELECT unnest([1000, 5000]) AS n)
SELECT n::BIGINT AS n, (count(DISTINCT array_to_string(items[:k], ' ')) + 1)::BIGINT AS nodes FROM n, o, unnest(range(1, len(items) + 1)) AS t(k) WHERE tid < n GROUP BY n""")
def trie_size_at(spark: SparkSession, d: str) -> DataFrame:
    tx = T.stream(spark, d)
    return trie.sizes_at(tx, trie.ranks(tx), [1000, 5000])


@query(f"WITH {RANK_SQL.format(v='userday')} SELECT left(prefix, len(prefix) - len(item) - 1) AS items, count FROM nodes WHERE item = 'purchase' AND depth > 1")
def conditional_base(spark: SparkSession, d: str) -> DataFrame:
    return trie.conditional_base(trie.tree(T.userday(spark, d)), "purchase").select(F.array_join("items", " ").alias("items"), "count")


@query(f"""WITH {RANK_SQL.format(v='userday')}, e AS (SELECT string_split(prefix, ' ') AS p, count FROM nodes WHERE depth > 1)
SELECT p[-2] AS parent, p[-1] AS child, sum(count)::BIGINT AS count FROM e GROUP BY 1, 2""")
def edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return trie.edges(trie.tree(T.userday(spark, d))).drop("next_items")


HALF = "(SELECT max(tid) // 2 FROM stream)"


@query(f"""WITH o AS (SELECT * FROM stream), r AS (SELECT item, row_number() OVER (ORDER BY item) AS rank FROM stream GROUP BY item),
x AS (SELECT tid < {HALF} AS early, list(item ORDER BY rank) AS items FROM stream JOIN r USING (item) GROUP BY tid),
g AS (SELECT early, items[k - 1] AS parent, items[k] AS child, count(*) AS count FROM x, unnest(range(2, len(items) + 1)) AS t(k) GROUP BY ALL),
a AS (SELECT * FROM g WHERE early), b AS (SELECT * FROM g WHERE NOT early)
SELECT b.parent, b.child, b.count::BIGINT AS count, CASE WHEN a.count IS NULL OR b.count > a.count THEN 1.0 WHEN a.count = b.count THEN 0.99 ELSE 1.0 END::DOUBLE AS weight FROM b LEFT JOIN a ON a.parent = b.parent AND a.child = b.child""")
def edge_weights(spark: SparkSession, d: str) -> DataFrame:
    tx = T.stream(spark, d)
    rank = trie.ranks(tx, "alphabetical")
    half = tx.agg(F.max("tid")).first()[0] // 2
    of = lambda part: trie.edges(trie.prefixes(trie.ordered(part, rank)))
    old = of(tx.where(F.col("tid") < half)).withColumn("weight", F.lit(1.0))
    return trie.reweigh(old, of(tx.where(F.col("tid") >= half)))


@query("""WITH e AS (SELECT * FROM basket), n AS (SELECT count(DISTINCT tid)::DOUBLE AS n FROM e), s AS (SELECT item, count(*) / any_value(n) AS s FROM e, n GROUP BY 1),
g AS (SELECT x.item AS a, y.item AS b, count(*) / any_value(n) AS xy FROM e x JOIN e y ON x.tid = y.tid AND x.item <> y.item, n GROUP BY 1, 2)
SELECT a AS item, round(sum(-xy * ln(xy / x.s) - (x.s - xy) * ln((x.s - xy + 1e-6) / x.s) - xy * ln(xy / y.s) - (y.s - xy) * ln((y.s - xy + 1e-6) / y.s)) / 2, 6) AS disc FROM g JOIN s x ON x.item = a JOIN s y ON y.item = b GROUP BY a""")
def discriminativeness(spark: SparkSession, d: str) -> DataFrame:
    return counting.discriminativeness(T.basket(spark, d)).withColumn("disc", F.round("disc", 6))


@query("SELECT item, count(*)::BIGINT AS count, rank() OVER (ORDER BY count(*) DESC) + (count(*) OVER (PARTITION BY count(*)) - 1) / 2.0::DOUBLE AS rank FROM basket GROUP BY item")
def avg_rank(spark: SparkSession, d: str) -> DataFrame:
    return counting.average_ranks(counting.item_counts(T.basket(spark, d)))


HALVES_SQL = f"""a AS (SELECT item, rank() OVER (ORDER BY count(*) DESC) + (count(*) OVER (PARTITION BY count(*)) - 1) / 2.0::DOUBLE AS r FROM stream WHERE tid < {HALF} GROUP BY item),
b AS (SELECT item, rank() OVER (ORDER BY count(*) DESC) + (count(*) OVER (PARTITION BY count(*)) - 1) / 2.0::DOUBLE AS r FROM stream WHERE tid >= {HALF} GROUP BY item)"""


def _halves(spark: SparkSession, d: str) -> list[DataFrame]:
    tx = T.stream(spark, d)
    half = tx.agg(F.max("tid")).first()[0] // 2
    return [counting.average_ranks(counting.item_counts(tx.where(c))) for c in (F.col("tid") < half, F.col("tid") >= half)]


@query(f"WITH {HALVES_SQL} SELECT round(1 - 6 * sum((a.r - b.r) ** 2) / (count(*) * (count(*) * count(*) - 1)), 6) AS rho FROM a JOIN b USING (item)")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    return counting.spearman(*_halves(spark, d)).select(F.round("rho", 6).alias("rho"))


@query(f"WITH {HALVES_SQL} SELECT round(sum(abs(a.r - b.r)) / (count(*) * (count(*) - 1) + count(*) * count(*) // 4), 6) AS entropy FROM a JOIN b USING (item)")
def rank_entropy(spark: SparkSession, d: str) -> DataFrame:
    return counting.rank_entropy(*_halves(spark, d)).select(F.round("entropy", 6).alias("entropy"))


FULL = f"f AS (SELECT tid // {BLOCK} AS block, item, tid % {BLOCK} AS p FROM stream WHERE tid // {BLOCK} IN (SELECT tid // {BLOCK} FROM (SELECT DISTINCT tid FROM stream) GROUP BY 1 HAVING count(*) = {BLOCK}))"


@query(f"""WITH {FULL}, c AS (SELECT block, item, count(*) FILTER (p < {BLOCK // 2}) AS prev, count(*) AS now FROM f GROUP BY 1, 2)
SELECT block, item, round(CASE WHEN sqrt(ln(1000) / (2 * {BLOCK})) < 2 * ((now - prev) - prev) / {BLOCK}.0::DOUBLE THEN 2 * now / {BLOCK}.0::DOUBLE ELSE (now + 2 * (now - prev) - prev) / {BLOCK}.0::DOUBLE END, 6) AS forecast FROM c""")
def linear_forecast(spark: SparkSession, d: str) -> DataFrame:
    return forecast.linear(T.stream(spark, d), BLOCK).withColumn("forecast", F.round("forecast", 6))


@query(f"""WITH {FULL}, x AS (SELECT unnest(range({BLOCK // 5}, {BLOCK + 1}, {BLOCK // 5})) AS x),
y AS (SELECT block, item, x, count(*) AS y FROM f, x WHERE p < x GROUP BY ALL)
SELECT block, item, round(4.0::DOUBLE * {BLOCK} * {BLOCK} * sum(x::DOUBLE * x * y) / (SELECT sum(x::DOUBLE ** 4) FROM x), 4) AS forecast FROM y GROUP BY 1, 2""")
def kernel_forecast(spark: SparkSession, d: str) -> DataFrame:
    return forecast.kernel(T.stream(spark, d), BLOCK, 5).withColumn("forecast", F.round("forecast", 4))


@query(f"""WITH c AS (SELECT item, count(*)::BIGINT AS count FROM basket GROUP BY 1), n AS (SELECT count(DISTINCT tid)::BIGINT AS n FROM basket)
SELECT item, round((count * (1 - count / n::DOUBLE) ** 2 + (n - count) * (count / n::DOUBLE) ** 2) / n, 6) AS variance FROM c, n""")
def bernoulli_variance(spark: SparkSession, d: str) -> DataFrame:
    tx = T.basket(spark, d)
    n = F.lit(float(tx.count()))
    return counting.item_counts(tx).select("item", F.round(stats.bernoulli_variance(F.col("count"), n), 6).alias("variance"))


@query(f"""WITH c AS (SELECT item, count(*) FILTER (tid < {HALF}) AS l, count(*) FILTER (tid >= {HALF}) AS r FROM stream GROUP BY 1), n AS (SELECT {HALF}::DOUBLE AS nl, (max(tid) + 1 - {HALF})::DOUBLE AS nr FROM stream),
m AS (SELECT item, l / nl AS sl, r / nr AS sr, (l + r) / (nl + nr) AS s, ln(2 * ln(nl + nr) / 0.05) AS dd, 1 / (nr - 4) + 1 / (nl - 4) AS m FROM c, n)
SELECT item, round(sqrt(2 * m * s * (1 - s) * dd) + 2.0::DOUBLE / 3 * dd * m, 6) AS epsilon, abs(sl - sr) > sqrt(2 * m * s * (1 - s) * dd) + 2.0::DOUBLE / 3 * dd * m AS drifted FROM m""")
def distribution_cut(spark: SparkSession, d: str) -> DataFrame:
    tx = T.stream(spark, d)
    last = tx.agg(F.max("tid")).first()[0]
    half = last // 2
    nl, nr = F.lit(float(half)), F.lit(float(last + 1 - half))
    c = counting.exploded(tx).groupBy("item").agg(F.sum((F.col("tid") < half).cast("long")).alias("l"), F.count("*").alias("n"))
    s = F.col("n") / (nl + nr)
    eps = stats.cut_epsilon(nl, nr, s * (1 - s), 0.05)
    return c.select("item", F.round(eps, 6).alias("epsilon"), (F.abs(F.col("l") / nl - (F.col("n") - F.col("l")) / nr) > eps).alias("drifted"))


@query(f"""WITH c AS (SELECT item, count(*) FILTER (tid < {HALF}) AS l, count(*) AS n FROM stream GROUP BY 1), h AS (SELECT {HALF}::DOUBLE AS nl, (max(tid) + 1)::DOUBLE AS nn FROM stream)
SELECT round(avg((abs(n - l) > sqrt((1 / (1 / nn + 1 / nl)) / 2 * ln(4 * (nn + nl) / 0.001)))::INT), 6) AS instability FROM c, h""")
def table_instability(spark: SparkSession, d: str) -> DataFrame:
    tx = T.stream(spark, d)
    last = tx.agg(F.max("tid")).first()[0]
    bound = stats.hoeffding_two(F.lit(float(last + 1)), F.lit(float(last // 2)), 0.001)
    c = counting.exploded(tx).groupBy("item").agg(F.sum((F.col("tid") < last // 2).cast("long")).alias("l"), F.count("*").alias("n"))
    return c.agg(F.round(F.avg((F.abs(F.col("n") - F.col("l")) > bound).cast("int")), 6).alias("instability"))


@query("SELECT k::BIGINT AS items, p::BIGINT AS paths, round(abs((1 - 2.24 / sqrt(k - 1)) * (k * k - 1) / (6 * k * p)), 6) AS threshold FROM (SELECT count(DISTINCT item)::DOUBLE AS k, count(DISTINCT tid)::DOUBLE AS p FROM basket)")
def auto_threshold(spark: SparkSession, d: str) -> DataFrame:
    tx = counting.exploded(T.basket(spark, d))
    s = tx.agg(F.countDistinct("item").alias("items"), F.countDistinct("tid").alias("paths"))
    return s.select("items", "paths", F.round(stats.auto_threshold(F.col("items").cast("double"), F.col("paths").cast("double")), 6).alias("threshold"))


TREES_SQL = f"""ra AS (SELECT item, row_number() OVER (ORDER BY item) AS rank FROM stream GROUP BY item), rb AS (SELECT item, row_number() OVER (ORDER BY item DESC) AS rank FROM stream GROUP BY item),
leaves AS (SELECT DISTINCT list(item ORDER BY rank) AS l, list(item ORDER BY item DESC) AS r FROM stream JOIN ra USING (item) GROUP BY tid),
coded AS (SELECT len(l) AS n, array_to_string([chr(19968 + list_position(l, x)::INT) for x in l], '') AS a, array_to_string([chr(19968 + list_position(l, x)::INT) for x in r], '') AS b FROM leaves)"""


@query(f"WITH {TREES_SQL} SELECT round(avg(levenshtein(a, b) / n::DOUBLE), 6) AS instability FROM coded")
def tree_instability(spark: SparkSession, d: str) -> DataFrame:
    tx = T.stream(spark, d)
    paths = trie.leaves(trie.tree(tx, "alphabetical"))
    items = counting.item_counts(tx).select("item")
    from pyspark.sql import Window

    table = items.select(F.lit(0).alias("k"), "item", F.row_number().over(Window.orderBy(F.col("item").desc())).alias("rank"))
    return trie.instability(paths, table).select(F.round("instability", 6).alias("instability"))


@query(f"WITH {TREES_SQL} SELECT round(avg((levenshtein(a, b) / n::DOUBLE) ** 2), 6) AS instability FROM coded")
def tree_instability_between(spark: SparkSession, d: str) -> DataFrame:
    tx = T.stream(spark, d)
    from pyspark.sql import Window

    up = trie.ranks(tx, "alphabetical")
    down = up.select("item", F.row_number().over(Window.orderBy(F.col("item").desc())).alias("rank"))
    return trie.instability_between(trie.leaves(trie.tree(tx, "alphabetical")), up.withColumn("k", F.lit(0)), down).select(F.round("instability", 6).alias("instability"))


@query("""WITH s AS (SELECT item, row_number() OVER (ORDER BY item) AS rank FROM userday GROUP BY item), q AS (SELECT item, row_number() OVER (ORDER BY item DESC) AS rank FROM userday GROUP BY item),
x AS (SELECT DISTINCT k, array_to_string(i[:k], ' ') AS p, i[k] AS item FROM (SELECT list(item ORDER BY rank) AS i FROM userday JOIN s USING (item) GROUP BY tid), unnest(range(1, len(i) + 1)) AS t(k)),
y AS (SELECT DISTINCT k, i[k] AS item FROM (SELECT list(item ORDER BY rank) AS i FROM userday JOIN q USING (item) GROUP BY tid), unnest(range(1, len(i) + 1)) AS t(k))
SELECT round(100.0::DOUBLE * (1 + count(*) FILTER (EXISTS (SELECT 1 FROM y WHERE y.item = x.item AND abs(y.k - x.k) <= 1))) / (1 + count(*)), 6) AS similarity FROM x""")
def tree_similarity(spark: SparkSession, d: str) -> DataFrame:
    tx = T.userday(spark, d)
    from pyspark.sql import Window

    up = trie.ranks(tx, "alphabetical")
    down = up.select("item", F.row_number().over(Window.orderBy(F.col("item").desc())).alias("rank"))
    return trie.similarity(trie.prefixes(trie.ordered(tx, up)), trie.prefixes(trie.ordered(tx, down))).select(F.round("similarity", 6).alias("similarity"))


@query("""WITH c AS (SELECT unnest(['click view', 'error', 'click purchase signup', 'view nosuch']) AS items), m AS (SELECT items, unnest(string_split(items, ' ')) AS item, len(string_split(items, ' ')) AS k FROM c),
h AS (SELECT items, tid FROM m JOIN userday USING (item) GROUP BY items, tid, k HAVING count(*) = k)
SELECT items, (SELECT count(*) FROM h WHERE h.items = c.items)::BIGINT AS count FROM c""")
def itemset_counts(spark: SparkSession, d: str) -> DataFrame:
    sets = spark.createDataFrame([(x.split(),) for x in ("click view", "error", "click purchase signup", "view nosuch")], "items array<string>")
    return counting.count_itemsets(T.userday(spark, d), sets).select(F.when(F.array_contains("items", "nosuch"), "view nosuch").otherwise(F.array_join("items", " ")).alias("items"), "count")


@query("SELECT item, count(*)::BIGINT AS count FROM stream GROUP BY item")
def bitmap_counts(spark: SparkSession, d: str) -> DataFrame:
    return counting.count_by_bitmaps(counting.tid_lists(T.stream(spark, d)))


@query(f"SELECT item, count(*) FILTER (tid >= {HALF})::BIGINT AS count FROM stream GROUP BY item")
def retracted_counts(spark: SparkSession, d: str) -> DataFrame:
    tx = T.stream(spark, d)
    half = tx.agg(F.max("tid")).first()[0] // 2
    return counting.retract(counting.item_counts(tx), counting.item_counts(tx.where(F.col("tid") < half)))


@query("""WITH b AS (SELECT tid, list_sort(list(item)) AS i FROM userday GROUP BY tid)
SELECT array_to_string(x.i, ' ') AS a, array_to_string(y.i, ' ') AS b, len(list_intersect(x.i, y.i))::INT AS common, array_to_string(list_sort(list_distinct(list_concat(x.i, y.i))), ' ') AS either, array_to_string(list_sort([k for k in x.i if NOT list_contains(y.i, k)]), ' ') AS only_a FROM (SELECT DISTINCT i FROM b) x, (SELECT DISTINCT i FROM b) y""")
def itemset_algebra(spark: SparkSession, d: str) -> DataFrame:
    s = T.userday(spark, d).select("items").distinct()  # 31 at most, of five event types
    p = F.broadcast(s.select(F.col("items").alias("a"), F.lit(1).alias("one"))).join(s.select(F.col("items").alias("b"), F.lit(1).alias("one")), "one")
    a, b = F.col("a"), F.col("b")
    return p.select(itemsets.text(a).alias("a"), itemsets.text(b).alias("b"), itemsets.intersection_size(a, b).alias("common"), itemsets.text(itemsets.union(a, b)).alias("either"), itemsets.text(itemsets.difference(a, b)).alias("only_a"))


def _events(events: list[dict], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e["run"], e["first"], e["last"], e["forgotten"]) for e in events], "run int, first long, last long, forgotten long")


def _rules(rules: DataFrame, *more: str) -> DataFrame:
    return rules.select(*more, F.array_join("antecedent", " ").alias("antecedent"), F.array_join("consequent", " ").alias("consequent"), "count", F.round("confidence", 6).alias("confidence"), F.round("lift", 6).alias("lift"))


# Those of the queries above that end at a size, with sets of any size: the test data's transactions have at most as many
# items as the SQL has levels (five event types, four attributes of an event).

LEVELS_5 = LEVELS.replace("sets AS (", """f5 AS (SELECT x.item AS a, y.item AS b, z.item AS c, w.item AS d, v.item AS e, count(*) AS count FROM k x JOIN k y ON x.tid = y.tid AND x.item < y.item JOIN k z ON x.tid = z.tid AND y.item < z.item JOIN k w ON x.tid = w.tid AND z.item < w.item JOIN k v ON x.tid = v.tid AND w.item < v.item GROUP BY 1, 2, 3, 4, 5 HAVING count(*) / (SELECT n FROM n)::DOUBLE >= {s}),
sets AS (SELECT a || ' ' || b || ' ' || c || ' ' || d || ' ' || e AS items, 5 AS size, count FROM f5 UNION ALL """)
#: All splits of sets (items, size, count, more), supports as shares of n.
SPLITS = """m AS (SELECT {by} string_split(items, ' ') AS i, size, count, unnest(range(1, (1 << size) - 1)) AS m FROM sets WHERE size > 1),
r AS (SELECT {by} count, array_to_string([i[j + 1] for j in range(0, size) if (m >> j) & 1 = 1], ' ') AS x, array_to_string([i[j + 1] for j in range(0, size) if (m >> j) & 1 = 0], ' ') AS y FROM m),
c AS (SELECT {r_by} x AS antecedent, y AS consequent, r.count, (r.count / {n}) / (sa.count / {n}) AS confidence, sb.count / {n} AS sb FROM r JOIN sets sa ON sa.items = x {on_a} JOIN sets sb ON sb.items = y {on_b})
SELECT {by} antecedent, consequent, count::BIGINT AS count, round(confidence, 6) AS confidence, round(confidence / sb, 6) AS lift FROM c WHERE confidence > {conf} AND confidence / sb > {lift}"""
BLOCKS_4 = BLOCKS_SQL.replace("sets AS (", f"""f4 AS (SELECT x.block, x.item || ' ' || y.item || ' ' || z.item || ' ' || w.item AS items, 4 AS size, count(*)::BIGINT AS count FROM e x JOIN e y ON x.tid = y.tid AND x.item < y.item JOIN e z ON x.tid = z.tid AND y.item < z.item JOIN e w ON x.tid = w.tid AND z.item < w.item GROUP BY ALL HAVING count(*) / {BLOCK}.0::DOUBLE >= 0.05),
sets AS (SELECT * FROM f4 UNION ALL """)


@query(f"WITH {LEVELS_5.format(v='userday', s=0.0)} SELECT items, size, count::BIGINT AS count FROM sets WHERE count >= 600")
def min_count_filter_all(spark: SparkSession, d: str) -> DataFrame:
    return _text(mining.apriori(T.userday(spark, d), mining.min_count(600)))


@query(f"WITH {LEVELS_5.format(v='userday', s=0.01)} SELECT items, size, count::BIGINT AS count FROM sets")
def frequent_all_apriori_all(spark: SparkSession, d: str) -> DataFrame:
    return _text(mining.frequent_itemsets(T.userday(spark, d), 0.01, "apriori"))


@query(f"WITH {LEVELS_5.format(v='userday', s=0.02)}, {SPLITS.format(by='', r_by='', on_a='', on_b='', n='(SELECT n FROM n)::DOUBLE', conf=0.3, lift=0.5)}")
def rules_all_splits_all(spark: SparkSession, d: str) -> DataFrame:
    tx = written(T.userday(spark, d))
    n = tx.count()
    return _rules(mining.association_rules(mining.frequent_itemsets(tx, 0.02, n=n), n, 0.3, 0.5))


@query(f"WITH {BLOCKS_4} SELECT block, items, size, count FROM sets")
def block_itemsets_all(spark: SparkSession, d: str) -> DataFrame:
    return _text(mining.block_itemsets(T.stream(spark, d), BLOCK, 0.05), "block")


@query(f"WITH {BLOCKS_4}, {SPLITS.format(by='block,', r_by='r.block,', on_a='AND sa.block = r.block', on_b='AND sb.block = r.block', n=f'{BLOCK}.0::DOUBLE', conf=0.2, lift=1.0)}")
def block_rules_all(spark: SparkSession, d: str) -> DataFrame:
    return _rules(mining.association_rules(mining.block_itemsets(T.stream(spark, d), BLOCK, 0.05), BLOCK, 0.2, 1.0, by=["block"]), "block")


def ssdd_drift(spark: SparkSession, d: str) -> DataFrame:
    o = modes.Options("SSDD", min_support=0.05, block_size=BLOCK, tree_drift=0.1, item_drift=0.9)
    return _events(drift.detect(T.stream(spark, d), o, flush=True), spark)


def dbdd_drift(spark: SparkSession, d: str) -> DataFrame:
    return _events(drift.detect(T.stream(spark, d), modes.Options("DBDD", min_support=0.05, delta=0.05), flush=True), spark)


def ddtree_drift(spark: SparkSession, d: str) -> DataFrame:
    o = modes.Options("DDTreeStream", min_support=0.05, block_size=BLOCK, sort_interval=500, stop_depth=3)
    return spark.createDataFrame([(e["run"], e["first"], e["last"], e["similarity"], e["drift"]) for e in drift.dd_tree(T.stream(spark, d), o)], "run int, first long, last long, similarity double, drift boolean")


def ssdd_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    w = drift.Window(1000)
    for end in range(999, T.stream(spark, d).count(), 1000):
        w = w.passed(end, adaptive=True)
    return spark.createDataFrame(list(w.points), "first long, last long")


def spo_resorts(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(modes.resort_points(T.stream(spark, d), 500, 0.02), "tid long, entropy double")


@query("""WITH e AS (SELECT tid, unnest(['flag=' || l_returnflag, 'status=' || l_linestatus, 'year=' || year(l_shipdate)]) AS item FROM (SELECT row_number() OVER () AS tid, * FROM lineitem)),
n AS (SELECT count(*) AS n FROM lineitem), c AS (SELECT item, count(*) AS c FROM e GROUP BY item),
p AS (SELECT x.item AS a, y.item AS b, count(*) AS count FROM e x JOIN e y ON x.tid = y.tid AND x.item < y.item GROUP BY 1, 2),
q AS (SELECT x.item AS a, y.item AS b, z.item AS c, count(*) AS count FROM e x JOIN e y ON x.tid = y.tid AND x.item < y.item JOIN e z ON x.tid = z.tid AND y.item < z.item GROUP BY 1, 2, 3),
asked AS (SELECT a || ' ' || b AS items, 2 AS size, p.count, x.c AS x, y.c AS y, n FROM p JOIN c x ON x.item = a JOIN c y ON y.item = b, n UNION ALL
SELECT q.a || ' ' || q.b || ' ' || q.c, 3, q.count, least(x.c, y.c, z.c), CASE WHEN x.c <= y.c AND x.c <= z.c THEN yz.count WHEN y.c <= z.c THEN xz.count ELSE xy.count END, n FROM q JOIN c x ON x.item = q.a JOIN c y ON y.item = q.b JOIN c z ON z.item = q.c JOIN p xy ON xy.a = q.a AND xy.b = q.b JOIN p xz ON xz.a = q.a AND xz.b = q.c JOIN p yz ON yz.a = q.b AND yz.b = q.c, n),
t AS (SELECT *, unnest(range(greatest(0, x + y - n), least(x, y) + 1)) AS k FROM asked),
u AS (SELECT *, sum(exp(lgamma(y + 1) + lgamma(n - y + 1) + lgamma(x + 1) + lgamma(n - x + 1) - lgamma(k + 1) - lgamma(y - k + 1) - lgamma(x - k + 1) - lgamma(n - x - y + k + 1) - lgamma(n + 1))) OVER (PARTITION BY items ORDER BY k ROWS UNBOUNDED PRECEDING) AS s FROM t),
m AS (SELECT items, size, count, coalesce(min(k) FILTER (s > 0.999), least(any_value(x), any_value(y))) AS bound FROM u GROUP BY items, size, count),
good AS (SELECT items, size, count FROM m WHERE count > bound)
SELECT item AS items, 1 AS size, c::BIGINT AS count FROM c UNION ALL SELECT items, size, count::BIGINT FROM good WHERE size = 2 UNION ALL
SELECT items, size, count::BIGINT FROM good g WHERE size = 3 AND (SELECT count(*) FROM good h WHERE h.size = 2 AND list_has_all(string_split(g.items, ' '), string_split(h.items, ' '))) = 3""")
def minabssup_mode(spark: SparkSession, d: str) -> DataFrame:
    """Sets that occur more often than by chance: attributes of line items, numbered by their order, part and line."""
    lines = T.table(spark, d, "lineitem")
    tid = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    items = F.array(F.concat(F.lit("flag="), "l_returnflag"), F.concat(F.lit("status="), "l_linestatus"), F.concat(F.lit("year="), F.year("l_shipdate").cast("string")))
    tx = lines.select(tid.alias("tid"), items.alias("items"))
    return _text(modes.run(tx, modes.Options("minabssup")).itemsets)


# Trees cut at a depth, and modes that order items in their own way.

SLICED_SETS = """f1 AS (SELECT {by} i[1] AS items, 1 AS size, count(*) AS count FROM s1 GROUP BY ALL),
f2 AS (SELECT {by} i[1] || ' ' || i[2] AS items, 2 AS size, count(*) AS count FROM s2 GROUP BY ALL),
f3 AS (SELECT {by} i[1] || ' ' || i[2] || ' ' || i[3] AS items, 3 AS size, count(*) AS count FROM s3 GROUP BY ALL),
sets AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3)"""
#: Subsets of at most three items, from sorted lists.
SUBSETS = """s1 AS (SELECT {by} [unnest(items)] AS i FROM t),
s2 AS (SELECT {by} [items[a], items[b]] AS i FROM t, unnest(range(1, len(items))) AS x(a), unnest(range(2, len(items) + 1)) AS y(b) WHERE a < b),
s3 AS (SELECT {by} [items[a], items[b], items[c]] AS i FROM t, unnest(range(1, len(items) - 1)) AS x(a), unnest(range(2, len(items))) AS y(b), unnest(range(3, len(items) + 1)) AS z(c) WHERE a < b AND b < c)"""


@query(f"""WITH {RANK_SQL.format(v='userday')}, t AS (SELECT list_sort(items[:3]) AS items FROM o), {SUBSETS.format(by='')}, {SLICED_SETS.format(by='')}
SELECT items, size::INT AS size, count::BIGINT AS count FROM sets WHERE count / (SELECT count(*) FROM o)::DOUBLE >= 0.02""")
def fptree_pruned(spark: SparkSession, d: str) -> DataFrame:
    return _text(modes.run(T.userday(spark, d), modes.Options("fptree", min_support=0.02, prune_depth=4)).itemsets)


@query(f"""WITH a AS (SELECT item, min(tid * 1000 + pos) AS seen FROM (SELECT tid, item, row_number() OVER (PARTITION BY tid ORDER BY item) AS pos FROM userday) GROUP BY item),
t AS (SELECT list_sort((list(item ORDER BY seen))[:2]) AS items FROM userday JOIN a USING (item) GROUP BY tid), {SUBSETS.format(by='')}, {SLICED_SETS.format(by='')}
SELECT items, size::INT AS size, count::BIGINT AS count FROM sets WHERE count / (SELECT count(*) FROM t)::DOUBLE >= 0.02""")
def cantree_pruned(spark: SparkSession, d: str) -> DataFrame:
    return _text(modes.run(T.userday(spark, d), modes.Options("cantree", min_support=0.02, prune_depth=3)).itemsets)


IN_BLOCKS = f"""e AS (SELECT tid, tid // {BLOCK} AS block, item, row_number() OVER (PARTITION BY tid ORDER BY item) AS pos FROM stream WHERE tid // {BLOCK} IN (SELECT tid // {BLOCK} FROM (SELECT DISTINCT tid FROM stream) GROUP BY 1 HAVING count(*) = {BLOCK})),
seen AS (SELECT block, item, min(tid * 1000 + pos) AS seen, count(*) AS now FROM e GROUP BY ALL)"""
MINED = f"""{SUBSETS.format(by='block,')}, {SLICED_SETS.format(by='block,')} SELECT block, items, size::INT AS size, count::BIGINT AS count FROM sets WHERE count / {BLOCK}.0::DOUBLE >= 0.02"""


@query(f"""WITH {IN_BLOCKS}, n AS (SELECT {BLOCK}.0::DOUBLE AS n), s AS (SELECT block, item, count(*) / any_value(n) AS s FROM e, n GROUP BY ALL),
g AS (SELECT x.block, x.item AS a, y.item AS b, count(*) / any_value(n) AS xy FROM e x JOIN e y ON x.tid = y.tid AND x.item <> y.item, n GROUP BY ALL),
v AS (SELECT g.block, a AS item, sum(-xy * ln(xy / x.s) - (x.s - xy) * ln((x.s - xy + 1e-6) / x.s) - xy * ln(xy / y.s) - (y.s - xy) * ln((y.s - xy + 1e-6) / y.s)) / 2 AS value FROM g JOIN s x ON x.block = g.block AND x.item = a JOIN s y ON y.block = g.block AND y.item = b GROUP BY ALL),
t AS (SELECT block, list_sort((list(item ORDER BY value DESC, seen))[:3]) AS items FROM e JOIN v USING (block, item) JOIN seen USING (block, item) WHERE value > 0.6 GROUP BY block, tid), {MINED}""")
def disctree_mode(spark: SparkSession, d: str) -> DataFrame:
    o = modes.Options("disctree", min_support=0.02, block_size=BLOCK, sort_interval=BLOCK, prune_depth=4, min_disc=0.6)
    return _text(modes.run(T.stream(spark, d), o).itemsets, "block")


@query(f"""WITH {IN_BLOCKS}, w AS (SELECT b.block, ((b.block + 1) * {BLOCK}) // 1000 * 1000 AS upto FROM (SELECT DISTINCT block FROM e) b),
v AS (SELECT w.block, s.item, count(*) AS value FROM w JOIN stream s ON s.tid < upto AND s.tid >= upto - {BLOCK} GROUP BY ALL),
t AS (SELECT e.block, list_sort((list(e.item ORDER BY value DESC NULLS LAST, seen))[:2]) AS items FROM e JOIN seen ON seen.block = e.block AND seen.item = e.item LEFT JOIN v ON v.block = e.block AND v.item = e.item GROUP BY e.block, tid), {MINED}""")
def cptree_stream_pruned(spark: SparkSession, d: str) -> DataFrame:
    o = modes.Options("cptreeStream", min_support=0.02, block_size=BLOCK, sort_interval=1000, prune_depth=3)
    return _text(modes.run(T.stream(spark, d), o).itemsets, "block")


@query(f"""WITH {IN_BLOCKS}, c AS (SELECT block, item, count(*) FILTER (tid % {BLOCK} < {BLOCK // 2}) AS prev, count(*) AS now FROM e GROUP BY ALL),
v AS (SELECT block, item, CASE WHEN sqrt(ln(1000) / (2 * {BLOCK})) < 2 * ((now - prev) - prev) / {BLOCK}.0::DOUBLE THEN 2 * now / {BLOCK}.0::DOUBLE ELSE (now + 2 * (now - prev) - prev) / {BLOCK}.0::DOUBLE END AS value FROM c),
t AS (SELECT block, list_sort((list(item ORDER BY value DESC, seen))[:2]) AS items FROM e JOIN v USING (block, item) JOIN seen USING (block, item) GROUP BY block, tid), {MINED}""")
def extrap_stream_pruned(spark: SparkSession, d: str) -> DataFrame:
    o = modes.Options("ExtrapStream", min_support=0.02, block_size=BLOCK, prune_depth=3)
    return _text(modes.run(T.stream(spark, d), o).itemsets, "block")


@query(f"""WITH {IN_BLOCKS} SELECT block, item, row_number() OVER (PARTITION BY block ORDER BY now DESC, seen)::INT AS rank FROM seen""")
def spotree_stream_order(spark: SparkSession, d: str) -> DataFrame:
    return modes.run(T.stream(spark, d), modes.Options("spotreeStream", min_support=0.5, block_size=BLOCK, entropy_threshold=0.02)).order


@query("""WITH p AS (SELECT tid, tid // 500 AS part, item, row_number() OVER (PARTITION BY tid ORDER BY item) AS pos FROM stream),
s AS (SELECT item, min(part) AS first, min(tid * 1000 + pos) AS seen FROM p GROUP BY item), k AS (SELECT unnest(range(0, (SELECT max(part) + 1 FROM p))) AS part),
c AS (SELECT k.part, s.item, any_value(first) AS first, any_value(seen) AS seen, count(*) AS n FROM k JOIN s ON first <= k.part JOIN p ON p.item = s.item AND p.part <= k.part GROUP BY ALL)
SELECT part, item, row_number() OVER (PARTITION BY part ORDER BY n DESC, seen)::INT AS rank, first FROM c""")
def running_ranks(spark: SparkSession, d: str) -> DataFrame:
    return modes.running_ranks(T.stream(spark, d), 500)


# Trees: removal, other orders, chains, conditional trees, connections.

SECOND = "userday WHERE tid % 2 = 1"


@query(f"""WITH r AS (SELECT item, row_number() OVER (ORDER BY count(*) DESC, min(tid * 1000 + pos)) AS rank FROM (SELECT tid, item, row_number() OVER (PARTITION BY tid ORDER BY item) AS pos FROM userday) GROUP BY item),
o AS (SELECT tid, list(item ORDER BY rank) AS items FROM (SELECT * FROM {SECOND}) JOIN r USING (item) GROUP BY tid)
SELECT array_to_string(items[:k], ' ') AS prefix, k::INT AS depth, count(*)::BIGINT AS count FROM o, unnest(range(1, len(items) + 1)) AS t(k) GROUP BY ALL""")
def trie_removal(spark: SparkSession, d: str) -> DataFrame:
    """All transactions come, those of even number go again."""
    tx = T.userday(spark, d)
    o = trie.ordered(tx, trie.ranks(tx))
    both = o.withColumn("w", F.lit(1)).unionByName(o.where("tid % 2 = 0").withColumn("w", F.lit(-1)))
    return trie.prefixes(both, F.col("w")).select(F.array_join("prefix", " ").alias("prefix"), "depth", "count")


@query(f"""WITH r AS (SELECT item, row_number() OVER (ORDER BY n DESC NULLS LAST, seen) AS rank FROM (SELECT item, min(tid * 1000 + pos) AS seen FROM (SELECT tid, item, row_number() OVER (PARTITION BY tid ORDER BY item) AS pos FROM userday) GROUP BY item) LEFT JOIN (SELECT item, count(*) AS n FROM {SECOND} GROUP BY item) USING (item)),
o AS (SELECT tid, list(item ORDER BY rank) AS items FROM userday JOIN r USING (item) GROUP BY tid)
SELECT array_to_string(items[:k], ' ') AS prefix, k::INT AS depth, count(*)::BIGINT AS count FROM o, unnest(range(1, len(items) + 1)) AS t(k) GROUP BY ALL""")
def trie_resorted(spark: SparkSession, d: str) -> DataFrame:
    """The tree of all transactions, sorted by the frequencies of some."""
    tx = T.userday(spark, d)
    rank = trie.ranks_by(counting.item_counts(tx.where("tid % 2 = 1")), "count", tx)
    return trie.prefixes(trie.ordered(tx, rank)).select(F.array_join("prefix", " ").alias("prefix"), "depth", "count")


@query(f"""WITH {RANK_SQL.format(v='userday')}, w AS (SELECT depth, count(*) AS wide FROM nodes GROUP BY depth), c AS (SELECT left(prefix, len(prefix) - len(item) - 1) AS p, prefix FROM nodes)
SELECT 'all' AS tree, max(wide) = 1 AND count(*) >= 2 AS single FROM w UNION ALL
SELECT 'first', (SELECT count(*) FROM (SELECT item FROM userday WHERE tid = (SELECT min(tid) FROM (SELECT tid FROM userday GROUP BY tid HAVING count(*) > 1)))) >= 2""")
def single_path(spark: SparkSession, d: str) -> DataFrame:
    """Whether the tree of all transactions, and that of the first with two items and more, is a chain."""
    tx = T.userday(spark, d)
    first = tx.where(F.size("items") > 1).agg(F.min_by("items", "tid").alias("items")).select(F.lit(0).alias("tid"), "items")
    return spark.createDataFrame([("all", trie.has_single_path(trie.tree(tx))), ("first", trie.has_single_path(trie.tree(first)))], "tree string, single boolean")


@query(f"""WITH {RANK_SQL.format(v='userday')}, b AS (SELECT row_number() OVER () AS id, string_split(left(prefix, len(prefix) - len(item) - 1), ' ') AS i, count FROM nodes WHERE item = 'purchase' AND depth > 1),
x AS (SELECT id, count, k AS pos, i[k] AS item FROM b, unnest(range(1, len(i) + 1)) AS t(k)),
f AS (SELECT item, sum(count) AS f, min(pos) AS p FROM x GROUP BY item HAVING sum(count) >= 100), k AS (SELECT item, row_number() OVER (ORDER BY f DESC, p, item) AS rank FROM f),
c AS (SELECT id, any_value(count) AS count, list(item ORDER BY rank) AS items FROM x JOIN k USING (item) GROUP BY id)
SELECT array_to_string(items[:k], ' ') AS prefix, k::INT AS depth, sum(count)::BIGINT AS count FROM c, unnest(range(1, len(items) + 1)) AS t(k) GROUP BY ALL""")
def conditional_tree(spark: SparkSession, d: str) -> DataFrame:
    return trie.conditional_tree(trie.tree(T.userday(spark, d)), "purchase", 100).select(F.array_join("prefix", " ").alias("prefix"), "depth", "count")


@query(f"""WITH {RANK_SQL.format(v='userday')}, l AS (SELECT string_split(prefix, ' ') AS i, count FROM nodes x WHERE NOT EXISTS (SELECT 1 FROM nodes y WHERE y.depth = x.depth + 1 AND starts_with(y.prefix, x.prefix || ' '))),
m AS (SELECT i, count, unnest(range(1, 1 << len(i))) AS m FROM l)
SELECT array_to_string([i[j + 1] for j in range(0, len(i)) if (m >> j) & 1 = 1], ' ') AS items, sum(count)::BIGINT AS count FROM m GROUP BY 1""")
def path_patterns(spark: SparkSession, d: str) -> DataFrame:
    found = trie.patterns_in_path(trie.leaves(trie.tree(T.userday(spark, d))))
    return found.select(F.array_join("items", " ").alias("items"), "count")


@query(f"""WITH RECURSIVE {RANK_SQL.format(v='userday')}, g AS (SELECT DISTINCT p[-2] AS a, p[-1] AS b FROM (SELECT string_split(prefix, ' ') AS p FROM nodes WHERE depth > 1)),
f AS (SELECT item, count(*) // 400 AS f FROM userday GROUP BY item),
reach AS (SELECT a, b FROM g UNION SELECT reach.a, g.b FROM reach JOIN g ON g.a = reach.b JOIN f x ON x.item = reach.b JOIN f y ON y.item = g.b WHERE x.f = y.f)
SELECT a, b FROM reach""")
def reachable_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Connections, also through items as frequent as their end, to the next 400."""
    tx = T.userday(spark, d)
    coarse = counting.item_counts(tx).withColumn("count", F.floor(F.col("count") / 400))
    return trie.reachable(trie.edges(trie.tree(tx)), coarse)


@query(f"""WITH {RANK_SQL.format(v='userday')} SELECT CASE WHEN item IS NULL THEN 'root' ELSE item END AS item, depth, count FROM (SELECT item, depth, count FROM nodes WHERE depth <= 2 UNION ALL SELECT NULL, 0, 0)""")
def tree_vector(spark: SparkSession, d: str) -> DataFrame:
    return trie.to_vector(trie.tree(T.userday(spark, d)), 2).withColumn("item", F.coalesce("item", F.lit("root")))


# What the detectors measure at a checkpoint, by their own code.

CUTS = f"""p AS (SELECT tid, item, row_number() OVER (PARTITION BY tid ORDER BY item) AS pos FROM stream WHERE tid < (SELECT (max(tid) + 1) // 1000 * 1000 FROM stream)),
n AS (SELECT max(tid) + 1 AS n FROM p), k AS (SELECT k::INT AS k, (k + 1) * 1000 - 1 AS cut FROM n, unnest(range(0, n // 1000)) AS t(k)),
s AS (SELECT item, min(tid * 1000 + pos) AS seen, count(*) AS c FROM p GROUP BY item),
h AS (SELECT k, cut, s.item, any_value(seen) AS seen, any_value(c) AS c, count(*) FILTER (p.tid <= cut) AS had FROM k, s JOIN p ON p.item = s.item GROUP BY k, cut, s.item),
r AS (SELECT k, item, row_number() OVER (PARTITION BY k ORDER BY had DESC, seen) AS old, row_number() OVER (PARTITION BY k ORDER BY c DESC, seen) AS now FROM h),
x AS (SELECT k, tid, list(p.item ORDER BY now) AS a, list(p.item ORDER BY old) AS b FROM p JOIN r ON r.item = p.item GROUP BY k, tid),
d AS (SELECT DISTINCT k, a, b FROM x),
l AS (SELECT k, levenshtein(array_to_string([chr(19968 + list_position(a, z)::INT) for z in a], ''), array_to_string([chr(19968 + list_position(a, z)::INT) for z in b], '')) / len(a)::DOUBLE AS d FROM d),
t AS (SELECT k, avg(d) AS tree, avg(d * d) AS squared FROM l GROUP BY k),
m AS (SELECT h.k, avg((abs(c - had) > sqrt(1 / (1 / n::DOUBLE + 1 / 999.0::DOUBLE) / 2 * ln(4 * (n + 999) / 0.001)))::INT) AS table_, max(CASE WHEN n - cut - 1 > 4 THEN (abs(had / (cut + 1)::DOUBLE - (c - had) / (n - cut - 1)::DOUBLE) > sqrt(2 * (1 / (n - cut - 5)::DOUBLE + 1 / (cut - 3)::DOUBLE) * (c / n::DOUBLE) * (1 - c / n::DOUBLE) * ln(2 * ln(n) / 0.05)) + 2.0::DOUBLE / 3 * ln(2 * ln(n) / 0.05) * (1 / (n - cut - 5)::DOUBLE + 1 / (cut - 3)::DOUBLE))::INT ELSE 0 END) AS cut FROM h, n GROUP BY h.k)"""


@query(f"WITH {CUTS} SELECT k, round(tree, 6) AS tree, round(squared, 6) AS squared, round(table_, 6) AS moved, m.cut = 1 AS apart FROM t JOIN m USING (k)")
def checkpoint_measures(spark: SparkSession, d: str) -> DataFrame:
    """Every thousandth transaction a checkpoint, against the last: instability of the tree and of the table, and whether
    some item is distributed otherwise."""
    tx = T.stream(spark, d)
    points = tuple((at, at + 999) for at in range(0, tx.count() - 999, 1000))
    found = drift.Detector(tx, 1000).measure(0, [(points[-1][1], points)], tree=True, table=True, delta=0.05)
    rows = [(k, round(m.tree, 6), round(m.squared, 6), round(m.table, 6), m.cut) for k, m in enumerate(found[points[-1][1]])]
    return spark.createDataFrame(rows, "k int, tree double, squared double, moved double, apart boolean")


# Reading and writing.


@query("SELECT p_partkey AS tid, array_to_string(list_sort(list_distinct([trim(p_brand), 'size=' || p_size, 'band=' || (p_size // 10)])), ' ') AS items FROM part")
def read_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with runs of delimiters, white space around items and repeated items, read as transactions."""
    c = T.table(spark, d, "part")
    band = F.concat(F.lit("band="), F.floor(F.col("p_size") / 10).cast("string"))
    lines = c.select("p_partkey", F.concat(F.lit(" "), "p_brand", F.lit("\t,, size="), F.col("p_size").cast("string"), F.lit(" ,"), band, F.lit(",  "), "p_brand", F.lit(",\r")).alias("line"))
    # a delimiter before the white space at the end would make an item of nothing: as the end of a line it is cut off
    lines = lines.withColumn("line", F.regexp_replace("line", ",\r$", ""))
    return lines.select(F.col("p_partkey").alias("tid"), F.array_join(F.sort_array(T.items_of_line(F.col("line"))), " ").alias("items"))


@query("WITH o AS (SELECT tid, list_sort(list(item)) AS items FROM basket GROUP BY tid) SELECT row_number() OVER (ORDER BY tid) - 1 AS tid, array_to_string(items, ' ') AS items FROM o")
def numbered_transactions(spark: SparkSession, d: str) -> DataFrame:
    return T.number_transactions(T.basket(spark, d)).select("tid", F.array_join("items", " ").alias("items"))


@query("""WITH r AS (SELECT event_id, event_type, user_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS run FROM events)
SELECT min(event_id) AS tid, array_to_string(list(user_id::VARCHAR ORDER BY event_id), ' ') AS items FROM r GROUP BY event_type, run""")
def consecutive_rows(spark: SparkSession, d: str) -> DataFrame:
    found = T.from_consecutive(T.table(spark, d, "events"), "event_id", "event_type", "user_id")
    return found.select("tid", F.array_join("items", " ").alias("items"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 1000")
def first_thousand(spark: SparkSession, d: str) -> DataFrame:
    return T.first_rows(T.table(spark, d, "events"), "event_id", 1).select("event_id", "user_id", "event_type")


@query(f"WITH {LEVELS.format(v='userday', s=0.02)} SELECT items, round(count / (SELECT n FROM n)::DOUBLE, 6) AS support FROM sets")
def itemset_files(spark: SparkSession, d: str) -> DataFrame:
    """Itemsets written to a file, and read back."""
    path = sinks.itemset_file(shared_path(spark), 0.02)
    sinks.write_itemsets(mining.frequent_itemsets(T.userday(spark, d), 0.02, max_size=4), path)
    return sinks.read_itemsets(spark, path).select(F.array_join("items", " ").alias("items"), F.round("support", 6).alias("support"))


for f in (ssdd_drift, dbdd_drift, ddtree_drift, ssdd_checkpoints, spo_resorts):
    QUERIES[f.__name__] = f
