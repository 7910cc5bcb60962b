"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

Nearness is the inner product. With one more component, sqrt(m * m - |x|**2) for vectors and 0 for queries, m the largest
length of any vector, distances order as inner products do, and obey the triangle inequality that the trees prune by. A node
has a vantage point and the distances from it at which its inner and outer half begin and end. A query at distance d from the
vantage point can leave a half out if that is more than tau / factor away from d, tau being the distance of its k-th
nearest so far: factor 1 is exact search, larger factors leave out more. Queries go through a tree together, those of
each node in one product of matrices, nearer half first.

Shards hold a bounded number of vectors; queries meet every shard in blocks, a task having a shard and up to `ASKED`
blocks, and what they find in each is merged. The k-th value of a shard is exact for the vectors that were reached: products are taken again component by component, so
equal vectors tie exactly, and ties go to the smaller id.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without id;
rows that share an id are vectors of their own, and if they are queries each has an answer of its own, in which the others
are candidates; a query meets vectors of its own length, which is unbounded but for a shard's memory; with fewer than k
candidates all are found; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestry.llm import common as C

K, FACTOR = 20, 1.0
SHARD, QUERIES, LEAF = 8192, 2048, 256
#: Blocks of queries that one task answers; for more, a shard has a copy for each so many.
ASKED = 64
#: What rounding may cost, relative to the square of the largest length.
SLACK = 1e-9


class Tree:
    """A vantage-point tree over vectors x of one length, lifted by the largest length m of all shards."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, m: float, leaf: int = LEAF, rows: np.ndarray | None = None):
        """rows: numbers of the rows, if ids are not unique."""
        self.m = m
        lift = np.sqrt(np.maximum(0.0, m * m - (x * x).sum(1)))
        self.full = np.hstack([x, lift[:, None]])
        self.nodes: list[tuple] = []  # (vantage row, inner low, inner high, outer low, outer high, inner, outer) or (begin, end)
        draw = np.random.default_rng(len(ids))
        place = np.arange(len(ids))

        def build(lo: int, hi: int) -> int:
            at = len(self.nodes)
            self.nodes.append(())
            if hi - lo <= leaf:
                self.nodes[at] = (lo, hi)
                return at
            rows = place[lo:hi]
            v = rows[draw.integers(len(rows))]
            d = np.sqrt(np.maximum(0.0, ((self.full[rows] - self.full[v]) ** 2).sum(1)))
            by = np.argsort(d, kind="stable")
            place[lo:hi], d = rows[by], d[by]
            mid = (hi - lo) // 2
            bounds = (float(d[0]), float(d[mid - 1]), float(d[mid]), float(d[-1]))
            self.nodes[at] = (int(v), *bounds, build(lo, lo + mid), build(lo + mid, hi))
            return at

        self.root = build(0, len(ids)) if len(ids) else -1
        self.vantage = {n[0]: self.full[n[0]] for n in self.nodes if len(n) == 7}
        self.ids, self.rows, self.x, self.full = ids[place], (ids if rows is None else rows)[place], x[place], None
        self.visited = 0

    def search(self, own: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and product of the k nearest of each query (all that tie are cut by id); own: the queries' rows."""
        n, slack = len(q), SLACK * max(self.m * self.m, 1e-300)
        lengths = (q * q).sum(1)
        products = np.full((n, k), -np.inf)  # the k largest so far, unordered
        # what can still come among the first k, as flat lists
        found: list[list[np.ndarray]] = [[] for _ in range(3)]

        def leaf(lo: int, hi: int, who: np.ndarray) -> None:
            self.visited += len(who) * (hi - lo)
            p = q[who] @ self.x[lo:hi].T
            p[own[who][:, None] == self.rows[None, lo:hi]] = -np.inf
            least = products[who].min(1)
            i, j = np.nonzero((p >= least[:, None] - slack) & (p > -np.inf))
            if not len(i):
                return
            found[0].append(who[i])
            found[1].append(lo + j)
            found[2].append(p[i, j])
            both = np.hstack([products[who], p])
            products[who] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]

        def go(at: int, who: np.ndarray) -> None:
            if not len(who):
                return
            node = self.nodes[at]
            if len(node) == 2:
                leaf(*node, who)
                return
            v, in_lo, in_hi, out_lo, out_hi, inner, outer = node
            vp = self.vantage[v]
            d = np.sqrt(np.maximum(0.0, lengths[who] + self.m * self.m - 2 * (q[who] @ vp[:-1])))
            first_in = d < (in_hi + out_lo) / 2
            low = {inner: np.maximum(np.maximum(in_lo - d, d - in_hi), 0.0), outer: np.maximum(np.maximum(out_lo - d, d - out_hi), 0.0)}
            for near in (inner, outer):
                far = outer if near == inner else inner
                mine = first_in if near == inner else ~first_in
                for child in (near, far):
                    # distance of the k-th so far; what rounds is given room
                    tau = np.sqrt(np.maximum(0.0, lengths[who] + self.m * self.m - 2 * products[who].min(1)) + 2 * slack)
                    go(child, who[mine & (low[child] <= tau / factor + 1e-7 * self.m)])

        with np.errstate(invalid="ignore"):
            if self.root >= 0:
                go(self.root, np.arange(n))
        if not found[0]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        i, j, p = (np.concatenate(x) for x in found)
        keep = p >= products.min(1)[i] - slack
        i, j = i[keep], j[keep]
        exact = np.zeros(len(i))
        for c in range(q.shape[1]):  # component by component: the same sum wherever the pair is computed
            exact += q[i, c] * self.x[j, c]
        order = np.lexsort((self.ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        return i[keep], self.ids[j][keep], exact[keep]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _search(k: int, factor: float, m: float):
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by shard, the vectors (block -1) before the blocks of queries."""
        now, held, tree = None, [], None

        def ask(block: list[tuple]) -> pa.RecordBatch:
            row, own, q = (np.concatenate(x) for x in zip(*block, strict=True))
            i, vec, p = tree.search(row, q, k, factor)
            return pa.RecordBatch.from_arrays([pa.array(row[i]), pa.array(own[i]), pa.array(vec), pa.array(p)], schema=schema)

        pending, which = [], None
        for b in batches:
            shard, block, dim = (np.asarray(b.column(i)) for i in range(3))
            cut = np.flatnonzero((shard[1:] != shard[:-1]) | (block[1:] != block[:-1])) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
                if hi <= lo:
                    continue
                key = (int(shard[lo]), int(block[lo]))
                if pending and key != which:
                    yield ask(pending)
                    pending = []
                if key[0] != now:
                    now, held, tree = key[0], [], None
                part = b.slice(lo, hi - lo)
                x = (np.asarray(part.column(3)), np.asarray(part.column(4)), _matrix(part.column(5), int(dim[lo])))
                if key[1] < 0:
                    held.append(x)
                elif held or tree:
                    if tree is None:
                        row, ids, vectors = (np.concatenate(y) for y in zip(*held, strict=True))
                        tree, held = Tree(ids, vectors, m, rows=row), []
                    which = key
                    pending.append(x)
        if pending:
            yield ask(pending)

    return C.lean(run)


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda c: c != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of every row that is_query (of column id) holds for."""
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    v = v.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    v = C.written(v.withColumn("row", F.monotonically_increasing_id()))  # written, a row keeps its number
    norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
    stats = v.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.sqrt(F.max(norm)).alias("m")).collect()  # a row for each length of vectors
    deal, base = [], 0
    for r in stats:
        shards, blocks = -(-r["n"] // SHARD), max(1, -(-r["q"] // QUERIES))
        teams = -(-blocks // ASKED)
        deal.append((r["dim"], base, shards, blocks, teams))
        base += shards * teams
    if not deal:
        return v.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    m = max(r["m"] for r in stats) * (1 + 1e-12)
    names = ("base", "shards", "blocks", "teams")
    of = F.create_map(*(x for dim, *plan in deal for x in (F.lit(dim), F.struct(*(F.lit(y).alias(c) for y, c in zip(plan, names, strict=True))))))[F.col("dim")]
    # Hashes deal rows out evenly, so that many rows of an id are no hot shard. A shard is a task for each team of blocks;
    # every query goes to all shards
    shard, block = F.pmod(F.xxhash64("row"), of["shards"]), F.pmod(F.xxhash64("row", F.lit(1)), of["blocks"]).cast("int")
    each = lambda first, last, step: F.explode(F.sequence(first.cast("int"), last.cast("int"), step.cast("int")))
    place = of["base"] + shard * of["teams"]
    mine = v.select(each(place, place + of["teams"] - 1, F.lit(1)).alias("shard"), F.lit(-1).alias("block"), "dim", "row", "id", "v")
    first = of["base"] + F.floor(block / ASKED)
    asked = v.where(is_query).select(each(first, first + (of["shards"] - 1) * of["teams"], of["teams"]).alias("shard"), block.alias("block"), "dim", "row", "id", "v")
    rows = mine.unionByName(asked).repartitionById(base, F.col("shard")).sortWithinPartitions("shard", "block")
    found = rows.mapInArrow(_search(k, factor, m), "query long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's search of all embeddings, exact: factor 1."""
    return nearest(C.table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


OP2_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id, array_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
