"""Transactions: a DataFrame (tid long, items array<string>), items distinct and in the order of their first occurrence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.sources.scratch import written

_ENDS = r"^[ \t\r\n]+|[ \t\r\n]+$"


def tokenize(line: Column, delimiters: str = ",") -> Column:
    """Runs of delimiters count as one; a delimiter at an end makes no empty token."""
    return F.filter(F.split(line, "[" + "".join(f"\\{c}" for c in delimiters) + "]"), lambda t: t != "")


def trim(token: Column) -> Column:
    return F.regexp_replace(token, _ENDS, "")


def items_of_line(line: Column, mode: str = "strict") -> Column:
    """Tokens of a line, trimmed, the first of equal ones kept.

    mode: strict raises for a blank line, an empty item and an item with a space inside; drop gives null for them.
    """
    items = F.transform(tokenize(line), trim)
    bad = (F.size(items) == 0) | F.exists(items, lambda t: (t == "") | t.contains(" "))
    if mode == "strict":
        return F.when(bad, F.raise_error(F.concat(F.lit("not a transaction: "), line)).cast("array<string>")).otherwise(F.array_distinct(items))
    if mode != "drop":
        raise ValueError("mode is strict or drop")
    return F.when(~bad, F.array_distinct(items))


def read_transactions(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """Text files, a transaction a line. tid rises with file and line, by the bytes before the line's part of the file.

    Numbers are unique but have gaps; number_transactions() closes them. A missing path raises AnalysisException.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("tid"))
    return lines.select("tid", items_of_line(F.col("value"), mode).alias("items")).where("items IS NOT NULL")


def parse_lines(spark: SparkSession, lines: list[str], mode: str = "strict") -> DataFrame:
    """Transactions of lines given in a program, numbered from 0."""
    df = spark.createDataFrame(list(enumerate(lines)), "tid long, line string")
    return df.select("tid", items_of_line(F.col("line"), mode).alias("items")).where("items IS NOT NULL")


def load(tx: DataFrame, on_start: Callable[[], None] | None = None, on_load: Callable[[DataFrame], None] | None = None, on_end: Callable[[DataFrame], None] | None = None, batch: int | None = None, on_unload: Callable[[DataFrame], None] | None = None, window: int | None = None) -> DataFrame:
    """Materialises transactions and tells listeners: on_start before, on_load for each batch of so many transactions (all
    of them if not given) as a DataFrame, on_unload for those that each batch pushes out of a window of the last so many,
    and on_end with all of them. What listeners keep is theirs; transactions stay where they are."""
    if on_start:
        on_start()
    tx = written(tx.select("tid", "items"))
    if on_load or on_unload:
        last = tx.agg(F.max("tid")).first()[0]
        step = batch or (0 if last is None else last + 1)
        for at in range(0, 0 if last is None else last + 1, max(1, step)):
            if on_unload and window is not None:
                out = tx.where(F.col("tid").between(max(0, at - window), at + step - window - 1))
                if at + step > window:
                    on_unload(out)
            if on_load:
                on_load(tx.where(F.col("tid").between(at, at + step - 1)))
    if on_end:
        on_end(tx)
    return tx


def number_transactions(tx: DataFrame) -> DataFrame:
    """tx with tid 0, 1, 2, ... in the order of tid. Rows are sorted by ranges of tid that hold about as many each; a sum over
    the ranges, whose number is that of the partitions, gives each its first number."""
    from pyspark.sql import Window

    rows = written(tx.withColumnRenamed("tid", "__tid").repartitionByRange("__tid").withColumn("__p", F.spark_partition_id()))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("__p").count().select(F.col("__p").alias("__o"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    rank = F.row_number().over(Window.partitionBy("__p").orderBy("__tid")) - 1
    out = rows.withColumn("__r", rank).join(F.broadcast(base), F.col("__p") == F.col("__o"))  # a row for each partition
    return out.select((F.col("__base") + F.col("__r")).alias("tid"), *(c for c in tx.columns if c != "tid"))


def from_long(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(key, item) rows to transactions (key, items), items sorted."""
    return rows.groupBy(F.col(key).alias("tid")).agg(F.sort_array(F.collect_set(F.col(item).cast("string"))).alias("items"))


def from_consecutive(rows: DataFrame, order: str, key: str, item: str) -> DataFrame:
    """Consecutive rows with the same key, in the order of a column, as transactions: one key may give several.

    A key's runs are numbered within the key, so that no task sorts the whole table: needs `order` without gaps.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    run = F.col(order) - F.row_number().over(w)
    return rows.withColumn("__run", run).groupBy(key, "__run").agg(F.min(order).alias("tid"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).cast("string").alias("i")))), lambda x: x["i"]).alias("items")).select("tid", "items")


def first_rows(rows: DataFrame, order: str, thousands: int) -> DataFrame:
    """The first thousands of rows, in the order of a column: a split of a long table for trials."""
    return rows.orderBy(order).limit(thousands * 1000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return from_long(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", "p_brand")


def attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of a line item as flag=, status=, qty=, disc=; has no tid."""
    c = table(spark, sf_dir, "lineitem")
    cells = [F.concat(F.lit("flag="), "l_returnflag"), F.concat(F.lit("status="), "l_linestatus"), F.concat(F.lit("qty="), F.floor(F.col("l_quantity") / 10).cast("string")), F.concat(F.lit("disc="), F.round(F.col("l_discount") * 100).cast("int").cast("string"))]
    return c.select(F.sort_array(F.array(*cells)).alias("items"))


def userday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of a user's day."""
    e = table(spark, sf_dir, "events")
    day = F.unix_date(F.col("ts").cast("date"))
    return from_long(e.select((F.col("user_id") * 100000 + day).alias("key"), "event_type"), "key", "event_type")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in their order as type=, hour=, k=, val= in bands."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("tid"),
        F.array(F.concat(F.lit("hour="), F.floor(F.hour("ts") / 6).cast("string")), F.concat(F.lit("k="), F.floor(k / 25).cast("string")), F.concat(F.lit("type="), "event_type"), F.concat(F.lit("val="), F.floor(F.col("value") / 100).cast("string"))).alias("items"),
    )


#: The same views as SQL for DuckDB: (tid, item) rows.
VIEWS_SQL = {
    "basket": "SELECT DISTINCT l_orderkey AS tid, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey",
    "userday": "SELECT DISTINCT user_id * 100000 + date_diff('day', DATE '1970-01-01', ts::DATE) AS tid, event_type AS item FROM events",
    "stream": """SELECT event_id AS tid, unnest(['hour=' || (hour(ts) // 6)::INT, 'k=' || ((json_extract_string(props, '$.k')::INT) // 25), 'type=' || event_type, 'val=' || floor(value / 100)::INT]) AS item FROM events""",
    "attr": """SELECT tid, unnest(['flag=' || l_returnflag, 'status=' || l_linestatus, 'qty=' || floor(l_quantity / 10)::INT, 'disc=' || round(l_discount * 100)::INT]) AS item FROM (SELECT row_number() OVER () AS tid, * FROM lineitem)""",
}


def make_transactions(spark: SparkSession, rows: list[list[str]]) -> DataFrame:
    """In-memory transactions, numbered from 0."""
    return spark.createDataFrame(list(enumerate(rows)), "tid long, items array<string>")
