"""Files of itemsets and rules, their names and the log."""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("harvestry")


def itemset_file(prefix: str, min_support: float, run: int | None = None) -> str:
    return f"{prefix}.itemsets.{min_support:g}{'' if run is None else f'-{run}'}.csv"


def rule_file(prefix: str, min_confidence: float, min_lift: float, min_support: float, run: int | None = None) -> str:
    return f"{prefix}.rules.{min_confidence:g}.{min_lift:g}.{min_support:g}{'' if run is None else f'-{run}'}.csv"


def log_file(prefix: str) -> str:
    return f"{prefix}.log.txt"


def init_log(prefix: str | None = None) -> logging.Logger:
    """Standard output and, with a prefix, a file."""
    close_log()
    log.setLevel(logging.INFO)
    for h in [logging.StreamHandler(sys.stdout), *([logging.FileHandler(log_file(prefix))] if prefix else [])]:
        h.setFormatter(logging.Formatter("%(message)s"))
        log.addHandler(h)
    return log


def close_log() -> None:
    for h in list(log.handlers):
        h.close()
        log.removeHandler(h)


def write_itemsets(itemsets: DataFrame, path: str, count_only: bool = False, min_support: float = 0.0) -> int:
    """Lines `a b c,support`. count_only writes nothing. Returns how many there are; logs a warning if some are below
    min_support."""
    if not count_only:
        support = F.col("support") if "support" in itemsets.columns else F.lit(0)
        itemsets.select(F.concat_ws(",", F.array_join(F.sort_array("items"), " "), support.cast("string"))).write.mode("overwrite").text(path)
        if min_support and "support" in itemsets.columns and (poor := itemsets.where(F.col("support") < min_support).count()):
            log.warning("%d itemsets are below the support of %g", poor, min_support)
    return itemsets.count()


def read_itemsets(spark: SparkSession, path: str) -> DataFrame:
    """(items, support) of such lines; the last comma separates, lines without one are no itemsets."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("v")).where("v LIKE '%,%'")
    return lines.select(F.sort_array(F.filter(F.split(F.regexp_extract("v", r"^(.*),", 1), "[ ]+"), lambda x: x != "")).alias("items"), F.regexp_extract("v", r",([^,]*)$", 1).cast("double").alias("support"))


def write_rules(rules: DataFrame, path: str, count_only: bool = False) -> int:
    """Lines `a b -> c,confidence,lift,count`."""
    if not count_only:
        text = lambda c: F.array_join(F.sort_array(c), " ")
        rules.select(F.concat_ws(",", F.concat(text("antecedent"), F.lit(" -> "), text("consequent")), F.col("confidence").cast("string"), F.col("lift").cast("string"), F.col("count").cast("string"))).write.mode("overwrite").text(path)
    return rules.count()


def append_drift(events: DataFrame, path: str) -> None:
    """Tab-separated rows of drift results, appended."""
    events.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in events.columns))).write.mode("append").text(path)
