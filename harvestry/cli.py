"""Command line: python -m harvestry.cli -m MODE -i INPUT -o PREFIX -minsup S ..."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from harvestry.plans import modes
from harvestry.sources import sinks, transactions


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="harvestry", allow_abbrev=False)
    p.add_argument("-m", dest="mode", required=True, choices=[*modes.BATCH, *modes.BLOCKS, *modes.DRIFT])
    p.add_argument("-i", dest="input", required=True)
    p.add_argument("-o", dest="output", required=True)
    numbers = {
        "minsup": ("min_support", float),
        "minconf": ("min_confidence", float),
        "minlift": ("min_lift", float),
        "blockSize": ("block_size", int),
        "cp-sort-interval": ("sort_interval", int),
        "disc-sort-interval": ("sort_interval", int),
        "spo-entropy-threshold": ("entropy_threshold", float),
        "extrap-entropy-threshold": ("half_interval", int),
        "kernel-datapoints": ("kernel_points", int),
        "tree-prune-depth": ("prune_depth", int),
        "min-disc": ("min_disc", float),
        "stopDepth": ("stop_depth", int),
        "cmpDepthTh": ("depth_threshold", int),
        "driftThreshold": ("drift_threshold", float),
        "ssdd-tree-drift-threshold": ("tree_drift", float),
        "ssdd-tree-merge-threshold": ("tree_merge", float),
        "ssdd-item-freq-drift-threshold": ("item_drift", float),
        "ssdd-item-freq-merge-threshold": ("item_merge", float),
        "dbdd-delta": ("delta", float),
    }
    flags = {
        "adaptive-windows": "adaptive",
        "almost-exact": "almost_exact",
        "automatic-ssdd-structural-drift-threshold": "automatic_threshold",
        "ssdd-window-cmp": "compare_windows",
        "ssdd-print-blocks": "print_blocks",
        "dbdd-print-blocks": "print_blocks",
    }
    for name, (dest, kind) in numbers.items():
        p.add_argument(f"-{name}", dest=dest, type=kind, default=argparse.SUPPRESS)
    for name, dest in flags.items():
        p.add_argument(f"-{name}", dest=dest, action="store_true", default=argparse.SUPPRESS)
    p.add_argument("-use-kernel-regressiony", dest="use_kernel", action="store_true")
    p.add_argument("-log-tree-metrics", dest="tree_sizes_at", type=lambda s: [int(x) for x in s.split(",")], default=argparse.SUPPRESS)
    p.add_argument("-driftResultsFile", dest="drift_file")
    p.add_argument("-count-itemsets-only", dest="count_itemsets", action="store_true")
    p.add_argument("-count-rules-only", dest="count_rules", action="store_true")
    return p


def write(result: modes.Result, o: modes.Options, tx, prefix: str, only_sets: bool, only_rules: bool) -> tuple[int, int]:
    """Files of itemsets and rules, one of each for every run, from 1, of modes that have runs; how many there are of both.
    """
    tag = next((c for c in ("run", "block") if c in result.itemsets.columns), None)
    if tag is None:
        parts = [(None, result.itemsets, result.rules, tx.count())]
    else:
        # a row for each run
        sizes = {r["run"]: r["last"] - r["first"] + 1 for r in result.events.collect()} if tag == "run" else {}
        keys = sorted({r[0] for r in result.itemsets.select(tag).distinct().collect()} | set(sizes))
        number = lambda k: k if tag == "run" else k + 1
        parts = [(number(k), result.itemsets.where(F.col(tag) == k), result.rules.where(F.col(tag) == k), sizes.get(k, o.block_size)) for k in keys]
    sets = rules = 0
    for run, s, r, n in parts:
        s = s.withColumn("support", F.col("count") / F.lit(float(max(1, n))))
        sets += sinks.write_itemsets(s, sinks.itemset_file(prefix, o.min_support, run), only_sets, o.min_support)
        rules += sinks.write_rules(r, sinks.rule_file(prefix, o.min_confidence, o.min_lift, o.min_support, run), only_rules)
    return sets, rules


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    given = [a for a in argv if a.startswith("-") and not a.lstrip("-").replace(".", "").isdigit()]
    if len(given) != len(set(given)):
        raise SystemExit("an option is given twice")
    a = vars(parser().parse_args(argv))
    source, prefix, drift_file, only_sets, only_rules, use_kernel = (a.pop(k) for k in ("input", "output", "drift_file", "count_itemsets", "count_rules", "use_kernel"))
    if use_kernel != ("kernel_points" in a):
        raise SystemExit("kernel regression goes with a number of data points")
    o = modes.Options(**a).check()
    spark = SparkSession.builder.appName("harvestry").getOrCreate()
    log, began = sinks.init_log(prefix), time.time()
    tx = transactions.number_transactions(transactions.read_transactions(spark, source))
    result = modes.run(tx, o)
    counted = write(result, o, tx, prefix, only_sets, only_rules)
    log.info("%d itemsets", counted[0])
    log.info("%d rules", counted[1])
    if result.events is not None:
        log.info("%d %s", result.events.count(), "runs" if o.mode in modes.DRIFT else "sorts")
        if o.print_blocks:
            for r in result.events.orderBy("run").collect():
                log.info("run %d: transactions %d to %d, forgotten up to %d", r["run"], r["first"], r["last"], r["forgotten"])
        if drift_file:
            sinks.append_drift(result.events, drift_file)
    if o.tree_sizes_at:
        from harvestry.operators import trie

        for r in trie.sizes_at(tx, trie.ranks(tx), o.tree_sizes_at).orderBy("n").collect():
            log.info("%d nodes after %d transactions", r["nodes"], r["n"])
    log.info("%.1f s", time.time() - began)
    sinks.close_log()
    return 0


if __name__ == "__main__":
    sys.exit(main())
