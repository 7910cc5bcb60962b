"""Itemsets and rules against brute force, and the engines against each other."""

import itertools
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from harvestry.functions import stats
from harvestry.operators import counting, mining
from harvestry.plans import modes
from harvestry.sources import transactions as T
from harvestry.streaming import blocks

FP_TEST = ["i1,i2,i5", "i2,i4", "i2,i3", "i1,i2,i4", "i1,i3", "i2,i3", "i1,i3", "i1,i2,i3,i5", "i1,i2,i3"]
SMALL = ["1,3,4", "2,3,5", "1,2,3,5", "2,5"]


def brute(rows, least):
    items = sorted({x for r in rows for x in r})
    out = {}
    for k in range(1, len(items) + 1):
        for c in itertools.combinations(items, k):
            n = sum(set(c) <= set(r) for r in rows)
            if n and n / len(rows) >= least:
                out[c] = n
    return out


def brute_rules(sets, n, min_confidence, min_lift):
    out = {}
    for s, c in sets.items():
        for k in range(1, len(s)):
            for a in itertools.combinations(s, k):
                b = tuple(x for x in s if x not in a)
                conf = (c / n) / (sets[a] / n)
                if conf > min_confidence and conf / (sets[b] / n) > min_lift:
                    out[a, b] = c
    return out


def as_dict(sets):
    return {tuple(r["items"]): r["count"] for r in sets.collect()}


@pytest.mark.parametrize("engine", ["fpgrowth", "apriori", "mllib"])
@pytest.mark.parametrize(("lines", "support", "n_sets", "n_rules"), [(FP_TEST, 0.2, 13, 6), (SMALL, 0.5, 9, 5), (["a", "b"], 0.2, 2, 0), (["a,b", "a,b,c"], 0.2, 7, 0)])
def test_fixtures(spark, engine, lines, support, n_sets, n_rules):
    tx = T.parse_lines(spark, lines)
    rows = [x.split(",") for x in lines]
    sets = mining.frequent_itemsets(tx, support, engine)
    got = as_dict(sets)
    assert got == brute(rows, support) and len(got) == n_sets
    rules = mining.association_rules(sets, len(rows)).collect()
    want = brute_rules(got, len(rows), 0.9, 1.0)
    assert {(tuple(r["antecedent"]), tuple(r["consequent"])): r["count"] for r in rules} == want and len(want) == n_rules


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=6), min_size=1, max_size=12), st.sampled_from([0.2, 0.5, 1.0]))
def test_engines_agree(spark, rows, support):
    tx = T.make_transactions(spark, [list(dict.fromkeys(r)) for r in rows])
    want = brute(rows, support)
    assert as_dict(mining.frequent_itemsets(tx, support, "fpgrowth")) == want
    assert as_dict(mining.frequent_itemsets(tx, support, "apriori")) == want
    assert as_dict(mining.frequent_itemsets(tx, support, "mllib")) == want
    assert as_dict(mining.frequent_itemsets(tx, support, max_size=2)) == {s: n for s, n in want.items() if len(s) <= 2}
    least = mining.least_count(len(rows), support)
    assert {tuple(s): n for s, n in blocks.mine_block(rows, least)} == want


def test_blocks_equal_batches(spark):
    rows = [["a", "b"], ["a"], ["b", "c"], ["a", "b", "c"], ["c"], ["a", "c"], ["b"]]
    got = {}
    for r in mining.block_itemsets(T.make_transactions(spark, rows), 3, 0.5).collect():
        got.setdefault(r["block"], {})[tuple(r["items"])] = r["count"]
    assert got == {0: brute(rows[:3], 0.5), 1: brute(rows[3:6], 0.5)}


@pytest.mark.parametrize(("a", "b", "n", "want"), [(250, 250, 1000, 81), (250, 500, 1000, 146), (600, 500, 1000, 324), (500, 500, 1000, 274), (500, 1000, 1000, 500), (500, 1000, 10000, 71), (50, 1000, 10000, 12), (50, 5000, 10000, 36)])
def test_min_abs_sup(a, b, n, want):
    assert stats.min_abs_sup(a, b, n, 0.999) == want


def test_least_count():
    assert mining.least_count(100, 0.07) == 7
    assert mining.least_count(10, 0.2) == 2
    assert mining.least_count(3, 1.0) == 3


def test_min_abs_sup_sets(spark):
    rows = [["a", "b"]] * 6 + [["a"], ["b"], ["c"], ["c"]]
    tx = T.make_transactions(spark, rows)
    got = as_dict(mining.apriori(tx, mining.min_abs_sup(tx)))
    assert set(got) == {("a",), ("b",), ("c",)} | ({("a", "b")} if 6 > stats.min_abs_sup(7, 7, 10) else set())


def test_counts(spark):
    tx = T.parse_lines(spark, ["aa, gg,", "aa ,bb", "aa,bb,cc"])
    sets = spark.createDataFrame([(["aa"],), (["aa", "bb"],), (["gg"],), (["x", "y"],)], "items array<string>")
    assert as_dict(counting.count_itemsets(tx, sets)) == {("aa",): 3, ("aa", "bb"): 2, ("gg",): 1, ("x", "y"): 0}
    assert {(r["a"], r["b"]): r["count"] for r in counting.pair_counts(tx).collect()} == {("aa", "gg"): 1, ("aa", "bb"): 2, ("aa", "cc"): 1, ("bb", "cc"): 1}
    assert {r["item"]: r["count"] for r in counting.count_by_bitmaps(counting.tid_lists(tx)).collect()} == {"aa": 3, "bb": 2, "cc": 1, "gg": 1}


def test_spearman(spark):
    ranks = lambda xs: spark.createDataFrame(list(zip("abcdef", xs, strict=True)), "item string, rank double")
    assert counting.spearman(ranks([1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), ranks([1.0, 2.0, 4.0, 3.0, 6.0, 5.0])).first()[0] == pytest.approx(1 - 6 * 4 / 210)


@pytest.mark.parametrize("mode", ["apriori", "fptree", "cantree"])
def test_modes(spark, mode):
    r = modes.run(T.parse_lines(spark, FP_TEST), modes.Options(mode, min_support=0.2))
    assert r.itemsets.count() == 13 and r.rules.count() == 6


def test_pruned_trees(spark):
    """Nodes at the depth and below do not count; support stays a share of all transactions."""
    chain = T.parse_lines(spark, ["a,b,c", "a,b", "a"])
    sets = lambda lines, depth, mode="fptree", support=0.2: as_dict(modes.run(lines, modes.Options(mode, min_support=support, prune_depth=depth, **({"sort_interval": 2} if mode == "cptree" else {}))).itemsets)
    assert len(sets(chain, None)) == 7
    assert sets(chain, 2) == {("a",): 3} and sets(chain, 3) == {("a",): 3, ("b",): 2, ("a", "b"): 2}
    tx = T.parse_lines(spark, FP_TEST)
    rows = [x.split(",") for x in FP_TEST]
    count, seen = {}, {}
    for r in rows:
        for x in r:
            count[x] = count.get(x, 0) + 1
            seen.setdefault(x, len(seen))
    cut = [sorted(r, key=lambda x: (-count[x], seen[x]))[:2] for r in rows]
    assert sets(tx, 3) == brute(cut, 0.2) != brute(rows, 0.2)
    assert sets(tx, 3, "cantree") == brute([sorted(r, key=seen.get)[:2] for r in rows], 0.2)
    early = {x: sum(x in r for r in rows[:8]) for x in count}  # sorted after every second of nine
    assert sets(tx, 3, "cptree") == brute([sorted(r, key=lambda x: (-early[x], seen[x]))[:2] for r in rows], 0.2)


def test_disctree(spark):
    """Items under a discriminativeness are left out, block by block, and transactions that lose all still count."""
    rows = ([["a", "b"]] * 2 + [["a"]] * 2 + [["c"]] * 4 + [["b", "c"]] * 2) * 2
    tx = T.make_transactions(spark, rows)

    def value(block, x):
        s = lambda *i: sum(set(i) <= set(r) for r in block) / len(block)
        out = 0.0
        for y in {y for r in block for y in r} - {x}:
            if (xy := s(x, y)) > 0:
                sx, sy = s(x), s(y)
                out += -xy * math.log(xy / sx) - (sx - xy) * math.log((sx - xy + 1e-6) / sx) - xy * math.log(xy / sy) - (sy - xy) * math.log((sy - xy + 1e-6) / sy)
        return out / 2

    block = rows[:10]
    values = {x: value(block, x) for x in "abc"}
    limit = sorted(values.values())[0] + 1e-9
    kept = [[x for x in r if values[x] > limit] for r in block]
    assert [] in kept
    o = modes.Options("disctree", min_support=0.25, block_size=10, sort_interval=10, prune_depth=9, min_disc=limit)
    got = modes.run(tx, o).itemsets.collect()
    assert {b: {tuple(r["items"]): r["count"] for r in got if r["block"] == b} for b in (0, 1)} == {b: brute(kept, 0.25) for b in (0, 1)}
    o.min_disc, o.prune_depth = None, 2
    first = {x: -values[x] for x in values}
    cut = [sorted(r, key=lambda x: (first[x], "abc".index(x)))[:1] for r in block]
    assert as_dict(modes.run(tx, o).itemsets.where("block = 1").drop("block")) == brute(cut, 0.25)


@pytest.mark.parametrize("mode", ["cptree", "spotree", "stream", "cptreeStream", "spotreeStream", "ExtrapStream"])
def test_modes_agree(spark, mode):
    """Without a depth all trees give the same sets; with one they still run, and report their sorts and orders."""
    rows = [x.split(",") for x in FP_TEST]
    more = {"cptree": {"sort_interval": 2}, "cptreeStream": {"sort_interval": 2}, "spotree": {"entropy_threshold": 0.1}, "spotreeStream": {"entropy_threshold": 0.1}, "ExtrapStream": {"kernel_points": 2}}.get(mode, {})
    got = modes.run(T.parse_lines(spark, FP_TEST), modes.Options(mode, min_support=0.2, block_size=4, **more))
    if mode in modes.BLOCKS:
        assert {b: {tuple(r["items"]): r["count"] for r in got.itemsets.collect() if r["block"] == b} for b in (0, 1)} == {0: brute(rows[:4], 0.2), 1: brute(rows[4:8], 0.2)}
        assert got.order.where("block = 0").count() == len({x for r in rows[:4] for x in r})
    else:
        assert as_dict(got.itemsets) == brute(rows, 0.2) and got.order.count() == 5
    if mode.startswith("cptree"):
        assert [r["tid"] for r in got.events.orderBy("tid").collect()] == [1, 3, 5, 7]
    few = modes.run(T.parse_lines(spark, FP_TEST), modes.Options(mode, min_support=0.2, block_size=4, prune_depth=2, **more)).itemsets
    assert {len(r["items"]) for r in few.collect()} == {1}


def test_large_blocks(spark, monkeypatch):
    """Blocks beyond one task's memory are mined level by level, with the same result."""
    monkeypatch.setattr(mining, "IN_MEMORY", 1)
    rows = [["a", "b"], ["a"], ["b", "c"], ["a", "b", "c"], ["c"], ["a", "c"], ["b"]]
    got = {}
    for r in mining.block_itemsets(T.make_transactions(spark, rows), 3, 0.5).collect():
        got.setdefault(r["block"], {})[tuple(r["items"])] = r["count"]
    assert got == {0: brute(rows[:3], 0.5), 1: brute(rows[3:6], 0.5)}


def test_options_are_checked():
    assert modes.Options("SSDD", 0.1, tree_drift=0.2, prune_depth=3).check()
    for bad in (modes.Options("fptree", 0.1, sort_interval=5), modes.Options("apriori", 0.1, prune_depth=3), modes.Options("fptree", 0.1, prune_depth=1), modes.Options("stream", 0.1, delta=0.5)):
        with pytest.raises(ValueError):
            bad.check()
    for bad in (modes.Options("nope", 0.1), modes.Options("apriori"), modes.Options("cptree", 0.1), modes.Options("SSDD", 0.1), modes.Options("DBDD", 0.1, delta=2.0)):
        with pytest.raises(ValueError):
            bad.check()


def test_sliding(spark):
    tx = T.make_transactions(spark, [["a"], ["a", "b"], ["b"], ["a"], ["c"], ["a"]])
    got = {(r["tid"], r["item"]): r["count"] for r in counting.sliding_counts(tx, 4, 2).collect()}
    assert got == {(1, "a"): 2, (1, "b"): 1, (3, "a"): 3, (3, "b"): 2, (5, "a"): 2, (5, "b"): 1, (5, "c"): 1}
    rows = [["a", "b"] if i % 3 else ["b", "c"] for i in range(40)]
    tx = T.make_transactions(spark, rows)
    for window, at in ((7, 3), (2, 5), (5, 5)):
        want = {}
        for end in range(at - 1, 40, at):
            for i in range(max(0, end + 1 - window), end + 1):
                for x in rows[i]:
                    want[end, x] = want.get((end, x), 0) + 1
        assert {(r["tid"], r["item"]): r["count"] for r in counting.sliding_counts(tx, window, at).collect()} == want


def test_block_rules_of_all_sizes(spark):
    """All splits of all sets of every whole block, against brute force."""
    import itertools

    from harvestry import registry

    at = "/root/testdata/sf0.01"
    blocks = {}
    for r in registry.T.stream(spark, at).select("tid", "items").collect():
        blocks.setdefault(r["tid"] // registry.BLOCK, []).append(frozenset(r["items"]))
    n, want = registry.BLOCK, set()
    for block, tx in blocks.items():
        if len(tx) < n:
            continue
        count = {}
        for t in tx:
            for k in range(1, len(t) + 1):
                for c in itertools.combinations(sorted(t), k):
                    count[c] = count.get(c, 0) + 1
        sets = {c: x for c, x in count.items() if x / n >= 0.05}
        for c, x in sets.items():
            for k in range(1, len(c)):
                for a in itertools.combinations(c, k):
                    b = tuple(i for i in c if i not in a)
                    if (conf := (x / n) / (sets[a] / n)) > 0.2 and conf / (sets[b] / n) > 1.0:
                        want.add((block, " ".join(a), " ".join(b), x))
    got = [tuple(r)[:4] for r in registry.QUERIES["block_rules_all"](spark, at).collect()]
    print("rules:", len(want), "of pairs:", sum(" " not in a + b for _, a, b, _ in want))
    assert sorted(got) == sorted(want)
    assert any(" " in a or " " in b for _, a, b, _ in want)
