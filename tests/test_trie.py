import pytest
from test_mining import FP_TEST

from harvestry.operators import trie
from harvestry.sources import transactions as T


@pytest.fixture(scope="module")
def nodes(spark):
    return trie.tree(T.parse_lines(spark, FP_TEST)).cache()


def test_tree(nodes):
    assert trie.render(nodes) == "(root:0 (i1:2 (i3:2)) (i2:7 (i1:4 (i3:2 (i5:1)) (i4:1) (i5:1)) (i3:2) (i4:1)))"
    assert trie.node_count(nodes) == 11
    assert {tuple(r["path"]) for r in trie.leaves(nodes).collect()} == {("i1", "i3"), ("i2", "i1", "i3", "i5"), ("i2", "i1", "i4"), ("i2", "i1", "i5"), ("i2", "i3"), ("i2", "i4")}
    assert not trie.has_single_path(nodes)
    assert [r["depth"] for r in trie.to_vector(nodes, 0).collect()] == [0] and trie.to_vector(nodes).count() == 11
    assert {r["line"] for r in trie.frequencies(nodes).collect()} == {"i1 6", "i2 7", "i3 6", "i4 2", "i5 2"}
    assert "i2/i1" in "".join(r["line"] for r in trie.graphviz(nodes).collect())


def test_conditional(nodes):
    got = {tuple(r["items"]): r["count"] for r in trie.conditional_base(nodes, "i5").collect()}
    assert got == {("i2", "i1"): 1, ("i2", "i1", "i3"): 1}
    assert trie.render(trie.conditional_tree(nodes, "i5", 2)) == "(root:0 (i2:2 (i1:2)))"


def test_removal(spark):
    tx = T.parse_lines(spark, FP_TEST)
    o = trie.ordered(tx, trie.ranks(tx))
    from pyspark.sql import functions as F

    both = o.withColumn("w", F.lit(1)).unionByName(o.where("tid < 4").withColumn("w", F.lit(-1)))
    want = trie.render(trie.prefixes(o.where("tid >= 4")))
    assert trie.render(trie.prefixes(both, F.col("w"))) == want
    assert trie.is_sorted(o, trie.ranks(tx))


def test_single_path(spark):
    chain = trie.tree(T.parse_lines(spark, ["a,b,c", "a,b"]))
    assert trie.has_single_path(chain)
    path = spark.createDataFrame([(["a", "b", "c"], 2), (["a", "d"], 1)], "path array<string>, count long")
    got = {tuple(r["items"]): r["count"] for r in trie.patterns_in_path(path).collect()}
    assert got == {("a",): 3, ("b",): 2, ("c",): 2, ("d",): 1, ("a", "b"): 2, ("a", "c"): 2, ("b", "c"): 2, ("a", "b", "c"): 2, ("a", "d"): 1}
    with pytest.raises(Exception, match="too many subsets"):
        trie.patterns_in_path(path, 2).collect()


def test_edit_distance(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "b", "c"], 0), (["a", "b", "c"], ["a", "c", "b"], 2), (["a", "b"], ["a"], 1)], "a array<string>, b array<string>, d int")
    from pyspark.sql import functions as F

    assert all(r["d"] == r["e"] for r in df.withColumn("e", trie.edit_distance(F.col("a"), F.col("b"))).collect())


def test_similarity_and_edges(spark, nodes):
    assert trie.similarity(nodes, nodes).first()[0] == 100.0
    e = {(r["parent"], r["child"]): (r["count"], r["next_items"]) for r in trie.edges(nodes).collect()}
    assert e["i2", "i1"] == (4, ["i3", "i4", "i5"]) and e["i1", "i3"] == (4, ["i5"])
    w = trie.reweigh(trie.edges(nodes).selectExpr("parent", "child", "count", "1.0D AS weight"), trie.edges(nodes))
    assert {r["weight"] for r in w.collect()} == {0.99}


def test_reachable(spark):
    conn = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "parent string, child string")
    freq = spark.createDataFrame([("a", 3), ("b", 2), ("c", 2), ("d", 1)], "item string, count long")
    got = {(r["a"], r["b"]) for r in trie.reachable(conn, freq).collect()}
    f = {"a": 3, "b": 2, "c": 2, "d": 1}
    pairs = {("a", "b"), ("b", "c"), ("c", "d")}
    assert got == {(x, y) for x in "abcd" for y in "abcd" if x != y and trie.connected(trie.steps_from(pairs), f, x, y)}


def test_exact_instability(spark):
    paths = spark.createDataFrame([(["a", "b", "c"],)], "path array<string>")
    up, down = {"a": 1, "b": 2, "c": 3}, {"a": 3, "b": 2, "c": 1}
    conn, freq = {("a", "b"), ("b", "c")}, {"a": 3, "b": 2, "c": 1}
    assert trie.instability_exact(paths, up, up, conn, freq, []) == 0.0
    assert trie.instability_exact(paths, up, down, conn, freq, []) == pytest.approx(2 / 3)
    assert trie.instability_exact(paths, up, up, {("a", "b")}, freq, []) == pytest.approx(1 / 3)
    assert trie.edit_distance_of(list("kitten"), list("sitting")) == 3
