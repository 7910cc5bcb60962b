import pytest
from pyspark.errors import AnalysisException

from harvestry import cli
from harvestry.operators import mining
from harvestry.sources import sinks
from harvestry.sources import transactions as T


def test_reading(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b" aa, gg,\r\nbb,aa ,bb\r\ncc")
    rows = T.number_transactions(T.read_transactions(spark, str(tmp_path / "t.csv"))).orderBy("tid").collect()
    assert [(r["tid"], r["items"]) for r in rows] == [(0, ["aa", "gg"]), (1, ["bb", "aa"]), (2, ["cc"])]


@pytest.mark.parametrize("bad", ["", "a,  ,b", "a b,c"])
def test_bad_lines(spark, bad):
    with pytest.raises(Exception, match="not a transaction"):
        T.parse_lines(spark, ["a,b", bad]).collect()
    assert T.parse_lines(spark, ["a,b", bad], "drop").count() == 1


def test_missing_input(spark, tmp_path):
    with pytest.raises(AnalysisException):
        T.read_transactions(spark, str(tmp_path / "none")).collect()


def test_pivot_and_runs(spark):
    rows = spark.createDataFrame([(0, "k", "b"), (1, "k", "a"), (2, "j", "c"), (3, "k", "d")], "o long, key string, item string")
    assert {tuple(r["items"]) for r in T.from_long(rows, "key", "item").collect()} == {("a", "b", "d"), ("c",)}
    assert T.first_rows(rows, "o", 1).count() == 4 and T.first_rows(rows, "o", 0).count() == 0
    assert [r["items"] for r in T.from_consecutive(rows, "o", "key", "item").orderBy("tid").collect()] == [["b", "a"], ["c"], ["d"]]


def test_listeners(spark):
    tx, heard = T.make_transactions(spark, [["a"], ["b"], ["c"], ["d"], ["e"]]), []
    tids = lambda df: sorted(r["tid"] for r in df.collect())
    done = T.load(tx, lambda: heard.append("start"), lambda b: heard.append(("in", tids(b))), lambda b: heard.append(("end", tids(b))), 2, lambda b: heard.append(("out", tids(b))), 3)
    assert heard == ["start", ("in", [0, 1]), ("out", [0]), ("in", [2, 3]), ("out", [1, 2]), ("in", [4]), ("end", [0, 1, 2, 3, 4])]
    assert tids(T.load(tx.limit(0), on_load=heard.append)) == [] and done.count() == 5


def test_numbers_of_many_rows(spark):
    tx = spark.range(5000).selectExpr("id * id * 7 AS tid", "array(cast(id AS string)) AS items").repartition(9)
    got = {r["items"][0]: r["tid"] for r in T.number_transactions(tx).collect()}
    assert got == {str(i): i for i in range(5000)}
    assert T.number_transactions(tx.limit(0)).count() == 0


def test_warning_below_support(spark, tmp_path, caplog):
    sets = spark.createDataFrame([(["a"], 0.1), (["b"], 0.6)], "items array<string>, support double")
    with caplog.at_level("WARNING", "harvestry"):
        assert sinks.write_itemsets(sets, str(tmp_path / "s"), min_support=0.5) == 2
    assert "1 itemsets are below" in caplog.text


def test_cli_writes_runs(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\nb,c\na,b\na\nc\nc\na\n")
    assert cli.main(["-m", "stream", "-i", str(tmp_path / "t.csv"), "-o", str(tmp_path / "out"), "-minsup", "0.6", "-blockSize", "3"]) == 0
    read = lambda run: {(tuple(r["items"]), round(r["support"], 3)) for r in sinks.read_itemsets(spark, str(tmp_path / f"out.itemsets.0.6-{run}.csv")).collect()}
    assert read(1) == {(("a",), 0.667), (("b",), 1.0), (("a", "b"), 0.667)} and read(2) == {(("c",), 0.667)}
    with pytest.raises(SystemExit):
        cli.main(["-m", "ExtrapStream", "-i", "x", "-o", "y", "-minsup", "0.6", "-use-kernel-regressiony"])
    with pytest.raises(ValueError):
        cli.main(["-m", "apriori", "-i", "x", "-o", "y", "-minsup", "0.6", "-tree-prune-depth", "3"])


def test_round_trip(spark, tmp_path):
    sets = mining.frequent_itemsets(T.parse_lines(spark, ["a,b", "b,c", "b"]), 0.3)
    assert sinks.write_itemsets(sets, str(tmp_path / "s")) == sets.count()
    back = sinks.read_itemsets(spark, str(tmp_path / "s"))
    assert sorted((r["items"], r["support"]) for r in back.collect()) == sorted((r["items"], r["support"]) for r in sets.collect())
    assert sinks.itemset_file("p", 0.2, 1) == "p.itemsets.0.2-1.csv" and sinks.rule_file("p", 0.9, 1.0, 0.2) == "p.rules.0.9.1.0.2.csv"


def test_cli(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\nb,c\na,b\n")
    assert cli.main(["-m", "fptree", "-i", str(tmp_path / "t.csv"), "-o", str(tmp_path / "out"), "-minsup", "0.5"]) == 0
    assert sinks.read_itemsets(spark, str(tmp_path / "out.itemsets.0.5.csv")).count() == 3
    assert "3 itemsets" in (tmp_path / "out.log.txt").read_text()
    with pytest.raises(SystemExit):
        cli.main(["-m", "fptree", "-m", "fptree", "-i", "x", "-o", "y"])
