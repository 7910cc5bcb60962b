"""Each operator against brute force on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from harvestry.llm import common as C
from harvestry.llm import fingerprint, hpylm, language_id, mixing, packing, simhash, substring_dedup, url_filter, vantage, warc

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, kept_text string"
PASSAGE = " ".join(f"p{i}" for i in range(30))


def texts():
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [
        (5, f"one two {PASSAGE} three", "en", "a"),
        (3, f"four {PASSAGE}  \t{PASSAGE} five", "en", "b"),
        (9, None, "fr", "a"),
        (8, "", None, None),
        (7, " \n\t ", "en", "a"),
        (1, "Ünïcode wörds été nbsp \U0001f600", "fr", "b"),
        (2, long, "en", "a"),
        (4, long + " end", "en", "a"),
        (6, "short text", "en", None),
        (6, "short text", "en", None),
        (10, "short  text", "en", "c"),
        (None, f"{PASSAGE} six", "en", "c"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "clash") for r in texts()], SHAPE).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


def words(t):
    return [w.decode() for w in (t or "").encode().split()]


def test_substring(docs, none):
    places = {}
    big = 1 << 62
    for d, t, *_ in texts():
        w = words(t)
        for i in range(len(w) - 19):
            places.setdefault(tuple(w[i : i + 20]), []).append((big if d is None else d, i))
    want = []
    for d, t, *_ in texts():
        w, gone = words(t), set()
        for i in range(len(w) - 19):
            if min(places[tuple(w[i : i + 20])]) < (big if d is None else d, i):
                gone.update(range(i, i + 20))
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.substring_dedup(docs).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert substring_dedup.substring_dedup(none).count() == 0
    kept = {r["doc_id"]: r["kept_text"] for r in substring_dedup.substring_dedup(docs, whole_words=False).collect()}
    assert kept[5] == "one two three" and kept[1] == texts()[5][1] and kept[3] == f"four {PASSAGE}  \tfive"


@pytest.mark.parametrize("same", [None, 50])
def test_substring_of_rows_that_share_an_id(spark, same):
    """Two rows of one id repeat different documents from the same starts: both lose all that is repeated."""
    one, two = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, one), (2, two), (same, one + " tail"), (same, two + " rest"), (same, " ".join(f"c{i}" for i in range(60)))]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["n_words"], r["n_removed"], r["kept_text"]) for r in got if r["doc_id"] == same) == sorted([(61, 60, "tail"), (61, 60, "rest"), (60, 0, rows[4][1])])


def test_vantage(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(700, 8)).astype(np.float32)
    x[30:60] = x[3]
    rows = [(i, [float(v) for v in x[i]], "q") for i in range(700)]
    rows += [(701, None, "q"), (702, [0.0] * 8, "q"), (703, [math.nan] * 8, "q"), (704, [math.inf] + [1.0] * 7, "q"), (None, [1.0] * 8, "q"), (705, [1.0, 2.0], "q"), (706, [2.0, 1.0], "q")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string")
    got = vantage.nearest(df, F.col("id") % 20 == 0).collect()
    p = x.astype(np.float64)
    for q in range(0, 700, 20):
        s = [(-sum(a * b for a, b in zip(p[q], p[j], strict=True)), j) for j in range(700) if j != q]
        want = [j for _, j in sorted((round(v, 12), j) for v, j in s)[:20]]
        assert [g["vec_id"] for g in sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])] == want
    assert vantage.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0
    small = vantage.nearest(df.where("size(embedding) = 2"), F.col("id") == 705).collect()
    assert [(g["vec_id"], g["score"]) for g in small] == [(706, 4.0)]


def test_vantage_of_rows_that_share_an_id(spark):
    """Candidates are rows: of two that share an id both are found, and a query's namesake is no part of it."""
    rows = [(20, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [5.0, 0.0]), (4, [2.0, 0.0]), (4, [2.0, 0.0]), (20, [3.0, 3.0])]
    got = vantage.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()
    assert Counter((g["query_id"], g["rank"], g["vec_id"], g["score"]) for g in got) == Counter(
        [(20, 1, 3, 5.0), (20, 2, 20, 3.0), (20, 3, 4, 2.0), (20, 4, 4, 2.0), (20, 5, 3, 0.0)] + [(20, 1, 3, 15.0), (20, 2, 4, 6.0), (20, 3, 4, 6.0), (20, 4, 3, 3.0), (20, 5, 20, 3.0)]
    )


def test_vantage_deals_queries_out(spark, monkeypatch):
    """Many small shards, and several tasks for each, find what one does."""
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, r.normal(size=3).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, vantage.nearest(df, F.col("id") % 2 == 0, 5).collect()))
    for name, value in (("SHARD", 90), ("QUERIES", 20), ("ASKED", 3)):
        monkeypatch.setattr(vantage, name, value)
    assert sorted(map(tuple, vantage.nearest(df, F.col("id") % 2 == 0, 5).collect())) == want


def test_vantage_factor():
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 2))
    m = float(np.sqrt((x * x).sum(1).max())) * 1.000001
    q, own = x[:50], np.arange(50)
    exact = vantage.Tree(np.arange(3000), x, m, 32)
    i, v, _ = exact.search(own, q, 10, 1.0)
    loose = vantage.Tree(np.arange(3000), x, m, 32)
    loose.search(own, q, 10, 4.0)
    p = q @ x.T
    p[own, own] = -np.inf
    assert v.reshape(50, 10).tolist() == np.argsort(-p, axis=1)[:, :10].tolist()
    assert exact.visited < 50 * 3000 and loose.visited < exact.visited


def test_warc(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 100_000, "<p>a</p>", "x"]
    urls = ["http://B.example.com/x?y#z", "https://a.example.com:80/", None, "no scheme", "http://a.example.com/ü \r\n", "http://b.example.com/x?y", "http://"]
    rows = [(i * 3 + 1, u, h, "clash") for i, (u, h) in enumerate(zip(urls, html, strict=True))] + [(None, "http://c/", "x", "clash"), (1, urls[0], html[0], "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string")
    archive = warc.write_archive(pages, block=2)
    got = warc.keys_of(pages, "page_id", "url").distinct().sort("key", "id").mapInArrow(archive.reader(), warc.READ).collect()
    first = {}
    for p, _, h, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", p)
    want = []
    for p, _, h, _ in rows:
        b = (h or "").encode()
        lead = first[h or ""]
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), *(("response", None) if p == lead else ("revisit", lead))))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert warc.url_key("http://WWW.Example.com:8080/a?b#c") == "com,example,www:8080)/a?b"
    empty = pages.limit(0)
    assert warc.write_archive(empty).shards == []
    raw = warc.record(1, "http://a/", b"data", None, "2020-01-01T00:00:00Z")
    assert warc.parse(raw)["payload"] == b"data"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"data", b"dada"))


def fair(sizes, weights, share, most):
    """Targets by sharing the excess again until none is above."""
    total = share * sum(sizes.values())
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, (s or "").encode())), itertools.cycle(weights), strict=False))
    target, open_ = {}, set(sizes)
    while open_:
        rest = total - sum(target.values())
        part = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] >= most * sizes[s]}
        if not over:
            return target | part
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing(spark, docs, none):
    got = mixing.mix_sources(docs).collect()
    sizes = Counter()
    for _, t, _, s in texts():
        sizes[s] += len(words(t))
    assert {r["source"]: pytest.approx(r["target"]) for r in got} == fair(sizes, (3, 1, 2), 1.5, 2.0)
    assert len(got) == len(texts()) and all(0 <= r["copies"] <= 2 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    assert mixing.mix_sources(none).count() == 0


@pytest.mark.parametrize(
    ("weights", "share", "totals", "ids"),
    [
        ((3, 1, 2), 1.5, [4500, 1500, 3000, 4500], "own"),
        ((3, 1, 2), 1.5, [1500] * 6, "one"),
        ((1, 1, 1), 1.0, [900, 900], "null"),
    ],
)
def test_mixing_of_ties_and_equal_rows(spark, weights, share, totals, ids):
    """Sources that tie in cap over weight, and rows of one id or none, equal ones among them: targets are met."""
    r = np.random.default_rng(sum(totals) + len(totals))
    rows = []
    for i, total in enumerate(totals):
        rows.append((-1, "", f"s{i}" if i else None))
        while total:
            k = int(min(total, r.choice([1, 2, 3, 5, 30])))
            rows.append(({"own": len(rows), "one": 7, "null": None}[ids], "w " * k, f"s{i}" if i else None))
            total -= k
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights, share).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for x in got:
        assert 0 <= x["copies"] <= 2 and x["target"] >= 0
        sizes[x["source"]] += x["size"]
        taken[x["source"]] += x["size"] * x["copies"]
        target[x["source"]] = x["target"]
    want = fair(sizes, weights, share, 2.0)
    assert len(got) == len(rows) and target == {s: pytest.approx(t) for s, t in want.items()}
    assert sum(target.values()) == pytest.approx(min(share * sum(sizes.values()), 2 * sum(sizes.values())))
    assert all(abs(taken[s] - want[s]) <= 15 for s in sizes)


def test_mixing_by_odds(spark):
    """Copies follow the weights: over many documents, those of four times the weight are taken four times as often."""
    many = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', 1 + cast(id % 2 AS int) * 15) AS text", "'s' AS source", "id % 3 AS grade")
    got = mixing.mix_sources(many, (1,), 0.5).collect()
    mean = {k: sum(r["copies"] for r in got if r["size"] == k) / 3000 for k in (1, 16)}
    level = 0.5 * 17 / (1 + 16 * 4)  # copies are level times the square root of the size
    assert mean[1] == pytest.approx(level, abs=0.03) and mean[16] == pytest.approx(4 * level, abs=0.03)
    assert abs(sum(r["size"] * r["copies"] for r in got) - 25_500) <= 8
    # a weight of documents' own, and what is cut off at `most` shared again
    graded = many.withColumn("text", F.lit("a b"))
    for most, want in ((2.0, {0: 0.0, 1: 2 / 3, 2: 4 / 3}), (1.2, {0: 0.0, 1: 0.8, 2: 1.2})):
        own = F.when(F.col("grade") == 0, F.lit(-1.0)).otherwise(F.col("grade").cast("double"))
        rows = mixing.repeated(graded, (1,), 2 / 3, most, weight=own).groupBy("grade").count().collect()
        assert {k: pytest.approx(v, abs=0.05) for k, v in want.items() if v} == {x["grade"]: x["count"] / 2000 for x in rows}


def test_mixing_keeps_rows_apart(spark, tmp_path):
    """repeated() counts for each row, from a file and from a program, whatever columns it has."""
    rows = [(1, "a b c", "s", "x"), (1, "d", "s", "y"), (None, "e f", None, "z"), (None, "e f", None, "z"), (2, None, "s", "n"), (3, "", "t", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    df.write.parquet(str(tmp_path / "t"))
    for docs in (df, spark.read.parquet(str(tmp_path / "t"))):
        out = mixing.repeated(docs, (1,), 2.0)
        assert out.columns == df.columns
        assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(str(r) for r in rows if (r[1] or "").split() for _ in range(2))
    assert mixing.repeated(df.limit(0)).count() == 0


def test_fingerprints(spark, docs, none):
    d = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = fingerprint.next_text(d.withColumn("mark", F.lit(1)), lambda x: x.withColumn("fp", fingerprint.winnow(F.col("text"))), {"text": "after", "fp": "after_fp"}).collect()
    by = {r["doc_id"]: r for r in rows}
    ids = sorted(by, reverse=True)
    assert [by[a]["after"] for a in ids] == [by[b]["text"] for b in [*ids[1:], ids[0]]]
    assert [by[a]["after_fp"] for a in ids] == [by[b]["fp"] for b in [*ids[1:], ids[0]]]
    assert by[8]["fp"] == [] and by[7]["fp"] == [] and len(by[6]["fp"]) == 1
    assert by[6]["fp"] == by[10]["fp"]  # equal words
    assert fingerprint.next_text(none.select("doc_id", "text"), lambda x: x, {"text": "after"}).count() == 0
    one = spark.createDataFrame([(4, "only")], "doc_id long, text string")
    assert fingerprint.next_text(one, lambda x: x, {"text": "after"}).first()["after"] == "only"


def test_next_text_of_hot_ids(spark, monkeypatch):
    """Ids that many rows share, and rows without one, are spread over ranges; all form one circle of descending ids."""
    monkeypatch.setattr(C, "parts", lambda df, per_mb=0: 8)
    rows = [(7, f"seven {i}") for i in range(300)] + [(None, f"none {i}") for i in range(200)] + [(i, f"own {i}") for i in range(20, 120)] + [(3, "three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = fingerprint.next_text(df, lambda d: d.withColumn("task", F.spark_partition_id()), {"text": "after"}).collect()
    after = {r["text"]: r["after"] for r in got}
    ids = {t: i for i, t in rows}
    seen = ["own 119"]
    while len(seen) < len(rows):
        seen.append(after[seen[-1]])
    assert set(seen) == set(ids) and after[seen[-1]] == "own 119"
    assert [ids[t] for t in seen] == [*range(119, 19, -1), *[7] * 300, 3, *[None] * 200]
    assert len({r["task"] for r in got if r["doc_id"] == 7}) > 1 and len({r["task"] for r in got if r["doc_id"] is None}) > 1


def test_edits(spark, sf):
    t = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(t, reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.op5_fingerprints(spark, sf).collect()}
    assert set(got) == set(t)
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):
        n = len(t[a])
        edited = t[a][: n - n // 2] + t[b][: n // 2]
        assert (got[a]["n_chars"], got[a]["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
    marks = lambda f: {x.split(":")[0] for x in f.split()}
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):
        for x, y, like in ((got[a]["fingerprint"], got[a]["edited_fingerprint"], got[a]["near_edited"]), (got[a]["fingerprint"], got[b]["fingerprint"], got[a]["near_next"])):
            x, y = marks(x), marks(y)
            assert like == (len(x & y) / len(x | y) if x | y else 1.0)


def test_winnowing_rule(spark):
    r = np.random.default_rng(0)
    text = " ".join(f"w{i}" for i in r.integers(0, 6, 400))
    df = spark.createDataFrame([(text,)], "text string")
    tokens = text.split()
    n = len(tokens) - 4
    each = {x["t"]: x["h"] for x in spark.createDataFrame([(t,) for t in sorted(set(tokens))], "t string").select("t", F.shiftrightunsigned(F.xxhash64("t"), 28).alias("h")).collect()}
    h = [sum(each[t] % fingerprint.P * fingerprint.BASE ** (4 - j) for j, t in enumerate(tokens[i : i + 5])) % fingerprint.P for i in range(n)]
    want = set()
    for i in range(n - 15):
        least = min(h[i : i + 16])
        want.add((max(j for j in range(i, i + 16) if h[j] == least), least))
    got = df.select(fingerprint.as_text(fingerprint.winnow(F.col("text")))).first()[0]
    assert {(int(p), int(x, 16)) for x, p in (e.split(":") for e in got.split())} == want
    same = df.select(fingerprint.likeness(fingerprint.winnow(F.col("text")), fingerprint.winnow(F.col("text"))), fingerprint.likeness(fingerprint.winnow(F.lit("")), fingerprint.winnow(F.col("text")))).first()
    assert tuple(same) == (1.0, 0.0)
    # a shared run of 20 tokens shares a fingerprint, also without white space, wherever it stands
    solid = "".join(tokens)
    got = df.select(*(fingerprint.likeness(fingerprint.winnow(F.lit(solid)), fingerprint.winnow(F.lit(x))) for x in (solid[:600] + "z" * 300, "q" + solid, "word " + solid[7:]))).first()
    assert 0.3 < got[0] < 1.0 and got[1] > 0.95 and got[2] > 0.95
    # runs of any length roll up from their parts
    hashes = [int(x) for x in r.integers(0, fingerprint.P, 40)]
    for k in (1, 2, 3, 5, 7, 8, 13):
        rolled = df.select(fingerprint._rolled(F.array(*(F.lit(x).cast("long") for x in hashes)), k)).first()[0]
        assert rolled[: 41 - k] == [sum(x * pow(fingerprint.BASE, k - 1 - j, fingerprint.P) for j, x in enumerate(hashes[i : i + k])) % fingerprint.P for i in range(41 - k)]


def test_urls(spark):
    urls = [None, "", "nothing", "http://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://a.www.example.com/en/y?z", "http://x.org", "http://com/", "http://example.com", "http://a.net/es/1", "http://a.net/de/1", "http://example.com:80/en/", "http://notexample.com/en/", "ftp://u@net/fr/#f"]
    want = [("", "", None), ("", "", None), ("", "", None), ("example.com", "/en/x", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"), ("a.www.example.com", "/en/y", "www.example.com/en/"), ("x.org", "", None), ("com", "/", "com/"), ("example.com", "", None), ("a.net", "/es/1", "net/es/"), ("a.net", "/de/1", None), ("example.com:80", "/en/", None), ("notexample.com", "/en/", "com/"), ("u@net", "/fr/", None)]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(99 + i, f"http://h{i % 7}.{'net' if i % 3 else 'com'}/{'es' if i % 2 else 'fr'}/{i}", "clash") for i in range(300)], "page_id long, url string, host string")
    got = {r["id"]: r for r in url_filter.url_verdicts(df).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(urls))] == want
    assert all(r["verdict"] in ("allow", "block") for r in got.values()) and len(got) == 314
    assert url_filter.url_verdicts(df.limit(0)).count() == 0


def test_url_trees_learn(spark):
    rows = [(f"http://s{i % 40}.{'net' if i % 4 else 'com'}/{('en', 'es', 'fr')[i % 3]}/{i * 37}", ) for i in range(2000)]
    df = spark.createDataFrame(rows, "url string")
    host, path = url_filter.host_and_path(F.col("url"))
    df = df.withColumn("host", host).withColumn("path", path)
    df = df.withColumn("verdict", F.when(F.endswith("host", F.lit(".net")) & ~F.startswith("path", F.lit("/en/")), "block").otherwise("allow")).cache()
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    model = url_filter.Filter(df.where(~held).select("url", "host", "path", "verdict"), trees=5)
    r = model.verdicts(df.where(held)).agg(F.avg((F.col("method") == F.col("verdict")).cast("int"))).first()[0]
    assert r > 0.97
    # rates count all labelled URLs, however few the trees see; a URL that they learn from leaves out its own fold
    few = url_filter.Filter(df.where(~held).select("url", "host", "path", "verdict"), trees=2, sample=200)
    n = df.where(~held).count()
    assert few.stats.groupBy("kind").agg(F.sum("n").alias("n")).distinct().count() == 4 and {r["n"] for r in few.stats.groupBy("kind").agg(F.sum("n").alias("n")).collect()} == {n}
    fold = F.floor(url_filter._draw(1) * url_filter.FOLDS)
    counts = {(r["p"], r["fold"]): (r["b"], r["n"]) for r in df.where(~held).groupBy(F.regexp_extract("path", "^/([^/]*)", 1).alias("p"), fold.alias("fold")).agg(F.sum((F.col("verdict") == "block").cast("int")).alias("b"), F.count("*").alias("n")).collect()}
    one = few._vectors(url_filter.lexical(df.where(~held).withColumn("fold", fold.cast("int")).limit(50)), own_fold=True).collect()
    for r in one:
        b, m = (sum(c[i] for (p, f), c in counts.items() if p == r["k_segment"] and f != r["fold"]) for i in (0, 1))
        assert r["f_segment"] == pytest.approx((b + 2 * few.share) / (m + 2))
    e = spark.range(1).select(url_filter.entropy(F.lit("aabb")), url_filter.entropy(F.lit(""))).first()
    assert tuple(e) == (1.0, 0.0)


def test_simhash(docs, none):
    got = simhash.simhash_groups(docs, shingle=4, bits=64, radius=4, repeats=True).collect()
    assert len(got) == len(texts())
    fps = {}
    import xxhash

    for d, t, *_ in texts():
        w = [x.encode() for x in words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))]
        sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.setdefault(d, set()).add(sum(1 << j for j in range(64) if sum(x >> j & 1 for x in h) * 2 > len(h)))
    big = 1 << 63
    nodes = [(big if d is None else d, f) for d, s in fps.items() for f in s]
    root = {n: n[0] for n in nodes}
    for _ in nodes:
        for a, b in itertools.permutations(nodes, 2):
            if (a[1] ^ b[1]).bit_count() <= 4:
                root[a] = root[b] = min(root[a], root[b])
    want = {n: (None if r == big else r) for n, r in root.items()}
    for r in got:
        assert want[big if r["id"] is None else r["id"], int.from_bytes(r["fp"], "big")] == r["group"]
    assert simhash.simhash_groups(none, shingle=4, bits=64, radius=4, repeats=True).count() == 0


@pytest.mark.parametrize("radius", [1, 3, 4, 7, 12])
def test_bit_slices(radius):
    r = np.random.default_rng(1)
    base = r.integers(0, 2**64, 20, dtype=np.uint64)
    f = base[r.integers(0, 20, 333)]
    for _ in range(5):
        f = f ^ (np.uint64(1) << r.integers(0, 64, 333).astype(np.uint64))
    far = np.bitwise_count(f[:, None] ^ f[None]) <= radius
    hit = simhash.near(f[:, None], f[:, None], radius)
    bits = np.unpackbits(np.ascontiguousarray(hit.astype("<u8")).view(np.uint8), axis=1, bitorder="little")[:, :333]
    assert (bits == far).all()
    upper = simhash.near(f[:, None], f[:, None], radius, 0)
    bits = np.unpackbits(np.ascontiguousarray(upper.astype("<u8")).view(np.uint8), axis=1, bitorder="little")[:, :333]
    assert (bits == np.triu(far, 1)).all()


def test_large_buckets_are_dealt_out(spark):
    r = np.random.default_rng(9)
    f = np.unique(np.uint64(7) ^ (np.uint64(1) << r.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 60).astype(np.uint64)))
    df = spark.createDataFrame([(x.astype(">u8").tobytes(),) for x in f], "fp binary")
    edges = simhash.links(df, 64, 4, 10**6, 0.01, most=5)
    got = {tuple(r) for r in simhash.components(edges).collect()}
    assert len({b for _, b in got}) == 1 and len(got) == len(f)


def test_tables_are_searched_some_at_a_time(spark, monkeypatch):
    """What is shuffled at once follows the number of fingerprints, not the number of tables that so many of them need."""
    r = np.random.default_rng(4)
    f = r.integers(0, 1 << 63, (40, 16)).astype(np.uint64)
    f = np.concatenate((f, f ^ (np.uint64(1) << r.integers(0, 64, f.shape).astype(np.uint64))))
    df = spark.createDataFrame([(x.astype(">u8").tobytes(),) for x in f], "fp binary")
    distinct, radius, at_once, plain = 300_000, 195, [], simhash._keys
    monkeypatch.setattr(simhash, "_keys", lambda tables, words: at_once.append(len(tables)) or plain(tables, words))
    got = {tuple(r) for r in simhash.components(simhash.links(df, 1024, radius, distinct, 0.01)).collect()}
    assert sum(at_once) == len(simhash.choose(distinct, 1024, radius, 0.01)) > 40 and max(at_once) <= 16
    assert len(got) == 80 and len({b for _, b in got}) == 40
    # buckets in parts, in rounds
    f = np.unique(np.uint64(7) ^ (np.uint64(1) << r.integers(0, 64, 60).astype(np.uint64)))
    df = spark.createDataFrame([(x.astype(">u8").tobytes(),) for x in f], "fp binary")
    got = {tuple(r) for r in simhash.components(simhash.links(df, 64, 4, len(f), 0.01, most=5, held=72, least=0)).collect()}
    assert len({b for _, b in got}) == 1 and len(got) == len(f)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 103), (200, 100)] + [(500, i) for i in range(501, 540)]
    got = dict(tuple(r) for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (100, 101, 103, 200)} == {100} and {got[i] for i in range(500, 540)} == {500}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    ids = Counter()
    for d, x, *_ in texts():
        ids[d, tuple([*t.encode(x or "", add_special_tokens=False).ids, 0])] += 1
    want = Counter()
    pieces = {}
    for r in got:
        pieces.setdefault((r["id"], r["doc_tokens"]), []).append(r)
    for (d, seq), n in ids.items():
        mine = sorted(pieces[d, len(seq)], key=lambda r: r["start"])
        covered = Counter(i for r in mine for i in range(r["start"], r["start"] + r["length"]))
        assert covered == Counter({i: sum(k for (e, s), k in ids.items() if e == d and len(s) == len(seq)) for i in range(len(seq))})
        for r in mine:
            raw = np.array(seq[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert zlib.crc32(raw) == r["ids_crc32"] or n < sum(k for (e, s), k in ids.items() if e == d and len(s) == len(seq))
        want[d] += n
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at == 1024 or at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(none, path).count() == 0


def test_tokens():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, ids = Tokenizer.from_file(path), packing.Ids(path)
    for x in ["", " ", "  a  b\n c", "a<|endoftext|>b", " x", "it's  we'll \n\n x   ", "é ñ 中文 字", "\n", "a ", "a    b 12 3.4", "a  b 　c", "\t x\ty"]:
        assert np.frombuffer(ids(x), "<u2").tolist() == [*t.encode(x, add_special_tokens=False).ids, 0], x


@pytest.mark.parametrize(
    ("sizes", "weights"),
    [([5000, 100, 3000, 17], None), ([1024], None), ([3], None), ([2048, 2048, 4096], None), ([5000, 100, 3000, 0, 900], [1, 1, 1, 1, 1]), ([700, 6000, 333], [5, 2, 0])],
)
def test_schedule(sizes, weights):
    s = packing.Schedule(sizes, 64, weights)
    seen = Counter()
    for q, n in enumerate(sizes):
        at = 0
        for first, k, seq, off in itertools.chain.from_iterable(((a + b, k, w, o) for b, k, w, o in s.pieces(q, a, min(333, n - a))) for a in range(0, n, 333)):
            assert first == at
            at += k
            seen.update((seq, off + i) for i in range(k))
        assert at == n
    assert (not seen or max(seen.values()) == 1) and len(seen) == sum(sizes)
    # a round of its own, window by window: quantum and deficit, dry queues leave
    left, w = list(sizes), weights or sizes
    for n in range(s.full):
        had = [s.served(q, n + 1) - s.served(q, n) for q in range(len(sizes))]
        assert sum(had) == 64
        active = [x if left[q] else 0 for q, x in enumerate(w)]
        if all(left[q] > 64 for q in range(len(sizes)) if active[q]) and any(active):
            for q, x in enumerate(active):
                assert abs(had[q] - 64 * x / sum(active)) < 2  # a quantum, and less than a token of deficit either way
        left = [x - y for x, y in zip(left, had, strict=True)]
        assert all(abs(s.deficit(q, n + 1)) < 1 for q in range(len(sizes)))
    if weights is None:
        for n in range(s.full):
            assert all(abs(s.served(q, n) - n * 64 * x / sum(sizes)) < 1 for q, x in enumerate(sizes))


def test_lanes():
    """Small sources take turns in the joint queue, all tokens in one piece each, spread evenly."""
    plan = packing.Plan([9000], [400, 400, 200, 7], 100, turn=50)
    place = {}
    for lane, size in enumerate([9000, 400, 400, 200, 7]):
        for first, k, seq, off in plan.pieces(lane, 0, size):
            for i in range(k):
                assert (seq, off + i) not in place
                place[seq, off + i] = lane, first + i
    assert len(place) == 10_007 and len(set(place.values())) == 10_007
    halves = Counter((lane, seq < 50) for (seq, _), (lane, _) in place.items())
    assert all(abs(halves[lane, True] - n / 2) < 60 for lane, n in ((1, 400), (2, 400), (3, 200)))


def test_packing_to_weights(spark):
    """Windows take target proportions as long as there are tokens; a source without a weight comes last."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, "a b c d e f g", "x" if i % 4 == 0 else "y") for i in range(4000)] + [(5000, "h " * 100, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), path, 64, {"x": 1, "y": 1}).collect()
    source = {i: s for i, _, s in rows}
    by = Counter()
    for r in got:
        by[r["sequence_id"], source[r["id"]]] += r["length"]
    assert all(abs(by[w, "x"] - 32) <= 1 and abs(by[w, "y"] - 32) <= 1 for w in range(200))  # x has 8000 tokens
    assert max(w for w, s in by if s == "x") < min(w for w, s in by if s is None)
    assert sum(by.values()) == 4000 * 8 + next(r["doc_tokens"] for r in got if r["id"] == 5000)
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), path, 64, {"x": 1, "y": 100})


def test_hpylm(docs, none):
    got = hpylm.score_texts(docs).collect()
    assert len(got) == len(texts())
    tok = lambda t: [w.lower() if w.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words(t)] + ["\n"]
    train = [tok(t) for d, t, *_ in texts() if zlib.crc32(str("" if d is None else d).encode()) % 10]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), len(tok(t)), sum(w in c for w in tok(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok(t)), 4)) for d, t, *_ in texts())
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert hpylm.score_texts(none).count() == 0


def test_restaurants():
    text = "the cat sat on the mat and the dog sat on the log " * 40
    buf = np.frombuffer(hpylm.spelled(text.encode()), np.uint8)
    codes, n = hpylm._distinct_runs(hpylm.runs(buf, 4), np.ones(len(buf), bool))
    tree = hpylm._subtree(codes, n, 4, 1)
    flat = np.full(1 << 16, 1 / 256)
    for _ in range(3):
        tree.sweep(lambda c: flat[hpylm._upper(c)])
    for level in tree.levels:
        assert (level.tables >= (level.customers > 0)).all() and (level.tables <= level.customers).all()
    # probabilities of all dishes after a context sum to one, at every level
    context = np.uint64(int.from_bytes(b"eht", "big")) << np.uint64(8)
    every = context | np.arange(256, dtype=np.uint64)
    top = hpylm.top_restaurants(np.bincount(hpylm._upper(tree.levels[-1].codes), tree.levels[-1].tables, 1 << 16).astype(np.int64), 2, 2, 1)
    base = hpylm._upper(hpylm.shorter(every))
    assert top[base].sum() == pytest.approx(1)
    p = tree.predict(every, top[base])
    assert p.sum() == pytest.approx(1) and p[ord(" ")] > 0.9
    # contexts end at ends
    r = hpylm.runs(np.frombuffer(b"ab\ncd\n", np.uint8), 3)
    assert [x.to_bytes(3, "big") for x in r.tolist()] == [b"\n\na", b"a\nb", b"ba\n", b"\n\nc", b"c\nd", b"dc\n"]


def arrangements(counts, tables_of, theta, d):
    """Weights of all numbers of tables of a restaurant's dishes: (tables, weight), with generalised Stirling numbers."""
    top = max(counts)
    stirling = [[0.0] * (top + 2) for _ in range(top + 2)]
    stirling[0][0] = 1.0
    for c in range(top):
        for t in range(1, c + 2):
            stirling[c + 1][t] = stirling[c][t - 1] + (c - t * d) * stirling[c][t]
    for t in itertools.product(*(range(1 if c else 0, tables_of(c) + 1) for c in counts)):
        rise = math.prod(theta + i * d for i in range(sum(t)))
        yield t, rise * math.prod(stirling[c][k] for c, k in zip(counts, t, strict=True)) / math.prod(theta + i for i in range(sum(counts)))


def test_gibbs_finds_the_posterior():
    """Two restaurants over a shared parent: averaged predictive probabilities against the sum over all seatings."""
    d, theta, base = 0.5, hpylm.THETA, 1 / 256
    counts = {b"x": [4, 1, 2], b"y": [2, 3, 0]}  # of dishes a, b, c after x and after y
    codes, n = [], []
    for ctx, cs in counts.items():
        for dish, c in zip(b"abc", cs, strict=True):
            if c:
                codes.append(ctx[0] << 8 | dish)
                n.append(c)
    asked = np.array([ctx[0] << 8 | dish for ctx in counts for dish in b"abcz"], np.uint64)
    want, total = np.zeros(len(asked)), 0.0
    for tx, wx in arrangements(counts[b"x"], lambda c: c, theta, d):
        for ty, wy in arrangements(counts[b"y"], lambda c: c, theta, d):
            c = [a + b for a, b in zip(tx, ty, strict=True)]
            for s, ws in arrangements(c, lambda k: k, theta, d):
                weight = wx * wy * ws * base ** sum(s)
                above = [(c[i] - d * s[i] + (theta + d * sum(s)) * base) / (theta + sum(c)) for i in range(3)] + [(theta + d * sum(s)) * base / (theta + sum(c))]
                p = [((cs[i] - d * t[i] if i < 3 else 0) + (theta + d * sum(t)) * above[i]) / (theta + sum(cs)) for cs, t in ((counts[b"x"], tx), (counts[b"y"], ty)) for i in range(4)]
                want += weight * np.array(p)
                total += weight
    want /= total
    tree = hpylm.Subtree(np.array(codes, np.uint64), np.array(n), 2, 0, 3)
    for level in tree.levels:
        level.discount = d
    got, flat = np.zeros(len(asked)), lambda c: np.full(len(c), base)
    for i in range(2100):
        tree.sweep(flat)
        if i >= 100:
            got += tree.predict(asked, np.full(len(asked), base))
            if i % 500 == 0:
                for level in tree.levels:  # seats, tables and customers agree
                    size = np.add.reduceat(np.append(level.seats.size, 0), level.seats.start[:-1])[level.place]
                    used = np.add.reduceat(np.append(level.seats.size > 0, 0), level.seats.start[:-1])[level.place]
                    assert (size == level.customers).all() and (used == level.tables).all()
    assert np.abs(got / 2000 - want).max() < 0.015 and np.abs(got / 2000 / want - 1).max() < 0.12


def test_model_beats_interpolated_bytes(spark, sf):
    """Held-out texts are likelier than by interpolated n-grams of bytes, of the same order."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text")
    rows = docs.collect()
    scored = hpylm.score_texts(docs).cache()
    got = scored.where("held_out").agg(F.sum("score"), F.sum("n_tokens")).first()
    train, test = [], []
    for r in rows:
        (test if hpylm.held_out(r["doc_id"]) else train).append(hpylm.spelled(r["text"].encode()))
    after = [{} for _ in range(hpylm.ORDER)]
    for t in train:
        t = b"\n" * (hpylm.ORDER - 1) + t
        for i in range(hpylm.ORDER - 1, len(t)):
            for k in range(hpylm.ORDER):
                after[k].setdefault(t[i - k : i], Counter())[t[i]] += 1
    size = [{u: (sum(c.values()), len(c)) for u, c in level.items()} for level in after]
    total = 0.0
    for t in test:
        t = b"\n" * (hpylm.ORDER - 1) + t
        for i in range(hpylm.ORDER - 1, len(t)):
            p = 1 / 256
            for k in range(hpylm.ORDER):  # Witten and Bell: as much for the shorter context as there are distinct bytes
                n, distinct = size[k].get(t[i - k : i], (0, 0))
                if n:
                    p = (after[k][t[i - k : i]][t[i]] + distinct * p) / (n + distinct)
            total += math.log10(p)
    assert got[0] > total
    assert hpylm.perplexity(scored) == pytest.approx(10 ** (-got[0] / got[1]))


def test_contexts_are_of_words(spark):
    """What follows depends on the two words before, which end alike: bytes before the last word don't tell."""
    r = np.random.default_rng(5)
    vocabulary = [f"{a}{b}commonending" for a in "bcdfg" for b in "aeiou"]
    after = {(i, j): r.permutation(25) for i in range(25) for j in range(25)}

    def text():
        w = [int(x) for x in r.integers(25, size=2)]
        while len(w) < 60:
            w.append(int(after[w[-2], w[-1]][0 if r.random() < 0.8 else r.integers(25)]))
        return [vocabulary[i] for i in w]

    held = [i for i in range(3000) if hpylm.held_out(i)][:20]
    rows = [(i, " ".join(text())) for i in range(400) if not hpylm.held_out(i)]
    asked = {i: text() for i in held[:10]}
    rows += [(i, " ".join(w)) for i, w in asked.items()] + [(j, " ".join(r.permutation(asked[i]))) for i, j in zip(held[:10], held[10:], strict=True)]
    rows.append((held[0] + 100_000, "x" * 5000))  # a word beyond the least number above zero
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {row["doc_id"]: row["score"] for row in hpylm.score_texts(docs).collect()}
    assert len(got) == len(rows) and all(math.isfinite(x) and x < 0 for x in got.values())
    assert all(got[i] > got[j] + 10 for i, j in zip(held[:10], held[10:], strict=True))
    one = {row["doc_id"]: row["score"] for row in hpylm.score_texts(docs, words=2).collect()}
    assert sum(got[i] for i in held[:10]) > sum(one[i] for i in held[:10]) + 100
    # frequent words in parts: 400 occurrences each
    parted = {row["doc_id"]: row["score"] for row in hpylm.score_texts(docs, split=200).collect()}
    assert parted.keys() == got.keys() and abs(sum(parted[i] - got[i] for i in held[:10])) < 0.1 * 61 * 10


def test_restaurants_of_words():
    """Averaged predictive probabilities against the sum over all seatings; those of all dishes sum to one at every level."""
    d, theta, base = 0.6, hpylm.THETA, np.array([0.2, 0.3, 0.1, 0.4])
    counts = np.array([3, 1, 2, 0])
    want, total = np.zeros(4), 0.0
    for t, w in arrangements(counts, lambda c: c, theta, d):
        w *= math.prod(base ** np.array(t))
        want += w * (counts - d * np.array(t) + (theta + d * sum(t)) * base) / (theta + counts.sum())
        total += w
    tree = hpylm.Words([np.full(4, 7), np.array([10, 11, 12, 13])], counts, 4)
    tree.levels[0].discount = d
    got = np.zeros(4)
    for i in range(4100):
        tree.seat(np.log(base))
        got += np.exp(tree.logs(np.log(base))) * (i >= 100)
    assert np.abs(got / 4000 - want / total).max() < 0.01 and got.sum() / 4000 == pytest.approx(1)
    r = np.random.default_rng(2)
    before = r.integers(4, size=(2, 600))
    seen = np.concatenate((before, r.integers(8, size=(1, 600)) // 2), axis=0)
    every = np.array([(i, j, k) for i in range(4) for j in range(4) for k in range(4)]).T
    tree = hpylm.Words(list(np.concatenate((seen, every), axis=1)), np.concatenate((np.ones(600, int), np.zeros(64, int))), 1)
    for _ in range(4):
        tree.seat(np.log(base))
        for level in tree.levels:
            assert (level.tables >= (level.customers > 0)).all() and (level.tables <= level.customers).all()
        assert (tree.levels[1].customers == np.bincount(tree.to[0], tree.levels[0].tables)).all()
    p = np.exp(tree.logs(np.log(base)))[tree.row[600:]].reshape(16, 4)
    assert p.sum(axis=1) == pytest.approx(1)


def test_dishes_seated_at_once():
    """Averaged predictive probabilities against the sum over all seatings, without a table's size being kept; in a child
    restaurant whose tables come to and leave the parent, too."""
    d, theta, base = 0.5, hpylm.THETA, 1 / 256
    below, n = [4, 1, 2], np.array([4, 1, 2])
    codes = np.array([ord("x") << 8 | dish for dish in b"abc"], np.uint64)
    want, total = np.zeros(3), 0.0
    for t, w in arrangements(below, lambda c: c, theta, d):
        for s, v in arrangements(list(t), lambda c: c, theta, d):
            above = np.array([(t[i] - d * s[i] + (theta + d * sum(s)) * base) / (theta + sum(t)) for i in range(3)])
            weight = w * v * base ** sum(s)
            want += weight * (n - d * np.array(t) + (theta + d * sum(t)) * above) / (theta + 7)
            total += weight
    tree = hpylm.Subtree(codes, n, 2, 0, 3, 8)
    for level in tree.levels:
        level.discount = d
    got = np.zeros(3)
    for i in range(4100):
        tree.sweep(lambda c: np.full(len(c), base))
        got += tree.predict(codes, np.full(3, base)) * (i >= 100)
    assert not len(tree.levels[0].order) and np.abs(got / 4000 / (want / total) - 1).max() < 0.05
    # numbers of tables of a lone dish, against generalised Stirling numbers, however many restaurants there are
    for c in (2, 3, 7, 20, 60):
        level = hpylm.Level(np.arange(20_000, dtype=np.uint64) << np.uint64(8), np.random.default_rng(c), True, 8, np.full(20_000, c), 64)
        level.customers[:], level.discount = c, d
        level.tables[:] = 1
        level.settle()
        p = np.full(20_000, 0.3)
        level.first_seating(p)
        level.sweep(p)
        weights = np.array([(t[0], w * 0.3 ** t[0]) for t, w in arrangements([c], lambda c: c, theta, d)])
        assert (level.tables <= c).all() and (level.tables >= 1).all() and (level.t_u == level.tables).all()
        assert level.tables.mean() == pytest.approx((weights[:, 0] * weights[:, 1]).sum() / weights[:, 1].sum(), rel=0.03)


def test_customers_leave_at_once():
    draw = np.random.default_rng(1)
    level = hpylm.Level(np.arange(3000, dtype=np.uint64) << np.uint64(8), draw)
    level.customers[:] = 20
    level.settle()
    level.first_seating(np.full(3000, 0.3))
    stay = draw.integers(1, 21, 3000)
    level.meet(stay, np.full(3000, 0.3))
    size = [level.seats.size[a:b] for a, b in zip(level.seats.start[:-1], level.seats.start[1:], strict=True)]
    assert (level.customers == stay).all() and (level.c_u == stay).all() and [x.sum() for x in size] == stay.tolist()
    assert (level.tables == [(x > 0).sum() for x in size]).all() and (level.t_u == level.tables).all()


def test_runs_are_planted_once():
    """What later rounds read instead of the batches' runs says the same; so do the short cuts over symbols."""
    r = np.random.default_rng(3)
    columns, counts = [r.integers(k, size=500) * 7 for k in (9, 30, 60)], r.integers(3, size=500)
    plan, dishes, row = hpylm.Plan.of(columns, counts)
    again = hpylm.Plan.unpacked(plan.packed())
    for a, b in ((plan.contexts, again.contexts), (plan.dishes, again.dishes), (plan.up, again.up), ([plan.counts], [again.counts])):
        assert all((x == y).all() for x, y in zip(a, b, strict=True))
    seen = Counter()
    for *run, n in zip(*columns, counts, strict=True):
        seen[tuple(run)] += n
    assert len(plan.counts) == len(seen) and all(plan.counts[i] == seen[run] and dishes[plan.dishes[0][i]] == run[2] for i, *run in ((i, *map(int, x)) for i, *x in zip(row, *columns, strict=True)) for run in [tuple(run)])
    words = [bytes(r.integers(97, 100, n).astype(np.uint8)) for n in (*r.integers(1, 12, 400), 70_000, 0)]
    data, weights = b"".join(w + b"\n" for w in words), r.integers(100_000, size=len(words))
    codes = hpylm.runs(np.frombuffer(data, np.uint8), 6)
    of = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
    distinct, n = hpylm._spelled_runs(data, 6, weights)
    values, inverse = np.unique(codes, return_inverse=True)
    assert (distinct == values).all() and (n == np.bincount(inverse, weights[of])).all()
    log = r.random(len(distinct))
    assert hpylm._spelled_logs(data, 6, distinct, log) == pytest.approx(np.bincount(of, log[inverse]))
    h, is_end, starts, stops = hpylm._token_hashes(data.replace(b"\n", b" ") + b"\n" + b"aab  aab\n\n")
    assert is_end.sum() == 3 and is_end[-1] and len(h) == len(words) - 1 + 5
    assert len(set(h[~is_end].tolist())) == len({*words, b"aab"} - {b""}) and len(set(h[is_end].tolist())) == 1


def test_runs_of_a_batch():
    """Runs end at the bounds of texts, however short these are, also where three numbers of words don't fit 64 bits."""
    sizes, token = np.array([1, 3, 2, 1, 4]), np.array([4, 0, 1, 4, 2, 4, 4, 0, 1, 3, 4])
    number, counts = np.array([70, 20, 30, 90, 10]), np.array([5, 5, 5, 5, 5])
    want, lo = [], 0
    for size in sizes:
        t = [4, 4, *token[lo : lo + size]]
        want += [tuple(int(number[t[i - k]]) for k in (1, 2, 0)) for i in range(2, len(t))]
        lo += size
    for words, pick in ((3, (0, 1, 2)), (2, (0, 2))):
        for more in (0, (1 << 22) if words == 3 else 0):
            columns, to, run = hpylm._runs_of(sizes, token, np.append(number, 100 + np.arange(more)), np.append(counts, np.zeros(more, int)), words, 1 << 19, 3)
            got = list(zip(*(c.tolist() for c in columns), strict=True))
            assert len(set(got)) == len(got) and [got[i] for i in run] == [tuple(w[k] for k in pick) for w in want]
            assert (np.diff(to) >= 0).all()


def test_language(spark, none):
    langs = {"en": "the of and that with have this from they", "de": "der die und nicht von das mit sich auch", "fr": "les des une est pas que dans pour qui"}
    r = np.random.default_rng(1)
    rows = [(i, " ".join(r.choice(langs[k].split(), 40)), k, "s", 0, "") for i, k in enumerate(list(langs) * 60)]
    rows += [(900, None, "en", "s", 0, ""), (901, "", "en", "s", 0, ""), (902, "12 34 !?", "en", "s", 0, ""), (903, "the of and", None, "s", 0, ""), (None, "nicht von das mit sich", "de", "s", 0, "")]
    df = spark.createDataFrame(rows, SHAPE)
    held = language_id.crc_of_id() % 4 == 2
    learned = language_id.learn(df.where(~held), F.col("doc_id"))
    assert sorted(k for k, _ in learned) == ["de", "en", "fr"]
    got = language_id.identify(df.withColumn("held", held), learned).collect()
    test = [r for r in got if r["held"] and r["text"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert sum(r["lang_pred"] == r["lang"] for r in test) >= 0.97 * len(test)
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (900, 901, 902)} == {k: ("und", 0.0) for k in (900, 901, 902)}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.identify(none, learned).count() == 0
    assert language_id.learn(none, F.col("doc_id")) == []
    assert {r["lang_pred"] for r in language_id.identify(df, []).collect()} == {"und"}


def test_language_of_long_texts(sf):
    """A clear text keeps its margin at any length."""
    import types

    import pyarrow as pa
    import pyarrow.parquet as pq

    by = {}
    for t, k in zip(*(pq.read_table(f"{sf}/documents.parquet", columns=["text", "lang"]).column(i).to_pylist() for i in (0, 1)), strict=True):
        if t and k:
            by.setdefault(k, []).append(t)
    learned = [(k, b" ".join(language_id.plain(t) for t in ts[: language_id.SAMPLE])) for k, ts in sorted(by.items())]
    r = np.random.default_rng(3)
    ts = by["en"]
    long = " ".join(" ".join(r.permutation(ts[i].split())) for i in r.integers(len(ts), size=12_000_000 // (sum(map(len, ts)) // len(ts))))
    batch = pa.RecordBatch.from_arrays([pa.array([long[:30_000], long]), pa.array([0, 1])], ["text", "rest"])
    out = next(iter(language_id._predict(types.SimpleNamespace(value=learned), language_id.LEVEL)(iter([batch]))))
    short_score, score = out.column(1).to_pylist()
    assert out.column(0).to_pylist() == ["en", "en"]
    assert score >= 5 * language_id.NARROW and score > 0.8 * short_score


def test_language_by_hand(spark, tmp_path, sf):
    """The registered query against dictionaries made by hand: few rows, so that all of them are learned from."""
    import pyarrow.parquet as pq
    import zstandard

    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").limit(150).collect()]
    odd = [(9000, "\u00bd \u00b2 \u2460", "en"), (9001, None, "de"), (9002, "  12 !", "de"), (9003, "\u4e2d", ""), (9005, "ok then " * 9000, "en"), (9006, "empty tag of a language " * 30, ""), (9006, "empty tag of a language " * 30, "")]
    table = [(r["doc_id"], r["text"], r["lang"]) for r in rows] + odd
    import pyarrow as pa

    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in table], pa.int64()), "text": [x[1] for x in table], "lang": [x[2] for x in table], "source": ["s"] * len(table), "n_chars": [0] * len(table)}), f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in language_id.op10_language_id(spark, str(tmp_path)).collect())
    learn = [x for x in table if x[1] is not None and x[2] is not None and zlib.crc32(str(x[0]).encode()) % 4 != 2]
    langs = sorted(Counter(x[2] for x in learn).items(), key=lambda kv: (-kv[1], kv[0]))
    hashed = {(r["doc_id"], r["text"]): r["u"] for r in spark.createDataFrame([(x[0], x[1]) for x in learn], "doc_id long, text string").select("*", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)).alias("u")).collect()}
    packs = []
    for lang, _ in langs:
        mine = [x for x in learn if x[2] == lang]
        size = {id(x): len(x[1].encode()) for x in mine}
        mine.sort(key=lambda x: (size[id(x)] > language_id.LONGEST and size[id(x)], hashed[x[0], x[1]], x[1]))
        content = b" ".join(language_id.plain(x[1]) for x in mine[: language_id.SAMPLE])
        packs.append((lang, zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)))
    want = Counter()
    for d, t, _ in table:
        held = zlib.crc32(str(d).encode()) % 4 == 2
        if t is None or not any(ch.isalpha() for ch in t):
            want[d, held, "und", 0.0] += 1
            continue
        data = language_id.plain(t)
        sizes = [sum(len(p.compress(data[i : i + language_id.CHUNK])) for i in range(0, len(data), language_id.CHUNK)) for _, p in packs]
        best = sizes.index(min(sizes))
        second = min(n for i, n in enumerate(sizes) if i != best)
        want[d, held, packs[best][0], round(1 - sizes[best] / second, 9)] += 1
    assert got == want and "" in {lang for lang, _ in langs}


@pytest.mark.parametrize("name", ["op5_fingerprints", "op6_url_filter", "op7_simhash", "op8_packing", "op9_hpylm", "op10_language_id"])
def test_columns_of_the_contract(spark, sf, name):
    from harvestry.llm import registry

    want = {
        "op5_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
        "op6_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
        "op7_simhash": "doc_id bigint, fingerprint string, component_id bigint",
        "op8_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
        "op9_hpylm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
        "op10_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    }[name]
    df = registry.QUERIES[name](spark, sf)
    assert {c.split()[0]: c.split()[1] for c in want.split(", ")} == dict(df.dtypes)


def test_sizes(docs):
    got = sorted((str(r[0]), r[1]) for r in docs.select("doc_id", C.size_of_words(F.col("text"))).collect())
    assert got == sorted((str(d), len(words(t))) for d, t, *_ in texts())
