"""Each stage of the pipeline on what its predecessor kept, against brute force."""

import collections
import zlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from harvestry.llm import registry


@pytest.fixture(scope="module")
def kept(spark, sf, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, out[-1], sf).write.parquet(str(at / str(i)))
        out.append(spark.read.parquet(str(at / str(i))))
    return out


def text_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(kept):
    for df in kept[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language(kept):
    before, after = text_of(kept[0]), text_of(kept[1])
    assert set(after) <= set(before) and len(after) >= 0.97 * len(before)
    assert all(after[d] == before[d] for d in after)
    assert all(len(before[d] or "") < 60 for d in set(before) - set(after))  # only texts too short to tell


def test_near_dedup(kept):
    before, after = text_of(kept[1]), text_of(kept[2])

    def shingles(t):
        w = t.lower().encode().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {d: shingles(t) for d, t in before.items()}
    where = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    shared = collections.Counter((a, b) for ds in where.values() for a in ds for b in ds if a < b)
    root = {d: d for d in before}
    for p, n in shared.items():
        if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= 0.8:
            low, high = sorted((root[p[0]], root[p[1]]))
            root = {d: low if r == high else r for d, r in root.items()}
    assert set(after) == set(root.values()) and len(after) < len(before)
    assert all(after[d] == before[d] for d in after)


def test_substrings(kept):
    before, after = text_of(kept[2]), text_of(kept[3])
    first = {}
    for d in sorted(before):
        w = before[d].encode().split()
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (d, i))
    for d, t in before.items():
        w, gone = t.encode().split(), set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (d, i):
                gone.update(range(i, i + 20))
        assert after[d].encode().split() == [x for i, x in enumerate(w) if i not in gone]
        assert gone or after[d] == t
    assert all(r["n_chars"] == len(r["text"]) for r in kept[3].collect())


def test_mix(kept):
    before, rows = text_of(kept[3]), kept[4].collect()
    copies = collections.Counter(r["doc_id"] for r in rows)
    assert max(copies.values()) <= 2 and set(copies) <= set(before)
    total = sum(len(t.encode().split()) for t in before.values())
    mixed = sum(len(r["text"].encode().split()) for r in rows)
    longest = max(len(t.encode().split()) for t in before.values())
    assert abs(mixed - 1.5 * total) <= 20 * longest


def test_pack(kept):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = sum(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in kept[4].collect())
    pieces = kept[5].collect()
    assert sum(p["length"] for p in pieces) == n
    ids = [t.encode(kept[4].where(f"doc_id = {p['doc_id']}").first()["text"], add_special_tokens=False).ids + [0] for p in pieces[:20]]
    import numpy as np

    assert [zlib.crc32(np.array(i[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for i, p in zip(ids, pieces, strict=False)] == [p["ids_crc32"] for p in pieces[:20]]


def test_registered(spark, sf):
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in registry.QUERIES}
    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(registry.SQL[name]).fetchall()
    names = [d[0] for d in con.description]
    got = [tuple(r) for r in registry.QUERIES[name](spark, sf).select(*names).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_odd_rows(spark):
    from test_operators import texts

    shape = "doc_id long, text string, lang string, source string, n_chars long, copies string, id string, n_words string, __row string, __kept string, __more string"
    rows = [(*r, None, "x", None, "y", "r", "k", "m") for r in texts()]
    docs = spark.createDataFrame(rows, shape)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, "unused")
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        assert {r["n_words"] for r in out.collect()} <= {"y"}
    kept = P.near_dedup(spark, docs, "").collect()
    assert sorted(str(r["doc_id"]) for r in kept if r["doc_id"] not in (6, 10, 7, 8, 9)) == sorted(["1", "2", "3", "5", "None"])
    assert len([r for r in kept if r["doc_id"] in (6, 10)]) == 1 and len([r for r in kept if r["doc_id"] in (7, 8, 9)]) == 1
    assert P.pack(spark, docs, "").count() > 0
    # repeated rows and rows of one id are rows of their own to the mix
    mixed = P.mix(spark, docs.unionByName(docs), "").collect()
    size = collections.Counter(r["source"] for r in mixed)
    assert size["a"] > 0 and all(r["text"] and r["text"].split() for r in mixed)
    none = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, "").count() == 0


def test_near_dedup_is_exact(spark):
    """Pairs on both sides of 0.8, short and long: those at it or above are all found, those below all stay."""
    words = lambda k, n: [f"k{k}x{i}" for i in range(n)]
    rows, want = [], []
    for k in range(60):
        n = 504 if k % 2 else 84
        near = words(k, n)
        at = n - 4 - (n - 4) // 9  # so many shingles shared, of n - 4 each: 0.8 if 9 divides
        far = near[: at + 4 - k % 3] + words(f"{k}y", n - at - 4 + k % 3)
        m = at - k % 3
        rows += [(4 * k, " ".join(near)), (4 * k + 1, " ".join(far))]
        want += [4 * k] if m / (2 * (n - 4) - m) >= 0.8 else [4 * k, 4 * k + 1]
        a = words(f"{k}s", 8 if k % 2 else 10)
        rows += [(4 * k + 2, " ".join(a)), (4 * k + 3, " ".join([*a, "end"]))]  # 4 of 5 and 6 of 7
        want += [4 * k + 2]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in P.near_dedup(spark, docs, "").select("doc_id").collect())
    assert got == want


def test_near_dedup_by_row(spark):
    """Rows that share an id but not a text both stay or go by their own text; of copies without an id one stays."""
    one, other, third = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, one), (2, other), (2, one), (None, third), (None, third), (None, third + " end")]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r["doc_id"]), r["text"][0]) for r in P.near_dedup(spark, docs, "").collect())
    assert got == [("1", "a"), ("2", "b"), ("None", "c")]


def test_near_dedup_in_rounds(spark, monkeypatch):
    """A component in many pairs of parts sends its texts in rounds, and keeps the same rows."""
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*words[: 250 + i // 2], *(f"e{i}x{j}" for j in range(50 - i // 2))])) for i in range(60)]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted(r["doc_id"] for r in P.near_dedup(spark, docs, "").select("doc_id").collect())
    calls, plain = [], P.simhash._verify
    monkeypatch.setattr(P.simhash, "SETS", 8)
    monkeypatch.setattr(P.simhash, "_verify", lambda *a: calls.append(a) or plain(*a))
    assert sorted(r["doc_id"] for r in P.near_dedup(spark, docs, "").select("doc_id").collect()) == want
    assert len(calls) > 1 and 1 < len(want) < 60
