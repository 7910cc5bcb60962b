"""Language identification by compression: the language whose zstandard raw-content dictionary shrinks a text most.

A dictionary is made for each language from the whole texts of `sample` labelled rows at most, chosen by a hash of their
ids among those of up to `longest` bytes (where a language has fewer of them, also among its shortest others), so the
bound is one on rows. A text is lower-cased, all of ASCII but letters becomes space, and the whole of it is compressed
with each dictionary, in chunks of `CHUNK` bytes that know nothing of each other: a dictionary helps each as much, so
that the margin of a long text is that of its chunks. The smallest sum names the language; ties go to the language with
more labelled rows, then to the smaller name. The margin, 1 - smallest / second, is the score: narrow margins are
rejected by accepted().

Defined cases: a null text, or one without a letter (Unicode category L), is `und` with score 0; a null language is not
learned, an empty one is a language like any other; with one language every text with a letter is that, with score 1; with
none all are `und`; a null id counts as the text '' in the choice of labelled rows, and rows of equal id are chosen by
their texts; repeated rows count each; the smaller of two equal sums is the first language's; an empty table gives no
rows; columns named lang_pred and score are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestry.llm import common as C

#: Labelled rows of a language that are learned from, at most, and the bytes that such a text rather has at most.
SAMPLE, LONGEST, LEVEL = 96, 1 << 14, 6
#: Bytes of text that are compressed at a time.
CHUNK = 1 << 14
#: Margins below this are narrow.
NARROW = 0.002
#: What the dictionaries may take together, in bytes, as far as texts of LONGEST bytes fill them: they go to every executor.
BOUND = 1 << 28
_PLAIN = bytes(c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))
_LETTER = regex.compile(r"\p{L}")


def plain(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_PLAIN).split())


def learn(labelled: DataFrame, key: Column, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, longest: int = LONGEST) -> list[tuple[str, bytes]]:
    """(language, dictionary content), the language with most rows first. key: decides which rows are sampled.

    With very many languages each has fewer rows, so that all dictionaries together stay under BOUND.
    """
    text = F.col(f"`{text_col}`")
    rows = labelled.select(text.alias("text"), F.col(f"`{lang_col}`").alias("lang"), (F.pmod(F.xxhash64(key, text), F.lit(1 << 40)) / float(1 << 40)).alias("u"), F.octet_length(text).alias("n"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: (r["rows"], r["fit"]) for r in rows.groupBy("lang").agg(F.count("*").alias("rows"), F.count(F.when(F.col("n") <= longest, 1)).alias("fit")).collect()}
    if not counts:
        return []
    sample = max(1, min(sample, BOUND // (longest * len(counts))))
    # about twice the sample passes, so that no task sorts all rows; of languages with few rows that fit, all of them do
    share = F.create_map(*(F.lit(x) for lang, (_, fit) in counts.items() for x in (lang, min(1.0, 2.0 * sample / max(1, fit) + 20.0 / max(1, fit)))))
    near = rows.where((F.col("n") <= longest) & (F.col("u") < F.element_at(share, F.col("lang"))))
    if few := [lang for lang, (all_, fit) in counts.items() if fit < min(sample, all_)]:
        # the shortest of those that are longer: a top-k by language, without their texts until they are chosen
        long = rows.where(F.col("lang").isin(few) & (F.col("n") > longest))
        at = Window.partitionBy("lang").orderBy("n", "u")
        ends = long.select("lang", "n", "u", F.row_number().over(at).alias("i")).where(F.col("i") <= sample).groupBy("lang").agg(F.max(F.struct("n", "u")).alias("end"))
        long = long.join(ends.select(F.col("lang").alias("l"), "end"), F.col("lang") == F.col("l")).where(F.struct("n", "u") <= F.col("end"))
        near = near.unionByName(long.select(*near.columns))
    got: dict[str, list[str]] = {}
    for r in sorted(near.collect(), key=lambda r: (r["n"] > longest and r["n"], r["u"], r["text"])):
        if len(mine := got.setdefault(r["lang"], [])) < sample:
            mine.append(r["text"])
    return [(lang, b" ".join(plain(t) for t in got.get(lang, []))) for lang in sorted(counts, key=lambda x: (-counts[x][0], x))]


def _predict(learned, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = [
            (lang, zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) if len(content) >= 8 else zstandard.ZstdCompressor(level=level))
            for lang, content in learned.value
        ]

        def of(text: str | None) -> tuple[str, float]:
            if not packs or text is None or not _LETTER.search(text):
                return "und", 0.0
            data = plain(text)
            chunks = [data[i : i + CHUNK] for i in range(0, max(1, len(data)), CHUNK)]
            sizes = [sum(len(pack.compress(c)) for c in chunks) for _, pack in packs]
            best = min(range(len(sizes)), key=sizes.__getitem__)
            second = min((n for i, n in enumerate(sizes) if i != best), default=0)
            return packs[best][0], 1.0 - sizes[best] / second if second else 1.0

        for b in batches:
            lang, score = zip(*map(of, b.column(0).to_pylist()), strict=True) if b.num_rows else ((), ())
            rest = b.column(1)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), rest], ["lang_pred", "score", "rest"])

    return C.lean(run)


def identify(docs: DataFrame, learned: list[tuple[str, bytes]], text_col: str = "text", level: int = LEVEL) -> DataFrame:
    """docs with lang_pred and score, which replace columns of the same names."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rest = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.lit(0).alias("_"))
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), rest.alias("rest"))
    held = docs.sparkSession.sparkContext.broadcast(learned)
    shape = f"lang_pred string, score double, rest {rows.schema['rest'].dataType.simpleString()}"
    done = rows.mapInArrow(_predict(held, level), shape)
    return done.select(*(F.col(f"rest.c{i}").alias(c) for i, c in enumerate(names)), "lang_pred", "score")


def accepted(narrow: float = NARROW) -> Column:
    return (F.col("lang_pred") != "und") & (F.col("score") >= narrow)


def crc_of_id(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's prediction for all documents, learned from those whose crc32 of the id, mod 4, is not 2."""
    docs = C.table(spark, sf_dir, "documents")
    held_out = crc_of_id() % 4 == 2
    learned = learn(docs.where(~held_out), F.col("doc_id"))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), learned).select("doc_id", "held_out", "lang_pred", "score")
