"""Five stages from raw documents to packed training sequences, each one of the operators of harvestry.llm.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents (any more pass through), and returns a
DataFrame that is written as Parquet and read again as the docs of the next.

1. language_id: documents whose language is clear stay; those without a letter, and those whose margin between the two
   best languages is narrow, go. Dictionaries are learned from the labelled rows among docs.
2. simhash_near_dedup: of documents linked by a Jaccard similarity of 0.8 or more of their sets of five-word shingles,
   the one with the smallest doc_id stays (of rows that share that id, one), and of those without a doc_id one.
   1,024-bit SimHash fingerprints find the candidates, an exact comparison decides.
3. substring_dedup: passages of 20 words and more that an earlier document, or an earlier place of the document, has are
   cut out of the text; n_chars follows. Documents stay, also if nothing is left of them.
4. mix_sources: documents are dropped or repeated so that sources take their target weights, long ones rather kept.
5. packing: the documents' tokens as pieces of full sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm import common as C
from harvestry.llm import language_id, mixing, packing, simhash, substring_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _aside(docs: DataFrame, *own: Column) -> DataFrame:
    """Columns besides those of documents in one, so that operators' own columns can't meet their names."""
    more = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in COLUMNS]
    return docs.select(*COLUMNS, *([F.struct(*more).alias("__more")] if more else []), *own)


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*(F.col(c) if c in COLUMNS else F.col(f"__more.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def clear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; null and empty texts have none, rows count each, no label is asked of a row."""
    learned = language_id.learn(docs, F.col("doc_id"))
    return _back(language_id.identify(_aside(docs), learned).where(language_id.accepted()), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: by row, whatever ids they have or share; texts without words are alike."""
    docs, place = C.numbered(docs)
    rows = _aside(docs, place.alias("__row"))
    kept = C.written(simhash.near_duplicates(rows, "__row").select(F.col("key").alias("__kept")))
    return _back(rows.join(kept, F.col("__row") == F.col("__kept"), "left_semi"), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without repeated passages, all else of them as it was; null texts become empty."""
    cut = substring_dedup.substring_dedup(_aside(docs), whole_words=False)
    cut = cut.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("text").cast("long"))
    return _back(cut, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: those that share an id or have none have copies of their own, empty ones none."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, each window in the shares that the mix has given the sources; null texts are an end alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", clear_language),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", cut_repeats),
    ("mix_sources", mix),
    ("packing", pack),
]

#: Compression, fingerprints of random bits and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {}
