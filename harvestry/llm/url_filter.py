"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the URLs that no rule fits.

The trees (pyspark.ml, in the JVM) learn from URLs that rules have labelled: about `sample` of them, chosen by hash.
Features: lengths, depth, labels, digit ratio, entropy, parameters, and how often labelled URLs of the same host suffix
(one, two, three labels) and first path segment are blocked. Those statistics count all labelled URLs; they are tables
of their own, joined as the plan sees fit. A URL that the trees learn from has the rates of the other folds (of FOLDS,
by a hash of the URL), so that its own label is not among its features.

Defined cases: a null URL, or one without ://, has empty host and path and fits no rule; of equally long rules the first
given wins; if the labelled URLs are all of one verdict, that is the method's; if there are none, it allows; equal URLs
have equal verdicts, and repeated rows count each in the statistics; URLs of any length are taken whole; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm import common as C

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
SAMPLE = 20_000
TREES, DEPTH = 12, 4
FOLDS = 5
KEYS = ("suffix1", "suffix2", "suffix3", "segment")
FEATURES = ("f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_entropy", "f_parameters", "f_query_length", "f_fragment", "f_hyphens", "f_suffix1", "f_suffix2", "f_suffix3", "f_segment")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at == 0, "").otherwise(F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits a character; 0 for an empty text."""
    n = F.length(text)
    each = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n == 0, 0.0).otherwise(F.aggregate(F.filter(each, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def keys(host: Column, path: Column) -> list[Column]:
    """What statistics are kept of: the last one, two and three labels of the host, and the first segment of the path."""
    labels = F.split(host, r"\.")
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (k - 1), F.lit(1)), F.lit(k)), ".")
    return [*(last(k).alias(f"k_suffix{k}") for k in (1, 2, 3)), F.regexp_extract(path, r"^/([^/]*)", 1).alias("k_segment")]


def lexical(urls: DataFrame) -> DataFrame:
    """urls (url, host, path) with the features that need no statistics, and the keys of those that do."""
    u = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    n = F.length(u)
    labels = F.split(F.col("host"), r"\.")
    number = lambda c: c.cast("double")
    return urls.select(
        "*",
        number(n).alias("f_length"), number(F.length("host")).alias("f_host_length"), number(F.length("path")).alias("f_path_length"),
        number(F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).alias("f_depth"), number(F.size(labels)).alias("f_labels"),
        F.when(n == 0, 0.0).otherwise(F.length(F.regexp_replace(u, "[^0-9]", "")) / F.greatest(n, F.lit(1))).alias("f_digits"), entropy(u).alias("f_entropy"),
        number(F.when(query == "", 0).otherwise(F.size(F.split(query, "&")))).alias("f_parameters"), number(F.length(query)).alias("f_query_length"),
        number(F.contains(u, F.lit("#")).cast("int")).alias("f_fragment"), number(n - F.length(F.replace(u, F.lit("-"), F.lit("")))).alias("f_hyphens"),
        *keys(F.col("host"), F.col("path")),
    )


def _draw(part: int) -> Column:
    """A number in [0, 1) that a URL decides; part: which of several."""
    return F.pmod(F.xxhash64("url", F.lit(part)), F.lit(1 << 30)) / float(1 << 30)


class Filter:
    """Learned from labelled URLs (host, path, url, verdict): rates from all of them, trees from about `sample`."""

    def __init__(self, labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, sample: int = SAMPLE):
        counts = {r[0]: r[1] for r in labelled.groupBy("verdict").count().collect()}
        n = sum(counts.values())
        self.share = counts.get("block", 0) / max(1, n)
        self.model: GBTClassificationModel | None = None
        if len(counts) < 2:
            return
        fold = F.floor(_draw(1) * FOLDS).cast("int")
        blocked = (F.col("verdict") == "block").cast("long")
        rows = labelled.select(*keys(F.col("host"), F.col("path")), fold.alias("fold"), blocked.alias("blocked"))
        # one pass over all labelled URLs: a row for each kind of key, key and fold
        kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"k_{k}").alias("key")) for k in KEYS)))
        parts = rows.select(kinds.alias("at"), "fold", "blocked").groupBy("at.kind", "at.key", "fold")
        self.parts = C.written(parts.agg(F.sum("blocked").alias("b"), F.count("*").alias("n")))
        self.stats = C.written(self.parts.groupBy("kind", "key").agg(F.sum("b").alias("b"), F.sum("n").alias("n")))
        few = labelled.where(_draw(0) < sample / n).select("url", "host", "path", blocked.cast("double").alias("label"), fold.alias("fold"))
        few = self._vectors(lexical(few.coalesce(4)), own_fold=True).select("features", "label")
        self.model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, seed=1).fit(C.written(few))

    def _vectors(self, rows: DataFrame, own_fold: bool = False) -> DataFrame:
        """rows with their features; own_fold: the rates leave out what a row's fold (column fold) has counted."""
        for k in KEYS:
            known = self.stats.where(F.col("kind") == k).select(F.col("key").alias("__key"), F.col("b").alias("__b"), F.col("n").alias("__n"))
            rows = rows.join(known, F.col(f"k_{k}") == F.col("__key"), "left").drop("__key")
            b, n = F.coalesce("__b", F.lit(0)), F.coalesce("__n", F.lit(0))
            if own_fold:
                own = self.parts.where(F.col("kind") == k).select(F.col("key").alias("__key"), F.col("fold").alias("__fold"), F.col("b").alias("__own"), F.col("n").alias("__of"))
                rows = rows.join(own, (F.col(f"k_{k}") == F.col("__key")) & (F.col("fold") == F.col("__fold")), "left").drop("__key", "__fold")
                b, n = b - F.coalesce("__own", F.lit(0)), n - F.coalesce("__of", F.lit(0))
            rows = rows.withColumn(f"f_{k}", (b + 2.0 * self.share) / (n + 2.0)).drop("__b", "__n", "__own", "__of")
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)

    def verdicts(self, urls: DataFrame) -> DataFrame:
        """urls with column method: allow or block."""
        if self.model is None:
            return urls.withColumn("method", F.lit("block" if self.share > 0 else "allow"))
        keep = urls.columns
        done = self.model.transform(self._vectors(lexical(urls)))
        return done.select(*keep, F.when(F.col("prediction") > 0, "block").otherwise("allow").alias("method"))


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of pages."""
    urls = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))
    host, path = host_and_path(F.col("url"))
    urls = urls.withColumn("host", host).withColumn("path", path)
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    urls = urls.withColumn("rule", rule).withColumn("verdict", verdict)
    learned = Filter(urls.where("verdict IS NOT NULL").select("url", "host", "path", "verdict"), sample=sample)
    done = learned.verdicts(urls)
    return done.select("id", "host", "path", "rule", F.coalesce("verdict", "method").alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's verdicts on all pages' URLs; those without a rule have the trees'."""
    return url_verdicts(C.table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
