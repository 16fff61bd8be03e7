"""URL filter: gradient-boosted trees on lexical features, trained from labelled URLs.

Features: lengths, depth, digit ratio, character entropy, parameter counts, dots and hyphens of the host, and for
the host's suffix and the path's extension how often they occur and how often they are bad (smoothed).

Defined results
- A null or blank URL has a null score and is not spam.
- Repeated rows get the same score. All other columns are kept, whatever their names; those named like a result column are
  replaced.
- An empty table gives an empty table. Without labelled URLs of both classes there is nothing to learn: all scores are the
  share of bad ones among them, 0 if there are none.
- What the trees see of the labels of a suffix or extension leaves out those of the URL's own fold, so that no URL of the
  fit sees its own label.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.shared import checkpointed, fields, plain

LEXICAL = ("length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "dots", "hyphens", "host_digits", "longest_label", "secure", "fragment")
SUFFIX = ("suffix_count", "suffix_bad", "extension_count", "extension_bad")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def lexical(rows: DataFrame) -> DataFrame:
    """Adds one column a lexical feature, and __suffix and __extension."""
    url = F.lower(F.trim(F.coalesce("url", F.lit(""))))
    rest = F.regexp_replace(F.col("__url"), r"^[a-z][a-z0-9+.-]*://", "")
    chars = F.filter(F.split("__url", ""), lambda c: c != "")
    n = F.greatest(F.length("__url"), F.lit(1))
    share = lambda c: F.size(F.filter("__chars", lambda x: x == c)) / n
    return (
        rows.withColumn("__url", url)
        .withColumns({"__host": F.regexp_extract(rest, r"^([^/?#:]*)", 1), "__path": F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1), "__query": F.regexp_extract("__url", r"\?([^#]*)", 1), "__chars": chars})
        .withColumns({
            "length": F.length("__url"), "host_length": F.length("__host"), "path_length": F.length("__path"), "depth": _count(F.col("__path"), r"/[^/]+"),
            "digit_ratio": _count(F.col("__url"), r"\d") / n, "parameters": _count(F.col("__query"), r"[^&;]+"),
            "entropy": -F.aggregate(F.transform(F.array_distinct("__chars"), lambda c: share(c) * F.log(share(c))), F.lit(0.0), lambda a, x: a + x),
            "dots": _count(F.col("__host"), r"\."), "hyphens": _count(F.col("__host"), "-"), "host_digits": _count(F.col("__host"), r"\d"),
            "longest_label": F.array_max(F.transform(F.split("__host", r"\."), lambda x: F.length(x))),
            "secure": F.startswith("__url", F.lit("https:")).cast("int"), "fragment": F.contains("__url", F.lit("#")).cast("int"),
            "__suffix": F.regexp_extract("__host", r"([^.]*)$", 1), "__extension": F.regexp_extract("__path", r"\.([a-z0-9]{1,5})$", 1),
        })
        .drop("__chars", "__query", "__path", "__host")
    )


FOLDS = 5


@dataclass
class UrlModel:
    trees: GBTClassificationModel | None
    suffixes: DataFrame
    extensions: DataFrame
    base_rate: float


def _bad_rate(bad, n, base: float):
    return (bad + 5 * base) / (n + 5)


def _statistics(pages: DataFrame, labelled: DataFrame, key: str, name: str, base: float, least: int) -> DataFrame:
    """How often each value of key occurs in pages and is bad in labelled; values seen less than `least` times are left out."""
    bad = labelled.groupBy(key).agg(F.count("*").alias("n"), F.sum("__label").alias("bad"))
    return (
        pages.groupBy(key).agg(F.count("*").alias("all")).where(F.col("all") >= least).join(bad, key, "left").fillna(0, ["n", "bad"])
        .select(key, F.log1p("all").alias(f"{name}_count"), _bad_rate(F.col("bad"), F.col("n"), base).alias(f"{name}_bad"))
    )


def _out_of_fold(rows: DataFrame, labelled: DataFrame, key: str, name: str, base: float) -> DataFrame:
    """rows with the bad rates of a column taken over the labelled rows of all folds but their own. Values that aren't counted stay so."""
    by = labelled.groupBy(key, "__fold").agg(F.count("*").alias("n"), F.sum("__label").alias("bad"))
    whole = Window.partitionBy(key)
    others = by.select(key, "__fold", _bad_rate(F.sum("bad").over(whole) - F.col("bad"), F.sum("n").over(whole) - F.col("n"), base).alias("__other"))
    joined = rows.join(others, [key, "__fold"], "left")
    return joined.withColumn(f"{name}_bad", F.when(F.col(f"{name}_count").isNotNull(), F.coalesce("__other", f"{name}_bad"))).drop("__other")


def _features(rows: DataFrame, suffixes: DataFrame, extensions: DataFrame, base: float, labelled: DataFrame | None = None) -> DataFrame:
    """labelled: rows are of them, and their rates are taken out of fold."""
    rows = rows.join(suffixes, "__suffix", "left").join(extensions, "__extension", "left")
    if labelled is not None:
        rows = _out_of_fold(_out_of_fold(rows, labelled, "__suffix", "suffix", base), labelled, "__extension", "extension", base)
    rows = rows.fillna({"suffix_count": 0.0, "extension_count": 0.0, "suffix_bad": base, "extension_bad": base})
    return VectorAssembler(inputCols=[*LEXICAL, *SUFFIX], outputCol="__features").transform(rows)


def train(labelled: DataFrame, pages: DataFrame | None = None, max_rows: int = 200_000, trees: int = 20, depth: int = 4, seed: int = 1) -> UrlModel:
    """labelled: url, label (0 or 1). pages: all URLs, by which suffixes and extensions are counted; None takes the labelled ones.

    At most about max_rows labelled URLs, chosen by a hash of the URL, fit the trees; the statistics take all.
    """
    some = F.col("url").isNotNull() & (F.trim("url") != "")
    rows = fields(labelled, "url", "label").where(some & F.col("label").isin(0, 1)).select("url", F.col("label").cast("double").alias("__label"))
    n, bad = rows.agg(F.count("*"), F.sum("__label")).first()
    base = bad / n if n else 0.0
    rows = rows.withColumn("__fold", F.pmod(F.xxhash64("url", F.lit(seed)), F.lit(FOLDS)))
    known = lexical(rows)
    everything = known if pages is None else lexical(fields(pages, "url").where(some))
    suffixes = _statistics(everything, known, "__suffix", "suffix", base, 5)
    extensions = _statistics(everything, known, "__extension", "extension", base, 5)
    if not n or not 0 < bad < n:
        return UrlModel(None, suffixes, extensions, base)
    fitted = known
    if n > max_rows:
        fitted = lexical(rows.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(1e6 * max_rows / n)))
    made = _features(fitted, suffixes, extensions, base, known).withColumn("__weight", F.when(F.col("__label") == 1, 0.5 / base).otherwise(0.5 / (1 - base)))
    made = checkpointed(made.select("__features", "__label", "__weight"))  # the passes of the fit don't count all URLs again
    model = GBTClassifier(featuresCol="__features", labelCol="__label", weightCol="__weight", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed).fit(made)
    return UrlModel(model, suffixes, extensions, base)


def score(pages: DataFrame, model: UrlModel, threshold: float = 0.5) -> DataFrame:
    """All rows and columns of pages with score (probability of spam) and spam."""
    pages, names, (url,) = plain(pages, ("url",), ("score", "spam"))
    # struct: columns of the input can't clash with those of the features
    rows = lexical(pages.select(F.struct(*pages.columns).alias("__row"), F.col(url).cast("string").alias("url")))
    if model.trees is None:
        probability = F.when(F.col("__url") != "", F.lit(round(model.base_rate, 9)))
        scored = rows
    else:
        trees = model.trees.copy({model.trees.predictionCol: "__p", model.trees.rawPredictionCol: "__raw", model.trees.probabilityCol: "__prob"})
        probability = F.when(F.col("__url") != "", F.round(vector_to_array("__prob")[1], 9))
        scored = trees.transform(_features(rows, model.suffixes, model.extensions, model.base_rate))
    return scored.select("__row.*", probability.alias("score"), F.coalesce(probability >= threshold, F.lit(False)).alias("spam")).toDF(*names, "score", "spam")


def blocklist_labels(pages: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """url, label: 1 where a label of the host, cut at hyphens, is on the list."""
    pages = fields(pages, "url")
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1)
    return pages.where(host != "").select("url", F.arrays_overlap(F.split(host, r"[.-]"), F.array(*map(F.lit, words))).cast("int").alias("label"))
