"""Operator 12, URL filters: rules for hosts and paths, gradient-boosted trees for the urls that no rule fits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, materialize

#: (verdict, host and path) of the contract.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A suffix has a statistic of its own if so large a part of all urls has it; there can be so many at most of a kind.
FREQUENT = 10_000
#: Urls that a suffix's block share is drawn to the overall share by.
PRIOR = 20.0
#: Suffixes of more characters have no statistics.
LONGEST = 255
SUFFIXES = ("last_label", "last_two_labels", "label_and_step")
LEXICAL = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "parameters", "query_length", "fragment")
FEATURES = (*LEXICAL, *(f"{s}_{x}" for s in SUFFIXES for x in ("share", "blocked")))


def url_parts(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with ``host`` (A-Z lower-cased), ``path`` and ``rest`` (from the first ? or # on); empty without ``://``."""
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    split = urls.drop(*{"host", "path", "rest"} - {url_col}).withColumn("_after", after).withColumn("_host", F.regexp_extract("_after", "^[^/?#]*", 0))
    split = split.withColumn("_tail", F.substring("_after", F.length("_host") + 1, F.length("_after"))).withColumn("path", F.regexp_extract("_tail", "^[^?#]*", 0))
    return split.withColumn("rest", F.substring("_tail", F.length("path") + 1, F.length("_tail"))).withColumn("host", ascii_lower(F.col("_host"))).drop("_after", "_host", "_tail")


def matched_rule(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule that fits ``host`` and ``path`` and its verdict, null where none does; the longest wins, of equals the first named."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def lexical_features(parts: DataFrame, url_col: str = "url") -> DataFrame:
    """``parts`` with the columns of ``LEXICAL`` and the keys of ``SUFFIXES``; built-in functions only."""
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    query = F.regexp_extract("rest", "^\\?([^#]*)", 1)
    step = F.get(F.split("path", "/"), F.lit(1))
    shares = F.transform(F.array_distinct(F.split(url, "")), lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / F.length(url))
    values = {
        "url_length": F.length(url),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": F.size(F.array_remove(F.split("path", "/"), "")),
        "labels": F.size(F.split("host", "\\.")),
        "digit_ratio": (F.length(url) - F.length(F.translate(url, "0123456789", ""))) / F.greatest(F.length(url), F.lit(1)),
        "hyphens": F.length("host") - F.length(F.translate("host", "-", "")),
        "entropy": F.when(F.length(url) > 0, -F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda sum_, p: sum_ + p * F.log2(p))).otherwise(0.0),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "query_length": F.length(query),
        "fragment": F.col("rest").contains("#").cast("int"),
    }
    last = F.substring_index("host", ".", -1)
    keys = {"last_label": last, "last_two_labels": F.substring_index("host", ".", -2), "label_and_step": F.concat(last, F.lit("/"), F.coalesce(step, F.lit("")))}
    return parts.select("*", *[v.cast("double").alias(k) for k, v in values.items()], *[F.when(F.length(v) <= LONGEST, v).alias(k) for k, v in keys.items()])


def suffix_statistics(urls: DataFrame) -> DataFrame:
    """(kind, suffix, share, blocked) from all of ``urls``, with ``said`` the verdict of a rule or null.

    ``share`` is the part of all urls with the suffix, ``blocked`` the part of
    those decided by a rule that it blocks, drawn to the overall part by
    ``PRIOR`` urls. Only suffixes of at least one in ``FREQUENT`` urls have a
    row, so there are at most ``FREQUENT`` of each kind, of ``LONGEST`` characters
    or less; rarer ones say nothing certain and count as share 0 with the
    overall part, which is the row of null kind.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("suffix")) for k in SUFFIXES], F.struct(F.lit(None).cast("string").alias("kind"), F.lit("").alias("suffix")))
    counts = urls.select("said", F.explode(kinds).alias("k")).where("k.suffix IS NOT NULL").groupBy("k.kind", "k.suffix")
    counts = counts.agg(F.count("*").alias("n"), F.count_if(F.col("said") == "block").alias("blocks"), F.count("said").alias("decided"))
    counts = materialize(counts, "suffixes")
    total = counts.where("kind IS NULL").select(F.col("n").alias("all"), ((F.col("blocks") + 1) / (F.col("decided") + 2)).alias("part"))
    blocked = (F.col("blocks") + PRIOR * F.col("part")) / (F.col("decided") + PRIOR)
    frequent = counts.crossJoin(F.broadcast(total)).where(F.col("n") * FREQUENT >= F.col("all"))  # one row
    return frequent.select("kind", "suffix", (F.col("n") / F.col("all")).alias("share"), F.when(F.col("kind").isNull(), F.col("part")).otherwise(blocked).alias("blocked"))


def with_statistics(urls: DataFrame, statistics: DataFrame) -> DataFrame:
    """``urls`` with two features for each kind of suffix; the statistics' size is bounded by ``FREQUENT``."""
    overall = statistics.where("kind IS NULL").select(F.col("blocked").alias("_overall"))
    for kind in SUFFIXES:
        own = statistics.where(F.col("kind") == kind).select(F.col("suffix").alias(kind), F.col("share").alias(f"{kind}_share"), F.col("blocked").alias(f"{kind}_blocked"))
        urls = urls.join(F.broadcast(own), kind, "left")
    urls = urls.crossJoin(F.broadcast(overall))  # one row
    filled = {f"{k}_share": F.coalesce(f"{k}_share", F.lit(0.0)) for k in SUFFIXES} | {f"{k}_blocked": F.coalesce(f"{k}_blocked", "_overall") for k in SUFFIXES}
    return urls.withColumns(filled).drop("_overall")


@dataclass
class UrlModel:
    """Trees over ``FEATURES``, or the one verdict that all labelled urls had."""

    trees: GBTClassificationModel | None
    only: str = "allow"

    def verdicts(self, urls: DataFrame) -> DataFrame:
        """``urls`` with ``judged``, the model's verdict, and ``p_block``."""
        if self.trees is None:
            return urls.withColumn("judged", F.lit(self.only)).withColumn("p_block", F.lit(1.0 if self.only == "block" else 0.0))
        scored = self.trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(urls))
        return scored.withColumn("p_block", vector_to_array("probability")[1]).withColumn("judged", F.when(F.col("prediction") == 1, "block").otherwise("allow")).drop("_features", "rawPrediction", "probability", "prediction")


def fit_urls(urls: DataFrame, sample_rows: int = 100_000, trees: int = 20, depth: int = 4, seed: int = 7) -> UrlModel:
    """Boost trees on about ``sample_rows`` of the rows of ``urls`` (FEATURES, said) that have a verdict, drawn by a hash of ``spread``.

    Spark's own boosting fits them, so the rows stay on the executors. Where
    all labelled urls have one verdict there is nothing to learn and the model
    gives that one; without any it allows.
    """
    labelled = urls.where("said IS NOT NULL")
    counts = {r["said"]: r["count"] for r in labelled.groupBy("said").count().collect()}  # two rows
    if len(counts) < 2:
        return UrlModel(None, *counts)
    draw = F.pmod(F.xxhash64(F.lit(seed), "spread"), F.lit(1 << 30)) / float(1 << 30)
    drawn = labelled.where(draw < sample_rows / sum(counts.values())).select(*FEATURES, (F.col("said") == "block").cast("double").alias("label"), "spread")
    # Spark's split candidates follow the order of rows, so the sample gets one.
    drawn = materialize(drawn.orderBy("spread", *FEATURES).coalesce(8), "labelled-urls")
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(drawn)
    boost = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed, checkpointInterval=-1)
    if assembled.select(F.count_distinct("label")).first()[0] < 2:  # a tiny sample may miss one verdict
        return UrlModel(None, max(counts, key=lambda k: (counts[k], k)))
    return UrlModel(boost.fit(assembled))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", sample_rows: int = 100_000) -> DataFrame:
    """A verdict for each url: that of the longest rule that fits, else that of boosted trees learnt from the urls with a rule.

    A rule is a host and the start of a path (``example.net/en/``) and fits the
    host and all its subdomains; ``rules`` is configuration and becomes one
    expression. Features are lexical (length, depth, digits, entropy,
    parameters) and statistics of suffixes counted over all urls
    (:func:`suffix_statistics`). The trees are fitted on about ``sample_rows``
    labelled rows; every row is judged.

    Returns id, host, path, rule, verdict and ``p_block`` (the trees' own
    probability, whatever the rule says). Null urls and urls without ``://``
    have empty host and path and are judged like any other. Rows stay as many
    as they are, repeated ids and urls included; an empty table stays empty;
    other columns, clashing ones too, are left out.
    """
    urls = pages.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{url_col}`").cast("string").alias("url"))
    rule, said = matched_rule(rules)
    rows = lexical_features(url_parts(urls).withColumns({"rule": rule, "said": said, "spread": F.xxhash64("url", id_col)}))
    rows = materialize(rows.drop("rest"), "urls")
    rows = with_statistics(rows, materialize(suffix_statistics(rows), "suffix-statistics"))
    judged = fit_urls(rows, sample_rows).verdicts(rows)
    return judged.select(id_col, "host", "path", "rule", F.coalesce("said", "judged").alias("verdict"), "p_block")


def op12_url_filters(spark, sf_dir):
    """Verdicts over the urls of all pages."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
