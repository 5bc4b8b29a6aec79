"""URL filter: allow and block rules by host and path, then a logistic regression on hashed character n-grams.

Everything on rows is DataFrame functions: n-grams are cut, hashed and summed in the JVM.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """Fits its host and all subdomains, if the url's path starts with the rule's; ``text`` is host and path together."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1]


RULES = (UrlRule("allow", "org/"), UrlRule("block", "example.org/es/"), UrlRule("block", "example.org/en/1"), UrlRule("allow", "com/fr/"), UrlRule("block", "com/de/"))

#: Parameters of the model: n-gram lengths, hash buckets, regularisation.
NGRAMS, BUCKETS, REGULARISATION = (3, 4), 4096, 0.001
MAX_LABELLED = 20_000
#: Log odds from which a url is blocked: two to one.
BLOCK_FROM = 0.69

# The labelled table: a row for each pair of words, so that no word decides by its partner. Ordinary words of both kinds of hosts.
_BLOCKED_WORDS = (
    "casino poker roulette jackpot betting slots lottery gambling viagra cialis pharmacy pills steroids payday loans replica "
    "porn adult escort dating xxx cams nude warez crack keygen torrents doorway clickbait adserver tracker popunder malware phishing"
).split()
_BLOCKED_MATES = "cheap free win best click online bonus".split()
_KEPT_WORDS = (
    "news library school garden museum weather recipes history science travel music theatre university college hospital council "
    "church football cycling nature forest river kitchen bakery bookshop gallery archive journal research teacher physics "
    "astronomy language dictionary railway harbour village market weekly review notebook"
).split()
_KEPT_MATES = "city daily open local my the north".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label (1: block): hosts in both orders of their words, under the same paths and prefixes for both labels."""
    fronts, tails = ("", "www.", "blog.", "m."), ("example.com/en/12", "example.net/de/507/", "example.com/es/81.html", "example.net/fr/3")
    rows = []
    for label, words, mates in ((1, _BLOCKED_WORDS, _BLOCKED_MATES), (0, _KEPT_WORDS, _KEPT_MATES)):
        for i, (a, b) in enumerate(itertools.product(words, mates)):
            pair = f"{a}-{b}" if i % 2 else f"{b}-{a}"
            rows.append((f"https://{fronts[i % 4]}{pair}.{tails[(i // 4) % 4]}", label))
        for i, a in enumerate(words):
            rows.append((f"http://{fronts[i % 4]}{a}.{tails[(i // 4) % 4]}", label))
    return spark.createDataFrame(rows, "url string, label int")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for a null url or one without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty as for the host."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...], part: str) -> Column:
    """The ``text`` or ``verdict`` of the longest rule that fits, else null; of equal lengths the first given wins."""
    out = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, part))).otherwise(out)
    return out


def ngram_buckets(host: Column, path: Column, sizes: tuple[int, ...] = NGRAMS, buckets: int = BUCKETS) -> Column:
    """Buckets of the distinct character n-grams of host and path, each marked with where it comes from and padded at both ends."""

    def grams(mark: str, text: Column, n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, F.lit(n))), F.lit(buckets)).cast("int"))

    padded = {"h": F.concat(F.lit("^"), host, F.lit("$")), "p": F.concat(F.lit("^"), path, F.lit("$"))}
    parts = [grams(mark, text, n) for mark, text in padded.items() for n in sizes]
    return F.array_distinct(F.concat(*parts))


@dataclass(frozen=True)
class UrlModel:
    """Weights of the buckets and the intercept."""

    weights: tuple[float, ...]
    intercept: float

    def score(self, buckets: Column) -> Column:
        """The log odds of ``block``. The weights are one constant of the plan: its size is the number of buckets."""
        table = F.from_json(F.lit("[" + ",".join(f"{w:.9g}" for w in self.weights) + "]"), "array<double>")
        return F.aggregate(buckets, F.lit(float(self.intercept)), lambda total, b: total + F.element_at(table, b + 1))


def fit(labelled: DataFrame, buckets: int = BUCKETS, regularisation: float = REGULARISATION) -> UrlModel:
    """Trains on a small table (url, label); rows with a null url or label are left out.

    At most ``MAX_LABELLED`` rows: their n-grams pass through the driver.
    """
    spark = labelled.sparkSession
    grams = labelled.filter("url is not null and label is not null").select(F.col("label").cast("int"), ngram_buckets(host_of(F.col("url")), path_of(F.col("url")), buckets=buckets))
    few = grams.limit(MAX_LABELLED + 1).collect()
    if len(few) > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows; give a bounded sample of it")
    rows = [(float(r[0]), Vectors.sparse(buckets, sorted(r[1]), [1.0] * len(r[1]))) for r in few]
    data = spark.createDataFrame(rows, ["label", "features"]).coalesce(1)
    m = LogisticRegression(regParam=regularisation, maxIter=60, standardization=False).fit(data)
    return UrlModel(tuple(float(x) for x in m.coefficients), float(m.intercept))


_MODELS: dict[str, UrlModel] = {}


def default_model(spark: SparkSession) -> UrlModel:
    """The model of ``labelled_urls``, trained once an application."""
    app = spark.sparkContext.applicationId
    if app not in _MODELS:
        _MODELS[app] = fit(labelled_urls(spark).coalesce(1))
    return _MODELS[app]


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, model: UrlModel | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per row of ``pages``, without a shuffle.

    ``rule`` is the longest rule that fits, else null; ``verdict`` is the rule's, else ``block`` from ``BLOCK_FROM`` log odds.
    A null or malformed url has an empty host and path, and the model's verdict on these. Null ids and repeated rows are kept.
    An empty table gives an empty result. Only id and url are read, so no other column can clash.
    """
    model = model or default_model(pages.sparkSession)
    url = F.col(url_col).cast("string")
    parts = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    scored = parts.withColumn("score", model.score(ngram_buckets(host, path)))
    return scored.select(
        "page_id", "host", "path", rule_of(host, path, rules, "text").alias("rule"),
        F.coalesce(rule_of(host, path, rules, "verdict"), F.when(F.col("score") >= BLOCK_FROM, "block").otherwise("allow")).alias("verdict"), "score",
    )
