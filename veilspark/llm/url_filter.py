"""URL verdicts: rules first, then a logistic regression on character n-grams.

The model is trained from the small labelled table below (or one passed in) on
hashed n-grams of host and path. Training and scoring are DataFrame work; the
learned weights, one number for each hash bucket, are a constant of the
scoring expression.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 10
GRAMS = (3, 4, 5)

# (host, path start, verdict): a rule fits its host and all subdomains.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

# Training table: what kind of site a URL stands for.
BLOCKED = """
http://casino-royal.example.net/bonus http://www.free-casino.example.com/play http://win-big.example.net/slots
https://best-bets.example.com/odds http://free-bets.example.net/tips http://sports-betting.example.com/live
http://cheap-pills.example.net/buy https://online-pharmacy.example.com/viagra http://pills-shop.example.com/cialis
http://ads-track.example.com/click https://track-ads.example.net/pixel http://adserver.example.com/banner
http://spam-farm.example.com/page https://link-farm.example.net/links http://spam-links.example.net/seo
http://porn-tube.example.com/video https://xxx-cams.example.net/live http://adult-dating.example.com/join
http://payday-loan.example.com/apply https://quick-loans.example.net/cash http://get-rich-fast.example.com/win
http://replica-watches.example.com/sale https://cheap-replica.example.net/bags http://warez-crack.example.com/keygen
https://free-download-crack.example.net/serial http://click-bait.example.com/shock https://poker-win.example.com/table
http://lottery-win.example.net/prize http://jackpot-casino.example.com/spin https://miracle-diet.example.net/pills
""".split()
ALLOWED = """
http://news.example.com/world/2021 https://www.university.example.net/research http://library.example.com/catalogue
https://blog.gardening.example.com/roses http://docs.example.net/manual https://museum.example.com/exhibits
http://weather.example.net/forecast https://recipes.example.com/soup http://city-council.example.net/minutes
https://school.example.com/lessons http://m.travel.example.net/rome https://blog.history.example.com/medieval
http://science.example.net/physics https://forum.example.com/thread/12 http://wiki.example.net/page
https://www.theatre.example.com/plays http://blog.thereading.example.net/en/25 https://m.thother.example.com/en/310
http://www.another.example.net/de/77 https://thinking.example.com/en/9.html http://blog.nation.example.com/es/500
https://health-service.example.net/vaccines http://parks.example.com/trails https://orchestra.example.net/concerts
http://m.language.example.com/grammar https://engineering.example.net/bridges http://farming.example.com/wheat
https://chess-club.example.com/openings http://bakery.example.net/bread https://www.thertion.example.com/fr/404
""".split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The part after the first :// up to /, ? or #, A-Z lower-cased; then what stands before ? or #."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null. Equally long ones: the first in the table."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    out = None
    for name, start, verdict in ordered:
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        found = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def slots(host: Column, path: Column) -> Column:
    """Hash buckets of the distinct n-grams of host and path, each with its ends marked."""
    def grams(text: Column, mark: str) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        parts = []
        for n in GRAMS:
            starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - (n - 1), F.lit(1)))
            parts.append(F.transform(starts, _piece(marked, n, mark)))
        return F.flatten(F.array(*parts))

    both = F.concat(grams(host, "h"), grams(path, "p"))
    return F.array_distinct(F.transform(both, lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")))


def _piece(text: Column, n: int, mark: str):
    return lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n)))


def train(spark: SparkSession, blocked: list[str] | None = None, allowed: list[str] | None = None) -> tuple[list[float], float]:
    """(weight of each bucket, bias)."""
    rows = [(u, 1.0) for u in (BLOCKED if blocked is None else blocked)] + [(u, 0.0) for u in (ALLOWED if allowed is None else allowed)]
    host, path = host_and_path(F.col("url"))
    made = spark.createDataFrame(rows, "url string, label double").withColumn("slots", slots(host, path))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: F.array_contains("slots", k).cast("double"))
    made = made.select("label", array_to_vector(dense).alias("features"))
    model = LogisticRegression(regParam=0.01, maxIter=100, standardization=False).fit(made)
    return model.coefficients.toArray().tolist(), float(model.intercept)


def score(host: Column, path: Column, weights: list[float], bias: float) -> Column:
    """The probability that a URL is to be blocked."""
    table = F.array(*[F.lit(w) for w in weights])
    total = F.aggregate(slots(host, path), F.lit(bias), lambda a, k: a + F.get(table, k))
    return 1 / (1 + F.exp(-total))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
          model: tuple[list[float], float] | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score.

    Null URLs and those without :// have an empty host and path and are judged
    as such. Repeated rows are judged each for itself; other columns are not looked at.
    A score of exactly the threshold blocks. URLs may be of any length; an empty table gives an empty result.
    """
    weights, bias = train(pages.sparkSession) if model is None else model
    host, path = host_and_path(F.col(url_col))
    split = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    judged = split.withColumn("found", rule_for(F.col("host"), F.col("path"), rules)).withColumn("score", score(F.col("host"), F.col("path"), weights, bias))
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return judged.select(id_col, "host", "path", F.col("found.rule").alias("rule"),
                         F.coalesce("found.verdict", by_model).alias("verdict"), "score")
