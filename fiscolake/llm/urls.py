"""URL filters: rules first, else a logistic regression on hashed character n-grams of host and path.

DataFrame and ML functions only. The host stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; the path up to ``?``, ``#`` or the end. A rule (host, path prefix, verdict) fits its host and all
subdomains of it if the path begins with its own; the longest fitting rule decides. Other urls are judged by the
regression, trained on a small labelled table of urls: block if the probability is above one half.

Rows: a null url, or one without ``://``, has an empty host and path; no rule fits it and it has no n-grams, so the
intercept decides (allow). Long urls are read whole, repeated rows judged alike, extra columns never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscolake.llm.common import given, lower_ascii

#: Rules (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))

#: A small labelled table of host names: to block, and to allow. ``labelled_urls`` gives each the same subdomains, domains
#: and paths, so that only the names tell them apart.
BLOCKED = """
casino-win casino-royal online-casino casino-slots poker-casino jackpot-casino free-bets sports-bets betting-tips bet-now
free-spins free-slots cheap-pills diet-pills pills-online cheap-viagra cheap-pharmacy adult-x adult-cams adult-videos
xxx-videos xxx-adult free-porn hot-singles sex-chat spam-farm spam-links link-farm click-farm payday-loans fast-loans
quick-cash lottery-win jackpot-win win-prizes free-prizes torrent-warez warez-crack crack-keygen replica-watches
cheap-replica get-rich free-money crypto-win pills-cheap casino-bets
""".split()
ALLOWED = """
news daily-news garden-blog weather museum library university cooking travel science history docs forum book-shop school
city-council health sports music chess-club railway cinema open-data wiki hiking-trails farm-life theatre garden theory
earth north-river old-town winter-light green-field thonan erther inthe ontion haened andre ththat therst tionble ththly
history-books city-news open-library river-trails school-music old-maps free-library art-prints home-cooking nderen tionsh thering ththwh ththes therre ththon thersh ththti erandes inghat ontheth reandon thanhe edoner
""".split()


def labelled_urls(names: Sequence[str]) -> list[str]:
    """Urls of host names, with subdomains, domains and paths in turn."""
    before, domains, paths = ("", "www.", "m.", "blog."), ("org", "net", "com"), ("en", "de", "es", "fr")
    after = ("/17", "/204/", "/3.html", "/88?page=2", "/6#top", "")
    return [f"http://{before[(i + k) % 4]}{name}.example.{domains[(i + k) % 3]}/{paths[(i // 2 + k) % 4]}{after[(i + k) % 6]}"
            for i, name in enumerate(names) for k in range(4)]


FEATURES = 1 << 13
SIZES = (3, 4, 5)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. Rules of one length: the first in their order."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for of_host, of_path, verdict in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == of_host) | host.endswith(f".{of_host}")) & path.startswith(of_path)
        found = F.when(fits, F.struct(F.lit(of_host + of_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def ngrams(host: Column, path: Column) -> Column:
    """Character n-grams of the host and, marked apart, of the path; digits count as one character."""
    def runs(text: Column, mark: str) -> Column:
        shown = F.concat(F.lit(mark), F.regexp_replace(text, "[0-9]+", "0"), F.lit("$"))
        each = [F.when(F.length(shown) >= n, F.transform(F.sequence(F.lit(1), F.length(shown) - n + 1),
                                                         lambda i, n=n: F.substring(shown, i, F.lit(n)))) for n in SIZES]
        return F.concat(*[F.coalesce(e, F.array().cast("array<string>")) for e in each])

    return F.when((host == "") & (path == ""), F.array().cast("array<string>")).otherwise(
        F.concat(runs(host, "^"), runs(lower_ascii(path), "^^")))


def with_parts(frame: DataFrame, url: str = "url") -> DataFrame:
    return frame.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})


def hashed(frame: DataFrame) -> DataFrame:
    grams = frame.withColumn("grams", ngrams(F.col("host"), F.col("path")))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(grams)


def train(spark: SparkSession, blocked: Sequence[str] | None = None,
          allowed: Sequence[str] | None = None) -> LogisticRegressionModel:
    blocked = labelled_urls(BLOCKED) if blocked is None else blocked
    allowed = labelled_urls(ALLOWED) if allowed is None else allowed
    rows = [(u, 1.0) for u in blocked] + [(u, 0.0) for u in allowed]
    table = hashed(with_parts(spark.createDataFrame(rows, "url string, label double").coalesce(1)))
    return LogisticRegression(regParam=0.001, maxIter=50, standardization=False).fit(table)


def judged(pages: DataFrame, model: LogisticRegressionModel, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, and the method's probability."""
    parts = with_parts(pages.select("page_id", "url"))
    found = model.transform(hashed(parts)).withColumn("p", vector_to_array("probability")[1])
    found = found.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    return found.select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
                        F.coalesce("fit.verdict", F.when(F.col("p") > 0.5, "block").otherwise("allow")).alias("verdict"),
                        F.col("p").alias("score"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(given(spark, sf_dir, "pages"), train(spark))
